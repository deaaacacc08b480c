"""Ridge regression from sums.

One pass adds up the products of all columns; every strength is solved from that small matrix.  A second pass adds up, for all
strengths at once, the squared errors of each row judged by the fit without it, which the hat matrix gives without fitting again:
the strength with the least error is taken, the first of ties.  A row may have a weight, for instance its number of copies after
resampling; it is then left out with all its copies, so none of them tells its answer.

Rows with a null among x, y or weight, and those of no weight, are left out; with no rows every coefficient is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The strengths that are tried.
ALPHAS = (0.01, 0.1, 1.0, 10.0)


def values(rows: DataFrame, x: str) -> Column:
    """A column of numbers, whether it is an array or a vector of Spark ML."""
    return vector_to_array(x) if isinstance(rows.schema[x].dataType, VectorUDT) else F.col(x).cast("array<double>")


def _cells(rows: DataFrame, x: str, y: str, weight: str | None) -> DataFrame:
    """(x, y, w) of the rows that count."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    given = rows.select(values(rows, x).alias("x"), F.col(y).cast("double").alias("y"), w.alias("w"))
    return given.where(F.col("y").isNotNull() & (F.col("w") > 0) & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = b.column("x")
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(x), -1) if len(x) else np.zeros((0, 0)), b.column("y").to_numpy(zero_copy_only=False), b.column("w").to_numpy(zero_copy_only=False)


def products(rows: DataFrame, x: str = "x", y: str = "y", weight: str | None = None) -> DataFrame:
    """(i, j, s), i <= j: weighted sums of the products of columns; 0 is the constant 1, then come those of x, and y is last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            if b.num_rows:
                xs, ys, ws = _arrays(b)
                z = np.concatenate([np.ones((len(ys), 1)), xs, ys[:, None]], axis=1)
                total = total + (z * ws[:, None]).T @ z
        if not np.isscalar(total):
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    found = _cells(rows, x, y, weight).mapInArrow(run, "i int, j int, s double")
    return found.groupBy("i", "j").agg(F.sum("s").alias("s"))


@dataclass
class Ridge:
    """A fit: coefficients, the strength taken, and the mean squared error without each row for every strength."""

    weights: np.ndarray
    intercept: float
    alpha: float
    errors: dict[float, float]

    def predicted(self, x: Column) -> Column:
        """The value of an array column."""
        if not len(self.weights):
            return F.lit(float(self.intercept))
        terms = F.zip_with(x, F.array(*map(F.lit, self.weights.tolist())), lambda a, b: a * b)
        return F.aggregate(terms, F.lit(float(self.intercept)), lambda s, t: s + t)

    def transform(self, rows: DataFrame, x: str = "x") -> DataFrame:
        """`rows` with `prediction`."""
        return rows.withColumn("prediction", self.predicted(values(rows, x)))


@dataclass
class Solved:
    """What the sums say: centre, axes of the columns' spread and what each explains of y."""

    total: float
    mean: np.ndarray
    level: float
    axes: np.ndarray
    spread: np.ndarray
    told: np.ndarray

    def weights(self, alpha: float) -> np.ndarray:
        wide = self.spread + alpha
        return self.axes @ np.divide(self.told, wide, out=np.zeros_like(wide), where=wide > 0)


def solved(sums: dict[tuple[int, int], float]) -> Solved:
    """From the collected `products`: (columns + 2) ** 2 / 2 numbers."""
    size = max(j for _, j in sums) + 1
    s = np.zeros((size, size))
    for (i, j), v in sums.items():
        s[i, j] = s[j, i] = v
    mean, level = s[0, 1:-1] / s[0, 0], s[0, -1] / s[0, 0]
    spread, axes = np.linalg.eigh(s[1:-1, 1:-1] - s[0, 0] * np.outer(mean, mean))
    return Solved(s[0, 0], mean, level, axes, spread.clip(0), axes.T @ (s[1:-1, -1] - s[0, 0] * mean * level))


def left_out(rows: DataFrame, fit: Solved, alphas: tuple[float, ...], x: str = "x", y: str = "y", weight: str | None = None) -> list[float]:
    """Weighted mean squared error of every row by the fit without it, for each strength."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(alphas))
        for b in batches:
            if b.num_rows:
                xs, ys, ws = _arrays(b)
                along = (xs - fit.mean) @ fit.axes
                for k, a in enumerate(alphas):
                    wide = fit.spread + a
                    part = np.divide(along, wide, out=np.zeros_like(along), where=wide > 0)
                    hat = ws * (1 / fit.total + (along * part).sum(axis=1))
                    error = (ys - fit.level - part @ fit.told) / np.maximum(1 - hat, 1e-12)
                    total[k] += (ws * error * error).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(alphas)), pa.int32()), pa.array(total)], names=["k", "s"])

    found = _cells(rows, x, y, weight).mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s"))
    sums = {r["k"]: r["s"] for r in found.collect()}
    return [float(sums.get(k, 0.0) / fit.total) for k in range(len(alphas))]


def ridge(rows: DataFrame, alphas: tuple[float, ...] = ALPHAS, x: str = "x", y: str = "y", weight: str | None = None) -> Ridge:
    """The fit of the strength that predicts left-out rows best: two passes over the rows."""
    sums = {(r["i"], r["j"]): r["s"] for r in products(rows, x, y, weight).collect()}
    if not sums:
        return Ridge(np.zeros(0), 0.0, alphas[0], dict.fromkeys(alphas, 0.0))
    fit = solved(sums)
    errors = left_out(rows, fit, alphas, x, y, weight)
    alpha = alphas[int(np.argmin(errors))]
    w = fit.weights(alpha)
    return Ridge(w, float(fit.level - w @ fit.mean), alpha, dict(zip(alphas, errors, strict=True)))
