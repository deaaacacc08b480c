"""A search over settings and folds of a small dense network, all of them trained at once.

Every step is one pass over the rows: each task adds up the gradients of all settings and folds over its rows, a row teaching every fold
but its own; the sums are added up in a tree, and the driver, which holds nothing but the networks, takes the step.  Then one
more pass counts each fold's own rows by gold and predicted class.  The setting with the best mean score wins, the last of ties.

Steps see all rows, so results depend neither on their order nor on their partitions (but for rounding).  Dropout draws a row's units from
the row's own number and the step.  Rows without a fold teach all folds and judge none.  Rows with a null class or null features are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ridge import values

#: Tasks whose sums are added up in one.
TOGETHER = 64


@dataclass(frozen=True)
class Setting:
    """A network and how it is trained."""

    hidden: int = 32
    second: int = 16
    init: str = "uniform"
    drop: float = 0.5
    rate: float = 0.01
    steps: int = 30
    seed: int = 7


def started(s: Setting, inputs: int, classes: int, folds: int) -> list[np.ndarray]:
    """Weights and offsets of three layers, the same for every fold."""
    r, out = np.random.default_rng(s.seed), []
    for a, b in ((inputs, s.hidden), (s.hidden, s.second), (s.second, classes)):
        w = r.uniform(-0.05, 0.05, (a, b)) if s.init == "uniform" else r.normal(0, 0.05, (a, b))
        out += [np.repeat(w[None], folds, 0), np.zeros((folds, b))]
    return out


def kept_units(ids: np.ndarray, step: int, s: Setting) -> np.ndarray:
    """Units of the first layer that a row keeps in a step, scaled: drawn from a hash of row, unit and step."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(s.hidden, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(step + 1) * np.uint64(0x94D049BB133111EB)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(11)) * 2.0**-53 >= s.drop


def forward(x: np.ndarray, net: list[np.ndarray], keep: np.ndarray | None, drop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hidden layers and the classes' probabilities: (folds, rows, units)."""
    a = np.maximum(x @ net[0] + net[1][:, None], 0)
    if keep is not None and drop:
        a = a * keep / (1 - drop)
    b = np.maximum(a @ net[2] + net[3][:, None], 0)
    z = b @ net[4] + net[5][:, None]
    z = np.exp(z - z.max(axis=2, keepdims=True))
    return a, b, z / z.sum(axis=2, keepdims=True)


def gradients(x: np.ndarray, y: np.ndarray, fold: np.ndarray, ids: np.ndarray, net: list[np.ndarray], s: Setting, step: int) -> list[np.ndarray]:
    """Summed over the rows that teach each fold, and last their number."""
    keep = kept_units(ids, step, s) if s.drop else None
    a, b, p = forward(x, net, keep, s.drop)
    teach = (fold[None] != np.arange(len(net[0]))[:, None]).astype(float)
    back = p.copy()
    back[:, np.arange(len(y)), y] -= 1
    back *= teach[:, :, None]
    gb = (back @ net[4].transpose(0, 2, 1)) * (b > 0)
    ga = gb @ net[2].transpose(0, 2, 1)
    ga = ga * (a > 0) / (1 - s.drop if s.drop else 1)  # a dropped unit is 0
    flip = lambda m: m.transpose(0, 2, 1)
    return [x.T @ ga, ga.sum(axis=1), flip(a) @ gb, gb.sum(axis=1), flip(b) @ back, back.sum(axis=1), teach.sum(axis=1)]


def stepped(net: list[np.ndarray], memory: list[np.ndarray], sums: list[np.ndarray], s: Setting) -> None:
    """A step against the mean gradient, scaled by a running mean of its squares, in place."""
    for w, m, g in zip(net, memory, sums[:-1], strict=True):
        g = g / np.maximum(sums[-1], 1).reshape(-1, *[1] * (w.ndim - 1))
        m *= 0.9
        m += 0.1 * g * g
        w -= s.rate * g / (np.sqrt(m) + 1e-7)


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = b.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold", "id"))


def _sums(rows: DataFrame, nets: list[list[np.ndarray]], settings: list[Setting], step: int) -> dict[int, list[np.ndarray]]:
    """The gradients of all settings that still learn, over all rows."""
    at = [k for k, s in enumerate(settings) if step < s.steps]
    shipped = rows.sparkSession.sparkContext.broadcast((nets, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets, settings = shipped.value
        total: dict[int, list[np.ndarray]] = {}
        for b in batches:
            if b.num_rows:
                given = _arrays(b)
                for k in at:
                    new = gradients(*given, nets[k], settings[k], step)
                    total[k] = [x + y for x, y in zip(total[k], new, strict=True)] if k in total else new
        flat = [np.concatenate([g.ravel() for g in total[k]]).tobytes() for k in total]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(total), pa.int32()), pa.array(flat, pa.binary())], names=["k", "task", "g"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(g, np.float64) for g in table.column("g").to_pylist())
        return pa.table({"k": table.column("k")[:1], "task": table.column("task")[:1], "g": pa.array([total.tobytes()], pa.binary())})

    shape = "k int, task int, g binary"
    found = rows.mapInArrow(run, shape)
    tasks = rows.rdd.getNumPartitions()
    while tasks > TOGETHER:
        found = found.groupBy("k", F.floor(F.col("task") / TOGETHER).cast("int").alias("part")).applyInArrow(add, shape).withColumn("task", F.floor(F.col("task") / TOGETHER).cast("int"))
        tasks = -(-tasks // TOGETHER)
    out = {}
    for r in found.groupBy("k").applyInArrow(add, shape).collect():
        flat, parts, n = np.frombuffer(bytes(r["g"]), np.float64), [], 0
        for w in nets[r["k"]]:
            parts.append(flat[n : n + w.size].reshape(w.shape))
            n += w.size
        out[r["k"]] = [*parts, flat[n:]]
    shipped.destroy()
    return out


def prepared(rows: DataFrame, x: str, y: str, fold: str, key: str) -> DataFrame:
    """(x, y, fold, id): what learns and judges; no fold is -1."""
    given = rows.select(values(rows, x).alias("x"), F.col(y).cast("int").alias("y"), F.coalesce(F.col(fold).cast("int"), F.lit(-1)).alias("fold"), F.xxhash64(key).alias("id"))
    return given.where(F.col("y").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))


def trained(rows: DataFrame, settings: list[Setting], inputs: int, classes: int, folds: int) -> list[list[np.ndarray]]:
    """The networks of every setting, one a fold, from `prepared` rows that the caller keeps."""
    nets = [started(s, inputs, classes, folds) for s in settings]
    memory = [[np.zeros_like(w) for w in net] for net in nets]
    for step in range(max(s.steps for s in settings)):
        for k, sums in _sums(rows, nets, settings, step).items():
            stepped(nets[k], memory[k], sums, settings[k])
    return nets


def judged(rows: DataFrame, nets: list[list[np.ndarray]]) -> DataFrame:
    """(setting, fold, y, p, n): each fold's own rows by gold and predicted class, the first of equal probabilities."""
    shipped = rows.sparkSession.sparkContext.broadcast(nets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, fold, _ = _arrays(b) if b.num_rows else (np.zeros((0, 1)), *[np.zeros(0, int)] * 3)
            own = np.flatnonzero(fold >= 0)
            found = []
            for k, net in enumerate(shipped.value):
                if len(own):
                    p = forward(x[own], net, None, 0)[2].argmax(axis=2)[fold[own], np.arange(len(own))]
                    cells, n = np.unique(np.stack([np.full(len(own), k), fold[own], y[own], p]), axis=1, return_counts=True)
                    found += [(*c, m) for c, m in zip(cells.T.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int32() if i < 4 else pa.int64()) for i in range(5)], names=["setting", "fold", "y", "p", "n"])

    found = rows.mapInArrow(run, "setting int, fold int, y int, p int, n long")
    return found.groupBy("setting", "fold", "y", "p").agg(F.sum("n").alias("n"))


def scores(counts: DataFrame, folds: int) -> DataFrame:
    """(setting, f1, best): the mean over folds of F1 of having any class but 0; a fold without hits counts 0."""
    of = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("n"))), F.lit(0))
    each = counts.groupBy("setting", "fold").agg(of("y <> 0 and p <> 0").alias("tp"), (of("y <> 0") + of("p <> 0")).alias("all"))
    mean = each.groupBy("setting").agg(F.round(F.sum(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("all")), F.lit(0.0))) / folds, 6).alias("f1"))
    top = mean.agg(F.max_by("setting", F.struct("f1", "setting")).alias("top"))
    return mean.crossJoin(F.broadcast(top)).select("setting", "f1", (F.col("setting") == F.col("top")).cast("int").alias("best"))  # one row


def search(rows: DataFrame, settings: list[Setting], x: str = "x", y: str = "y", fold: str = "fold", key: str = "doc_id", classes: int = 3, folds: int = 10) -> DataFrame:
    """(setting, f1, best, and the setting's fields): the mean score of every setting over its folds."""
    given = prepared(rows, x, y, fold, key).persist()
    try:
        one = given.select("x").first()
        shape = "setting int, " + ", ".join(f"{n} {'string' if n == 'init' else 'double' if n in ('drop', 'rate') else 'int'}" for n in asdict(settings[0]))
        listed = rows.sparkSession.createDataFrame([(k, *asdict(s).values()) for k, s in enumerate(settings)], shape)
        if one is None:
            return listed.withColumn("f1", F.lit(0.0)).withColumn("best", F.lit(0))
        found = scores(judged(given, trained(given, settings, len(one["x"]), classes, folds)), folds).collect()  # a row a setting
    finally:
        given.unpersist()
    return listed.join(rows.sparkSession.createDataFrame([tuple(r) for r in found], "setting int, f1 double, best int"), "setting", "left")
