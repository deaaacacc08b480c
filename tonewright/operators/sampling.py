"""Splits, folds and resampling, deterministic by natural keys; the random ones take a seed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked

#: Copies of a row that are made at a time, which are also the rows of a bucket to draw from, and buckets at most.
RUN, BUCKETS = 10_000, 16_384


def ordered_split(files: DataFrame, share: dict[str, float], order: str, by: str = "genre") -> DataFrame:
    """Add `split`: in each group the first floor(n * share) rows train, the rest test."""
    limit = F.lit(0.0)
    for k, p in share.items():
        limit = F.when(F.col(by) == k, p).otherwise(limit)
    split = F.when(F.col("rn") <= F.floor(F.col("rn_total") * limit), "train").otherwise("test")
    return ranked(files, (order,), (by,)).select(*files.columns, split.alias("split"))


def tail(rows: DataFrame, order: str, by: str, of: int = 10) -> DataFrame:
    """Add `valid`: 1 for the last floor(n / of) rows of each group."""
    held = (F.col("rn") > F.col("rn_total") - F.floor(F.col("rn_total") / of)).cast("int")
    return ranked(rows, (order,), (by,)).select(*rows.columns, held.alias("valid"))


def folds(rows: DataFrame, order: str, k: int, by: str) -> DataFrame:
    """Add `fold`: contiguous blocks of floor(n / k) rows of each group; the remainder is in no fold (null)."""
    size = F.floor(F.col("rn_total") / k)
    fold = F.floor((F.col("rn") - 1) / size)
    return ranked(rows, (order,), (by,)).select(*rows.columns, F.when(fold < k, fold).cast("int").alias("fold"))


def upsample_targets(counts: DataFrame, label: str = "y") -> DataFrame:
    """Rows of each class after up-sampling: none as is, neg as many, pos in proportion."""
    n = lambda k: F.coalesce(F.sum(F.when(F.col(label) == k, F.col("n"))), F.lit(0))
    t = counts.agg(n(0).alias("n0"), n(1).alias("n1"), n(2).alias("n2"))
    pos = F.coalesce(F.floor(F.try_divide(F.col("n0") * F.col("n2"), F.col("n1"))), F.lit(0))
    return t.select(F.col("n0").cast("long").alias("none_target"), F.col("n0").cast("long").alias("neg_target"), pos.cast("long").alias("pos_target"))


def upsample_cyclic(rows: DataFrame, order: str, label: str = "y") -> DataFrame:
    """Every class brought up to the largest by repeating its rows in turn; `copy` numbers the repeats."""
    top = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("top"))
    counted = ranked(rows, (order,), (label,)).crossJoin(F.broadcast(top))  # one row
    last = F.floor((F.col("top") - F.col("rn")) / F.col("rn_total"))
    # Copies come in runs, so that a class of one row needs no array of all its copies.
    runs = counted.select(*rows.columns, last.alias("_last"), F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(RUN).cast("long"))).alias("_from"))
    return runs.select(*rows.columns, F.explode(F.sequence("_from", F.least("_last", F.col("_from") + RUN - 1))).alias("copy"))


def cap(rows: DataFrame, k: int, order: str, by: str) -> DataFrame:
    """The first k rows of each class."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_rn") <= k).drop("_rn")


def drawn(rows: DataFrame, targets: dict[int, int], key: tuple[str, ...], label: str = "y", seed: int = 7) -> DataFrame:
    """`rows` drawn with replacement, exactly `targets[k]` of each class k; `copy` numbers a row's draws from 0.

    The rows of a class lie in buckets by a hash of their key.  The driver, which knows only the buckets' sizes (`BUCKETS` at most), gives
    each its share of the draws by one multinomial draw; every draw then takes a place within its bucket.  So draws are as independent
    and uniform as one by one, no class passes through one task, and partitions don't matter.  Rows of equal keys are told apart by
    their other columns; a class without rows stays so; classes without a target are left out.
    """
    wanted = {k: n for k, n in targets.items() if n > 0}
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect() if r[label] in wanted}  # a row a class
    if not sizes:
        return rows.where("false").withColumn("copy", F.lit(0).cast("long"))
    of = F.lit(1)
    for k, n in sizes.items():
        of = F.when(F.col(label) == k, max(1, min(BUCKETS // len(sizes), n // RUN))).otherwise(of)
    there = rows.where(F.col(label).isin(list(sizes))).withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), *key), of).cast("int"))
    counts = there.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("n")).orderBy(label, "_bucket").collect()
    times = []
    for k in sizes:
        mine = [(r["_bucket"], r["n"]) for r in counts if r[label] == k]
        shares = np.random.default_rng([seed, k]).multinomial(wanted[k], np.array([n for _, n in mine]) / sizes[k])
        times += [(k, b, n, int(t)) for (b, n), t in zip(mine, shares, strict=True) if t]
    spread = rows.sparkSession.createDataFrame(times, f"_class {rows.schema[label].dataType.simpleString()}, _bucket int, _size long, _times long")
    runs = spread.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1, F.lit(RUN).cast("long"))).alias("_from"))
    each = runs.select("_class", "_bucket", "_size", F.explode(F.sequence("_from", F.least("_times", F.col("_from") + RUN) - 1)).alias("_draw"))
    place = F.pmod(F.xxhash64(F.lit(seed), "_class", "_bucket", "_draw"), F.col("_size")) + 1
    hits = each.select("_class", "_bucket", place.alias("_place")).groupBy("_class", "_bucket", "_place").agg(F.count(F.lit(1)).alias("_hits"))
    order = Window.partitionBy(label, "_bucket").orderBy(F.xxhash64(F.lit(seed + 1), *key), *(F.col(f"`{c}`") for c in rows.columns))
    numbered = there.withColumn("_place", F.row_number().over(order).cast("long")).withColumnRenamed("_bucket", "_mine")
    met = numbered.join(hits.withColumnRenamed("_place", "_at"), (F.col(label) == F.col("_class")) & (F.col("_mine") == F.col("_bucket")) & (F.col("_place") == F.col("_at")))
    some = met.select(*rows.columns, "_hits", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_hits") - 1, F.lit(RUN).cast("long"))).alias("_from"))
    return some.select(*rows.columns, F.explode(F.sequence("_from", F.least("_hits", F.col("_from") + RUN) - 1)).alias("copy"))


def _others(rows: DataFrame, label: str) -> tuple[str, ...]:
    """What tells rows apart where no key is given: all columns but the label."""
    return tuple(c for c in rows.columns if c != label)


def resampled(rows: DataFrame, fractions: dict[int, float], label: str = "y", seed: int = 7, key: tuple[str, ...] | None = None) -> DataFrame:
    """Each class drawn with replacement to its own multiple of its rows, rounded down (above 1 repeats rows)."""
    n = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    return drawn(rows, {k: int(n[k] * f) for k, f in fractions.items() if n.get(k)}, key or _others(rows, label), label, seed).drop("copy")


def default_targets(counts: DataFrame, label: str = "y") -> DataFrame:
    """Rows that each class is drawn to by default: of three classes as many as there are of class 1; of two, half of all."""
    n = lambda k: F.coalesce(F.sum(F.when(F.col(label) == k, F.col("n"))), F.lit(0)).cast("long")
    sums = counts.agg(n(0).alias("n0"), n(1).alias("n1"), n(2).alias("n2"))
    three = F.array(*(F.struct(F.lit(3).alias("classes"), F.lit(k).alias("y"), F.col("n1").alias("target")) for k in range(3)))
    half = F.floor((F.col("n0") + F.col("n1")) / 2)
    two = F.array(*(F.struct(F.lit(2).alias("classes"), F.lit(k).alias("y"), half.alias("target")) for k in range(2)))
    return sums.select(F.explode(F.concat(three, two)).alias("t")).select("t.*")


def resampled_by_default(rows: DataFrame, classes: int = 3, label: str = "y", seed: int = 7, key: tuple[str, ...] | None = None) -> DataFrame:
    """Each class drawn with replacement to its default target exactly; a class without rows stays so."""
    n = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect() if r[label] is not None}  # a row a class
    target = n.get(1, 0) if classes == 3 else (n.get(0, 0) + n.get(1, 0)) // 2
    return drawn(rows, dict.fromkeys(range(classes), target), key or _others(rows, label), label, seed).drop("copy")


def bucket(key: Column, of: int) -> Column:
    """A stable bucket of a key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(of)).cast("int")
