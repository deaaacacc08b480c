"""Running sums and ranks within groups of any size: no group has to pass through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType


#: Ranges of an order: some `ROWS` rows each, at most `FEW` times `FEW`, but up to `FEW` of them (their cuts stand in the plan) from `SMALL` rows each on.
ROWS, FEW, EACH, SMALL = 4_000_000, 128, 64, 5_000


def _cut_points(rows: DataFrame, order: tuple[str, ...], parts: int | None, sample: int | None) -> list:
    """At most parts - 1 ascending keys, quantiles of some `sample` rows drawn at random; results don't depend on which."""
    total = rows.count()
    parts = parts or max(min(FEW, total // SMALL + 1), min(FEW * FEW, total // ROWS))
    if parts == 1:
        return []
    sample = sample or min(EACH * parts, 1 << 18)
    drawn = rows.select(*order).sample(min(1.0, sample / max(1, total)), 7)
    keys = [tuple(r) for r in drawn.orderBy(*order).collect()]
    found = [keys[i * len(keys) // parts] for i in range(1, parts)] if keys else []
    return list(dict.fromkeys(found))


def _placed(rows: DataFrame, order: tuple[str, ...], cuts: list) -> DataFrame:
    """Add `_part`, the number of cuts that are no greater than a row's key.

    Every `step`-th cut stands in the plan; the cuts between two of these are a row of a broadcast table of at most `FEW` rows.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    key = F.struct(*order)
    step = -(-(len(cuts) + 1) // FEW)
    outer = [F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, k, strict=True))) for k in cuts[step - 1 :: step]]

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < outer[mid], place(low, mid)).otherwise(place(mid + 1, high))

    if step == 1:
        return rows.withColumn("_part", place(0, len(outer)))
    inner = StructType([StructField("_at", IntegerType()), StructField("_cuts", ArrayType(StructType([StructField(c, kinds[c]) for c in order])))])
    table = rows.sparkSession.createDataFrame([(j, cuts[j * step : (j + 1) * step - 1]) for j in range(len(outer) + 1)], inner)
    found = rows.withColumn("_at", place(0, len(outer))).join(F.broadcast(table), "_at")
    return found.withColumn("_part", F.col("_at") * step + F.size(F.filter("_cuts", lambda x: x <= key))).drop("_at", "_cuts")


def running(rows: DataFrame, order: tuple[str, ...], add: dict[str, Column], by: tuple[str, ...] = (), parts: int | None = None, sample: int | None = None) -> DataFrame:
    """Add, for each name of `add`, its running sum in ascending `order` (nulls first), and `<name>_total` over the group.

    The keys are cut into `parts` ranges at sampled quantiles (by default in proportion to the rows); each range of a
    group is summed on its own and starts from the sums of the ranges before it, of which there is a row a group and
    range.  Rows with equal keys share a range, in any order: add columns to `order` where many may be equal.
    Null groups are groups; an empty table gives an empty one.
    """
    placed = _placed(rows, order, _cut_points(rows, order, parts, sample)).withColumns({f"_{n}": c for n, c in add.items()})
    sums = placed.groupBy(*by, "_part").agg(*(F.sum(f"_{n}").alias(f"_{n}_part") for n in add))
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(
        *(F.col(c).alias(f"_by_{c}") for c in by),
        F.col("_part").alias("_at"),
        *(F.coalesce(F.sum(f"_{n}_part").over(before), F.lit(0)).alias(f"_{n}_before") for n in add),
        *(F.sum(f"_{n}_part").over(group).alias(f"{n}_total") for n in add),
    )
    same = F.col("_part") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    upto = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sides = placed.join(heads, same)
    return sides.select(*rows.columns, *(c for n in add for c in ((F.col(f"_{n}_before") + F.sum(f"_{n}").over(upto)).alias(n), F.col(f"{n}_total"))))


def ranked(rows: DataFrame, order: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Add `rn`, the rank from 1 of each row of its group in `order`, and `rn_total`, the rows of the group."""
    return running(rows, order, {"rn": F.lit(1).cast("long")}, by)
