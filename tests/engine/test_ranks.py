"""Ranks and running sums against plain windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tonewright.operators import ranks, sampling


def test_ranks_match_plain_windows(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 50 != 0, F.col("id") % 3).alias("g"), F.when(F.col("id") != 7, F.md5(F.col("id").cast("string"))).alias("k"), (F.col("id") % 11).alias("v"), F.lit(1).alias("_part_of"))
    w = Window.partitionBy("g").orderBy("k")
    want = rows.withColumns({"r": F.row_number().over(w), "s": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), "t": F.sum("v").over(Window.partitionBy("g"))})
    got = ranks.running(rows, ("k",), {"r": F.lit(1), "s": F.col("v")}, ("g",))
    assert sorted(map(str, got.select("g", "k", "v", "r", "s", "s_total").toArrow().to_pylist())) == sorted(map(str, want.withColumnRenamed("t", "s_total").select("g", "k", "v", "r", "s", "s_total").toArrow().to_pylist()))


def test_two_column_order_and_empty_tables(spark):
    rows = spark.range(400).select(F.lit("hot").alias("a"), (399 - F.col("id")).alias("b"))
    got = ranks.ranked(rows, ("a", "b"))
    assert got.where("rn <> b + 1 or rn_total <> 400").count() == 0 and got.count() == 400
    assert ranks.ranked(rows.where("b < 0"), ("a", "b"), ("a",)).count() == 0


def test_many_ranges_by_a_table_of_cuts(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 4)
    rows = spark.range(4000).select(F.when(F.col("id") % 9 != 0, F.col("id") % 500).alias("a"), F.md5(F.col("id").cast("string")).alias("b"), (F.col("id") % 2).alias("g"))
    w = Window.partitionBy("g").orderBy("a", "b")
    want = rows.withColumn("rn", F.row_number().over(w).cast("long")).withColumn("rn_total", F.lit(2000).cast("long"))
    got = ranks.running(rows, ("a", "b"), {"rn": F.lit(1).cast("long")}, ("g",), 15, 900)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    cuts = ranks._cut_points(rows, ("a", "b"), 15, 900)
    assert len(cuts) > 4 and ranks._placed(rows, ("a", "b"), cuts).select("_part").distinct().count() == len(cuts) + 1


def test_hot_groups_are_cut_up(spark):
    rows = spark.range(100_000).select(F.lit("all").alias("g"), F.col("id").alias("k"))
    cuts = ranks._cut_points(rows, ("k",), 16, 4096)
    sizes = [b[0] - a[0] for a, b in zip([(0,), *cuts], [*cuts, (100_000,)], strict=True)]
    assert len(cuts) == 15 and max(sizes) < 10_000


def test_a_class_of_one_row_is_copied_in_runs(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RUN", 4)
    rows = spark.range(11).select("id", (F.col("id") == 10).cast("int").alias("y"))
    out = sampling.upsample_cyclic(rows, "id")
    assert sorted(r.copy for r in out.where("y = 1").collect()) == list(range(10)) and out.where("y = 0").count() == 10
