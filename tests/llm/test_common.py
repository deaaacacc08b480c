from pyspark.sql import functions as F

from tonewright.llm import common


def test_hot_keys_are_looked_up_by_broadcast(spark, monkeypatch):
    """The same rows whichever keys are hot; null and unknown keys stay in a left join."""
    rows = spark.range(600).select(F.when(F.col("id") % 10 != 0, F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50)).alias("k"), "id")
    table = rows.where("k <> 7").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(table, ["k"], how).collect()))
        for bar in (0, 12, 100, 10_000):
            assert sorted(map(str, common.looked_up(rows, table, ("k",), "n", bar, how).collect())) == want


def test_parts_of_large_groups(spark, monkeypatch):
    """Every two rows of a group meet in some part, and parts are bounded, with more large groups than are broadcast too."""
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    rows = spark.range(400).select(F.when(F.col("id") < 200, -1).otherwise(F.col("id") % 9).alias("g"), "id")
    parts = {}
    for r in common.triangles(rows, ("g",), F.count(F.lit(1)), 16, F.col("id")).collect():
        parts.setdefault(r.part_of, []).append((r.g, r.id))
    met = {(x, y) for p in parts.values() for x in p for y in p}
    every = [(r.g, r.id) for r in rows.collect()]
    assert all((x, y) in met for x in every for y in every if x[0] == y[0])
    assert max(map(len, parts.values())) < 100
