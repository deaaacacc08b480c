"""Splits, folds, resampling, ordinals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranks, sampling
from .registry import query
from .scans import GOLD, gold

#: Both engines have md5, so the checked split uses its first digits.
MD5_BUCKET = "(('0x' || substr(md5({k}::VARCHAR), 1, 8))::BIGINT % {n})::INT"


@query(f"WITH {GOLD}, r AS (SELECT doc_id, genre, row_number() OVER (PARTITION BY genre ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY genre) AS n FROM gold) SELECT doc_id, genre, CASE WHEN rn <= floor(n * CASE genre WHEN 'df' THEN 0.8 ELSE 0.2 END) THEN 'train' ELSE 'test' END AS split FROM r")
def ordered_split(t):
    return sampling.ordered_split(gold(t).select("doc_id", "genre"), {"df": 0.8, "nw": 0.2}, "doc_id")


@query(f"WITH {GOLD} SELECT doc_id, genre, (row_number() OVER (PARTITION BY genre ORDER BY doc_id) > count(*) OVER (PARTITION BY genre) - count(*) OVER (PARTITION BY genre) // 10)::INT AS valid FROM gold")
def tail_split(t):
    return sampling.tail(gold(t).select("doc_id", "genre"), "doc_id", "genre")


@query(f"WITH {GOLD}, r AS (SELECT doc_id, genre, (row_number() OVER (PARTITION BY genre ORDER BY doc_id) - 1) // (count(*) OVER (PARTITION BY genre) // 3) AS f FROM gold) SELECT doc_id, genre, CASE WHEN f < 3 THEN f::INT END AS fold FROM r")
def kfold_blocks(t):
    return sampling.folds(gold(t).select("doc_id", "genre"), "doc_id", 3, "genre")


@query(f"SELECT doc_id, CASE WHEN {MD5_BUCKET.format(k='doc_id', n=5)} = 0 THEN 'test' ELSE 'train' END AS split FROM documents")
def hash_split(t):
    b = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 5
    return t.documents.select("doc_id", F.when(b == 0, "test").otherwise("train").alias("split"))


@query(f"WITH {GOLD} SELECT k AS dropped, doc_id, y FROM gold, (VALUES (0), (1), (2)) v(k) WHERE y IS NOT NULL AND y <> k")
def one_vs_one_subset(t):
    rows = gold(t).where("y is not null").select(F.explode(F.array(*map(F.lit, range(3)))).alias("dropped"), "doc_id", "y")
    return rows.where("y <> dropped")


@query(f"WITH {GOLD}, c AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 2) AS n2 FROM gold) SELECT n0 AS none_target, n0 AS neg_target, coalesce(n0 * n2 // nullif(n1, 0), 0)::BIGINT AS pos_target FROM c")
def upsample_targets(t):
    return sampling.upsample_targets(gold(t).where("y is not null").groupBy("y").agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {GOLD}, r AS (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY y) AS n FROM gold WHERE y IS NOT NULL), top AS (SELECT max(n) AS top FROM r) SELECT doc_id, y, unnest(range(0, (top - rn) // n + 1)) AS copy FROM r, top")
def upsample_cyclic(t):
    return sampling.upsample_cyclic(gold(t).where("y is not null").select("doc_id", "y"), "doc_id")


@query("SELECT conv_id, turn, role || '_' || (row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) AS label FROM conversations")
def ordinal_ids(t):
    rows = ranks.ranked(t.conversations.select("conv_id", "turn", "role"), ("conv_id", "turn"), ("role",))
    return rows.select("conv_id", "turn", F.concat_ws("_", "role", F.col("rn") - 1).alias("label"))


@query()
def random_resample(t):
    """Draws with replacement to a multiple of each class's rows, seeded: rows only, their numbers are exact."""
    rows = gold(t).where("y is not null").select("doc_id", "y")
    return sampling.resampled(rows, {0: 2.0, 1: 2.0, 2: 0.5})


@query()
def shuffled(t):
    """Rows in a seeded random order: rows only."""
    return gold(t).select("doc_id").orderBy(F.rand(7))
