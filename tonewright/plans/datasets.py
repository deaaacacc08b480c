"""Data sets for document vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets
from .registry import query
from .scans import GOLD, gold

CLEAN = r"list_filter(regexp_split_to_array(regexp_replace(replace(replace(lower(text), chr(10), ''), '<br />', ' '), '([.\",()!?;:&_-])', ' \1 ', 'g'), ' +'), lambda x: x <> '')".replace('\\"', '"')


@query(rf"""WITH {GOLD}, own AS (SELECT '' AS prefix, d.doc_id::VARCHAR AS key, text, CASE y WHEN 2 THEN 1 WHEN 1 THEN 0 END AS y FROM documents d JOIN gold g ON g.doc_id = d.doc_id WHERE y IN (1, 2)),
ext AS (SELECT 'EXTERNAL_', conv_id || '-' || turn, text, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 END FROM conversations),
every AS (SELECT *, prefix || CASE WHEN y IS NULL THEN 'UNSUP' WHEN ('0x' || md5(key)[1:8])::BIGINT % 5 = 0 THEN 'TEST' ELSE 'TRAIN' END AS part FROM (SELECT * FROM own UNION ALL SELECT * FROM ext))
SELECT part || '_' || (row_number() OVER (PARTITION BY part ORDER BY 1 - coalesce(y, 0), length(key), key, text) - 1) AS tag, y, len({CLEAN})::INT AS words, md5(array_to_string({CLEAN}, ' ')) AS digest FROM every""")
def labelled_datasets(t):
    """The documents with an opinion, and the turns of conversations as an external corpus, split and tagged."""
    opinion = F.when(F.col("y") == 2, 1).when(F.col("y") == 1, 0)
    own = datasets.tagged(gold(t).where("y in (1, 2)").join(t.documents.select("doc_id", "text"), "doc_id"), "doc_id", "text", opinion)
    turns = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", "role")
    external = datasets.tagged(turns, "id", "text", F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 0), "EXTERNAL_", unsupervised=True)
    return datasets.with_external(own, external).select("tag", "y", F.size("words").alias("words"), F.md5(F.array_join("words", " ")).alias("digest"))
