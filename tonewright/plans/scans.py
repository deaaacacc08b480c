"""Scans, routing, filters and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import BELIEFS, POLARITIES, belief, decode, encode, genre, polarity
from ..operators import evaluate, sampling
from .registry import Tables, query

POL = "CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 2 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END"
BEL = "CASE WHEN quality = 1 AND toxic = 0 THEN 3 WHEN quality = 1 THEN 2 WHEN toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END"
GEN = "CASE WHEN try_cast(substr(source, 4) AS INT) % 5 = 0 THEN 'nw' ELSE 'df' END"
GOLD = f"gold AS (SELECT d.doc_id, {GEN} AS genre, {POL} AS y, {BEL} AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def metrics_sql(source: str, by: str = "") -> str:
    """Accuracy, precision, recall and F1 of 0/1 columns g and p."""
    r = lambda a, b: f"round(coalesce(({a})::DOUBLE / nullif({b}, 0), 0), 6)"
    tp, fp, fn = "count(*) FILTER (g = 1 AND p = 1)", "count(*) FILTER (g = 0 AND p = 1)", "count(*) FILTER (g = 1 AND p = 0)"
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"SELECT {head}count(*) AS n, {r('count(*) FILTER (g = p)', 'count(*)')} AS accuracy, {r(tp, f'{tp} + {fp}')} AS prec, {r(tp, f'{tp} + {fn}')} AS recall, {r(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1 FROM {source}{tail}"


def gold(t: Tables) -> DataFrame:
    """(doc_id, genre, y, b): every document with its annotation, null where there is none."""
    q, x = F.col("quality"), F.col("toxic")
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").select("doc_id", genre(F.col("source")).alias("genre"), polarity(q, x).alias("y"), belief(q, x).alias("b"))


@query(f"WITH {GOLD} SELECT doc_id, genre, y, b FROM gold")
def label_join(t):
    return gold(t)


@query(f"WITH {GOLD} " + metrics_sql("(SELECT genre, task, ((y = k) <> inv)::INT AS g, ((1 = k) <> inv)::INT AS p FROM gold, (VALUES ('none', 0, true), ('pos', 2, false), ('neg', 1, false)) v(task, k, inv) WHERE y IS NOT NULL)", "genre, task"))
def three_way_metrics(t):
    rows = gold(t).where("y is not null").withColumn("p", F.lit(1))
    return evaluate.one_against_rest(rows, "y", "p", {"none": 0, "pos": 2, "neg": 1}, ("genre",))


@query("SELECT doc_id, source, length(text)::INT AS chars, md5(text) AS digest FROM documents")
def scan_documents(t):
    return t.documents.select("doc_id", "source", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query(f"SELECT doc_id, {GEN} AS genre FROM documents")
def genre_route(t):
    return t.documents.select("doc_id", genre(F.col("source")).alias("genre"))


@query(f"SELECT doc_id, source FROM documents WHERE {GEN} = 'df'")
def genre_filter(t):
    return t.documents.where(genre(F.col("source")) == "df").select("doc_id", "source")


@query("""WITH ere AS (SELECT doc_id, 'DOC_' || lpad(doc_id::VARCHAR, 36, '0') || CASE WHEN doc_id % 3 = 0 THEN '_extra' ELSE '' END AS stem FROM labels),
src AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'DOC_' || lpad(doc_id::VARCHAR, 36, '0') || '.cmp.txt' ELSE substr('DOC_' || lpad(doc_id::VARCHAR, 36, '0'), 1, 32) || '.xml' END AS file, doc_id FROM documents)
SELECT e.stem, coalesce(a.file, b.file) AS file FROM ere e LEFT JOIN src a ON a.file = e.stem || '.cmp.txt'
LEFT JOIN (SELECT min(file) AS file FROM src GROUP BY file) b ON b.file = substr(e.stem, 1, 32) || '.xml'""")
def file_stem_join(t):
    name = F.concat(F.lit("DOC_"), F.lpad(F.col("doc_id").cast("string"), 36, "0"))
    ere = t.labels.select(F.concat(name, F.when(F.col("doc_id") % 3 == 0, "_extra").otherwise("")).alias("stem"))
    src = t.documents.select(F.when(F.col("doc_id") % 2 == 0, F.concat(name, F.lit(".cmp.txt"))).otherwise(F.concat(F.substring(name, 1, 32), F.lit(".xml"))).alias("file")).distinct()
    by_stem, by_prefix = src.select(F.col("file").alias("fa")), src.select(F.col("file").alias("fb"))
    out = ere.join(by_stem, F.col("fa") == F.concat("stem", F.lit(".cmp.txt")), "left").join(by_prefix, F.col("fb") == F.concat(F.substring("stem", 1, 32), F.lit(".xml")), "left")
    return out.select("stem", F.coalesce("fa", "fb").alias("file"))


@query("""WITH e AS (SELECT doc_id AS file, count(*) AS entity FROM labels GROUP BY 1), r AS (SELECT item_id AS file, count(*) AS relation FROM benchmark GROUP BY 1),
v AS (SELECT conv_id AS file, count(*) AS event FROM conversations GROUP BY 1)
SELECT file, entity, relation, event FROM e FULL JOIN r USING (file) FULL JOIN v USING (file)""")
def file_record_outer(t):
    n = lambda df, key, name: df.groupBy(F.col(key).alias("file")).agg(F.count(F.lit(1)).alias(name))
    return n(t.labels, "doc_id", "entity").join(n(t.benchmark, "item_id", "relation"), "file", "full").join(n(t.conversations, "conv_id", "event"), "file", "full")


@query(f"WITH {GOLD} SELECT doc_id, genre FROM gold WHERE y IS NOT NULL")
def annotated_source_filter(t):
    return gold(t).where("y is not null").select("doc_id", "genre")


@query(f"WITH {GOLD} SELECT doc_id, y FROM gold WHERE y <> 0")
def drop_none(t):
    return gold(t).where("y <> 0").select("doc_id", "y")


@query(f"WITH {GOLD} SELECT genre, y, count(*) AS n FROM gold WHERE y IS NOT NULL GROUP BY genre, y")
def class_counts(t):
    return gold(t).where("y is not null").groupBy("genre", "y").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GOLD} SELECT doc_id, y FROM gold WHERE y IS NOT NULL QUALIFY row_number() OVER (PARTITION BY y ORDER BY doc_id) <= 20")
def cap_per_class(t):
    return sampling.cap(gold(t).where("y is not null").select("doc_id", "y"), 20, "doc_id", "y")


@query(f"WITH {GOLD} SELECT doc_id, 1 AS mode, (y <> 0)::INT AS y FROM gold WHERE y IS NOT NULL UNION ALL SELECT doc_id, 2, y - 1 FROM gold WHERE y > 0")
def binary_label(t):
    g = gold(t).where("y is not null")
    return g.select("doc_id", F.lit(1).alias("mode"), (F.col("y") != 0).cast("int").alias("y")).unionByName(g.where("y > 0").select("doc_id", F.lit(2).alias("mode"), (F.col("y") - 1).alias("y")))


@query(f"WITH {GOLD}, n AS (SELECT doc_id, CASE y WHEN 0 THEN 'None' WHEN 1 THEN 'neg' ELSE 'pos' END AS polarity, CASE b WHEN 0 THEN 'na' WHEN 1 THEN 'rob' WHEN 2 THEN 'ncb' ELSE 'cb' END AS belief, y, b FROM gold WHERE y IS NOT NULL) SELECT doc_id, polarity, belief, y, b FROM n")
def label_encode(t):
    g = gold(t).where("y is not null")
    named = g.select("doc_id", F.when(F.col("y") == 0, "None").otherwise(decode(F.col("y"), POLARITIES)).alias("polarity"), decode(F.col("b"), BELIEFS).alias("belief"))
    return named.withColumns({"y": encode(F.col("polarity"), POLARITIES), "b": encode(F.col("belief"), BELIEFS)})


@query("SELECT 'entity' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'relation', count(*) FROM pages UNION ALL SELECT 'event', count(*) FROM events")
def sample_count(t):
    one = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one(t.documents, "entity").unionByName(one(t.pages, "relation")).unionByName(one(t.events, "event"))


@query("SELECT count(*) AS total, count(l.quality) AS annotated FROM documents d LEFT JOIN labels l USING (doc_id)")
def annotation_totals(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").agg(F.count(F.lit(1)).alias("total"), F.count("quality").alias("annotated"))
