"""Result documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..operators import sinks, spans
from .registry import query
from .scans import POL
from .text import MENTIONS

RESULT = f"""{MENTIONS}, rows AS (SELECT m.doc_id AS file, m.mention, m.off, m.len, CASE WHEN l.toxic = 1 THEN 'neg' WHEN l.quality = 1 THEN 'pos' ELSE 'none' END AS label FROM mentions m JOIN labels l ON l.doc_id = m.doc_id)"""


def rows(t):
    label = F.when(F.col("toxic") == 1, "neg").when(F.col("quality") == 1, "pos").otherwise("none")
    found = spans.mentions(t.documents).join(t.labels, "doc_id")
    kind = F.when(F.col("off") % 3 == 0, "entity").when(F.col("off") % 3 == 1, "relation").otherwise("event")
    return found.select(F.col("doc_id").alias("file"), kind.alias("kind"), F.concat_ws("-", "doc_id", "off").alias("target_id"), "off", "len", F.col("mention").alias("text"), label.alias("label"), F.when(F.col("len") % 2 == 0, F.concat(F.lit("s"), "off")).alias("source_id"), F.col("off").alias("source_off"), F.col("len").alias("source_len"), F.col("mention").alias("source_text"))


@query(f"WITH {RESULT} SELECT file, count(*) FILTER (off % 3 = 0) AS entities, count(*) FILTER (off % 3 = 1) AS relations, count(*) FILTER (off % 3 = 2) AS events, count(*) FILTER (label <> 'none' AND len % 2 = 0) AS sources, md5(coalesce(string_agg(file || '-' || off || ':' || label, ' ' ORDER BY off) FILTER (off % 3 = 0), '')) AS digest FROM rows GROUP BY file")
def result_doc_struct(t):
    docs = sinks.result_documents(rows(t), "sentiment")
    size = lambda k: F.size(f"doc.{k}").cast("long")
    every = F.concat("doc.entity", "doc.relation", "doc.event")
    line = F.array_join(F.transform("doc.entity", lambda x: F.concat_ws(":", x["_ere_id"], x["sentiment"]["_polarity"])), " ")
    sources = F.size(F.filter(every, lambda x: x["sentiment"]["source"].isNotNull())).cast("long")
    return docs.select("file", size("entity").alias("entities"), size("relation").alias("relations"), size("event").alias("events"), sources.alias("sources"), F.md5(line).alias("digest"))


@query(f"WITH {RESULT} SELECT file, count(*) AS targets, sum(off)::BIGINT AS offsets FROM rows GROUP BY file")
def result_xml(t):
    """Documents written as XML text and read back."""
    xml = sinks.as_xml(sinks.result_documents(rows(t), "belief"))
    item = "ARRAY<STRUCT<_ere_id: STRING, _offset: INT>>"
    back = xml.select("file", F.from_xml("xml", f"entity {item}, relation {item}, event {item}").alias("d"))
    every = F.concat(*(F.coalesce(f"d.{k}", F.array()) for k in ("entity", "relation", "event")))
    return back.select("file", F.size(every).cast("long").alias("targets"), F.aggregate(every, F.lit(0).cast("long"), lambda s, x: s + x["_offset"]).alias("offsets"))


@query("WITH p AS (SELECT l_orderkey, count(*) AS args, string_agg(l_linenumber || ':' || l_partkey || ':' || o_orderpriority, ' ' ORDER BY l_linenumber, l_partkey) AS nested FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey) SELECT o_orderkey AS event_mention_id, coalesce(args, 0) AS args, coalesce(nested, '') AS nested FROM orders LEFT JOIN p ON l_orderkey = o_orderkey")
def event_args_nest(t):
    events = t.orders.select(F.col("o_orderkey").alias("event_mention_id"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("source_id"))
    args = t.lineitem.select(F.col("l_orderkey").alias("event_mention_id"), F.col("l_linenumber").alias("arg_off"), F.col("l_partkey").alias("arg_id"), F.lit("").alias("arg_text"))
    out = sinks.nested_args(events, args)
    line = F.array_join(F.transform("args", lambda a: F.concat_ws(":", a["_offset"], a["_ere_id"], a["belief"])), " ")
    return out.select("event_mention_id", F.size("args").cast("long").alias("args"), line.alias("nested"))


@query(f"WITH s AS (SELECT doc_id AS file, {POL} AS sentiment FROM labels), b AS (SELECT item_id AS file, length(text) AS size FROM benchmark) SELECT s.file, sentiment, b.size::INT AS belief FROM s LEFT JOIN b ON b.file = s.file")
def merge_outputs(t):
    from ..functions import polarity

    s = t.labels.select(F.col("doc_id").alias("file"), polarity(F.col("quality"), F.col("toxic")).alias("sentiment"))
    return sinks.merge_results(s, t.benchmark.select(F.col("item_id").alias("file"), F.length("text").alias("belief")))


MERGED = f"""{RESULT}, s AS (SELECT file, off, len, mention, label, CASE off % 3 WHEN 0 THEN 'entity' WHEN 1 THEN 'relation' ELSE 'event' END AS kind, len % 2 = 0 AND label <> 'none' AS sourced FROM rows),
st AS (SELECT file, 'sentiment' AS task, kind, file || '-' || off AS target_id, off, len, mention AS text, label, CASE WHEN sourced THEN 's' || off END AS source_id FROM s WHERE NOT (kind = 'relation' AND off % 2 = 0)),
be AS (SELECT s.file, 'belief', s.kind, s.file || '-' || s.off, CASE WHEN s.kind = 'event' THEN s.off WHEN t.off IS NOT NULL THEN t.off END, CASE WHEN s.kind = 'event' THEN s.len WHEN t.off IS NOT NULL THEN t.len END, CASE WHEN s.kind = 'event' OR t.off IS NOT NULL THEN s.mention END, CASE s.label WHEN 'none' THEN 'na' WHEN 'neg' THEN 'rob' ELSE 'cb' END, CASE WHEN s.len % 2 = 0 THEN 's' || s.off END
FROM s LEFT JOIN st t ON t.file = s.file AND t.kind = 'relation' AND t.off = s.off AND s.kind = 'relation' WHERE s.kind <> 'entity')"""


@query(f"WITH {MERGED} SELECT * FROM st UNION ALL SELECT * FROM be WHERE file IN (SELECT file FROM st)")
def merged_result_xml(t):
    """Sentiment and belief results of the same files merged into one XML document each, and read back.

    Some relations have no sentiment; those that have one lend it their trigger.
    """
    found = rows(t)
    sentiment = found.where("not (kind = 'relation' and off % 2 = 0)")
    label = F.when(F.col("label") == "none", "na").when(F.col("label") == "neg", "rob").otherwise("cb")
    belief = sinks.with_triggers(found.where("kind <> 'entity'").withColumn("label", label), sentiment)
    xml = sinks.result_files(sinks.annotations(sentiment, "sentiment"), sinks.annotations(belief, "belief"))
    back = xml.select("file", F.from_xml("xml", sources.RESULT).alias("d")).select("file", "d.*")
    one = lambda task: sources.result_rows(back, task)[0].select("file", F.lit(task).alias("task"), "kind", "target_id", "off", "len", "text", "label", "source_id")
    return one("sentiment").unionByName(one("belief"))
