"""Markup: nested blocks, and who holds an opinion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import HIDDEN
from ..operators import spans, threads
from .registry import Tables, query
from .text import pieces_sql

THREADS = """turns AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '[<>]', ' ', 'g') AS body FROM conversations),
posts AS (SELECT conv_id, turn, '<post author="' || role || '">' || CASE WHEN lag(body) OVER w IS NULL THEN '' ELSE '<quote orig_author="' || lag(role) OVER w || '">' || lag(body) OVER w || '</quote>' END || body || '</post>' AS post
FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
threads AS (SELECT conv_id AS doc_id, string_agg(post, '' ORDER BY turn) AS text FROM posts GROUP BY conv_id),
parts AS (""" + pieces_sql("<post[^>]*>|</post>|<quote[^>]*>|</quote>|[^<]+|<", "piece", "threads") + """),
opens AS (SELECT doc_id, pos, off, piece, regexp_extract(piece, 'author="([^"]*)"', 1) AS author, CASE WHEN piece LIKE '<post%' THEN 'post' ELSE 'quote' END AS kind FROM parts WHERE piece LIKE '<post%' OR piece LIKE '<quote%'),
spans AS (SELECT o.*, (SELECT min(c.pos) FROM parts c WHERE c.doc_id = o.doc_id AND c.pos > o.pos AND c.piece = '</' || o.kind || '>') AS close FROM opens o),
held AS (SELECT p.doc_id, p.pos, p.off, p.piece, s.off AS block_off, s.author, (s.off + instr(s.piece, 'author="') + 7)::INT AS author_off FROM parts p JOIN spans s ON p.doc_id = s.doc_id AND s.pos < p.pos AND p.pos < s.close
WHERE p.piece NOT LIKE '<%' QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.pos ORDER BY s.pos DESC) = 1)"""


def blocks(t: Tables) -> DataFrame:
    return threads.enclosing_blocks(threads.thread_pieces(threads.thread_texts(t.conversations)))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(html, '<script[^>]*>[\s\S]*?</script>|<style[^>]*>[\s\S]*?</style>|<!--[\s\S]*?-->', '', 'g') AS html FROM pages),
tags AS (SELECT page_id, unnest(l) AS tag, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '</?(?:p|div|ul|li|nav|article)[ >]') AS l FROM p))
SELECT page_id, (pos - 1)::INT AS pos, tag, sum(CASE WHEN tag LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::INT AS depth FROM tags""")
def block_depth(t):
    shown = t.pages.select("page_id", F.regexp_replace("html", HIDDEN, "").alias("html"))
    tags = shown.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("</?(?:p|div|ul|li|nav|article)[ >]"), F.lit(0))).alias("pos", "tag"))
    upto = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return tags.withColumn("depth", F.sum(F.when(F.col("tag").startswith("</"), -1).otherwise(1)).over(upto).cast("int"))


@query(f"WITH {THREADS} SELECT doc_id, block_off, string_agg(piece, '' ORDER BY off) AS own, count(*) AS segments FROM held GROUP BY doc_id, block_off")
def block_own_text(t):
    return threads.own_text(threads.thread_pieces(threads.thread_texts(t.conversations)))


@query(f"WITH {THREADS} SELECT doc_id, block_off, string_agg(piece, '' ORDER BY off) AS own, min(off) AS start, max(off + length(piece))::INT AS \"end\", string_agg(off || ':' || (off + length(piece)), ' ' ORDER BY off) AS offsets FROM held GROUP BY doc_id, block_off")
def file_blocks(t):
    """Every block of every thread with the places of its own segments."""
    return threads.block_segments(threads.thread_pieces(threads.thread_texts(t.conversations)))


@query(f"""WITH {THREADS}, marks AS (SELECT doc_id, (off + length(piece) // 2)::INT AS at, length(piece) % 3 AS label FROM parts WHERE piece NOT LIKE '<%' UNION SELECT doc_id, off, 3 FROM parts),
hit AS (SELECT m.doc_id, m.at, m.label, arg_min(h.block_off, h.off) AS block_off FROM marks m JOIN held h ON h.doc_id = m.doc_id AND m.at BETWEEN h.off AND h.off + length(h.piece) GROUP BY ALL),
own AS (SELECT doc_id, block_off, string_agg(piece, '' ORDER BY off) AS own FROM held GROUP BY doc_id, block_off) SELECT DISTINCT own, label::INT AS label FROM hit JOIN own USING (doc_id, block_off)""")
def labelled_blocks(t):
    """The set of blocks' texts with the labels of the annotations that point into them."""
    parts = threads.thread_pieces(threads.thread_texts(t.conversations))
    size = F.length("piece")
    inside = parts.where("step = 0 and piece <> '<'").select("doc_id", (F.col("off") + F.floor(size / 2)).cast("int").alias("at"), (size % 3).cast("int").alias("label"))
    marks = inside.unionByName(parts.select("doc_id", F.col("off").alias("at"), F.lit(3).alias("label"))).distinct()
    return threads.labelled_blocks(parts, marks)


@query(f"WITH {THREADS} SELECT doc_id, off, author, author_off FROM held")
def enclosing_author(t):
    return blocks(t).select("doc_id", "off", "author", "author_off")


FIRST = "ments AS (SELECT doc_id, off AS author_off, author, doc_id || '-' || off AS mention_id FROM (SELECT doc_id, (off + instr(piece, 'author=\"') + 7)::INT AS off, author FROM opens WHERE kind = 'post'))"


def post_mentions(t: Tables) -> DataFrame:
    """Authors of posts as mentions: (doc_id, author_off, author, mention_id)."""
    parts = threads.thread_pieces(threads.thread_texts(t.conversations)).where(F.col("piece").startswith("<post"))
    off = (F.col("off") + F.instr("piece", 'author="') + 7).cast("int")
    return parts.select("doc_id", off.alias("author_off"), F.regexp_extract("piece", 'author="([^"]*)"', 1).alias("author"), F.concat_ws("-", "doc_id", off).alias("mention_id"))


@query(f"WITH {THREADS}, {FIRST} SELECT h.doc_id, h.off, h.author_off, m.mention_id FROM held h LEFT JOIN ments m ON m.doc_id = h.doc_id AND m.author_off = h.author_off")
def source_offset_join(t):
    return blocks(t).join(post_mentions(t).select("doc_id", "author_off", "mention_id"), ["doc_id", "author_off"], "left").select("doc_id", "off", "author_off", "mention_id")


@query(f"WITH {THREADS}, {FIRST} SELECT h.doc_id, h.off, h.author, h.author_off, m.mention_id FROM held h JOIN ments m ON m.doc_id = h.doc_id AND m.author_off = h.author_off")
def found_sources(t):
    return blocks(t).join(post_mentions(t).select("doc_id", "author_off", "mention_id"), ["doc_id", "author_off"]).select("doc_id", "off", "author", "author_off", "mention_id")


@query(f"WITH {THREADS}, {FIRST}, ids AS (SELECT doc_id, author, max_by(mention_id, author_off) AS source_id FROM ments GROUP BY doc_id, author) SELECT h.doc_id, h.off, h.author, i.source_id FROM held h LEFT JOIN ids i ON i.doc_id = h.doc_id AND i.author = h.author")
def source_id_lookup(t):
    ids = post_mentions(t).groupBy("doc_id", "author").agg(F.max_by("mention_id", "author_off").alias("source_id"))
    return blocks(t).join(ids, ["doc_id", "author"], "left").select("doc_id", "off", "author", "source_id")


@query(f"WITH {THREADS}, marks AS (SELECT doc_id, (off + length(piece) // 2)::INT AS at FROM parts WHERE piece NOT LIKE '<%') SELECT m.doc_id, m.at, arg_max(p.off, p.pos) AS block FROM marks m LEFT JOIN parts p ON p.doc_id = m.doc_id AND p.piece NOT LIKE '<%' AND m.at BETWEEN p.off AND p.off + length(p.piece) GROUP BY m.doc_id, m.at")
def interval_sentence_join(t):
    texts = threads.thread_pieces(threads.thread_texts(t.conversations)).where("step = 0 and piece <> '<'").select("doc_id", "pos", "off", F.length("piece").alias("len"))
    marks = texts.select(F.col("doc_id").alias("m_doc"), (F.col("off") + F.floor(F.col("len") / 2)).cast("int").alias("at"))
    inside = (F.col("m_doc") == F.col("doc_id")) & F.col("at").between(F.col("off"), F.col("off") + F.col("len"))
    return marks.join(texts, inside, "left").groupBy(F.col("m_doc").alias("doc_id"), "at").agg(F.max_by("off", "pos").alias("block"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN role END AS predict_source, CASE WHEN length(text) > 200 THEN length(role)::INT END AS predict_length FROM conversations")
def gold_source_copy(t):
    gold = t.conversations.select("conv_id", "turn", "role", F.when(F.length("text") > 200, F.length("role")).otherwise(0).alias("source_length"))
    has = F.col("source_length") != 0
    return gold.select("conv_id", "turn", F.when(has, F.col("role")).alias("predict_source"), F.when(has, F.col("source_length")).alias("predict_length"))


@query(f"WITH {THREADS} SELECT count(*) AS n, round(coalesce(avg((coalesce(h.author, '') = coalesce(t.role, ''))::INT), 0), 6) AS accuracy FROM held h JOIN turns t ON t.conv_id = h.doc_id AND t.turn = (SELECT count(*) - 1 FROM opens o WHERE o.doc_id = h.doc_id AND o.kind = 'post' AND o.pos < h.pos) + (SELECT min(turn) FROM turns u WHERE u.conv_id = h.doc_id)")
def source_accuracy(t):
    first = t.conversations.groupBy("conv_id").agg(F.min("turn").alias("low"))
    gold = t.conversations.join(first, "conv_id").select(F.col("conv_id").alias("doc_id"), (F.col("turn") - F.col("low") + 1).alias("post"), "role")
    right = F.coalesce("author", F.lit("")) == F.coalesce("role", F.lit(""))
    return blocks(t).join(gold, ["doc_id", "post"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg(right.cast("int")), F.lit(0.0)), 6).alias("accuracy"))


@query(f"WITH {THREADS}, {FIRST}, rule AS (SELECT h.doc_id, h.off, h.author_off AS rule_off, m.author_off AS gold_off FROM held h JOIN (SELECT doc_id, min(author_off) AS author_off FROM ments GROUP BY doc_id) m USING (doc_id)) SELECT doc_id, off, rule_off, gold_off FROM rule WHERE rule_off IS DISTINCT FROM gold_off")
def source_mismatch(t):
    gold = post_mentions(t).groupBy("doc_id").agg(F.min("author_off").alias("gold_off"))
    rule = blocks(t).select("doc_id", "off", F.col("author_off").alias("rule_off")).join(gold, "doc_id")
    return rule.where(~F.col("rule_off").eqNullSafe(F.col("gold_off")))
