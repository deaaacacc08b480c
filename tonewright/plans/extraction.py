"""Extraction end to end: pages stand in for sources, and mention and annotation files are written as XML and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import sources
from ..operators import extraction, spans
from .registry import Tables, query
from .text import pieces_sql

PIECES = "pieces AS (" + pieces_sql(r"<[^<>]*>|[^<>.!?\n]*[.!?\n]|[^<>.!?\n]+|[<>]", "sent", "pages", "page_id", "html") + ")"
PARTED = PIECES + ", parted AS (SELECT *, sum(regexp_full_match(sent, '<[^<>]*>')::INT) OVER (PARTITION BY page_id ORDER BY pos) AS part FROM pieces)"


def frame_sql(w: int) -> str:
    near = f"string_agg(sent, '') OVER (PARTITION BY page_id, part ORDER BY pos ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING)"
    return rf"regexp_replace(replace({near}, chr(10), ' '), '</?\w+[^>]*>', '', 'g') AS context{w}"


FRAMED = PARTED + ", framed AS (SELECT *, " + ", ".join(map(frame_sql, (7, 5, 3, 1))) + " FROM parted WHERE NOT regexp_full_match(sent, '<[^<>]*>'))"
TOKS = "toks AS (" + pieces_sql("[A-Za-z]+|[^A-Za-z]+", "tok", "pages", "page_id", "html") + ")"
FOUND = TOKS + ", found AS (SELECT page_id, 'ENG_DF_' || page_id AS file, tok AS mention, off, length(tok)::INT AS len, lead(tok) OVER w AS mention2, lead(off) OVER w AS off2, lead(length(tok)::INT) OVER w AS len2 FROM toks WHERE regexp_full_match(tok, '[A-Z][a-z]{3,}') WINDOW w AS (PARTITION BY page_id ORDER BY off))"
BASE = f"WITH {FRAMED}, {FOUND}"


def placed_sql(name: str, off: str) -> str:
    """The context of one place: nulls where there is none."""
    return f"LEFT JOIN framed {name} ON {name}.page_id = m.page_id AND {off} >= {name}.off AND {off} < {name}.off + length({name}.sent)"


def window_sql(name: str, off: str) -> str:
    words = lambda x: f"regexp_extract_all({x}, '[A-Za-z]+')"
    before, after = words(f"substr({name}.sent, 1, {off} - {name}.off)"), words(f"substr({name}.sent, {off} - {name}.off + 1)")
    return f"CASE WHEN {name}.sent IS NOT NULL THEN array_to_string(list_concat(({before})[greatest(len({before}) - 4, 1):], ({after})[1:5]), ' ') END"


def said(t: Tables) -> DataFrame:
    """(file, off, len, mention, off2, len2, mention2): capitalised words of pages with the next one of the page."""
    pages = t.pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    order = Window.partitionBy("doc_id").orderBy("off")
    after = [F.lead(c).over(order).alias(f"{c}2") for c in ("off", "len", "mention")]
    return spans.mentions(pages).select(F.concat(F.lit("ENG_DF_"), "doc_id").alias("file"), "off", "len", "mention", *after)


def written(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(file, xml) of mention files and of annotation files."""
    say = lambda x: F.format_string(x, *(F.col(c) for c in ("off", "len", "mention", "off2", "len2", "mention2")))
    entity = say('<entity id="e-%1$s" type="PER" specificity="specific"><entity_mention id="m-%1$s" noun_type="NAM" source="f" offset="%1$s" length="%2$s"><mention_text>%3$s</mention_text></entity_mention></entity>')
    filler = say('<filler id="f-%1$s" type="title" offset="%1$s" length="%2$s">%3$s</filler>')
    second = F.when(F.col("off") % 2 == 0, say('<rel_arg2 filler_id="f-%4$s" role="b">%6$s</rel_arg2>')).otherwise(say('<rel_arg2 entity_id="e-%4$s" entity_mention_id="m-%4$s" role="b">%6$s</rel_arg2>'))
    trigger = F.when(F.col("off") % 3 != 0, say('<trigger offset="%4$s" length="%5$s">%6$s</trigger>')).otherwise("")
    relation = F.when(F.col("off2").isNotNull(), F.concat(say('<relation id="r-%1$s" type="t" subtype="s"><relation_mention id="rm-%1$s" realis="true"><rel_arg1 entity_id="e-%1$s" entity_mention_id="m-%1$s" role="a">%3$s</rel_arg1>'), second, trigger, F.lit("</relation_mention></relation>")))
    arg = F.when(F.col("off2").isNotNull(), say('<em_arg entity_id="e-%4$s" entity_mention_id="m-%4$s" role="who">%6$s</em_arg>')).otherwise("")
    hopper = F.when(F.col("off") % 5 == 0, F.concat(say('<hopper id="h-%1$s"><event_mention id="ev-%1$s" type="t" subtype="s" realis="r" ways="w"><trigger offset="%1$s" length="%2$s">%3$s</trigger>'), arg, F.lit("</event_mention></hopper>")))
    rows = said(t)
    listed = lambda c: F.array_join(F.collect_list(c), "")
    ere = rows.groupBy("file").agg(F.concat(F.lit("<deft_ere><entities>"), listed(entity), F.lit("</entities><fillers>"), listed(filler), F.lit("</fillers><relations>"), listed(relation), F.lit("</relations><hoppers>"), listed(hopper), F.lit("</hoppers></deft_ere>")).alias("xml"))
    label = F.when(F.col("off") % 3 == 0, "none").when(F.col("off") % 3 == 1, "neg").otherwise("pos")
    source = F.when(F.col("off") % 4 != 0, say('<source ere_id="m-%1$s" offset="%1$s" length="%2$s">%3$s</source>')).otherwise("")
    mark = F.concat(say('<entity ere_id="m-%1$s" offset="%1$s" length="%2$s"><text>%3$s</text><sentiments><sentiment polarity="'), label, F.lit('" sarcasm="no">'), source, F.lit("</sentiment></sentiments></entity>"))
    best = rows.groupBy("file").agg(F.concat(F.lit("<belief_sentiment_doc><sentiment_annotations><entities>"), listed(mark), F.lit("</entities></sentiment_annotations></belief_sentiment_doc>")).alias("xml"))
    return ere, best


def extracted(t: Tables, annotated: bool = False) -> dict[str, DataFrame]:
    ere, best = written(t)
    texts = t.pages.select(F.concat(F.lit("ENG_DF_"), "page_id").alias("file"), F.col("html").alias("text"))
    return extraction.extract(sources.elements_of(ere), texts, sources.annotation_documents(best) if annotated else None)


LABEL = "CASE m.off % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'neg' ELSE 'pos' END"
SOURCED = "m.off % 3 <> 0 AND m.off % 4 <> 0"


@query(f"""{BASE} SELECT file, 'e-' || m.off AS entity_id, 'PER' AS entity_type, 'm-' || m.off AS mention_id, 'NAM' AS noun_type, m.off, m.len, m.mention, s.sent AS sentence, s.off AS sentence_off, s.context7, s.context5, s.context3, s.context1, {window_sql('s', 'm.off')} AS "window",
{LABEL} AS label_polarity, CASE WHEN {SOURCED} THEN 'm-' || m.off ELSE '' END AS source_id, CASE WHEN {SOURCED} THEN m.off ELSE 0 END AS source_off, CASE WHEN {SOURCED} THEN m.len ELSE 0 END AS source_len, CASE WHEN {SOURCED} THEN m.mention ELSE '' END AS source_text
FROM found m {placed_sql('s', 'm.off')} WHERE s.sent IS NOT NULL""")
def extracted_entities(t):
    rows = extracted(t, annotated=True)["entity"]
    return rows.select("file", "entity_id", "entity_type", "mention_id", "noun_type", "off", "len", "mention", "sentence", "sentence_off", "context7", "context5", "context3", "context1", "window", "label_polarity", "source_id", "source_off", "source_len", "source_text")


@query(f"""{BASE} SELECT file, 'rm-' || m.off AS mention_id, m.mention AS arg1_mention, m.off AS arg1_off, a.context3 AS arg1_context3, {window_sql('a', 'm.off')} AS arg1_window, mention2 AS arg2_mention, off2 AS arg2_off, len2 AS arg2_len, (m.off % 2 = 0)::INT AS arg2_is_filler, b.context3 AS arg2_context3, b.off AS arg2_sentence_off,
CASE WHEN m.off % 3 <> 0 THEN off2 END AS trigger_off, CASE WHEN m.off % 3 <> 0 THEN b.context1 END AS trigger_context FROM found m {placed_sql('a', 'm.off')} {placed_sql('b', 'm.off2')} WHERE off2 IS NOT NULL""")
def extracted_relations(t):
    rows = extracted(t)["relation"]
    return rows.select("file", "mention_id", "arg1_mention", "arg1_off", "arg1_context3", "arg1_window", "arg2_mention", "arg2_off", "arg2_len", "arg2_is_filler", "arg2_context3", "arg2_sentence_off", "trigger_off", "trigger_context")


@query(f"{BASE} SELECT file, 'h-' || m.off AS hopper_id, 'ev-' || m.off AS event_mention_id, m.off AS trigger_off, m.len AS trigger_len, m.mention AS trigger, (off2 IS NOT NULL)::INT AS em_arg_num, s.context7 AS trigger_context7, s.context1 AS trigger_context1, {window_sql('s', 'm.off')} AS trigger_window, s.off AS trigger_sentence_off FROM found m {placed_sql('s', 'm.off')} WHERE m.off % 5 = 0")
def extracted_events(t):
    rows = extracted(t)["event"]
    return rows.select("file", "hopper_id", "event_mention_id", "trigger_off", "trigger_len", "trigger", "em_arg_num", "trigger_context7", "trigger_context1", "trigger_window", "trigger_sentence_off")


@query(f"{BASE} SELECT file, 'ev-' || m.off AS event_mention_id, 'who' AS arg_role, mention2 AS arg_mention, off2 AS arg_off, 'PER' AS arg_entity_type, 0 AS arg_is_filler, s.context1 AS arg_context FROM found m {placed_sql('s', 'm.off2')} WHERE m.off % 5 = 0 AND off2 IS NOT NULL")
def extracted_args(t):
    return extracted(t)["em_args"].select("file", "event_mention_id", "arg_role", "arg_mention", "arg_off", "arg_entity_type", "arg_is_filler", "arg_context")
