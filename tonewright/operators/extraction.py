"""Extraction end to end: mentions, relations, events and arguments of mention files, with contexts, labels and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..functions import kept_for
from . import spans


def labelled(rows: DataFrame, annotations: DataFrame | None, target: str, with_none: bool = True) -> DataFrame:
    """Rows with label_polarity and the source of their annotation; those without one go, and those labelled none unless `with_none`.

    A target labelled none, or one without a source, has the source '' at 0 of length 0.
    """
    if annotations is None:
        return rows
    known = annotations.select(F.col("file").alias("_file"), F.col("target_id").alias("_target"), F.col("label").alias("label_polarity"), "source_id", "source_off", "source_len", "source_text")
    out = rows.join(known, (F.col("file") == F.col("_file")) & (F.col(target) == F.col("_target"))).drop("_file", "_target")
    if not with_none:
        out = out.where("label_polarity <> 'none'")
    none = (F.col("label_polarity") == "none") | F.col("source_id").isNull()
    empty = {"source_id": "", "source_off": 0, "source_len": 0, "source_text": ""}
    return out.withColumns({c: F.when(none, F.lit(v)).otherwise(F.col(c)) for c, v in empty.items()})


def extract(read, texts: DataFrame, annotations: DataFrame | None = None, with_none: bool = True, genre: str = "both") -> dict[str, DataFrame]:
    """entity, relation, event and em_args of all files of one genre, as DataFrames with the file as a column.

    `read` gives the elements of mention files (`sources.elements_in`, `elements_of`), `texts` (file, text) the sources that
    offsets point into.  Entity mentions that stand inside a tag are no samples and go; a relation keeps arguments and
    triggers without a context, an event's context is its trigger's.
    """
    parts = spans.marked_pieces(texts.where(kept_for(F.col("file"), genre)))
    own = lambda df: df.where(kept_for(F.col("file"), genre))
    entity = spans.in_context(own(sources.entity_rows(read)), parts).where("sentence is not null")
    relation = own(sources.relation_rows(read))
    for k in (1, 2):
        relation = spans.in_context(relation, parts, off=f"arg{k}_off", prefix=f"arg{k}_")
    relation = spans.in_context(relation, parts, off="trigger_off", widths=(1,), prefix="trigger_").drop("trigger_sentence", "trigger_sentence_off", "trigger_window").withColumnRenamed("trigger_context1", "trigger_context")
    events, args = sources.event_rows(read)
    event = spans.in_context(own(events), parts, off="trigger_off", prefix="trigger_")
    em_args = spans.in_context(own(args), parts, off="arg_off", widths=(1,), prefix="arg_").drop("arg_sentence", "arg_sentence_off", "arg_window").withColumnRenamed("arg_context1", "arg_context")
    return {
        "entity": labelled(entity, annotations, "mention_id", with_none),
        "relation": labelled(relation, annotations, "mention_id", with_none),
        "event": labelled(event, annotations, "event_mention_id", with_none),
        "em_args": em_args,
    }


def with_sources(ere: DataFrame, found: DataFrame) -> DataFrame:
    """(file, text): for each mention file of `ere` (file) its source of `found` (file, text): that of its own name, or of its first 32 characters."""
    prefix = F.substring("file", 1, 32)
    by_name = found.select(F.col("file").alias("_a"), F.col("text").alias("_own"))
    by_prefix = found.where(F.length("file") == 32).select(F.col("file").alias("_b"), F.col("text").alias("_shared"))
    names = ere.select("file").distinct()
    out = names.join(by_name, F.col("file") == F.col("_a"), "left").join(by_prefix, prefix == F.col("_b"), "left")
    return out.select("file", F.coalesce("_own", "_shared").alias("text")).where("text is not null")
