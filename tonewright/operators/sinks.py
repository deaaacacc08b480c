"""Sinks: tables, feature files, and result documents as XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Parquet, partitioned, in place of what is there."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A text column, a line each."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """(sample_id, y_predict) as CSV with a header, in place of what is there."""
    rows.select("sample_id", F.col("y").cast("int").alias("y_predict")).write.mode("overwrite").option("header", True).csv(path)


def write_features(rows: DataFrame, path: str) -> None:
    """(sample_id, x): features kept for later runs."""
    write_table(rows.select("sample_id", F.col("x").cast("array<double>").alias("x")), path)


def source_struct(id_: str = "source_id", off: str = "source_off", size: str = "source_len", text: str = "source_text") -> Column:
    """<source>, or nothing where none was found."""
    return F.when(F.col(id_).isNotNull(), F.struct(F.col(id_).alias("_ere_id"), F.col(off).alias("_offset"), F.col(size).alias("_length"), F.col(text).alias("_VALUE")))


def result_documents(rows: DataFrame, task: str, by: str = "file") -> DataFrame:
    """(by, doc): one nested result document a file; targets in order of offset, then id.

    `rows`: by, kind, target_id, off, len, text, label, source_id, source_off, source_len, source_text.
    Sentiment has a source only where the polarity isn't none; belief wherever one was found.
    """
    source = F.when((F.col("label") != "none") | F.lit(task == "belief"), source_struct())
    label = F.struct(F.lit("pos").alias("_polarity"), F.lit("no").alias("_sarcasm"), F.col("label").alias("_type"), source.alias("source")) if task == "belief" else F.struct(F.col("label").alias("_polarity"), F.lit("no").alias("_sarcasm"), source.alias("source"))
    target = F.struct(F.col("off").alias("_offset"), F.col("target_id").alias("_ere_id"), F.col("len").alias("_length"), "text", label.alias(task))
    pick = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, target)))
    return rows.groupBy(by).agg(F.struct(pick("entity").alias("entity"), pick("relation").alias("relation"), pick("event").alias("event")).alias("doc"))


def as_xml(docs: DataFrame, by: str = "file") -> DataFrame:
    """(by, xml): the nested documents as text."""
    return docs.select(by, F.to_xml("doc", {"rowTag": "belief_sentiment_doc"}).alias("xml"))


def nested_args(events: DataFrame, args: DataFrame, key: str = "event_mention_id") -> DataFrame:
    """Events with their arguments as an array; arguments take on the event's belief and source."""
    held = args.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("arg_off", "arg_id", "arg_text"))).alias("args"))
    out = events.join(held, key, "left")
    inherit = lambda a: F.struct(a["arg_id"].alias("_ere_id"), a["arg_off"].alias("_offset"), a["arg_text"].alias("text"), F.col("label").alias("belief"), F.col("source_id").alias("source"))
    return out.withColumn("args", F.coalesce(F.transform("args", inherit), F.array()))


def merge_results(sentiment: DataFrame, belief: DataFrame, key: str = "file") -> DataFrame:
    """Sentiment documents with the belief documents of the same file, where there are any."""
    return sentiment.join(belief, key, "left")


def annotations(rows: DataFrame, task: str, by: str = "file", args: DataFrame | None = None) -> DataFrame:
    """(by, `<task>_annotations`): a file's targets as result files nest them, in order of offset, then id.

    `rows` as for result_documents; off, len and text are a mention's or a trigger's, and a trigger of no length is left
    out.  `args` (by, event_id, arg_id, off, len, text): arguments of belief events; they take on the event's belief.
    A kind without targets has no element.
    """
    source = source_struct() if task == "belief" else F.when(F.col("label") != "none", source_struct())
    named = [F.col("label").alias("_type"), F.lit("pos").alias("_polarity")] if task == "belief" else [F.col("label").alias("_polarity")]
    mark = F.struct(F.struct(*named, F.lit("no").alias("_sarcasm"), source.alias("source")).alias(task)).alias(f"{task}s")
    place = [F.col("off").alias("_offset"), F.col("len").alias("_length")]
    trigger = F.when(F.coalesce("len", F.lit(0)) != 0, F.struct(*place, F.col("text").alias("_VALUE"))).alias("trigger")
    kinds = {"entities": ("entity", [*place, F.col("text"), mark]), "relations": ("relation", [trigger, mark]), "events": ("event", [trigger, mark])}
    if task == "belief":
        del kinds["entities"]
    if args is not None:
        held = args.groupBy(F.col(by).alias("_file"), F.col("event_id").alias("_event")).agg(F.sort_array(F.collect_list(F.struct("off", "arg_id", "len", "text"))).alias("_args"))
        rows = rows.join(held, F.col(by).eqNullSafe(F.col("_file")) & (F.col("target_id") == F.col("_event")) & (F.col("kind") == "event"), "left")
        each = F.transform("_args", lambda a: F.struct(a["arg_id"].alias("_ere_id"), a["off"].alias("_offset"), a["len"].alias("_length"), a["text"].alias("text"), mark))
        kinds["events"][1].append(F.when(F.size("_args") > 0, F.struct(each.alias("arg"))).alias("arguments"))
    pick = lambda kind, body: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("off", "target_id", F.struct(F.col("target_id").alias("_ere_id"), *body).alias("it"))))), lambda x: x["it"])
    found = rows.groupBy(by).agg(*(pick(*of).alias(name) for name, of in kinds.items()))
    return found.select(by, F.struct(*(F.when(F.size(name) > 0, F.struct(F.col(name).alias(of[0]))).alias(name) for name, of in kinds.items())).alias(f"{task}_annotations"))


def result_files(first: DataFrame, *more: DataFrame, by: str = "file", prefix: str = "tree-") -> DataFrame:
    """(by, xml): annotations as result files; `first` says which files there are.  Ids are a prefix and the file's ordinal."""
    out = first
    for other in more:
        out = out.join(other, by, "left")
    layers = sorted(c for c in out.columns if c.endswith("_annotations"))  # belief comes before sentiment
    named = ranked(out, (by,)).withColumn("_id", F.concat(F.lit(prefix), F.col("rn") - 1))
    return named.select(by, F.to_xml(F.struct("_id", *layers), {"rowTag": "belief_sentiment_doc"}).alias("xml"))


def with_triggers(belief: DataFrame, sentiment: DataFrame, by: str = "file") -> DataFrame:
    """Belief rows of relations take the trigger of the same sentiment relation (none where that has none)."""
    known = sentiment.where("kind = 'relation'").select(F.col(by).alias("_file"), F.col("target_id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in ("off", "len", "text"))).dropDuplicates(["_file", "_id"])
    out = belief.join(known, (F.col(by) == F.col("_file")) & (F.col("target_id") == F.col("_id")) & (F.col("kind") == "relation"), "left")
    return out.select(*(F.when(F.col("kind") == "relation", F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("off", "len", "text") else F.col(c) for c in belief.columns))


def write_files(files: DataFrame, path: str, by: str = "file") -> None:
    """A folder a file below `path`, with its XML in it."""
    files.select(by, "xml").write.mode("overwrite").partitionBy(by).text(path)
