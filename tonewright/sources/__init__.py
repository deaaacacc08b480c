"""Sources: texts, mention files, annotations, results and embeddings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: XML of mention files (attributes carry an underscore).
ENTITY = "_id STRING, _type STRING, _specificity STRING, entity_mention ARRAY<STRUCT<_id: STRING, _noun_type: STRING, _source: STRING, _offset: STRING, _length: STRING, mention_text: STRING>>"
_ARG = "STRUCT<_VALUE: STRING, _entity_id: STRING, _entity_mention_id: STRING, _filler_id: STRING, _role: STRING>"
_SPAN = "STRUCT<_VALUE: STRING, _offset: STRING, _length: STRING>"
RELATION = f"_id STRING, _type STRING, _subtype STRING, relation_mention ARRAY<STRUCT<_id: STRING, _realis: STRING, rel_arg1: {_ARG}, rel_arg2: {_ARG}, trigger: {_SPAN}>>"
HOPPER = f"_id STRING, event_mention ARRAY<STRUCT<_id: STRING, _type: STRING, _subtype: STRING, _realis: STRING, _ways: STRING, trigger: {_SPAN}, em_arg: ARRAY<{_ARG}>>>"
FILLER = "_VALUE STRING, _id STRING, _type STRING, _offset STRING, _length STRING"
_SOURCE = "STRUCT<_VALUE: STRING, _ere_id: STRING, _offset: STRING, _length: STRING>"
_SENTIMENT = f"sentiments STRUCT<sentiment: ARRAY<STRUCT<_polarity: STRING, _sarcasm: STRING, source: {_SOURCE}>>>"
_BELIEF = f"beliefs STRUCT<belief: ARRAY<STRUCT<_type: STRING, _polarity: STRING, _sarcasm: STRING, source: {_SOURCE}>>>"
ANNOTATED = f"_ere_id STRING, _offset STRING, _length STRING, text STRING, trigger {_SPAN}, {_SENTIMENT}, {_BELIEF}"


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): one row a file, unchanged, so that character offsets hold."""
    return spark.read.text(path, wholetext=True).select(_stem(F.input_file_name()).alias("file"), F.col("value").alias("text"))


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.cmp\.txt|\.rich_ere\.xml|\.rich\.ere\.xml|\.best\.xml|\.xml|\.txt)?$", 1)


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("file", _stem(F.input_file_name()))


def _int(c: str) -> Column:
    return F.col(c).try_cast("int")


#: A mention file and an annotation file as a whole.
_DOCUMENT = ", ".join(f"{many} STRUCT<{one}: ARRAY<STRUCT<{kind}>>>" for many, one, kind in (("entities", "entity", ENTITY), ("fillers", "filler", FILLER), ("relations", "relation", RELATION), ("hoppers", "hopper", HOPPER)))
_ANNOTATIONS = "sentiment_annotations STRUCT<" + ", ".join(f"{many}: STRUCT<{one}: ARRAY<STRUCT<{ANNOTATED}>>>" for many, one in (("entities", "entity"), ("relations", "relation"), ("events", "event"))) + ">"
_WITHIN = {"entity": "entities.entity", "filler": "fillers.filler", "relation": "relations.relation", "hopper": "hoppers.hopper"}


def elements_of(documents: DataFrame):
    """From (file, xml) of whole mention files, a reader of their elements: what the `*_rows` functions take."""
    parsed = documents.select("file", F.from_xml("xml", _DOCUMENT).alias("d"))
    return lambda tag: parsed.select("file", F.explode(f"d.{_WITHIN[tag]}").alias("e")).select("e.*", "file")


def annotation_documents(documents: DataFrame) -> DataFrame:
    """(file, target_id, label, source_id, source_off, source_len, source_text) from (file, xml): the first sentiment of each target."""
    parsed = documents.select("file", F.from_xml("xml", _ANNOTATIONS).getField("sentiment_annotations").alias("d"))
    every = F.concat(*(F.coalesce(f"d.{c}", F.array()) for c in ("entities.entity", "relations.relation", "events.event")))
    rows = parsed.select("file", F.explode(every).alias("e")).where("e._ere_id is not null")
    first = F.col("e.sentiments.sentiment")[0]
    rows = rows.select("file", F.col("e._ere_id").alias("target_id"), first["_polarity"].alias("label"), first["source"].alias("s")).dropDuplicates(["file", "target_id"])
    return rows.select("file", "target_id", "label", F.col("s._ere_id").alias("source_id"), _int("s._offset").alias("source_off"), _int("s._length").alias("source_len"), F.col("s._VALUE").alias("source_text"))


def elements_in(spark: SparkSession, path: str):
    """The same over mention files below `path`."""
    kinds = {"entity": ENTITY, "filler": FILLER, "relation": RELATION, "hopper": HOPPER}
    return lambda tag: _xml(spark, path, tag, kinds[tag])


def entity_file(spark: SparkSession, path: str) -> DataFrame:
    return entity_rows(elements_in(spark, path))


def entity_rows(read) -> DataFrame:
    """One row an entity mention; mentions without an id are skipped."""
    rows = read("entity").select("file", F.col("_id").alias("entity_id"), F.col("_type").alias("entity_type"), F.col("_specificity").alias("entity_specificity"), F.explode("entity_mention").alias("m"))
    return rows.where("m._id is not null").select("file", "entity_id", "entity_type", "entity_specificity", F.col("m._id").alias("mention_id"), F.col("m._noun_type").alias("noun_type"), _int("m._offset").alias("off"), _int("m._length").alias("len"), F.col("m.mention_text").alias("mention"))


def filler_file(spark: SparkSession, path: str) -> DataFrame:
    return filler_rows(elements_in(spark, path))


def filler_rows(read) -> DataFrame:
    return read("filler").select("file", F.col("_id").alias("filler_id"), F.col("_type").alias("filler_type"), _int("_offset").alias("off"), _int("_length").alias("len"), F.col("_VALUE").alias("mention"))


def resolve_args(args: DataFrame, entities: DataFrame, fillers: DataFrame, prefix: str) -> DataFrame:
    """Arguments (file, {prefix}_entity_id, {prefix}_mention_id, {prefix}_filler_id) with what they name: an entity's mention or else a filler."""
    e = entities.select("file", F.col("entity_id").alias(f"{prefix}_entity_id"), F.col("mention_id").alias(f"{prefix}_mention_id"), F.struct("entity_type", "entity_specificity", "noun_type", "off", "len", "mention").alias("_e")).dropDuplicates(["file", f"{prefix}_entity_id", f"{prefix}_mention_id"])
    f = fillers.select("file", F.col("filler_id").alias(f"{prefix}_filler_id"), F.struct(F.col("filler_type").alias("entity_type"), "off", "len", "mention").alias("_f")).dropDuplicates(["file", f"{prefix}_filler_id"])
    out = args.join(e, ["file", f"{prefix}_entity_id", f"{prefix}_mention_id"], "left").join(f, ["file", f"{prefix}_filler_id"], "left")
    both = [F.coalesce(f"_e.{c}", f"_f.{c}").alias(f"{prefix}_{c}") for c in ("entity_type", "off", "len", "mention")]
    return out.select(*args.columns, *both, F.col("_e.entity_specificity").alias(f"{prefix}_specificity"), F.col("_e.noun_type").alias(f"{prefix}_noun_type"), F.col("_e").isNull().cast("int").alias(f"{prefix}_is_filler")).drop("_e", "_f")


def relation_file(spark: SparkSession, path: str) -> DataFrame:
    return relation_rows(elements_in(spark, path))


def relation_rows(read) -> DataFrame:
    """One row a relation mention with both arguments resolved and its trigger, if it has one."""
    rows = read("relation").select("file", F.col("_id").alias("relation_id"), F.col("_type").alias("relation_type"), F.col("_subtype").alias("relation_subtype"), F.explode("relation_mention").alias("m"))
    flat = rows.select("file", "relation_id", "relation_type", "relation_subtype", F.col("m._id").alias("mention_id"), F.col("m._realis").alias("realis"), *(F.col(f"m.rel_arg{k}.{a}").alias(f"arg{k}_{b}") for k in (1, 2) for a, b in (("_entity_id", "entity_id"), ("_entity_mention_id", "mention_id"), ("_filler_id", "filler_id"), ("_role", "role"))), _int("m.trigger._offset").alias("trigger_off"), _int("m.trigger._length").alias("trigger_len"), F.col("m.trigger._VALUE").alias("trigger"))
    entities, fillers = entity_rows(read), filler_rows(read)
    return resolve_args(resolve_args(flat, entities, fillers, "arg1"), entities, fillers, "arg2")


def event_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return event_rows(elements_in(spark, path))


def event_rows(read) -> tuple[DataFrame, DataFrame]:
    """Event mentions, and their arguments resolved."""
    rows = read("hopper").select("file", F.col("_id").alias("hopper_id"), F.explode("event_mention").alias("m"))
    events = rows.select("file", "hopper_id", F.col("m._id").alias("event_mention_id"), *(F.col(f"m._{c}").alias(c) for c in ("type", "subtype", "realis", "ways")), _int("m.trigger._offset").alias("trigger_off"), _int("m.trigger._length").alias("trigger_len"), F.col("m.trigger._VALUE").alias("trigger"), F.coalesce(F.size("m.em_arg"), F.lit(0)).alias("em_arg_num"))
    args = rows.select("file", "hopper_id", F.col("m._id").alias("event_mention_id"), F.explode("m.em_arg").alias("a"))
    args = args.select("file", "hopper_id", "event_mention_id", F.col("a._entity_id").alias("arg_entity_id"), F.col("a._entity_mention_id").alias("arg_mention_id"), F.col("a._filler_id").alias("arg_filler_id"), F.col("a._role").alias("arg_role"))
    return events, resolve_args(args, entity_rows(read), filler_rows(read), "arg")


def annotation_file(spark: SparkSession, path: str, tag: str, first: bool = True) -> DataFrame:
    """Annotations of `tag` (entity, relation, event, arg): label, sarcasm and source; the first of each target, or all."""
    rows = _xml(spark, path, tag, ANNOTATED).where("_ere_id is not null")
    said = F.coalesce(F.transform("sentiments.sentiment", lambda x: F.struct(F.lit("sentiment").alias("task"), x["_polarity"].alias("label"), x["_sarcasm"].alias("sarcasm"), x["source"].alias("source"))), F.transform("beliefs.belief", lambda x: F.struct(F.lit("belief").alias("task"), x["_type"].alias("label"), x["_sarcasm"].alias("sarcasm"), x["source"].alias("source"))))
    rows = rows.select("file", F.col("_ere_id").alias("target_id"), F.explode_outer(F.slice(said, 1, 1) if first else said).alias("a"))
    return rows.select("file", "target_id", "a.task", "a.label", "a.sarcasm", F.col("a.source._ere_id").alias("source_id"), _int("a.source._offset").alias("source_off"), _int("a.source._length").alias("source_len"), F.col("a.source._VALUE").alias("source_text"))


_RESULT_ARG = "STRUCT<_ere_id STRING, _offset STRING, _length STRING, text STRING>"
_RESULT_ITEM = f"STRUCT<_ere_id STRING, _offset STRING, _length STRING, text STRING, trigger {_SPAN}, {_SENTIMENT}, {_BELIEF}, arguments STRUCT<arg ARRAY<{_RESULT_ARG}>>>"
_LAYER = f"STRUCT<entities STRUCT<entity ARRAY<{_RESULT_ITEM}>>, relations STRUCT<relation ARRAY<{_RESULT_ITEM}>>, events STRUCT<event ARRAY<{_RESULT_ITEM}>>>"
#: XML of whole result files.
RESULT = f"_id STRING, sentiment_annotations {_LAYER}, belief_annotations {_LAYER}"


def result_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, sentiment_annotations, belief_annotations): result files as written by the sinks."""
    return _xml(spark, path, "belief_sentiment_doc", RESULT)


def result_rows(files: DataFrame, task: str) -> tuple[DataFrame, DataFrame]:
    """The targets of one task and the arguments of its events, flat: what the sinks take.

    The first label of a target counts; a sentiment has a source only where its polarity isn't none.
    """
    at = f"{task}_annotations"
    listed = {"entity": f"{at}.entities.entity", "relation": f"{at}.relations.relation", "event": f"{at}.events.event"}
    tagged = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("xs")) for k, c in listed.items()))
    items = files.select("file", F.explode(tagged).alias("t")).select("file", "t.kind", F.explode("t.xs").alias("x"))
    first = F.col("x.sentiments.sentiment")[0] if task == "sentiment" else F.col("x.beliefs.belief")[0]
    label = first["_polarity"] if task == "sentiment" else first["_type"]
    source = F.when(label != "none", first["source"]) if task == "sentiment" else first["source"]
    whole = items.withColumns({"label": label, "s": source})
    span = [F.coalesce(f"x._{n}", f"x.trigger._{n}").try_cast("int").alias(c) for c, n in (("off", "offset"), ("len", "length"))]
    rows = whole.select("file", "kind", F.col("x._ere_id").alias("target_id"), *span, F.coalesce("x.text", "x.trigger._VALUE").alias("text"), "label", F.col("s._ere_id").alias("source_id"), _int("s._offset").alias("source_off"), _int("s._length").alias("source_len"), F.col("s._VALUE").alias("source_text"))
    args = items.where("kind = 'event'").select("file", F.col("x._ere_id").alias("event_id"), F.explode("x.arguments.arg").alias("a"))
    return rows, args.select("file", "event_id", F.col("a._ere_id").alias("arg_id"), _int("a._offset").alias("off"), _int("a._length").alias("len"), "a.text")


def embedding_lines(lines: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """(word, vec) from lines `word v1 v2 ...`; of repeated words the last in `order` stays (no order: any one)."""
    parts = F.split(F.col("value"), r"\s+")
    vec = F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.try_cast("float"))
    if not order:
        return lines.select(parts[0].alias("word"), vec.alias("vec")).dropDuplicates(["word"])
    rows = lines.select(parts[0].alias("word"), vec.alias("vec"), F.struct(*order).alias("_at"))
    return rows.groupBy("word").agg(F.max_by("vec", "_at").alias("vec"))


def embedding_file(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of embedding text files; of repeated words the last in the file stays."""
    at = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()}
    return embedding_lines(spark.read.text(path).withColumns(at), ("_file", "_block", "_line"))


def model_vectors(model) -> DataFrame:
    """(word, vec) of a fitted or loaded Word2Vec model."""
    return model.getVectors().select("word", vector_to_array("vector", "float32").alias("vec"))


def sample_csv(spark: SparkSession, path: str) -> DataFrame:
    """(text, label): the first and the last column of CSV files without a header."""
    rows = spark.read.option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.col(rows.columns[0]).alias("text"), F.col(rows.columns[-1]).alias("label"))


def review_folders(spark: SparkSession, path: str) -> DataFrame:
    """(text, y): reviews below folders named pos (1) and otherwise (0)."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("value").alias("text"), F.regexp_extract(F.input_file_name(), r"/(pos)/[^/]*$", 1).eqNullSafe("pos").cast("int").alias("y"))


def elements(texts: DataFrame, name: str) -> DataFrame:
    """(file, pos, body): the bodies of <name> elements, by pattern."""
    return texts.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(rf"<{name}>([\s\S]*?)</{name}>"), F.lit(1))).alias("pos", "body"))


def prediction_file(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, y_predict) as the sinks write them."""
    return spark.read.option("header", True).schema("sample_id string, y_predict int").csv(path)


def kept_features(spark: SparkSession, path: str, samples: DataFrame) -> DataFrame:
    """`samples` (sample_id, ...) with the features kept at `path`, null where there are none: by name, never by place."""
    return samples.join(spark.read.parquet(path).select("sample_id", "x"), "sample_id", "left")


@dataclass(frozen=True)
class Catalogue:
    """Where the files of a task lie below `root`; `predicted` chooses predicted mention files over gold ones."""

    root: str
    language: str = "english"
    task: str = "sentiment"
    split: str = "train"
    predicted: bool = False

    def at(self, *names: str) -> str:
        return "/".join((self.root.rstrip("/"), self.language, self.split, *names))

    @property
    def sources(self) -> str:
        return self.at("source")

    @property
    def mentions(self) -> str:
        return self.at("predicted_ere" if self.predicted else "ere")

    @property
    def annotations(self) -> str:
        return self.at("annotation")

    def table(self, kind: str) -> str:
        """The extracted table of entity, relation, event or em_args."""
        return self.at(self.task, kind)

    def output(self, name: str, genre: str = "both") -> str:
        return self.at(self.task, "output", genre, name)
