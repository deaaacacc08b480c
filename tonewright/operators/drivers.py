"""Whole runs: for each genre that is judged and each task, split, features, resampling, fit, decision, score and files.

A run sees the texts of its training and test part together when it weighs terms, as both are at hand; labels are learned from the
training part alone.  Features are a long table (sample, name, value) until a learner needs arrays, so blocks are put together by a
union and kept by name.  Upsampling gives a row a weight, its number of copies, instead of copying it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import BELIEFS, POLARITIES, argmax, cut_class, decode, threshold_class
from . import evaluate, features, learners, ridge, sampling, sinks
from .checkpoints import cut
from .ranks import ranked


@dataclass(frozen=True)
class Task:
    """A column of classes, their names, and where a regression is cut into them."""

    name: str
    label: str
    classes: tuple[str, ...]
    cuts: tuple[float, ...]

    def numbered(self) -> dict[str, int]:
        return {c: k for k, c in enumerate(self.classes)}


SENTIMENT = Task("sentiment", "y", POLARITIES, (0.7, 1.7))
BELIEF = Task("belief", "b", BELIEFS, (0.7, 1.7, 2.3))
TASKS = (SENTIMENT, BELIEF)
#: Shares of each genre's files that train when the other genre is judged: forum alone, or forum and a part of the newswire.
SHARES = {"df": {"df": 0.8}, "nw": {"df": 1.0, "nw": 0.2}}


def parts(samples: DataFrame, order: str = "doc_id", genres: tuple[str, ...] = tuple(SHARES)) -> DataFrame:
    """(wanted, and the columns of `samples`, part): for each genre that is judged, what trains and what is judged."""
    out = None
    for wanted, share in ((g, SHARES[g]) for g in genres):
        files = samples.where(F.col("genre").isin(list(share)))
        rows = sampling.ordered_split(files, share, order).select(F.lit(wanted).alias("wanted"), *samples.columns, F.col("split").alias("part"))
        out = rows if out is None else out.unionByName(rows)
    return out


def weights(train: DataFrame, order: str = "doc_id", label: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """`train` with `copies`: how often upsampling each class to the largest, its rows in turn, takes a row; within each run of `by`."""
    sizes = train.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.max("n").alias("top"))
    counted = ranked(train, (order,), (*by, label))
    counted = counted.join(F.broadcast(sizes), list(by)) if by else counted.crossJoin(F.broadcast(sizes))  # a row a run
    return counted.select(*train.columns, (F.floor((F.col("top") - F.col("rn")) / F.col("rn_total")) + 1).alias("copies"))


def general_features(rows: DataFrame, key: str, text: str, kind: str, terms: int = 300) -> DataFrame:
    """(key, name, value), zeros left out: weights of the most frequent terms, and 1 for the kind of the sample."""
    weighed = features.tfidf(rows, key, F.col(text), terms).select(key, F.concat(F.lit("term "), "term").alias("name"), F.col("weight").alias("value"))
    kinds = rows.where(F.col(kind).isNotNull()).select(key, F.concat(F.lit("kind "), kind).alias("name"), F.lit(1.0).alias("value"))
    return weighed.unionByName(kinds)


def dense(found: DataFrame, key: str, names: list[str], keys: DataFrame) -> DataFrame:
    """(key, x) for every key: the values of `names` in their order, 0 where there is none."""
    table = found.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "name string, k int")
    numbered = found.join(F.broadcast(table), "name")  # as many rows as features
    held = numbered.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))) if names else F.array().cast("array<double>")
    return keys.select(key).join(held, key, "left").select(key, cells.alias("x"))


def feature_names(found: DataFrame) -> list[str]:
    """The names in their order: a few hundred."""
    return [r["name"] for r in found.select("name").distinct().orderBy("name").collect()]


@dataclass
class Run:
    """One genre and one task: (doc_id, gold, x, copies) to learn from and (doc_id, gold, x) to judge."""

    wanted: str
    task: Task
    train: DataFrame
    test: DataFrame


def prepared(samples: DataFrame, wanted: str, task: Task, terms: int = 300) -> Run:
    """From (doc_id, genre, text, kind, and the task's label), null labels left out."""
    return runs(samples, wanted, (task,), terms)[0]


def runs(samples: DataFrame, wanted: str, tasks: tuple[Task, ...] = TASKS, terms: int = 300) -> list[Run]:
    """A run for each task.  Tasks whose labels are null in the same rows, as where one annotation gives both, share their features."""
    labels = [k.label for k in tasks]
    there = [F.col(c).isNotNull() for c in labels]
    mine = cut(parts(samples, genres=(wanted,)).where(F.greatest(*there, F.lit(False))))
    apart = len(tasks) > 1 and mine.where(F.greatest(*there) != F.least(*there)).limit(1).count() > 0
    out = []
    for some in [(k,) for k in tasks] if apart else [tasks]:
        held = mine.where(F.col(some[0].label).isNotNull())
        found = cut(general_features(held, "doc_id", "text", "kind", terms))
        x = dense(found, "doc_id", feature_names(found), held)
        rows = cut(held.select("doc_id", *dict.fromkeys(k.label for k in some), "part").join(x, "doc_id"))
        for task in some:
            named = rows.select("doc_id", F.col(task.label).alias("gold"), "part", "x")
            train = cut(weights(named.where("part = 'train'").select("doc_id", "gold", "x"), label="gold"))
            out.append(Run(wanted, task, train, named.where("part = 'test'").select("doc_id", "gold", "x")))
    return out


def by_regression(run: Run) -> DataFrame:
    """(doc_id, gold, p): ridge regression on class numbers, cut into classes."""
    fit = ridge.ridge(run.train, y="gold", weight="copies")
    return fit.transform(run.test).select("doc_id", "gold", cut_class(F.col("prediction"), run.task.cuts).alias("p"))


def _vector(rows: DataFrame, label) -> DataFrame:
    return rows.select("doc_id", "gold", label.cast("double").alias("y"), array_to_vector("x").alias("x"), *(["copies"] if "copies" in rows.columns else []))


def _width(rows: DataFrame) -> int:
    one = rows.select(F.size("x").alias("n")).first()
    return one["n"] if one else 0


def by_network(run: Run) -> DataFrame:
    """(doc_id, gold, p): a network over all classes, the first of equal probabilities.  Upsampled rows are copied: it knows no weights."""
    width = _width(run.train)
    copied = run.train.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_")
    model = learners.network(_vector(copied, F.col("gold")), width, len(run.task.classes))
    return model.transform(_vector(run.test, F.col("gold"))).select("doc_id", "gold", argmax(vector_to_array("probability")).alias("p"))


def by_filter(run: Run, t1: float = 0.1, t2: float = 0.0) -> DataFrame:
    """(doc_id, gold, p): a network that knows class 1 and class 2 alone; where neither leads by its threshold the class is 0."""
    width = _width(run.train)
    two = run.train.where("gold in (1, 2)")
    model = learners.network(_vector(two, F.col("gold") - 1), width, 2)
    return model.transform(_vector(run.test, F.lit(0))).select("doc_id", "gold", threshold_class(vector_to_array("probability"), t1, t2).alias("p"))


def scored(run: Run, judged: DataFrame) -> DataFrame:
    """(wanted, of, task, n, accuracy, prec, recall, f1) of every class against the rest; each row is judged once for all of them."""
    return evaluate.one_against_rest(cut(judged), "gold", "p", run.task.numbered()).select(F.lit(run.wanted).alias("wanted"), F.lit(run.task.name).alias("of"), "task", "n", "accuracy", "prec", "recall", "f1")


def write(run: Run, judged: DataFrame, folder: str) -> None:
    """Features and predictions of a run, each in a folder of its own below `folder`, and result files with an element a sample."""
    named = lambda df: df.withColumn("sample_id", F.col("doc_id").cast("string"))
    sinks.write_features(named(run.train.select("doc_id", "x").unionByName(run.test.select("doc_id", "x"))), f"{folder}/features")
    sinks.write_predictions(named(judged).select("sample_id", F.col("p").alias("y")), f"{folder}/predictions")
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("source_id", "string"), ("source_off", "int"), ("source_len", "int"), ("source_text", "string"))]
    rows = judged.select(F.col("doc_id").alias("file"), F.lit("event" if run.task is BELIEF else "entity").alias("kind"), F.col("doc_id").cast("string").alias("target_id"), F.lit(0).alias("off"), F.lit(1).alias("len"), F.lit("x").alias("text"), decode(F.col("p"), run.task.classes).alias("label"), *nothing)
    sinks.write_files(sinks.result_files(sinks.annotations(rows, run.task.name)), f"{folder}/results")
