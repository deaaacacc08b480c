"""Learned models: rows only, since SQL cannot train them."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cut_class
from ..operators import learners, nets, paragraphs, ridge, sampling, search
from .features import LENGTH, WIDTH, matrix_ids, sequence_ids, vector_table
from .registry import Tables, query
from .scans import GOLD, gold


def features(t: Tables) -> DataFrame:
    """(doc_id, y, x, test): eight text statistics of every annotated document."""
    size = F.length("text") + 1
    # Single characters are counted by taking them out, which is much faster than by patterns.
    without = lambda c: F.length("text") - F.length(F.replace(F.col("text"), F.lit(c)))
    share = lambda chars: sum(map(without, chars[1:]), without(chars[0])) / size
    capitals = F.regexp_count("text", F.lit("[A-Z]")) / size
    x = F.array(F.log(size), capitals, *map(share, ("!", "|", "*$%&#", " ", "\n", ".,")))
    d = t.documents.select("doc_id", array_to_vector(x).alias("x"))
    rows = gold(t).where("y is not null").join(d, "doc_id").select("doc_id", F.col("y").cast("double").alias("y"), "x")
    return rows.withColumn("test", sampling.bucket(F.col("doc_id"), 5) == 0)


_OUT = "(length(text) - length(replace(text, '{c}', '')))"


def _share_sql(chars: str) -> str:
    return "(" + " + ".join(_OUT.format(c=c) for c in chars) + ") / (length(text) + 1)::DOUBLE"


#: The same eight statistics, a row a place of the augmented vector (the constant, eight numbers and the class).
STATISTICS = ["1.0", "ln(length(text) + 1)", "len(regexp_extract_all(text, '[A-Z]')) / (length(text) + 1)::DOUBLE", *map(_share_sql, ("!", "|", "*$%&#", " ", "\n", ".,")), "y::DOUBLE"]
CELLS = f"{GOLD}, z AS (SELECT g.doc_id, [" + ", ".join(STATISTICS).replace("'\n'", "chr(10)") + "] AS z FROM gold g JOIN documents d ON d.doc_id = g.doc_id WHERE y IS NOT NULL)"


@query(f"WITH {CELLS} SELECT (i - 1)::INT AS i, (j - 1)::INT AS j, round(sum(z[i] * z[j]), 6) AS s FROM z, range(1, 11) a(i), range(1, 11) b(j) WHERE i <= j GROUP BY ALL")
def ridge_sums(t):
    """All that a ridge regression needs to know of its rows."""
    return ridge.products(features(t)).select("i", "j", F.round("s", 6).alias("s"))


@query()
def ridge_predict(t):
    rows = features(t)
    out = ridge.ridge(rows.where("not test")).transform(rows.where("test"))
    return out.select("doc_id", F.round("prediction", 6).alias("value"), cut_class(F.col("prediction"), (0.7, 1.7)).alias("y"))


@query()
def ridge_search(t):
    """The mean squared error without each row, for every strength."""
    fit = ridge.ridge(features(t))
    return t.spark.createDataFrame([(a, round(e, 6), int(a == fit.alpha)) for a, e in fit.errors.items()], "alpha double, error double, best int")


SETTINGS = [search.Setting(init=init, hidden=hidden, drop=drop) for init in ("uniform", "normal") for hidden in (16, 32) for drop in (0.0, 0.5)]


@query()
def network_search(t):
    """All settings and folds of a small network, trained side by side, and the best mean score."""
    rows = sampling.folds(features(t).withColumn("all", F.lit(0)), "doc_id", 5, "all")
    return search.search(rows, SETTINGS, folds=5)


@query()
def mlp_predict(t):
    rows = features(t)
    out = learners.network(rows.where("not test"), 8, 3).transform(rows.where("test"))
    return out.select("doc_id", F.col("prediction").cast("int").alias("y"))


@query()
def logit_predict(t):
    rows = features(t).withColumn("y", (F.col("y") != 0).cast("double"))
    out = learners.sparse_logistic(rows.where("not test")).transform(rows.where("test"))
    return out.select("doc_id", F.round(vector_to_array("probability")[1], 6).alias("p"), F.col("prediction").cast("int").alias("y"))


@query()
def ovo_predict(t):
    rows = features(t)
    return learners.one_against_one(rows.where("not test"), rows.where("test"), "doc_id")


@query()
def ovo_margins(t):
    """As `ovo_predict`, with linear margins instead of forests."""
    rows = features(t)
    return learners.one_against_one(rows.where("not test"), rows.where("test"), "doc_id", kind="margin")


@query()
def forest_out_of_bag(t):
    """How well each pair's forest judges rows by trees that have not seen them."""
    return learners.out_of_bag(features(t), "doc_id")


def turn_tokens(t: Tables) -> DataFrame:
    return t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("sample_id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))


@query()
def doc_vectors(t):
    """Paragraph vectors of every turn, 200 long."""
    return paragraphs.fit(turn_tokens(t), "sample_id", "w", paragraphs.Settings(size=200, window=5, rounds=5, kinds=("dm",)))[1]


@query()
def doc_vectors_joined(t):
    """Both kinds of paragraph vectors of every turn side by side, 400 each."""
    return paragraphs.fit(turn_tokens(t), "sample_id", "w", paragraphs.Settings(size=400, window=10))[1]


@query()
def doc_vectors_inferred(t):
    """Vectors of the turns of every fifth conversation, which were not learned from."""
    rows = turn_tokens(t).withColumn("test", sampling.bucket(F.split("sample_id", "-")[0], 5) == 0)
    how = paragraphs.Settings(size=100, window=5, rounds=5)
    tables, _ = paragraphs.fit(rows.where("not test"), "sample_id", "w", how)
    return paragraphs.infer(tables, rows.where("test"), "sample_id", "w", how)


@query()
def external_word_vectors(t):
    """Vectors of the words that occur five times in the documents, 100 long."""
    rows = t.documents.select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    return learners.word_vectors(rows, "w")


def pictures(t: Tables, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, x, y) to learn from and to judge: x holds a turn's ids as its only row; y is 1 for the assistant's turns."""
    rows = ids.select(*KEY, F.array("ids").alias("x"))
    known = rows.join(t.conversations.select(*KEY, (F.col("role") == "assistant").cast("int").alias("y")), list(KEY))
    test = sampling.bucket(F.col("conv_id"), 5) == 0
    return known.where(~test), known.where(test)


def words_first(t: Tables, shape: tuple[int, ...], network: nets.Network) -> nets.Network:
    """`network` behind the vectors of the matrices' ids."""
    return nets.Network([nets.Lookup(vector_table(t, (0.1, 0.01), 0.01), shape), *network.layers])


KEY = ("conv_id", "turn")


@query()
def dense_predict(t):
    """With dropout and early stopping, which Spark's own network lacks."""
    net = words_first(t, (WIDTH, 64), nets.dense(WIDTH * 64, 2))
    return nets.fit_predict(*pictures(t, matrix_ids(t)), KEY, (WIDTH,), net, epochs=20, patience=3)


@query()
def cnn_predict(t):
    net = words_first(t, (WIDTH, 64, 1), nets.convolutional(WIDTH, 64, 2))
    return nets.fit_predict(*pictures(t, matrix_ids(t)), KEY, (WIDTH,), net, epochs=2, at_once=32)


@query()
def cnn_deep_predict(t):
    """Two layers of filters and a wider hidden layer."""
    net = words_first(t, (WIDTH, 64, 1), nets.convolutional(WIDTH, 64, 2, (32, 64), 128, 0.25))
    return nets.fit_predict(*pictures(t, matrix_ids(t)), KEY, (WIDTH,), net, epochs=3, batch=32, at_once=32)


@query()
def lstm_predict(t):
    net = nets.Network([nets.Lookup(vector_table(t, (0.0,), 0.0), (LENGTH, 64)), *nets.recurrent(64, 2).layers])
    return nets.fit_predict(*pictures(t, sequence_ids(t)), KEY, (LENGTH,), net, epochs=1, at_once=32)
