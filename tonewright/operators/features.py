"""Features: term weights, one-hot columns, embeddings, lexicon scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut

#: A small fixed list of function words of the four languages; pass your own for real corpora.
STOPWORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "by", "this", "de", "la", "que", "el", "les", "et", "der", "die", "und")


#: Words that are broadcast at most, and words that are looked for inside a row at most.
WORDS, INSIDE = 20_000, 2000


def term_arrays(rows: DataFrame, key: str, text: Column, stop: tuple[str, ...] = STOPWORDS, pairs: bool = True, among: list[str] | None = None) -> DataFrame:
    """(key, terms): distinct lower-case words of two characters or more and, after stop words, their neighbours' pairs; of words `among` those alone, if they are given."""
    # Stop words go by one pass of a pattern over the text: a lambda over every word is several times as slow.
    shown = F.regexp_replace(F.lower("_text"), f"(?<![a-z0-9_])(?:{'|'.join(stop)})(?![a-z0-9_])", " ") if stop else F.lower("_text")
    words = F.regexp_extract_all(shown, F.lit("[a-z0-9_]{2,}"), F.lit(0))
    t = rows.select(key, text.alias("_text")).repartition(F.col(key)).select(key, words.alias("w"))
    # Words that are not asked for become null first, so that their pairs are neither written out nor compared.
    t = t if among is None else t.select(key, F.transform("w", lambda x: F.when(x.isin(among), x)).alias("w"))
    if pairs:
        two = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        t = t.select(key, F.concat("w", two).alias("w"))
    return t.select(key, F.array_distinct("w" if among is None else F.array_compact("w")).alias("terms"))


def exploded(found: DataFrame, key: str) -> DataFrame:
    """(key, term): a row for each of the terms.  The outer form keeps Spark from asking, in front of every shuffle, whether there are any: that would cut the texts once more."""
    return found.select(key, F.explode_outer("terms").alias("term")).where("term is not null")


def terms(rows: DataFrame, key: str, text: Column, stop: tuple[str, ...] = STOPWORDS, pairs: bool = True) -> DataFrame:
    """(key, term): a row for each of `term_arrays`."""
    return exploded(term_arrays(rows, key, text, stop, pairs), key)


def top_terms(found: DataFrame, k: int) -> DataFrame:
    """The k terms in most documents (ties by name) with their document frequency: k rows."""
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.col("df").desc(), "term").limit(k)


def most_common(rows: DataFrame, key: str, text: Column, k: int) -> DataFrame:
    """`top_terms` of all `terms`, without counting pairs that cannot be among them.

    A pair stands in no more documents than either of its words, so pairs of two words that are at least as common as the k-th word are enough.
    """
    words = cut(terms(rows, key, text, pairs=False).groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # counted once, asked three times
    best = words.orderBy(F.col("df").desc(), "term").limit(k).collect()
    if len(best) < k:
        return top_terms(terms(rows, key, text), k)
    able = words.where(F.col("df") >= best[-1]["df"]).select("term")
    few = [r["term"] for r in able.limit(INSIDE + 1).collect()]
    if len(few) <= INSIDE:
        both = exploded(term_arrays(rows, key, text, among=few), key).where(F.col("term").contains(" "))
    else:
        shown = F.broadcast if able.limit(WORDS + 1).count() <= WORDS else lambda df: df
        both = terms(rows, key, text).where(F.col("term").contains(" "))
        for name, at in (("_a", 1), ("_b", -1)):
            both = both.withColumn(name, F.substring_index("term", " ", at)).join(shown(able.withColumnRenamed("term", name)), name, "left_semi")
    pairs = both.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    singles = rows.sparkSession.createDataFrame([(r["term"], r["df"]) for r in best], "term string, df long")
    return singles.unionByName(pairs).orderBy(F.col("df").desc(), "term").limit(k)


def tfidf(rows: DataFrame, key: str, text: Column, k: int = 300) -> DataFrame:
    """(key, term, weight): binary term frequency, idf ln((1 + n) / (1 + df)) + 1, each row of length one.

    The k terms are known before the second pass, which makes rows of nothing else.
    """
    top = most_common(rows, key, text, k).collect()
    n = rows.count()
    table = rows.sparkSession.createDataFrame([(r["term"], math.log((1 + n) / (1 + r["df"])) + 1) for r in top], "term string, idf double")
    among = sorted({w for r in top for w in r["term"].split(" ")})
    chosen = F.array_intersect("terms", F.array(*(F.lit(r["term"]) for r in top)).cast("array<string>"))
    held = exploded(term_arrays(rows, key, text, among=among).select(key, chosen.alias("terms")), key).join(F.broadcast(table), "term")  # k rows
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy(key)))
    return held.select(key, "term", F.round(F.col("idf") / norm, 6).alias("weight"))


def one_hot(rows: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """0/1 columns in sorted order of the values; null has none."""
    return rows.select(key, *(F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"is_{v.lower().replace(' ', '_')}") for v in sorted(values)))


def word_vectors(words: DataFrame, vectors: DataFrame, miss: float = 0.01, dim: int = 64) -> DataFrame:
    """Words with their vectors; unknown words have a constant one."""
    return words.join(vectors, "word", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(miss), dim)))


def mean_vector(rows: DataFrame, by: str, vec: str, digits: int = 6) -> DataFrame:
    """(by, vec): elementwise mean, as one aggregation a dimension-free array."""
    cells = rows.select(by, F.posexplode(vec).alias("dim", "v")).groupBy(by, "dim").agg(F.round(F.avg(F.col("v").cast("double")), digits).alias("v"))
    return cells


def mean3(a: Column, b: Column, c: Column) -> Column:
    """Elementwise mean of three vectors."""
    return F.transform(F.zip_with(F.zip_with(a, b, lambda x, y: x + y), c, lambda x, y: x + y), lambda x: x / 3)


def signed_sums(polarities: Column) -> tuple[Column, Column]:
    """Sums of the positive and of the negative values of an array."""
    zero = F.lit(0.0)
    add = lambda keep: F.aggregate(polarities, zero, lambda s, x: s + keep(x, zero))
    return add(F.greatest), add(F.least)


def kinds_union(entity: DataFrame, relation: DataFrame, event: DataFrame) -> DataFrame:
    """The samples of the three kinds under each other, by name, with `kind_rank` for their order."""
    ranked = [df.withColumn("kind_rank", F.lit(k)) for k, df in enumerate((entity, relation, event))]
    return ranked[0].unionByName(ranked[1], allowMissingColumns=True).unionByName(ranked[2], allowMissingColumns=True)
