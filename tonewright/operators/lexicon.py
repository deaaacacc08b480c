"""A polarity lexicon induced from labelled texts, and scores of texts by it.

A word's polarity is the logarithm of how much oftener it occurs in positive texts than in negative ones, as a share of each class's texts,
shrunken twice: every word is counted `PRIOR` times more in the classes' own proportion, and the result is weakened by n / (n + `DOUBT`) for
a word that only n labelled texts hold.  Polarities lie between -1 and 1.  Its subjectivity is the share of texts with either opinion
among those that hold it.

In a text, a negation turns the polarity of the `REACH` words after it within its sentence, and an intensifier just before a word scales it.

Null texts count nothing and score 0; a word in all classes alike has no polarity; the `MOST` words in the most texts are kept and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIOR, DOUBT, REACH, LEAST, MOST = 1.0, 5.0, 3, 2, 20_000
WORDS = "[a-z]+"
#: Words that turn what follows, and words that make the next one stronger or weaker.
NEGATIONS = ("not", "no", "never", "nor", "neither", "without", "cannot", "hardly")
SCALES = {"very": 1.5, "really": 1.5, "so": 1.3, "extremely": 1.8, "too": 1.2, "quite": 1.1, "slightly": 0.5, "somewhat": 0.7, "barely": 0.4}


def counted(rows: DataFrame, text: str = "text", label: str = "y") -> DataFrame:
    """(word, none, neg, pos): how many texts of each class hold a word; unlabelled texts don't count."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)))
    each = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.explode(words).alias("word"))
    return each.groupBy("word").agg(*(F.count_if(F.col("y") == k).alias(n) for k, n in enumerate(("none", "neg", "pos"))))


def polarities(counts: DataFrame, texts: DataFrame, label: str = "y", prior: float = PRIOR, doubt: float = DOUBT, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(word, n, polarity, subjectivity) from `counted` and the labelled texts."""
    total = texts.agg(F.count_if(F.col(label) == 1).alias("all_neg"), F.count_if(F.col(label) == 2).alias("all_pos"))
    n = F.col("none") + F.col("neg") + F.col("pos")
    top = counts.withColumn("n", n).where(F.col("n") >= least).orderBy(F.col("n").desc(), "word").limit(most)
    both = top.crossJoin(F.broadcast(total))  # one row
    rate = lambda k: (F.col(k) + prior * F.col(f"all_{k}") / (F.col("all_neg") + F.col("all_pos"))) / (F.col(f"all_{k}") + prior)
    odds = F.when((F.col("all_neg") > 0) & (F.col("all_pos") > 0), F.log(rate("pos") / rate("neg"))).otherwise(0.0)
    told = F.col("neg") + F.col("pos")
    return both.select("word", "n", F.round(F.tanh(odds * told / (told + doubt) / 2), 6).alias("polarity"), F.round(told / F.col("n"), 6).alias("subjectivity"))


def scoped(words: Column, held: Column, reach: int = REACH) -> Column:
    """The polarities `held` beside the words of a sentence, turned and scaled by the words before them."""
    near = lambda i, k: F.slice(words, F.greatest(i - k + 1, F.lit(1)), F.least(i, F.lit(k)))
    scale = F.create_map(*(F.lit(x) for pair in SCALES.items() for x in pair))

    def one(p: Column, i: Column) -> Column:
        turned = F.size(F.array_intersect(near(i, reach), F.array(*map(F.lit, NEGATIONS)))) > 0
        by = F.coalesce(F.try_element_at(scale, F.get(words, i - 1)), F.lit(1.0))
        return p * F.when(turned, -1.0).otherwise(1.0) * by

    return F.transform(held, one)


def sentences(text: Column) -> Column:
    """A text's sentences as an array: they end at stops and line breaks."""
    return F.split(F.lower(text), r"[.!?\n]+")


def scored(rows: DataFrame, known: DataFrame, key: tuple[str, ...], text: str = "text") -> DataFrame:
    """(key, pos, neg, words): sums of the positive and of the negative polarities of a text in their scopes, and its number of known words."""
    cut = rows.select(*key, F.posexplode_outer(sentences(F.col(text))).alias("_s", "_text")).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORDS), F.lit(0)))
    each = cut.select(*key, "_s", F.posexplode("_words").alias("_at", "word"))
    found = each.join(F.broadcast(known.select("word", "polarity")), "word", "left")
    # The words of a sentence come back together: sentences are bounded where texts are not.
    back = found.groupBy(*key, "_s").agg(F.sort_array(F.collect_list(F.struct("_at", "word", "polarity"))).alias("w"))
    held = back.select(*key, F.transform("w", lambda x: x["word"]).alias("_words"), F.transform("w", lambda x: F.coalesce(x["polarity"], F.lit(0.0))).alias("_held"), F.size(F.filter("w", lambda x: x["polarity"].isNotNull())).alias("_known"))
    add = lambda keep: F.aggregate(scoped(F.col("_words"), F.col("_held")), F.lit(0.0), lambda s, x: s + keep(x, F.lit(0.0)))
    sums = held.select(*key, add(F.greatest).alias("_p"), add(F.least).alias("_n"), "_known").groupBy(*key).agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), F.sum("_known").alias("_k"))
    every = rows.select(*key).distinct().join(sums, list(key), "left")
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 6) + 0.0
    return every.select(*key, zero("_p").alias("pos"), zero("_n").alias("neg"), F.coalesce("_k", F.lit(0)).cast("long").alias("words"))
