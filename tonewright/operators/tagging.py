"""Part-of-speech tags by a hidden Markov model: counted in Spark, decoded for each sentence by itself.

The counts are sums over the corpus: pairs of neighbouring tags, words with their tag, and endings of words with their tag.  The most
frequent words and endings, a bounded number, and the tags' square table are broadcast; a sentence's most probable tags are found
by dynamic programming over its words.  A word that was not counted is judged by its ending: what its longest counted ending says,
backed off to ever shorter ones.

Words without a tag count nothing, and neither do pairs with one; null words are empty words; an empty sentence has no tags; of equally
probable tags the first by name is taken from the end backwards; without any counts there are no tags.
Words are told apart by whether they begin with a capital, and not by any other case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Letters of an ending at most, words and endings that are kept at most, and what every pair of tags is counted besides.
ENDING, MOST, LEAST = 3, 20_000, 0.1
START = "^"


def transitions(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """(before, tag, n): neighbouring tags; the first of a sentence stands after `^`."""
    pair = F.transform(tags, lambda t, i: F.struct(F.when(i > 0, F.get(F.col(tags), i - 1)).otherwise(START).alias("before"), t.alias("tag")))
    return rows.select(F.explode(pair).alias("p")).select("p.*").where("before is not null and tag is not null").groupBy("before", "tag").agg(F.count(F.lit(1)).alias("n"))


def spelled(word: Column) -> Column:
    """A word as it is counted: in lower case but for a capital at its start."""
    return F.when(word.rlike("^[A-Z]"), F.concat(F.substring(word, 1, 1), F.lower(F.substring(word, 2, 1 << 30)))).otherwise(F.lower(word))


def emissions(rows: DataFrame, words: str = "words", tags: str = "tags") -> DataFrame:
    """(word, tag, n): words as they are spelled with their tags."""
    both = F.zip_with(words, tags, lambda w, t: F.struct(spelled(F.coalesce(w, F.lit(""))).alias("word"), t.alias("tag")))
    return rows.select(F.explode(both).alias("p")).select("p.*").where("tag is not null").groupBy("word", "tag").agg(F.count(F.lit(1)).alias("n"))


def endings(words: DataFrame, most: int = ENDING) -> DataFrame:
    """(ending, tag, n) from `emissions`: the last 0 to `most` letters and whether a capital begins the word (A or a).

    Each word counts once a tag, since new words are rare words.
    """
    low, capital = F.lower("word"), F.when(F.col("word").rlike("^[A-Z]"), "A").otherwise("a")
    cut = lambda k: F.concat(F.substring(low, F.length("word") - k + 1, k), capital)
    each = words.select("tag", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.length("word"), F.lit(most))), cut)).alias("ending"))
    return each.groupBy("ending", "tag").agg(F.count(F.lit(1)).alias("n"))


def _top(counts: DataFrame, key: str) -> DataFrame:
    """The counts of the most frequent keys."""
    top = counts.groupBy(key).agg(F.sum("n").alias("_n")).orderBy(F.col("_n").desc(), key).limit(MOST).select(key)
    return counts.join(F.broadcast(top), key)


@dataclass
class Model:
    """Logarithms: of a tag after another (row `len(tags)` is the start), of known words given a tag, of tags given an ending, and of tags."""

    tags: list[str]
    pairs: np.ndarray
    words: dict[str, np.ndarray]
    endings: dict[str, np.ndarray]
    share: np.ndarray

    def given(self, word: str) -> np.ndarray:
        """The logarithm of a word's probability given each tag, up to a factor that is the same for all of them."""
        low, capital = word.lower(), "A" <= word[:1] <= "Z"
        key = word[0] + word[1:].lower() if capital else low
        if key in self.words:
            return self.words[key]
        ends = (low[len(low) - k :] + "aA"[capital] for k in range(min(ENDING, len(low)), -1, -1))
        return self.endings[next((e for e in ends if e in self.endings), "")] - self.share

    def tagged(self, words: list[str]) -> list[str]:
        """The most probable tags of a sentence."""
        if not words or not self.tags:
            return []
        best, back = self.pairs[-1] + self.given(words[0]), []
        for w in words[1:]:
            way = best[:, None] + self.pairs[:-1]
            back.append(way.argmax(axis=0))
            best = way.max(axis=0) + self.given(w)
        at = [int(best.argmax())]
        for b in reversed(back):
            at.append(int(b[at[-1]]))
        return [self.tags[k] for k in reversed(at)]


def model(pairs: DataFrame, words: DataFrame, ends: DataFrame) -> Model:
    """From the three counts; at most `MOST` words and endings reach the driver."""
    near = {(r["before"], r["tag"]): r["n"] for r in pairs.collect()}  # the tags' square table
    told = [(r["word"], r["tag"], r["n"]) for r in _top(words, "word").collect()]
    last = [(r["ending"], r["tag"], r["n"]) for r in _top(ends, "ending").collect()]
    of = {r["tag"]: r["n"] for r in words.groupBy("tag").agg(F.sum("n").alias("n")).collect()}
    tags = sorted(of)
    number, size = {t: k for k, t in enumerate(tags)}, np.array([of[t] for t in tags], float)
    table = np.array([[near.get((b, t), 0) + LEAST for t in tags] for b in [*tags, START]])
    table = np.log(table / table.sum(axis=1, keepdims=True)) if tags else table
    held: dict[str, np.ndarray] = {}
    for w, t, n in told:
        held.setdefault(w, np.zeros(len(tags)))[number[t]] = n
    # A little of every tag, in the share that it has of all words, so that a pair of tags may outweigh what was counted.
    share = size / size.sum() if tags else size
    known = {w: np.log((n + LEAST * share) / size) for w, n in held.items()}
    return Model(tags, table, known, _backed_off(last, number), np.log(share))


def _backed_off(last: list[tuple[str, str, int]], number: dict[str, int]) -> dict[str, np.ndarray]:
    """Tags given an ending: its own shares, mixed half and half with those of the ending that is a letter shorter."""
    held: dict[str, np.ndarray] = {"": np.zeros(len(number))}
    for e, t, n in last:
        held.setdefault(e, np.zeros(len(number)))[number[t]] = n
    out: dict[str, np.ndarray] = {}
    for e in sorted(held, key=len):
        n = held[e]
        below = next((out[e[k:]] for k in range(1, len(e) + 1) if e[k:] in out), np.full(len(n), 1 / max(1, len(n))))
        out[e] = (n / n.sum() + below) / 2 if n.sum() else below
    return {e: np.log(p) for e, p in out.items()}


def tag(rows: DataFrame, known: Model, words: str = "words") -> DataFrame:
    """`rows` with `tags`, an array beside that of the words."""
    shipped, shape = rows.sparkSession.sparkContext.broadcast(known), rows.schema.fromJson(rows.schema.jsonValue()).add("tags", ArrayType(StringType()))
    place = rows.columns.index(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            tags = [None if w is None else m.tagged([x or "" for x in w]) for w in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tags, pa.list_(pa.string()))], names=shape.names)

    return rows.mapInArrow(run, shape)


#: Words that have one tag in English, by tag.
CLOSED = {
    "DT": "a an the this that these those each every some any no",
    "IN": "of in on at by for with from into over under about after before between through during against",
    "PRP": "i you he she it we they me him her us them",
    "CC": "and or but nor",
    "TO": "to",
    "MD": "will would can could may might must shall should",
    "VB": "is are was were be been am do does did has have had",
    "RB": "not never very too also often always here there now then",
}


def seed(word: Column, before: Column) -> Column:
    """The tag of a word that shows it by itself or by the word before, else null: closed classes, numbers, names, clear endings."""
    low = F.lower(word)
    out = F.when(word.rlike("^[0-9]"), "CD")
    for t, listed in CLOSED.items():
        out = out.when(low.isin(*listed.split()), t)
    out = out.when(before.isNotNull() & word.rlike("^[A-Z][a-z]"), "NNP").when(low.rlike("[a-z]{2}ing$"), "VBG").when(low.rlike("[a-z]{2}ed$"), "VBD").when(low.rlike("[a-z]{2}ly$"), "RB")
    out = out.when(low.rlike("[a-z]{2}(ous|ful|ble|ive|al)$"), "JJ").when(low.rlike("[a-z]{2}(tion|ment|ness|ity)$"), "NN").when(low.rlike("[a-z]{3}[^s]s$"), "NNS")
    return out.when(F.lower(before).isin(*CLOSED["DT"].split()), "NN")


def seeded(words: Column) -> Column:
    """The seed tags beside an array of words."""
    return F.transform(words, lambda w, i: seed(w, F.when(i > 0, F.get(words, i - 1))))

