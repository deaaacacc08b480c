"""Words of a script without spaces: a dictionary learned from the corpus, then the most probable way through each run of characters.

A string is a word if its characters hold together and its neighbours vary: of all places to cut it in two, even the best one has its halves
meeting far more often than by chance (cohesion), and the characters before and after it are spread (branching entropy).  All of it comes
from one table, the counts of strings of up to one character more than a word: a string and its next character are a longer string.
The edges of a run are neighbours of their own kind.

The most frequent words, `MOST` at most, and the single characters are broadcast.  A run is cut where the product of its words' shares is
greatest, the longest first word of ties; offsets are those of the text, in code points.

Null texts have no runs; a character that was never counted is a word by itself; empty tables give no words.
Characters beyond the basic plane are not counted as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chinese characters, and what stands for the edge of a run.
HAN, EDGE = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]+", "\n"
#: Characters of a word at most, and words that are kept at most.
LONGEST, MOST = 4, 20_000
#: How often a word occurs, how many times oftener than by chance its halves meet (a logarithm), and the least spread on either side.
OFTEN, COHESION, SPREAD = 5, 2.0, 0.8


def runs(docs: DataFrame, text: str = "text", pattern: str = HAN) -> DataFrame:
    """(run): the runs of every text, their edges marked."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("r")
    return docs.select(found).select(F.concat(F.lit(EDGE), "r", F.lit(EDGE)).alias("run"))


def strings(found: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(s, n): how often each string of up to `longest` characters, and of one more, occurs; strings may touch an edge but are more than that."""
    # What stands at each place is counted before it is cut into its beginnings: each is a row a task at most.
    ahead = F.regexp_extract_all("run", F.lit(f"(?=([\\s\\S]{{1,{longest + 1}}}))"), F.lit(1))
    places = found.select(F.explode(ahead).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("m"))
    each = places.select("m", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.substring(F.col("w"), F.lit(1), k))).alias("s")).where(F.col("s") != EDGE)
    return each.groupBy("s").agg(F.sum("m").alias("n"))


def _spread(counts: DataFrame, inner: Column, name: str) -> DataFrame:
    """(s, name): the entropy of the characters on one side of a string."""
    # A string has no more neighbours than there are characters: a bounded list.
    total = counts.groupBy(inner.alias("s")).agg(F.sum("n").alias("_all"), F.collect_list(F.col("n").cast("double")).alias("_n"))
    return total.select("s", F.aggregate("_n", F.lit(0.0), lambda a, x: a - x / F.col("_all") * F.log(x / F.col("_all"))).alias(name))


def candidates(counts: DataFrame, longest: int = LONGEST, often: int = OFTEN) -> DataFrame:
    """(word, n, cohesion, before, after) of strings of 2 to `longest` characters that occur `often` times."""
    inside = counts.where(~F.col("s").contains(EDGE))
    total = inside.where(F.length("s") == 1).agg(F.sum("n").cast("double").alias("total"))
    many = inside.where(F.length("s").between(2, longest) & (F.col("n") >= often))
    halves = many.select("s", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda k: F.struct(F.substring(F.col("s"), F.lit(1), k).alias("a"), F.substring(F.col("s"), k + 1, F.length("s") - k).alias("b")))).alias("h")).select("s", "n", "h.*")
    one = lambda c: inside.select(F.col("s").alias(c), F.col("n").alias(f"n_{c}"))
    met = halves.join(one("a"), "a").join(one("b"), "b").crossJoin(F.broadcast(total))  # one row
    held = met.groupBy("s").agg(F.first("n").alias("n"), F.min(F.log(F.col("n") * F.col("total") / (F.col("n_a").cast("double") * F.col("n_b")))).alias("cohesion"))
    longer = counts.where(F.length("s").between(3, longest + 1))
    size = F.length("s")
    before = _spread(longer.where(~F.substring("s", 2, longest).contains(EDGE)), F.substring(F.col("s"), F.lit(2), size - 1), "before")
    after = _spread(longer.where(~F.substring(F.col("s"), F.lit(1), size - 1).contains(EDGE)), F.substring(F.col("s"), F.lit(1), size - 1), "after")
    return held.join(before, "s").join(after, "s").withColumnRenamed("s", "word")


@dataclass
class Dictionary:
    """Logarithms of the words' shares; an unknown character has the least of all."""

    shares: dict[str, float]
    least: float
    longest: int

    def cut(self, run: str) -> list[str]:
        """The most probable words of a run."""
        best, size = [(0.0, 0)] * (len(run) + 1), len(run)
        for i in range(size - 1, -1, -1):
            ways = []
            for k in range(1, min(self.longest, size - i) + 1):
                share = self.shares.get(run[i : i + k], self.least if k == 1 else None)
                if share is not None:
                    ways.append((share + best[i + k][0], k))
            best[i] = max(ways)
        out, i = [], 0
        while i < size:
            out.append(run[i : i + best[i][1]])
            i += best[i][1]
        return out


def dictionary(counts: DataFrame, found: DataFrame, longest: int = LONGEST, cohesion: float = COHESION, spread: float = SPREAD) -> Dictionary:
    """The words among the candidates and all single characters, `MOST` of each at most."""
    chosen = found.where((F.col("cohesion") >= cohesion) & (F.col("before") >= spread) & (F.col("after") >= spread)).select("word", "n")
    single = counts.where((F.length("s") == 1) & (F.col("s") != EDGE)).select(F.col("s").alias("word"), "n")
    top = lambda df: df.orderBy(F.col("n").desc(), "word").limit(MOST).collect()
    rows = [*top(chosen), *top(single)]
    total = sum(r["n"] for r in rows)
    return Dictionary({r["word"]: math.log(r["n"] / total) for r in rows}, math.log(0.5 / max(1, total)), longest)


def segmented(docs: DataFrame, known: Dictionary, key: str = "doc_id", text: str = "text", pattern: str = HAN) -> DataFrame:
    """(key, off, word) of every word in the runs of each text."""
    # Where runs start: what is left between them is matched too, so that offsets add up.
    shipped = docs.sparkSession.sparkContext.broadcast(known)
    piece = F.regexp_extract_all(F.col(text), F.lit(f"{pattern}|{_other(pattern)}"), F.lit(0))
    given = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), piece.alias("p"), F.transform(piece, lambda p: p.rlike(f"^{pattern}$")).alias("is_run"))
    shape = given.select("key").schema.add("off", "integer").add("word", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = shipped.value.cut
        for b in batches:
            rows, offs, words = [], [], []
            for n, (parts, hits) in enumerate(zip(b.column("p").to_pylist(), b.column("is_run").to_pylist(), strict=True)):
                at = 0
                for part, hit in zip(parts, hits, strict=True):
                    for w in cut(part) if hit else ():
                        rows.append(n)
                        offs.append(at)
                        words.append(w)
                        at += len(w)
                    at += 0 if hit else len(part)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows, pa.int64())), pa.array(offs, pa.int32()), pa.array(words, pa.string())], names=shape.names)

    return given.mapInArrow(run, shape).withColumnRenamed("key", key)


def _other(pattern: str) -> str:
    """What a class of characters with a plus leaves out."""
    return "[^" + pattern[1:]
