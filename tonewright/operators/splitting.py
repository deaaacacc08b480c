"""Sentence splitting that learns from the texts at hand which full stops end a sentence.

Nothing is labelled.  Log-likelihood ratios over counts of the whole corpus tell three things:

* abbreviations: words that nearly always carry a stop, the likelier the shorter they are, the more stops they have inside and the less
  often they stand without one;
* starters: words that follow a sure end of a sentence more often than chance;
* pairs: words that follow an abbreviation or a number with a stop more often than chance, and so belong to it.

A stop after an abbreviation or after "..." ends a sentence only before a capitalised starter that is no pair with it; other stops, "!", "?" and
line breaks always do.  Counting needs no order and no window: a word's successor is its neighbour in the text's own array.

Every word and pair that reaches its threshold is known.  Kinds of knowledge of up to `MOST` rows are broadcast; of a larger one each text is given, by a join,
what its own places ask for.

Null texts have no sentences; sentences joined give back the text, white space included; a corpus without stops has no abbreviations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut
from .spans import dealt

#: A word with the white space behind it; that before the first word is a piece of its own.
WORD = r"[^ \t\r\n]+[ \t\r\n]*"
PIECE = WORD + r"|[ \t\r\n]+"
#: What a piece holds that may end a sentence.
MAY_END = r"[.!?\n]"
SPACE, OPENING, CLOSING = " \t\r\n", "\"'([{", "\"')]},;:"
#: The published thresholds of the three ratios, and how sure a stop after an abbreviation is.
ABBREVIATION, STARTER, PAIR, SURE = 0.3, 30.0, 7.88, 0.99
#: Rows up to which a kind of knowledge is broadcast; a larger one is joined.
MOST = 20_000
#: Pieces that a task remembers, texts that it cuts at a time, and the patterns it cuts by.
MOST_FACTS, AT_ONCE = 200_000, 256
PIECES, NUMBER = re.compile(PIECE), re.compile(r"[0-9][0-9.,]*")


def bare(piece: Column) -> Column:
    """A piece without white space, opening and closing signs."""
    return F.ltrim(F.rtrim(F.rtrim(piece, F.lit(SPACE)), F.lit(CLOSING)), F.lit(OPENING))


def kind(word: Column) -> Column:
    """What counts as one word: lower case, without stops at its end; all numbers are `#`."""
    plain = F.rtrim(F.lower(word), F.lit("."))
    return F.when(plain.rlike(r"^[0-9][0-9.,]*\z"), "#").otherwise(plain)


def words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, stop, over, next, n): how often a word, with a stop or at a sure end of a sentence or without, stands (before another).

    `next` is null at the end of a text and of words with neither a stop nor an end.  Pieces are counted as they are written, and only then
    bared: there are far fewer of these than places.  This is the only pass over the texts.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    pairs = F.transform("p", lambda p, i: F.struct(p.alias("piece"), F.when(p.rlike(MAY_END), F.get(F.col("p"), i + 1)).alias("after")))
    each = docs.select(found.alias("p")).select(F.explode(pairs).alias("x")).groupBy("x.piece", "x.after").agg(F.count(F.lit(1)).alias("n"))
    each = each.select("piece", bare(F.col("piece")).alias("word"), bare(F.col("after")).alias("after"), "n")
    stop, over = F.col("word").endswith(".") & ~F.col("word").endswith(".."), F.col("piece").contains("\n") | F.col("word").rlike(r"[!?]\z")
    told = each.select(kind(F.col("word")).alias("kind"), stop.alias("stop"), over.alias("over"), F.when(stop | over, kind(F.col("after"))).alias("next"), "n")
    return told.groupBy("kind", "stop", "over", "next").agg(F.sum("n").alias("n"))


def _told(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k hits out of n at rate p; nothing times an infinity is nothing."""
    part = lambda times, rate: F.when(times > 0, times * F.log(rate)).otherwise(0.0)
    return part(k, p) + part(n - k, 1 - p)


def ratio(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """How unlikely it is that `ab` of the `a` places with one thing also have another, which `b` of all `n` places have."""
    a, b, ab, n = (c.cast("double") for c in (a, b, ab, n))
    rest = F.greatest(n - a, F.lit(1.0))
    one = _told(ab, a, b / n) + _told(b - ab, rest, b / n)
    return 2 * (_told(ab, a, ab / a) + _told(b - ab, rest, (b - ab) / rest) - one)


def abbreviations(found: DataFrame) -> DataFrame:
    """(kind, stopped, plain, score) of every kind that has a letter and stands with a stop at least once."""
    n = found.groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("stopped"))
    total = n.agg(F.sum("n").alias("all"), F.sum("stopped").alias("stops"))
    each = n.where("stopped > 0").where(F.col("kind").rlike("[^0-9._,#-]")).crossJoin(F.broadcast(total))  # one row
    stopped, plain = F.col("stopped").cast("double"), (F.col("n") - F.col("stopped")).cast("double")
    rate = F.col("stops") / F.col("all")
    sure = 2 * (_told(stopped, stopped + plain, F.lit(SURE)) - _told(stopped, stopped + plain, rate))
    size = F.length(F.replace(F.col("kind"), F.lit("."), F.lit("")))
    inside = F.length("kind") - size
    score = sure * F.exp(-size) * (inside + 1) * F.pow(size.cast("double"), -plain)
    return each.where(size > 0).select("kind", "stopped", (F.col("n") - F.col("stopped")).alias("plain"), score.alias("score"))


@dataclass
class Known:
    """What a corpus told: (kind, score) of abbreviations and starters, (kind, next, score) of pairs: all that reach their thresholds."""

    short: DataFrame
    starters: DataFrame
    pairs: DataFrame


def learned(docs: DataFrame, text: str = "text") -> Known:
    """From one pass over the texts; what follows works on the table of counted pairs."""
    found = cut(words(docs, text))
    short = cut(abbreviations(found).where(F.col("score") >= ABBREVIATION).select("kind", "score"))
    marked = found.join(short.select("kind", F.lit(True).alias("short")), "kind", "left").withColumn("short", F.coalesce("short", F.lit(False)))
    counts = found.groupBy("kind").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    sure = marked.where("next is not null and (over or (stop and not short))")
    after = sure.groupBy(F.col("next").alias("kind")).agg(F.sum("n").alias("ab"))
    breaks = sure.agg(F.sum("n").alias("a"))
    each = after.join(counts, "kind").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(breaks))  # one row each
    often = F.col("ab") / F.col("a") > F.col("n") / F.col("all")
    score = ratio(F.col("a"), F.col("n"), F.col("ab"), F.col("all")).alias("score")
    starters = cut(each.where(often).where(F.col("kind").rlike(r"^[^0-9._,#-]+\z")).select("kind", score).where(F.col("score") >= STARTER))
    joined = marked.where("stop and next is not null and (short or kind = '#')").groupBy("kind", "next").agg(F.sum("n").alias("ab"))
    both = joined.join(counts.withColumnRenamed("n", "a"), "kind").join(counts.select(F.col("kind").alias("next"), "n"), "next").crossJoin(F.broadcast(total))
    both = both.where(F.col("ab") / F.col("a") > F.col("n") / F.col("all")).join(starters.select(F.col("kind").alias("next")), "next", "left_anti")
    return Known(short, starters, cut(both.select("kind", "next", score).where(F.col("score") >= PAIR)))


class _Facts(dict):
    """What a piece and its lower case tell by themselves: (kind, whether it ends for sure, ends if nothing holds it back, is an ellipsis, is capitalised)."""

    def __missing__(self, piece: tuple[str, str]) -> tuple[str, bool, bool, bool, bool]:
        if len(self) > MOST_FACTS:
            self.clear()
        word, lower = (x.rstrip(SPACE).rstrip(CLOSING).lstrip(OPENING) for x in piece)
        plain = lower.rstrip(".")
        plain = "#" if NUMBER.fullmatch(plain) else plain
        sure = "\n" in piece[0] or word.endswith(("!", "?"))
        found = self[piece] = (plain, sure, word.endswith("."), word.endswith(".."), "A" <= word[:1] <= "Z")
        return found


def _places(said: str, lower: str, facts: _Facts) -> tuple[list[str], Iterator[tuple[int, tuple, tuple | None]]]:
    """A text's pieces, and for each that may end a sentence its number, what it tells and, behind a stop that is not sure, what the next one tells."""
    cut = PIECES.findall(said)
    low = cut if said.isascii() else PIECES.findall(lower)
    told = lambda i: facts[cut[i], cut[i].lower() if low is cut else low[i]]
    may_end = re.compile(MAY_END).search

    def places():
        for i in [i for i, x in enumerate(cut) if may_end(x)]:
            mine = told(i)
            yield i, mine, told(i + 1) if mine[2] and not mine[1] and i + 1 < len(cut) else None

    return cut, places()


#: Kinds of knowledge, and what a place asks each of them for.
KINDS = {"short": ("kind",), "starters": ("next",), "pairs": ("kind", "next")}


def _asked(given: DataFrame) -> DataFrame:
    """(h, kind, next): what the places of texts ask for, by the hash of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = _Facts()
        for whole in batches:
            for a in range(0, len(whole), AT_ONCE):
                b = whole.slice(a, AT_ONCE)
                rows = set()
                for h, said, lower in zip(*(b.column(c).to_pylist() for c in ("h", "text", "lower")), strict=True):
                    rows |= {(h, mine[0], after and after[0]) for _, mine, after in _places(said, lower, facts)[1] if mine[2] and not mine[1]}
                yield pa.RecordBatch.from_pylist([{"h": h, "kind": k, "next": n} for h, k, n in rows], pa.schema([("h", pa.int64()), ("kind", pa.string()), ("next", pa.string())]))

    return given.select("h", "text", "lower").mapInArrow(run, "h long, kind string, next string")


def split(docs: DataFrame, known: Known, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, off, sent): the sentences of each text in order, with their offsets in code points.

    A text is cut in its own row, by what is known, so nothing is sorted or put together again.  Knowledge beyond `MOST` rows of a kind comes to the texts that ask for it; equal hashes
    of different texts do no harm, since each of these is then given what both ask for.
    """
    told = {"short": known.short.select("kind"), "starters": known.starters.select(F.col("kind").alias("next")), "pairs": known.pairs.select("kind", "next")}
    few = {k: df.limit(MOST + 1).collect() for k, df in told.items()}
    large = [k for k in KINDS if len(few[k]) > MOST]
    plain = lambda k, rows: {r[KINDS[k][0]] if len(KINDS[k]) == 1 else (r["kind"], r["next"]) for r in rows}
    shipped = docs.sparkSession.sparkContext.broadcast({k: plain(k, few[k]) for k in KINDS if k not in large})
    given = dealt(docs.where(F.col(text).isNotNull()), (key,), text).select(F.col(key).alias("key"), F.col(text).alias("text"), F.lower(text).alias("lower"))
    shape = given.select("key").schema.add("pos", "integer").add("off", "integer").add("sent", "string")
    if large:
        given = given.withColumn("h", F.xxhash64("text"))
        asked = _asked(given)
        for k in large:
            mine = asked.select("h", *KINDS[k]).distinct().join(told[k], list(KINDS[k]), "left_semi")
            given = given.join(mine.groupBy("h").agg(F.collect_list(F.struct(*KINDS[k])).alias(k)), "h", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts, held = _Facts(), shipped.value
        for whole in batches:
            for a in range(0, len(whole), AT_ONCE):
                b = whole.slice(a, AT_ONCE)
                row, pos, off, sent = [], [], [], []
                own = {k: b.column(k).to_pylist() for k in large}
                for k, (said, lower) in enumerate(zip(b.column("text").to_pylist(), b.column("lower").to_pylist(), strict=True)):
                    short, starters, pairs = (plain(x, own[x][k] or ()) if x in own else held[x] for x in KINDS)
                    cut, places = _places(said, lower, facts)
                    upto, start, n = list(accumulate(map(len, cut))), 0, 0
                    for i, (kind, sure, stop, dots, _), after in places:
                        ends = sure or (stop and not dots and kind not in short)
                        if after and not ends:
                            ends = after[4] and after[0] in starters and (kind, after[0]) not in pairs
                        if ends:
                            row.append(k)
                            pos.append(n)
                            off.append(start)
                            sent.append(said[start : upto[i]])
                            start, n = upto[i], n + 1
                    if start < len(said):
                        row.append(k)
                        pos.append(n)
                        off.append(start)
                        sent.append(said[start:])
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(row, pa.int32())), pa.array(pos, pa.int32()), pa.array(off, pa.int32()), pa.array(sent, pa.string())], names=["key", "pos", "off", "sent"])

    return given.mapInArrow(run, shape).withColumnRenamed("key", key)
