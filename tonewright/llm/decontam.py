"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased.  An item's seeds are its n-grams (`GRAM` words, or the whole item if it
is shorter) but for the `COMMON`-th part of them that most passages hold.  Items of `WHOLE` + 1 to `SHORT` words have all their pairs of
words as seeds instead.

1. Every document is scanned once.  Its n-grams are looked up in a bitmap of the items' n-grams, whose size is bounded
   whatever the items are; where hits lie close together they and the words around them, as far as an alignment with the longest
   item may reach, are a passage.
2. How many passages hold an n-gram says which of an item's n-grams are common; the rest are its seeds.
3. Passages are joined with items on the seeds' hashes.  Those that share `HITS` different seeds (or all that the
   item has) are candidates.
4. Candidates are aligned: where the seeds lie close together, and enough of the item's words for the threshold occur around
   them, the item is aligned with the words there, locally, with match 1, mismatch and gap -1.  A document is
   contaminated if the best alignment reaches `THRESHOLD` of the score of a verbatim copy, and `LEAST` (or the verbatim score) at least.

Every copy of an item of up to `SHORT` words is found: between runs of matches an alignment loses a point, so one that scores 3 holds
two neighbouring pairs of the item.  Copies of longer items so broken up that fewer than `HITS` of the seeds are left are not found.  The common part is a share of the
item's own n-grams and not a bound on their counts, so a copy that many documents hold loses no more seeds than that.

Defined results: null texts and wordless items match nothing; a text of any length is read whole, in the memory that its
words take; repeated documents each have their rows; repeated items count once; every pair of document and item over
the threshold has one row, the best alignment (the first of ties); empty tables give empty results; other columns
are not read, and `clean` returns them as they were.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut
from .substring import BASE, _Hashes, rolled, word_hashes

GRAM, HITS, THRESHOLD = 3, 2, 0.5
#: Words of items that are seeds as a whole, most words of items with pairs for seeds, and the least score of a copy of all but the first.
WHOLE, SHORT, LEAST = 3, 12, 3
#: One n-gram in so many of an item is no seed: those that the most passages hold.
COMMON = 8
#: Bits of the bitmap, as a power of two: for each n-gram `SPARE` more at least, up to 16 MB; and of a part of it.
LEAST_BITS, SPARE_BITS, MOST_BITS, PART_BITS = 16, 8, 27, 21
_WORDS = re.compile(r"[^\W_]+").findall


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower())


def gram_hashes(each: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every `size` words; those of another size differ."""
    return rolled(each, size, BASE) + np.uint64(size)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(score, end in text) of the best local alignment, the first end of ties; match 1, mismatch and gap -1."""
    step = np.arange(len(text) + 1)
    last, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for w in item.tolist():
        now = np.maximum(last - 1, 0)
        np.maximum(now[1:], last[:-1] + np.where(text == w, 1, -1), out=now[1:])
        now = np.maximum.accumulate(now + step) - step  # gaps in the item
        top = int(now.max())
        if top >= best and top:
            at = int(now.argmax())
            if top > best or at < end:
                best, end = top, at
        last = now
    return best, end


def span(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, start, stop) of the best local alignment."""
    score, stop = align(item, text)
    _, back = align(item[::-1], text[:stop][::-1])
    return score, stop - back, stop


def _clusters(places: np.ndarray, gap: int):
    cuts = np.flatnonzero(np.diff(places) > gap) + 1
    edges = [0, *cuts.tolist(), len(places)]
    return zip(edges[:-1], edges[1:], strict=True)


def item_rows(benchmark: DataFrame, gram: int) -> DataFrame:
    """(item, item_id, words, n, size, grams, spare): the distinct items that have words; words are joined by spaces.

    `spare` is null, or for items with pairs for seeds the number of places whose pair stands elsewhere in the item too.
    """

    def run(batches):
        known = _Hashes()
        for b in batches:
            ids, rows = b.column("item_id"), [words_of(t) for t in b.column("text").to_pylist()]
            keep = [k for k, w in enumerate(rows) if w]
            rows = [rows[k] for k in keep]
            paired = [WHOLE < len(w) <= SHORT for w in rows]
            sizes = [min(2 if two else gram, len(w)) for w, two in zip(rows, paired, strict=True)]
            grams = [np.unique(gram_hashes(word_hashes(w, known), n)).view(np.int64) for w, n in zip(rows, sizes, strict=True)]
            columns = [ids.take(pa.array(keep, pa.int64())), pa.array([" ".join(w) for w in rows], pa.string()), pa.array([len(w) for w in rows], pa.int32()), pa.array(sizes, pa.int32()), pa.array(grams, pa.list_(pa.int64()))]
            spare = [len(w) - 1 - len(g) if two else None for w, g, two in zip(rows, grams, paired, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spare, pa.int32())], ["item_id", "words", "n", "size", "grams", "spare"])

    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    found = tests.mapInArrow(run, "item_id long, words string, n int, size int, grams array<long>, spare int")
    return cut(found.withColumn("item", F.monotonically_increasing_id()))


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bits at the high `bits` bits of each hash `h`: at most 2 ** (bits - 3) bytes reach the driver."""
    low = min(bits, PART_BITS)

    def pack(table: pa.Table) -> pa.Table:
        at = np.unique(table.column("at").to_numpy())
        held = np.zeros(1 << low, np.uint8)
        held[at] = 1
        return pa.table({"part": table.column("part")[:1], "held": pa.array([zlib.compress(np.packbits(held).tobytes(), 1)], pa.binary())})

    place = F.shiftrightunsigned("h", 64 - bits)
    parts = hashes.select(F.shiftright(place, low).cast("int").alias("part"), place.bitwiseAND((1 << low) - 1).cast("int").alias("at")).distinct()
    out = np.zeros(1 << bits, np.uint8)
    for r in parts.groupBy("part").applyInArrow(pack, "part int, held binary").collect():
        out[r["part"] << low : (r["part"] + 1) << low] = np.unpackbits(np.frombuffer(zlib.decompress(r["held"]), np.uint8))
    return np.packbits(out)


def passages(rows: DataFrame, held: np.ndarray, bits: int, sizes: list[int], reach: int, least: int) -> DataFrame:
    """(pid, rid, key, words, first, grams) from (key, text): stretches with `least` or more different n-grams of items, and what is around."""
    shipped = rows.sparkSession.sparkContext.broadcast(held)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        marks, known = shipped.value, _Hashes()
        for b in batches:
            out = []
            for k, text in enumerate(b.column("text").to_pylist()):
                words = words_of(text)
                each = word_hashes(words, known)
                places, codes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
                for size in sizes:
                    h = gram_hashes(each, size)
                    at = h >> np.uint64(64 - bits)
                    hit = np.flatnonzero((marks[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1)
                    places.append(hit)
                    codes.append(h[hit])
                places, codes = np.concatenate(places), np.concatenate(codes)
                if len(sizes) > 1:
                    order = np.argsort(places, kind="stable")
                    places, codes = places[order], codes[order]
                if not len(places):
                    continue
                for lo, hi in _clusters(places, reach):
                    mine = np.unique(codes[lo:hi])
                    if len(mine) >= least:
                        first, last = max(0, int(places[lo]) - reach), int(places[hi - 1]) + reach + max(sizes)
                        out.append((k, " ".join(words[first:last]), first, mine.view(np.int64)))
            at = pa.array([x[0] for x in out], pa.int64())
            columns = [b.column("rid").take(at), b.column("key").take(at), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "key", "words", "first", "grams"])

    found = rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(run, f"rid long, key {kind}, words string, first long, grams array<long>")
    return cut(found.withColumn("pid", F.monotonically_increasing_id()))


def seeds(items: DataFrame, held: DataFrame, common: int, hits: int) -> DataFrame:
    """(item, h, needed): the n-grams of each item but the `common`-th part that the most passages hold, and how many of them a copy needs.

    Pairs are all kept; a copy needs fewer of them where the item repeats some.
    """
    often = held.select(F.explode("grams").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("often"))
    each = items.select("item", "spare", F.size("grams").alias("of"), F.explode("grams").alias("h")).join(often, "h", "left")
    order = Window.partitionBy("item").orderBy(F.coalesce("often", F.lit(0)).desc(), "h")  # an item's own n-grams
    left = F.when(F.col("spare").isNull(), F.col("of") - F.floor(F.col("of") / common)).otherwise(F.col("of"))
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") > F.col("of") - left)
    needed = F.greatest(F.lit(1), F.lit(hits) - F.coalesce("spare", F.lit(0)))
    return ranked.select("item", "h", F.least(needed, left).alias("needed"))


def aligned(item: list[str], passage: list[str], size: int, chosen: set[int], needed: int, threshold: float, known: dict):
    """(score share, start, stop) of the best alignment with the words where seeds lie close together, or None."""
    h = gram_hashes(word_hashes(passage, known), size)
    places = np.flatnonzero(np.isin(h, np.array(sorted(chosen), np.int64).view(np.uint64)))
    number = {w: k for k, w in enumerate(dict.fromkeys(item), 1)}
    mine = np.array([number[w] for w in item], np.int64)
    words = np.fromiter((number.get(w, 0) for w in passage), np.int64, len(passage))
    best, bar = None, max(threshold * len(mine), min(LEAST, len(mine)) if len(mine) > WHOLE else 0)
    for a, b in _clusters(places, 2 * len(item)) if len(places) else ():
        if len(np.unique(h[places[a:b]])) < needed:
            continue
        low, high = max(0, int(places[a]) - 2 * len(item)), int(places[b - 1]) + 2 * len(item) + size
        if np.isin(mine, words[low:high]).sum() < bar:  # no alignment has more matches than that
            continue
        score, _ = align(mine, words[low:high])
        if score >= bar and (best is None or score > best[0]):
            best = score, low, high
    if not best:
        return None
    score, start, stop = span(mine, words[best[1] : best[2]])
    return score / len(mine), best[1] + start, best[1] + stop


def _found(rows: DataFrame, benchmark: DataFrame, gram: int, hits: int, threshold: float, common: int) -> DataFrame:
    """(key, item_id, score, start_word, stop_word) from (key, text), a row for each row and item that it holds a copy of."""
    bounded_batches(rows.sparkSession)
    kind = rows.schema["key"].dataType.simpleString()
    result = f"rid long, key {kind}, item long, item_id long, score double, start_word long, stop_word long"
    items = item_rows(benchmark, gram)
    known = items.agg(F.sum(F.size("grams")).alias("grams"), F.max("n").alias("longest"), F.min(F.greatest(F.lit(1), F.size("grams") - F.coalesce("spare", F.lit(0)))).alias("fewest"), F.collect_set("size").alias("sizes")).first()
    if not known["grams"]:
        return rows.sparkSession.createDataFrame([], result).drop("rid", "item")
    bits = min(MOST_BITS, max(LEAST_BITS, known["grams"].bit_length() + SPARE_BITS))
    held = bitmap(items.select(F.explode("grams").alias("h")), bits)
    found = passages(rows, held, bits, sorted(known["sizes"]), 2 * known["longest"], min(hits, known["fewest"]))
    chosen = cut(seeds(items, found, common, hits))
    met = found.select("pid", F.explode("grams").alias("h")).join(chosen, "h").groupBy("pid", "item").agg(F.count(F.lit(1)).alias("met"), F.min("needed").alias("needed"))
    whole = items.join(chosen.groupBy("item").agg(F.collect_set("h").alias("seeds")), "item").select("item", "item_id", F.col("words").alias("test"), "size", "seeds")
    pairs = met.where("met >= needed").drop("met").join(found.drop("grams"), "pid").join(whole, "item")

    def run(batches):
        hashes = _Hashes()
        for b in batches:
            said = zip(*(b.column(c).to_pylist() for c in ("test", "words", "size", "seeds", "needed", "first")), strict=True)
            out = []
            for k, (test, words, size, codes, needed, first) in enumerate(said):
                if best := aligned(test.split(" "), words.split(" "), size, set(codes), needed, threshold, hashes):
                    out.append((k, best[0], first + best[1], first + best[2]))
            at = pa.array([x[0] for x in out], pa.int64())
            columns = [b.column(c).take(at) for c in ("rid", "key", "item", "item_id")] + [pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "key", "item", "item_id", "score", "start_word", "stop_word"])

    hits_of = pairs.select("rid", "key", "item", "item_id", "test", "words", "size", "seeds", "needed", "first").mapInArrow(run, result)
    best = F.max_by(F.struct("key", "item_id", "score", "start_word", "stop_word"), F.struct("score", -F.col("start_word"))).alias("best")
    return hits_of.groupBy("rid", "item").agg(best).select("best.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, hits: int = HITS, threshold: float = THRESHOLD, common: int = COMMON) -> DataFrame:
    """(doc_id, item_id, score, start_word, stop_word): every document that holds a copy of a test item, verbatim or edited."""
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return _found(rows, benchmark, gram, hits, threshold, common).withColumnRenamed("key", "doc_id")


def _name(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def clean(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, hits: int = HITS, threshold: float = THRESHOLD, common: int = COMMON) -> DataFrame:
    """The rows of `docs` that hold no copy of a test item, whatever their ids, with their own columns."""
    rows = docs.select(_name(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    gone = _found(rows, benchmark, gram, hits, threshold, common).select("key").distinct()
    kept = docs.select(_name(F.col("text")).alias("key"), F.struct(*(f"`{c}`" for c in docs.columns)).alias("row")).join(gone, "key", "left_anti")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
