"""Homomorphic multiset fingerprints of documents, in DataFrame functions alone.

A document is the multiset of its paragraphs (lines).  Each paragraph is hashed to a wide vector, and the
fingerprint is the sum of the vectors: the order of paragraphs does not matter, and a paragraph is inserted or
deleted by adding or subtracting its vector.  The vector has two parts:

- `STRONG` lanes modulo 2**64, the words of the paragraph's SHA-512.  They tell multisets apart: 512 bits in all.
- `LANES` lanes modulo 2**16, a signed count of the paragraph's pairs of neighbouring words (the last word
  pairs with the line's end), each pair in one lane.  Being linear too, they add up to a count sketch of the whole
  text, whose cosine estimates that of the two texts' counts of pairs, with a standard error of about (1 - c * c) / sqrt(`LANES`)
  around a cosine of c: 0.09 for texts that have nothing in common, none for equal ones (measured in the tests).

Texts are laid out in blocks of neighbouring doc_ids, cut at ids of a sample; the top row of each block is also sent to the
block above, so every row meets its successor within one block and no order over all rows is needed.  All
later groupings are by (block, row) and reuse that layout.

Defined results: null texts are empty and have one empty paragraph; a text of any length is read whole (sums of lanes are
longs; a row has to fit into memory); the order is descending doc_id, null ids last, ties by
descending text; a sole row is its own successor; repeated rows give repeated results; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_blocks, texts

STRONG, LANES = 8, 128
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 2_000
_M16, _M32 = 1 << 16, 1 << 32


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n")


def strong_lanes(text: Column) -> Column:
    """Hex of the lanes modulo 2**64, each summed in two halves of 32 bits (`2**31` paragraphs don't overflow a long)."""
    hashed = F.transform(paragraphs(text), lambda p: F.sha2(p, 512))

    def half(k: int) -> Column:
        word = lambda h: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")
        return F.aggregate(hashed, F.lit(0).cast("long"), lambda a, h: a + word(h))

    # The sums of a lane's halves: the lower one carries into the upper one.
    lanes = F.transform(F.array(*(F.struct(half(2 * k).alias("high"), half(2 * k + 1).alias("low")) for k in range(STRONG))), lambda x: F.concat(_hex(F.pmod(x["high"] + F.shiftright(x["low"], 32), F.lit(_M32)), 8), _hex(F.pmod(x["low"], F.lit(_M32)), 8)))
    return F.array_join(lanes, "")


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(value)), digits, "0")


def pair_hashes(text: Column) -> Column:
    """63-bit hashes of the neighbouring words of every paragraph."""

    def pairs(p: Column) -> Column:
        words = F.filter(F.split(p, " "), lambda w: w != "")
        return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b).bitwiseAND((1 << 63) - 1))

    return F.flatten(F.transform(paragraphs(text), pairs))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two sketches, from 0 to 1; equal ones (empty ones too) have 1, an empty and another 0."""
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), zero, lambda s, v: s + v)
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
    return F.when(a == b, 1.0).otherwise(F.round(F.greatest(zero, F.least(F.lit(1.0), F.coalesce(value, zero))), 6))


def with_successor(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(blk, rid, guest, doc_id, text, following): every row and the text of the next one, descending doc_id.

    Rows with guest = 1 are copies of other blocks' top rows.
    """
    placed, blocks = id_blocks(texts(docs), block_bytes, block_rows)
    placed = placed.select("blk", "doc_id", "text")
    tops = placed.groupBy("blk").agg(F.max(F.struct("doc_id", "text")).alias("top"))  # nulls are least
    # No block is empty, so the next one above has the next number; the lowest is above the highest.
    up = F.pmod(F.col("blk") + 1, F.lit(blocks)).cast("int")
    guests = tops.select(up.alias("blk"), "top.doc_id", "top.text", F.lit(1).alias("guest"))
    # Ordered by plain columns, so that every branch below asks for the same exchange and it is made once.
    spec = Window.partitionBy("blk").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    both = placed.withColumn("guest", F.lit(0)).unionByName(guests)
    return both.withColumn("rid", F.row_number().over(spec)).withColumn("following", F.lead("text").over(spec))


def fingerprints(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every document.

    The edited text's last floor(n_chars / 2) characters are the first as many of the next document.
    """
    rows = with_successor(docs, block_bytes, block_rows)
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.coalesce(F.expr("left(following, cast(floor(length(text) / 2) as int))"), F.lit("")))
    known = rows.select("blk", "rid", "guest", "doc_id", "text", edited.alias("edited"))

    sketched = []
    for which, name in enumerate(("text", "edited")):
        fill = F.sequence(F.lit(-LANES).cast("long"), F.lit(-1).cast("long"))
        source = known if not which else known.where("guest = 0")
        sketched.append(source.select("blk", "rid", F.lit(which).alias("which"), F.explode(F.concat(pair_hashes(F.col(name)), fill)).alias("h")))
    elements = sketched[0].unionByName(sketched[1])
    lane = F.when(F.col("h") < 0, -F.col("h") - 1).otherwise(F.col("h").bitwiseAND(LANES - 1)).cast("int")
    sign = F.when(F.col("h") < 0, 0).otherwise(1 - 2 * F.shiftright("h", 20).bitwiseAND(1)).cast("long")
    elements = elements.select("blk", "rid", "which", lane.alias("lane"), sign.alias("v"))
    sums = elements.groupBy("blk", "rid", "which", "lane").agg(F.sum("v").alias("v"))
    # Likeness is that of the whole sums; they are reduced in the printed fingerprint only.
    lanes = sums.groupBy("blk", "rid", "which").agg(F.array_sort(F.collect_list(F.struct("lane", "v"))).alias("s"))
    lanes = lanes.select("blk", "rid", "which", F.transform("s", lambda x: x["v"]).alias("s"))
    lanes = lanes.groupBy("blk", "rid").agg(F.max(F.when(F.col("which") == 0, F.col("s"))).alias("a"), F.max(F.when(F.col("which") == 1, F.col("s"))).alias("b"))
    lanes = lanes.withColumn("c", F.lead("a").over(Window.partitionBy("blk").orderBy("rid")))

    plain = known.where("guest = 0").select(
        "blk", "rid", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), strong_lanes(F.col("text")).alias("strong"), strong_lanes(F.col("edited")).alias("edited_strong")
    )
    text_of = lambda s: F.array_join(F.transform(s, lambda v: _hex(F.pmod(v, F.lit(_M16)), 4)), "")
    out = plain.join(lanes, ["blk", "rid"])
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        F.concat("strong", text_of(F.col("a"))).alias("fingerprint"), F.concat("edited_strong", text_of(F.col("b"))).alias("edited_fingerprint"),
        cosine(F.col("a"), F.col("b")).alias("near_edited"), cosine(F.col("a"), F.col("c")).alias("near_next"),
    )
