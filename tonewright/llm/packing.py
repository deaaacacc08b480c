"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A document is its token ids and one end id.  Only documents longer than a sequence are cut; the first
piece takes the remainder, so every later piece fills a sequence by itself.  Pieces go by a hash of their
document to shards of about `shard_docs` documents that are packed independently (a shard leaves at most one
badly filled sequence, so the loss is below one in some ten thousand).  Within a shard:

1. open a sequence with the longest unpacked piece and fill it greedily, the longest that fits first;
2. take out its shortest piece (not the opener) and put in the two unpacked pieces that fill the
   enlarged gap most tightly, if they fill it better than the one did;
3. repeat until nothing improves.

Lengths are small integers, so a shard is a table of counts by length and each search is one vector step.

Token ids are those of a `tokenizers` file.  Where the same vocabulary is also given as a rank file, texts of characters below
U+0800 without special tokens are encoded from it by `tiktoken`, which is several times as fast; the ids are
the same (tests hold one against the other).  All other texts go to `tokenizers`.

Defined results: null texts are empty ones and hold the end id alone; repeated rows are packed each
(rows with the same doc_id keep their own pieces; ids stay gapless); empty tables give empty results;
other columns are not read.  A text that spells a special token is encoded as the library does by default.
"""

from __future__ import annotations

import base64
import os
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, texts

LENGTH = 2048
END = 0
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


class Encoder:
    """Texts to little-endian uint32 ids."""

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.quick = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.quick and not any(x in text for x in self.special):
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            if not len(raw) or raw.max() < 0xE0:  # characters below U+0800, whose classes no Unicode version changes
                return array("I", self.quick.encode_ordinary(text)).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces_of(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `total` ids."""
    if total <= length:
        return [(0, total)]
    head = total % length or length
    return [(0, head)] + [(at, length) for at in range(head, total, length)]


def tokenize(docs: DataFrame, path: str, length: int = LENGTH, ranks: str | None = None) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): the pieces of every document; `row` tells repeated rows apart."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        encoder, end = Encoder(path, ranks), np.array([END], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.encode(text) + end
                for k, (at, size) in enumerate(pieces_of(len(ids) // 4, length)):
                    out.append((doc, row, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    rows = texts(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: np.ndarray, length: int) -> list[list[int]]:
    """Sequences (lists of piece lengths) that hold counts[n] pieces of each length n."""
    left = counts.astype(np.int64).copy()
    grid = np.arange(length + 1)
    #: below[n]: the longest length up to n of which pieces are left, or 0.
    below = np.maximum.accumulate(np.where(left > 0, grid, 0))
    bins: list[list[int]] = []

    def take(n: int) -> None:
        nonlocal below
        left[n] -= 1
        if not left[n]:
            upto = int(np.searchsorted(below, n, "right"))
            below[n:upto] = below[n - 1]

    def give(n: int) -> None:
        left[n] += 1
        if left[n] == 1:
            upper = below[n:]
            upper[upper < n] = n

    while below[length]:
        here = [int(below[length])]
        take(here[0])
        gap = length - here[0]
        while gap and (n := int(below[gap])):
            take(n)
            here.append(n)
            gap -= n
        while gap and len(here) > 1:
            least = here[-1]
            room = gap + least
            first = grid[1 : room // 2 + 1]
            first = first[left[1 : room // 2 + 1] > 0]
            if not len(first):
                break
            second = below[room - first]
            # A pair of one length needs two pieces of it; the next shorter partner serves otherwise.
            lone = (second == first) & (left[first] < 2)
            second = np.where(lone, below[np.maximum(first - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            at = int(total.argmax())
            if total[at] <= least:
                break
            give(least)
            here.pop()
            for n in (int(first[at]), int(second[at])):
                take(n)
                here.append(n)
            here[1:] = sorted(here[1:], reverse=True)
            gap = room - int(total[at])
        bins.append(here)
    return bins


def pack(pieces: DataFrame, length: int = LENGTH, shard_docs: int = 32_768) -> DataFrame:
    """Add sequence_id and offset to `pieces`; sequences are numbered by shard."""
    total = pieces.count()
    shards = max(1, round(total / shard_docs))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "row", "piece"], ignore_index=True)
        size = frame["length"].to_numpy()
        counts = np.bincount(size, minlength=length + 1)
        nxt = np.concatenate(([0], np.cumsum(counts)))[: length + 1].tolist()
        seq, off = np.empty(len(frame), np.int64), np.empty(len(frame), np.int64)
        base = int(frame["shard"].iloc[0]) << 40
        for k, here in enumerate(best_two_fit(counts, length)):
            at = 0
            for n in here:
                row = nxt[n]
                nxt[n] += 1
                seq[row], off[row] = base + k, at
                at += n
        return frame.assign(sequence_id=seq, offset=off)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, path: str, length: int = LENGTH, ranks: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document and its place."""
    return pack(cut(tokenize(docs, path, length, ranks)), length)
