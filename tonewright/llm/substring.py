"""Repeated token windows, removed after their first document.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  A window is `size` consecutive words of one document; its
Rabin-Karp hash is the polynomial sum of 64-bit word hashes, rolled over the document.  A word goes if it lies in a
window whose word sequence also starts in a document with a smaller doc_id, as judged on the input;
touching and overlapping windows merge into maximal intervals.

How it is counted without a row a window.  Rows lie in blocks drawn by their place in the input, so that no id and
no copied text fills one.

1. A block sends each bucket of the hash space its distinct hashes there, cut to as few bits as tell most of the corpus's
   windows apart, sorted and packed as differences (3 to 5 bytes a window, and once however hot it is in the block).
   The bucket answers with one bit a hash: does another block have it?
2. For those that another has, the block sends a second, independent 64-bit hash and the least doc_id that holds the window.
   The bucket answers with one bit for each pair of hashes: does a document with a smaller id have the same pair?
   So a window goes only if two hashes, of some 40 to 60 and of 64 bits, agree: the check of a hit, without its words.
3. The block, laid out by the same exchange, puts the answers beside its own windows, compares its own documents among
   themselves by the same two hashes, and cuts its texts.

No group grows with one passage's or one id's popularity, and nothing but counts reaches the driver.  Blocks and buckets
grow with the square root of the input beyond 400 GB of text (`row_blocks`).

Defined results: null texts are empty (no words, SHA-256 of the empty string); a text of any length is read whole, in the
memory that its words take; rows with equal doc_id are separate documents of equal rank, so neither removes from the
other; a null doc_id ranks before all others; repeated rows give repeated results; empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, bounded_batches, covered, pack_sorted, row_blocks, texts, unpack_sorted

SIZE = 13
#: Odd multipliers of the two rolling hashes, modulo 2**64.
BASE, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
BLOCK_ROWS = 100_000
#: Bits of a hash beyond those that number the corpus's bytes: one window in a few thousand is asked about in vain.
SPARE = 10
_NULL = -(1 << 63)
_HAS, _LESS = 0, 1  # kinds of answers


class _Hashes(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < 2_000_000:
            self[word] = found
        return found


def mixed(h: np.ndarray) -> np.ndarray:
    """Another 64-bit hash of what `h` hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolled(each: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hashes of every `size` neighbours, by start."""
    n = len(each) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = each[:n].copy()
    factor = np.uint64(base)
    for k in range(1, size):
        out *= factor
        out += each[k : k + n]
    out ^= out >> np.uint64(31)  # high bits choose the bucket
    out *= factor
    return out


def word_hashes(words: list[bytes], known: dict) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class _Block:
    """The windows of a block in order of doc_id: `keys`, the distinct ones ascending, and for each window its place among them."""

    def __init__(self, table: pa.Table, size: int, bits: int):
        ranks = np.array([_NULL if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
        order = np.argsort(ranks, kind="stable")
        table = table.take(pa.array(order))
        self.ranks, self.ids = ranks[order], table.column("doc_id").to_pylist()
        self.words = [t.encode("utf-8", "surrogatepass").split() for t in table.column("text").to_pylist()]
        known = _Hashes()
        each = [word_hashes(w, known) for w in self.words]
        first = [rolled(x, size, BASE) for x in each]
        self.sizes = np.array([len(x) for x in first], np.int64)
        self.each, self.size = each, size
        whole = np.concatenate([np.empty(0, np.uint64), *first]) >> np.uint64(64 - bits)
        self.keys, self.place, self.times = np.unique(whole, return_inverse=True, return_counts=True)

    def pairs(self, chosen: np.ndarray):
        """For the windows of chosen keys: (their places, pair of each, key's place and second hash and least rank of each pair); pairs ascend."""
        at = np.flatnonzero(chosen[self.place]) if len(self.place) else np.empty(0, np.int64)
        second = np.concatenate([np.empty(0, np.uint64), *(rolled(mixed(x), self.size, SECOND) for x in self.each)])[at]
        key, owner = self.place[at], np.repeat(self.ranks, self.sizes)[at]
        order = np.lexsort((second, key))  # stable: ranks ascend within a pair
        key, second, owner = key[order], second[order], owner[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (second[1:] != second[:-1])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(fresh) - 1
        return at, of, key[fresh], second[fresh], owner[fresh]


def _slices(values: np.ndarray, buckets: int, bits: int):
    """(bucket, slice) of ascending hashes of so many bits, by their high bits."""
    shift = bits - (buckets - 1).bit_length() if buckets > 1 else 64
    which = (values >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(values), np.int64)
    edges = np.searchsorted(which, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, slice(int(edges[b]), int(edges[b + 1]))


def _answers(table: pa.Table, kind: int, bits: list[np.ndarray]) -> pa.Table:
    """A row for each row of `table`, with its answer."""
    return pa.table({
        "blk": table.column("blk"), "bucket": table.column("bucket"), "kind": pa.array([kind] * len(table), pa.int32()), "bits": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary()),
    })


def _elsewhere(table: pa.Table) -> pa.Table:
    """For each block's distinct hashes in one bucket, bits: does another block have this hash?"""
    lists = [unpack_sorted(x) for x in table.column("hashes").to_pylist()]
    whole = np.concatenate(lists)
    order = np.argsort(whole, kind="stable")
    same = whole[order[1:]] == whole[order[:-1]]
    found = np.zeros(len(whole), bool)
    found[order[1:]] |= same
    found[order[:-1]] |= same
    return _answers(table, _HAS, np.split(found, np.cumsum([len(x) for x in lists])[:-1]))


def _earlier(table: pa.Table) -> pa.Table:
    """For each block's pairs of hashes in one bucket, bits: has a document of smaller rank the same pair?"""
    lists = [unpack_sorted(x) for x in table.column("hashes").to_pylist()]
    key = np.concatenate(lists)
    second = np.frombuffer(b"".join(table.column("seconds").to_pylist()), "<u8")
    rank = np.frombuffer(b"".join(table.column("ranks").to_pylist()), "<i8")
    order = np.lexsort((rank, second, key))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (key[order[1:]] != key[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
    least = rank[order][fresh][np.cumsum(fresh) - 1]
    found = np.empty(len(order), bool)
    found[order] = least < rank[order]
    return _answers(table, _LESS, np.split(found, np.cumsum([len(x) for x in lists])[:-1]))


def repeated_windows(docs: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, text, removed array<struct<start, stop>>, n_words, n_removed, kept_sha256); intervals are word positions."""
    bounded_batches(docs.sparkSession)
    placed, blocks, total = row_blocks(texts(docs), block_bytes, block_rows)
    bits = min(64, math.ceil(math.log2(max(total, 2))) + SPARE)
    buckets = min(1 << (blocks - 1).bit_length(), 1 << bits)
    base = placed.select("blk", "doc_id", "text")

    def block_of(table: pa.Table) -> int:
        return table.column("blk")[0].as_py()

    def read(count: int, slices: list, right: pa.Table, kind: int) -> np.ndarray:
        """The bits that answer `count` ascending hashes."""
        rows = zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), right.column("bits").to_pylist(), strict=True)
        got = {b: x for k, b, x in rows if k == kind}
        out = np.zeros(count, bool)
        for b, s in slices:
            out[s] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=s.stop - s.start).astype(bool)
        return out

    def send(table: pa.Table) -> pa.Table:
        keys = _Block(table, size, bits).keys
        cuts = list(_slices(keys, buckets, bits))
        return pa.table({
            "blk": pa.array([block_of(table)] * len(cuts), pa.int32()),
            "bucket": pa.array([b for b, _ in cuts], pa.int32()),
            "hashes": pa.array([pack_sorted(keys[s]) for _, s in cuts], pa.binary()),
        })

    def contested(block: _Block, right: pa.Table) -> np.ndarray:
        return read(len(block.keys), list(_slices(block.keys, buckets, bits)), right, _HAS)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, size, bits)
        _, _, key, second, rank = block.pairs(contested(block, right))
        values = block.keys[key]
        cuts = list(_slices(values, buckets, bits))
        return pa.table({
            "blk": pa.array([block_of(left)] * len(cuts), pa.int32()),
            "bucket": pa.array([b for b, _ in cuts], pa.int32()),
            "hashes": pa.array([pack_sorted(values[s]) for _, s in cuts], pa.binary()),
            "seconds": pa.array([second[s].astype("<u8").tobytes() for _, s in cuts], pa.binary()),
            "ranks": pa.array([rank[s].astype("<i8").tobytes() for _, s in cuts], pa.binary()),
        })

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, size, bits)
        asked = contested(block, right)
        at, of, key, _, rank = block.pairs(asked | (block.times > 1))
        less = np.zeros(len(key), bool)
        sent = np.flatnonzero(asked[key])  # the pairs that ask() sent, in its order
        less[sent] = read(len(sent), list(_slices(block.keys[key[sent]], buckets, bits)), right, _LESS)
        flagged = np.zeros(len(block.place), bool)
        flagged[at] = less[of] | (rank[of] < np.repeat(block.ranks, block.sizes)[at])
        at, out = 0, {k: [] for k in ("doc_id", "text", "removed", "n_words", "n_removed", "kept_sha256")}
        for i, words, n in zip(block.ids, block.words, block.sizes.tolist(), strict=True):
            mask = covered(np.flatnonzero(flagged[at : at + n]), size, len(words))
            at += n
            kept = b" ".join(w for w, gone in zip(words, mask.tolist(), strict=True) if not gone) if mask.any() else b" ".join(words)
            turns = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))).reshape(-1, 2).tolist()
            out["doc_id"].append(i)
            out["text"].append(kept.decode("utf-8", "surrogatepass"))
            out["removed"].append([{"start": a, "stop": b} for a, b in turns])
            out["n_words"].append(len(words))
            out["n_removed"].append(int(mask.sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = {"doc_id": pa.int64(), "text": pa.string(), "removed": spans, "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    answer = "blk int, bucket int, kind int, bits binary"
    sent = base.groupBy("blk").applyInArrow(send, "blk int, bucket int, hashes binary")
    told = sent.groupBy("bucket").applyInArrow(_elsewhere, answer)
    asked = base.groupBy("blk").cogroup(told.groupBy("blk")).applyInArrow(ask, "blk int, bucket int, hashes binary, seconds binary, ranks binary")
    judged = asked.groupBy("bucket").applyInArrow(_earlier, answer)
    schema = "doc_id long, text string, removed array<struct<start: long, stop: long>>, n_words long, n_removed long, kept_sha256 string"
    return base.groupBy("blk").cogroup(told.unionByName(judged).groupBy("blk")).applyInArrow(apply, schema)
