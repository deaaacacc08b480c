"""Vector code compression: each part of a vector becomes the index of the nearest of a few learned entries.

Components are scaled to integers, so every distance, mean and tie is exact, whatever the order of rows.  An assignment is an exponion
search: it starts at the entry that the part had before and scans that entry's other entries in ascending distance, as far as twice the
part's own distance.  By the triangle inequality nothing farther out can be nearer or as near, so the scan finds the nearest entry, the
least index among equals.  Rows of a batch with the same previous entry are sorted by their own distance, so that every step of the scan is a
product over a shrinking prefix of them.

A round is one pass: the state of a row, its integers and codes in as few bytes as they need, is written to the checkpoint folder, so a lost
executor costs its own tasks only; what reaches the driver are the entries' sums (parts x entries x width numbers), never rows.

Defined results: rows whose vector is null, empty, of a length that the parts don't divide, or holds null or non-finite components are dropped, and
so are rows whose length differs from that of the first row by id; ids may repeat or be null (null ones come last); of equal ids the
lesser vector is first; with fewer rows than entries there are fewer entries; integers of any size are exact (large ones take a slower path, and an
error beyond 2^63 - 1 is given as that); doubles from 1e304 on count as infinite; no rows give none; further columns, under any name, are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, hot_bar, looked_up

#: Parts of a vector, entries of a part's codebook, rounds of learning, and steps to one unit of a component.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Binary digits of a limb of a sum, and the greatest error that is told.
LIMB, MOST = 32, (1 << 63) - 1


def narrow(size: int) -> int:
    """Integers up to this have distances over `size` components of at most 2^60."""
    return math.isqrt((1 << 60) // max(1, size)) // 2


def packed(row: np.ndarray) -> tuple[int, bytes]:
    """(bytes each, bytes) of whole float64 numbers."""
    top = float(np.abs(row).max(initial=0.0))
    wide, kind = (2, "<i2") if top < 1 << 15 else (4, "<i4") if top < 1 << 31 else (8, "<f8")
    return wide, row.astype(kind).tobytes()


def unpacked(wide: int, blobs: list[bytes], most: int) -> np.ndarray:
    """Rows of one width as a matrix of int64, or of Python's integers where one is over `most`."""
    kind = {2: "<i2", 4: "<i4", 8: "<f8"}[wide]
    rows = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)
    if float(np.abs(rows.astype(np.float64)).max(initial=0.0)) <= most:
        return rows.astype(np.int64)
    return np.array([[int(x) for x in r] for r in rows.tolist()], object).reshape(rows.shape)


def distances(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one entry, or to one entry each."""
    gap = rows - entry
    return np.einsum("ij,ij->i", gap, gap) if gap.dtype != object else (gap * gap).sum(axis=1)


class Codebook:
    """The entries of one part, and for each of them all others in ascending distance (then index)."""

    def __init__(self, entries: list[tuple[int, ...]]):
        big = max((abs(x) for e in entries for x in e), default=0) > narrow(len(entries[0]))
        self.entries = np.array(entries, object if big else np.int64).reshape(len(entries), -1)
        gap = self.entries[:, None, :] - self.entries[None, :, :]
        far = (gap * gap).sum(axis=2)
        self.near = [sorted((j for j in range(len(entries)) if j != i), key=lambda j: (far[i, j], j)) for i in range(len(entries))]
        self.far = [[int(far[i, j]) for j in self.near[i]] for i in range(len(entries))]

    def nearest(self, rows: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row, searched from the entry it had `before`."""
        own = distances(rows, self.entries[before])
        code, best = before.astype(np.int64), own.copy()
        # A stable order by previous entry, and within it by falling distance, so that each step's rows are a prefix.
        order = np.lexsort((-own, before)) if own.dtype != object else np.array(sorted(range(len(own)), key=lambda i: (before[i], -own[i])), np.int64)
        edges = np.searchsorted(before[order], np.arange(len(self.entries) + 1))
        for a, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            mine = order[low:high]
            if not len(mine):
                continue
            held, reach = rows[mine], (4 * own[mine])[::-1]  # ascending
            found, d = np.full(len(mine), a, np.int64), own[mine].copy()
            for j, far in zip(self.near[a], self.far[a], strict=True):
                live = len(mine) - int(np.searchsorted(reach, far, side="left"))
                if not live:
                    break
                new = distances(held[:live], self.entries[j])
                better = (new < d[:live]) | ((new == d[:live]) & (j < found[:live]))
                found[:live][better], d[:live][better] = j, new[better]
            code[mine], best[mine] = found, d
        return code, best


def _judged(b: pa.RecordBatch, books: list[Codebook]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(places, rows, codes, errors by part) of a batch's states of each width."""
    wide = b.column("wide").to_numpy(zero_copy_only=False)
    ints, before = b.column("ints").to_pylist(), b.column("codes").to_pylist()
    size = books[0].entries.shape[1]
    for w in np.unique(wide):
        at = np.flatnonzero(wide == w)
        rows = unpacked(int(w), [ints[i] for i in at], narrow(size))
        start = np.frombuffer(b"".join(before[i] for i in at), np.uint8).reshape(len(at), -1)
        found = [book.nearest(rows[:, p * size : (p + 1) * size], start[:, p]) for p, book in enumerate(books)]
        yield at, rows, np.stack([f[0] for f in found], axis=1).astype(np.uint8), [f[1] for f in found]


def _assign(books: list[Codebook]):
    """A function from batches of states to those with the nearest entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.zeros((b.num_rows, len(books)), np.uint8)
            for at, _, found, _ in _judged(b, books):
                codes[at] = found
            blobs = pa.array([r.tobytes() for r in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "label", "wide", "ints")), blobs], names=b.schema.names)

    return run


def _finish(books: list[Codebook]):
    """A function from batches of states to codes in hexadecimal digits and errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, errors = [""] * b.num_rows, [0] * b.num_rows
            for at, _, found, far in _judged(b, books):
                for k, i in enumerate(at):
                    codes[i], errors[i] = found[k].tobytes().hex(), min(MOST, sum(int(f[k]) for f in far))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def limbs(value: int) -> list[int]:
    """Numbers whose sum, the k-th of them shifted by k limbs, is `value`."""
    out = []
    while not -(1 << (LIMB - 1)) <= value < 1 << (LIMB - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _sums(size: int, parts: int, entries: int):
    """A function from batches of states to a task's sums: (part, entry, place, limb, amount); place -1 counts rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, size), object), np.zeros((parts, entries), np.int64)
        for b in batches:
            wide = b.column("wide").to_numpy(zero_copy_only=False)
            ints, held = b.column("ints").to_pylist(), b.column("codes").to_pylist()
            for w in np.unique(wide):
                at = np.flatnonzero(wide == w)
                rows = unpacked(int(w), [ints[i] for i in at], narrow(size))
                codes = np.frombuffer(b"".join(held[i] for i in at), np.uint8).reshape(len(at), -1)
                for p in range(parts):
                    sums = np.zeros((entries, size), rows.dtype)
                    np.add.at(sums, codes[:, p], rows[:, p * size : (p + 1) * size])
                    total[p] += sums.astype(object)
                    count[p] += np.bincount(codes[:, p], minlength=entries)
        rows = [(p, e, -1, k, x) for p in range(parts) for e in range(entries) for k, x in enumerate(limbs(int(count[p, e])))]
        rows += [(p, e, d, k, x) for p in range(parts) for e in range(entries) if count[p, e] for d in range(size) for k, x in enumerate(limbs(int(total[p, e, d])))]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)], names=["part", "entry", "place", "limb", "amount"])

    return run


def _learned(state: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """Every entry replaced by the floor of the mean of its parts; unused ones stay."""
    parts, entries, size = len(books), len(books[0].entries), books[0].entries.shape[1]
    found = state.mapInArrow(_sums(size, parts, entries), "part int, entry int, place int, limb int, amount long")
    found = found.groupBy("part", "entry", "place", "limb").agg(F.sum("amount").alias("amount")).collect()  # bounded by the codebooks' size
    sums: dict[tuple[int, int, int], int] = {}
    for r in found:
        key = (r["part"], r["entry"], r["place"])
        sums[key] = sums.get(key, 0) + (r["amount"] << (LIMB * r["limb"]))
    new = lambda p, e: tuple(sums.get((p, e, d), 0) // sums[p, e, -1] for d in range(size)) if sums.get((p, e, -1)) else tuple(map(int, books[p].entries[e]))
    return [Codebook([new(p, e) for e in range(entries)]) for p in range(parts)]


def _prepared(vectors: pa.RecordBatch, parts: int, scale: int, long: int) -> pa.RecordBatch:
    """States without a previous entry: all start from the first."""
    values = vectors.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, long)
    held = [packed(r) for r in np.floor(values * scale)]
    none = pa.array([bytes(parts)] * len(held), pa.binary())
    columns = [vectors.column("vec_id"), vectors.column("label"), pa.array([h[0] for h in held], pa.int32()), pa.array([h[1] for h in held], pa.binary()), none]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "wide", "ints", "codes"])


def codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256): each row's codes as two hexadecimal digits a part, and its squared distance from them.

    `entries` is at most 256.  The codebooks start as the parts of the first rows by id.
    """
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    sound = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < 1e304, F.lit(False)))
    rows = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)).where(sound)
    top = lambda df, n: df.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(n).collect()
    first = top(rows, 1)
    if not first:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
    long = len(first[0]["embedding"])
    size = long // parts
    kept = rows.where(F.size("embedding") == long)
    start = [[math.floor(x * scale) for x in r["embedding"]] for r in top(kept, entries)]
    books = [Codebook([tuple(r[p * size : (p + 1) * size]) for r in start]) for p in range(parts)]
    shape = lambda: rows.select("vec_id", "label").schema

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (_prepared(b, parts, scale, long) for b in batches)

    states = shape().add("wide", "integer").add("ints", "binary").add("codes", "binary")
    state = kept.mapInArrow(prepare, states)
    for _ in range(rounds):
        state = cut(state.mapInArrow(_assign(books), states))
        books = _learned(state, books)
    told = ",".join(str(int(x)) for book in books for e in book.entries for x in e)
    done = state.mapInArrow(_finish(books), shape().add("code", "string").add("error", "long"))
    return done.withColumn("codebooks_sha256", F.lit(hashlib.sha256(told.encode()).hexdigest()))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Add `label_error`, the sum of errors over equal labels (nulls together); labels with very many rows are looked up by broadcast."""
    keyed = cut(coded.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))}))
    sums = keyed.groupBy("_none", "_label").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    found = looked_up(keyed, sums, ("_none", "_label"), "_n", hot_bar(keyed.count()))
    return found.withColumn("label_error", F.least("_sum", F.lit(MOST).cast("decimal(38,0)")).cast("long")).drop("_none", "_label", "_n", "_sum")
