"""Document quality: random-indexing word vectors, pooled, and a two-layer network.

Words are runs of letters or of punctuation, lower-cased; a word in capitals is the word `<caps>`, and one that
repeats the word before it (a mark may stand between) is `<again>`.  Words are hashed to `BUCKETS` rows, which bounds the table whatever the corpus holds.  Random indexing: every row has a
sparse random index vector, and its context vector is the sum of the index vectors of the words up to
`REACH` places away, over all documents.  Tasks count this exactly in integers; their tables are added up in a tree,
`FAN` at a time, so that no task gathers more however many there are.
A document is the mean of its words' normalised vectors.  The network (one hidden layer, numpy) learns from at most
`sample` labelled rows, drawn by a hash of their id, and its temperature is set on rows that it did not learn from.

Defined results: null and empty texts have the zero vector and are scored; a text of any length is read whole, in the
memory that its words take; null labels are not learned from; of rows with one id the least text is learned from, once for each of
its labels; with fewer than two classes to learn from every score is the mean label (0.5 without labels);
repeated rows are scored alike; empty tables give empty results.  Other columns are not read, and stay: `score` puts its
two in place of columns of the names that it is given, `accepted` leaves all columns as they are.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import bounded_batches, cut, texts

BUCKETS, DIM, ENTRIES, REACH = 1 << 14, 64, 2, 2
#: Rows for marks; `<again>` and `<caps>` have rows 0 and 1.
MARKS = 1 << 10
#: Labelled rows that the network learns from at most, the least by a hash of their id.
SAMPLE = 20_000
THRESHOLD = 0.3
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 30, 128, 3e-3, 1e-4
_WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+").findall
_GROUP = 256
#: Tables that are added up in one task at most.
FAN = 32


class _Buckets(dict):
    """Word to bucket, remembered."""

    def __missing__(self, word: str) -> int:
        hashed = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        if len(word) > 1 and word.isupper():
            found = 1
        elif word[0].isalnum():
            found = MARKS + hashed % (BUCKETS - MARKS)
        else:
            found = 2 + hashed % (MARKS - 2)
        if len(self) < 1_000_000:
            self[word] = found
        return found


def word_ids(text: str, known: dict) -> np.ndarray:
    words = _WORD(text)
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    again = np.zeros(len(ids), bool)
    for k in (1, 2):
        again[k:] |= (ids[k:] == ids[:-k]) & (ids[k:] >= MARKS)
    ids[again] = 0
    return ids


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the non-zero entries of every bucket's index vector."""
    rng = np.random.default_rng(20)
    return rng.integers(0, DIM, (BUCKETS, ENTRIES)), rng.choice([-1, 1], (BUCKETS, ENTRIES))


def context_counts(parts: list[np.ndarray], places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """BUCKETS x DIM sums of neighbours' index vectors over some documents."""
    gap = np.full(REACH, -1)
    ids = np.concatenate([x for p in parts for x in (p, gap)]) if parts else gap
    out = np.zeros(BUCKETS * DIM, np.int64)
    for k in range(1, REACH + 1):
        a, b = ids[:-k], ids[k:]
        ok = (a >= 0) & (b >= 0)
        a, b = a[ok], b[ok]
        for word, other in ((a, b), (b, a)):
            for e in range(ENTRIES):
                cell, sign = word * DIM + places[other, e], signs[other, e]
                out += np.bincount(cell[sign > 0], minlength=len(out)) - np.bincount(cell[sign < 0], minlength=len(out))
    return out.reshape(BUCKETS, DIM)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Normalised context vectors over all of `docs` (BUCKETS x DIM, a fixed size)."""
    bounded_batches(docs.sparkSession)

    def count(batches):
        places, signs = index_vectors()
        known, total, held, size = _Buckets(), np.zeros((BUCKETS, DIM), np.int64), [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(word_ids(text, known))
                size += len(held[-1])
                if size > 1_000_000:
                    total += context_counts(held, places, signs)
                    held, size = [], 0
        total += context_counts(held, places, signs)
        groups = [(g, total[g : g + _GROUP]) for g in range(0, BUCKETS, _GROUP)]
        groups = [(g, zlib.compress(x.tobytes(), 1)) for g, x in groups if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in groups], pa.int32()), pa.array([x for _, x in groups], pa.binary())], ["rows", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in table.column("sums").to_pylist())
        return pa.table({"rows": table.column("rows")[:1], "at": table.column("at")[:1], "sums": pa.array([zlib.compress(total.tobytes())], pa.binary())})

    # Each task's part of the table is one row; `at` numbers the rows of one part, and every level has a FAN-th of them.
    sums = docs.select("text").mapInArrow(count, "rows int, sums binary").withColumn("at", F.spark_partition_id())
    tables = cut(sums)
    left = (tables.agg(F.max("at")).first()[0] or 0) + 1
    while left > 1:
        left = -(-left // FAN)
        tables = tables.withColumn("at", F.floor(F.col("at") / FAN).cast("int")).groupBy("rows", "at").applyInArrow(add, "rows int, at int, sums binary")
    out = np.zeros((BUCKETS, DIM), np.float64)
    for r in tables.collect():
        out[r["rows"] : r["rows"] + _GROUP] = np.frombuffer(zlib.decompress(r["sums"]), np.int64).reshape(_GROUP, DIM)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(text_list: list[str], vectors: np.ndarray, known: dict) -> np.ndarray:
    """Mean word vector of every text; zero without words."""
    out = np.zeros((len(text_list), vectors.shape[1]), np.float32)
    for k, text in enumerate(text_list):
        ids = word_ids(text, known)
        if len(ids):
            # By distinct word, so that long texts take no more memory than their vocabulary.
            words, times = np.unique(ids, return_counts=True)
            out[k] = times.astype(np.float32) @ vectors[words] / len(ids)
    return out


@dataclass
class Network:
    """score = sigmoid(logit / temperature); logits of standardised inputs through one hidden layer."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Fit by Adam on cross-entropy; a tenth of the rows is kept for the temperature."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    if not len(y) or y.min() == y.max() or len(y) < 10:
        rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Network(np.zeros(dim), np.ones(dim), np.zeros((dim, 1)), np.zeros(1), np.zeros(1), float(np.log(rate / (1 - rate))))
    order = rng.permutation(len(y))
    keep, fit = order[: max(1, len(y) // 10)], order[max(1, len(y) // 10) :]
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-6
    z = (x - mean) / scale
    p = [rng.normal(0, dim**-0.5, (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        shuffled = rng.permutation(fit)
        for k in range(0, len(shuffled), BATCH):
            rows = shuffled[k : k + BATCH]
            h = np.tanh(z[rows] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[rows]) / len(rows)
            back = d[:, None] * p[2] * (1 - h * h)
            grads = [z[rows].T @ back + DECAY * p[0], back.sum(0), h.T @ d + DECAY * p[2], np.array([d.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    logit = net.logits(x[keep])
    loss = lambda T: np.logaddexp(0, np.where(y[keep] > 0, -1, 1) * logit / T).mean()
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def learns(doc_id: Column) -> Column:
    """Rows that labels may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of `docs` and the network learned from `labels` (doc_id, quality)."""
    docs = texts(docs)
    vectors = word_vectors(docs)
    mark = [F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")]
    usable = labels.select(*mark).where(learns(F.col("doc_id")) & F.col("quality").isNotNull()).distinct().withColumn("h", F.xxhash64("doc_id", "quality"))
    # A bound on the hash leaves little more than `sample` rows in all, so that tasks don't each send as many.
    share = min(1.0, 1.2 * sample / max(1, usable.count()))
    few = usable if share == 1 else usable.where(F.col("h") < int(share * 2**64) - 2**63)
    chosen = few.orderBy("h", "doc_id", "quality").limit(sample).select("doc_id", "quality")

    def pool(batches):
        known = _Buckets()
        for b in batches:
            x = pooled(b.column("text").to_pylist(), vectors, known)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    # `chosen` has at most `sample` rows of two numbers, so it may be broadcast; one text for each of them is left.
    known = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = known.mapInArrow(pool, "doc_id long, quality int, x binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float32).reshape(len(rows), DIM)
    return vectors, train(x, np.array([r["quality"] for r in rows]))


def score(docs: DataFrame, vectors: np.ndarray, net: Network, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """`docs` with two more columns, the score and whether it reaches the threshold, in place of columns of these names."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in {n.lower() for n in names}))

    def run(batches):
        known = _Buckets()
        for b in batches:
            found = net.scores(pooled([t or "" for t in b.column("text").to_pylist()], vectors, known))
            columns = [*b.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())]))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    found = score(texts(docs), *fit(docs, labels))
    return found.select("doc_id", F.coalesce(~learns(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, with their own columns."""
    free = lambda name: name if name not in {c.lower() for c in docs.columns} else free(f"_{name}")
    names = free("score"), free("predicted")
    return score(docs, *fit(docs, labels), threshold, names).where(F.col(f"`{names[1]}`") == 1).select(*(f"`{c}`" for c in docs.columns))
