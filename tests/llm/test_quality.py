import math
import os
import zlib

import numpy as np
from pyspark.sql import functions as F

from tonewright.llm import quality
from tonewright.llm.queries import op1_quality_classifier


def test_documents_held_out(spark):
    rows = op1_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.95


def test_word_vectors_against_brute_force(spark, small):
    docs = spark.read.parquet(os.path.join(small, "documents.parquet")).limit(40).repartition(5)
    places, signs = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for r in docs.collect():
        ids = quality.word_ids(r.text, quality._Buckets()).tolist()
        for a, w in enumerate(ids):
            for b in range(max(0, a - quality.REACH), min(len(ids), a + quality.REACH + 1)):
                if a != b:
                    np.add.at(want[w], places[ids[b]], signs[ids[b]])
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(docs), want, atol=1e-6)


def test_odd(spark, odd, none):
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(1).alias("score"))
    assert len(quality.judged(odd, labels).collect()) == odd.count()
    empty = quality.judged(odd, labels.where("false")).collect()
    assert all(abs(r.score - 0.5) < 1e-9 for r in empty)
    assert quality.judged(none, labels).collect() == []
    kept = quality.score(odd, *quality.fit(odd, labels))
    assert set(odd.columns) | {"predicted"} == set(kept.columns)


def test_temperature_and_network_separate():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 800)
    x = rng.normal(0, 1, (800, quality.DIM)) + y[:, None]
    net = quality.train(x, y)
    assert 0.2 < net.temperature < 9 and ((net.scores(x) > 0.5) == y).mean() > 0.95


def test_scores_against_plain_sums(spark, small):
    """Pooling, network and temperature over every document, cell by cell."""
    docs = spark.read.parquet(os.path.join(small, "documents.parquet"))
    labels = spark.read.parquet(os.path.join(small, "labels.parquet"))
    vectors, net = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, vectors, net).select("doc_id", "score", "predicted").collect()}
    for r in docs.collect():
        ids = quality.word_ids(r.text or "", quality._Buckets()).tolist()
        x = [sum(float(vectors[i][d]) for i in ids) / len(ids) if ids else 0.0 for d in range(quality.DIM)]
        z = [(a - m) / s for a, m, s in zip(x, net.mean, net.scale, strict=True)]
        hidden = [math.tanh(sum(a * w for a, w in zip(z, net.w1[:, k], strict=True)) + net.b1[k]) for k in range(len(net.b1))]
        logit = sum(a * w for a, w in zip(hidden, net.w2, strict=True)) + net.b2
        want = 1 / (1 + math.exp(-logit / net.temperature))
        assert abs(got[r.doc_id].score - want) < 2e-4 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)


def test_training_follows_the_slopes(monkeypatch):
    """The first step of training, against finite differences of the loss."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 1, (40, 6)), rng.integers(0, 2, 40)
    y[:2] = 0, 1
    for name, value in (("EPOCHS", 1), ("BATCH", 64), ("DECAY", 0.0), ("HIDDEN", 3)):
        monkeypatch.setattr(quality, name, value)
    monkeypatch.setattr(quality, "RATE", 0.0)
    start = quality.train(x, y, 5)
    monkeypatch.setattr(quality, "RATE", 1e-6)
    moved = quality.train(x, y, 5)
    order = np.random.default_rng(5).permutation(40)
    fit = order[4:]

    def loss(net):
        return np.logaddexp(0, np.where(y[fit] > 0, -1, 1) * net.logits(x[fit])).mean()

    for name in ("w1", "b1", "w2"):
        table, change = getattr(start, name), getattr(moved, name) - getattr(start, name)
        for at in np.ndindex(table.shape):
            held = table[at]
            table[at] = held + 1e-5
            up = loss(start)
            table[at] = held - 1e-5
            slope = (up - loss(start)) / 2e-5
            table[at] = held
            assert abs(slope) < 1e-7 or np.sign(change[at]) == -np.sign(slope)  # Adam's first step has the slope's sign


def test_tables_are_added_in_a_tree(spark, small, monkeypatch):
    docs = spark.read.parquet(os.path.join(small, "documents.parquet"))
    want = quality.word_vectors(docs.coalesce(1))
    monkeypatch.setattr(quality, "FAN", 2)
    assert np.array_equal(quality.word_vectors(docs.repartition(11)), want)


def test_accepted_rows_keep_their_columns(spark, odd):
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(1, 13)], "doc_id long, quality int")
    docs = odd.withColumn("predicted", F.lit("mine"))
    kept = quality.accepted(docs, labels, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert {(r.score, r.predicted) for r in kept.collect()} == {(7, "mine")}
    assert quality.accepted(docs, labels, 1.1).count() == 0


def test_learned_rows_are_bounded(spark):
    """One id on many rows, and more labels than the bound."""
    docs = spark.range(3000).select((F.col("id") % 1500).alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(1500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    seen = []
    held = quality.train
    try:
        quality.train = lambda x, y: seen.append(len(y)) or held(x, y)
        quality.fit(docs, labels, 200)
        quality.fit(docs, labels, 10_000)
    finally:
        quality.train = held
    assert 150 < seen[0] <= 200 and seen[1] == labels.where(quality.learns(F.col("doc_id"))).count()


def test_a_long_text(spark):
    docs = spark.createDataFrame([(1, "some words " * 1_000_000), (2, "x")], "doc_id long, text string")
    got = quality.judged(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert len(got) == 2 and all(0 <= r.score <= 1 for r in got)
