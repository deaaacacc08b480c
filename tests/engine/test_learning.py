import time

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tonewright.operators import learners, sampling, search
from tonewright.operators.runlog import RunLog

# Resampling to exact sizes.


def test_classes_get_exactly_their_targets(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, 1).when(F.col("id") % 7 == 0, 2).otherwise(0).alias("y"))
    targets = {0: 1500, 1: 1200, 2: 37, 9: 5}
    got = sampling.drawn(rows, targets, ("doc_id",))
    assert {r.y: r["count"] for r in got.groupBy("y").count().collect()} == {0: 1500, 1: 1200, 2: 37}
    assert got.join(rows, ["doc_id", "y"]).count() == got.count() and got.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    again = sampling.drawn(rows.repartition(13).orderBy(F.rand()), targets, ("doc_id",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    assert sorted(map(tuple, sampling.drawn(rows, targets, ("doc_id",), seed=8).collect())) != sorted(map(tuple, got.collect()))


def test_draws_are_spread_as_independent_ones(spark, monkeypatch):
    """Over buckets and within them: how often rows are drawn has the mean and spread of draws with replacement."""
    monkeypatch.setattr(sampling, "RUN", 40)
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(1).alias("y"))
    times = np.zeros(400)
    for seed in range(3):
        for r in sampling.drawn(rows, {1: 4000}, ("doc_id",), seed=seed).groupBy("doc_id").count().collect():
            times[r.doc_id] += r["count"]
    assert times.sum() == 12000 and 20 < times.var() < 42 and times.min() > 8


def test_resampling_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 1, "b"), (None, 1, None), (2, None, "x")], "doc_id int, y int, copy_of string")
    assert sampling.drawn(rows, {1: 100}, ("doc_id",)).count() == 100 and sampling.drawn(rows, {0: 5}, ("doc_id",)).count() == 0
    assert sampling.drawn(rows.where("false"), {1: 100}, ("doc_id",)).count() == 0 and sampling.drawn(rows, {1: 0}, ("doc_id",)).count() == 0
    two = spark.createDataFrame([(k, k % 2) for k in range(21)], "doc_id int, y int")
    assert {r.y: r["count"] for r in sampling.resampled_by_default(two, classes=2).groupBy("y").count().collect()} == {0: 10, 1: 10}
    assert {r.y: r["count"] for r in sampling.resampled_by_default(two).groupBy("y").count().collect()} == {0: 10, 1: 10}
    assert {r.y: r["count"] for r in sampling.resampled(two, {0: 0.5, 1: 3.0}).groupBy("y").count().collect()} == {0: 5, 1: 30}


# The search over settings.

SETTINGS = [search.Setting(hidden=6, second=4, steps=6, drop=0.0, rate=0.05), search.Setting(hidden=4, second=3, steps=4, drop=0.5, rate=0.05, init="normal"), search.Setting(hidden=6, second=4, steps=6, drop=0.0, rate=0.05)]


def table(n=90, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    y = np.where(x[:, 0] > 0.3, 2, np.where(x[:, 1] > 0.3, 1, 0))
    return x, y, np.where(np.arange(n) < 80, np.arange(n) % 4, -1)


def loss(x, y, net):
    p = search.forward(x, [w[None] for w in net], None, 0)[2][0]
    return -np.log(p[np.arange(len(y)), y]).sum()


def test_gradients_against_differences():
    x, y, _ = table(12)
    s = search.Setting(hidden=5, second=4, drop=0.0)
    net = [w[0] + np.random.default_rng(3).normal(0, 0.3, w[0].shape) for w in search.started(s, 3, 3, 1)]
    got = search.gradients(x, y, np.full(12, -1), np.arange(12), [w[None] for w in net], s, 0)
    for k, w in enumerate(net):
        at = tuple(d // 2 for d in w.shape)
        moved = [n.copy() for n in net]
        moved[k][at] += 1e-6
        assert got[k][0][at] == pytest.approx((loss(x, y, moved) - loss(x, y, net)) / 1e-6, rel=1e-3, abs=1e-4)


def test_search_equals_fitting_one_by_one(spark):
    x, y, fold = table()
    rows = spark.createDataFrame([(k, list(map(float, a)), int(b), int(f) if f >= 0 else None) for k, (a, b, f) in enumerate(zip(x, y, fold, strict=True))], "doc_id long, x array<double>, y int, fold int")
    ids = np.array([r.h for r in rows.orderBy("doc_id").select(F.xxhash64("doc_id").alias("h")).collect()])
    want = []
    for s in SETTINGS:
        total = 0.0
        for f in range(4):
            net = search.started(s, 3, 3, 1)
            memory = [np.zeros_like(w) for w in net]
            mine = fold != f
            for step in range(s.steps):
                search.stepped(net, memory, search.gradients(x[mine], y[mine], np.full(mine.sum(), -1), ids[mine], net, s, step), s)
            p = search.forward(x[~mine], net, None, 0)[2][0].argmax(axis=1)
            tp, every = ((y[~mine] > 0) & (p > 0)).sum(), (y[~mine] > 0).sum() + (p > 0).sum()
            total += 2 * tp / every if every else 0
        want.append(round(total / 4, 6))
    got = search.search(rows.repartition(5), SETTINGS, folds=4).orderBy("setting").collect()
    assert [r.f1 for r in got] == pytest.approx(want, abs=1e-6)
    best = max(range(3), key=lambda k: (got[k].f1, k))
    assert [r.best for r in got] == [int(k == best) for k in range(3)] and best != 0 and got[1].init == "normal"  # the last of ties
    assert [r.f1 for r in search.search(rows.where("false"), SETTINGS, folds=4).collect()] == [0.0] * 3


def test_sums_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(search, "TOGETHER", 2)
    x, y, fold = table()
    rows = spark.createDataFrame([(k, list(map(float, a)), int(b), int(f)) for k, (a, b, f) in enumerate(zip(x, y, fold, strict=True))], "doc_id long, x array<double>, y int, fold int").repartition(7)
    given = search.prepared(rows, "x", "y", "fold", "doc_id")
    nets = [search.started(s, 3, 3, 4) for s in SETTINGS]
    got = search._sums(given, nets, SETTINGS, 0)
    ids = {r.x[0]: r.id for r in given.collect()}
    want = search.gradients(x, y, fold, np.array([ids[a] for a in x[:, 0]]), nets[1], SETTINGS[1], 0)
    assert all(np.allclose(a, b) for a, b in zip(got[1], want, strict=True))


# Forests, margins and the out-of-bag score.


def classes(spark, n=200):
    r = np.random.default_rng(4)
    x = r.normal(size=(n, 4))
    y = np.where(x[:, 0] > 0.5, 2, np.where(x[:, 1] > 0.2, 1, 0))
    return spark.createDataFrame([(k, list(map(float, a)), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "doc_id long, x array<double>, y double").withColumn("x", array_to_vector("x"))


def test_bags_are_poisson_draws(spark):
    got = spark.range(20_000).select(learners.bag(F.col("id"), 3).alias("n"), learners.bag(F.col("id"), 4).alias("m")).groupBy().agg(F.avg("n").alias("mean"), F.var_pop("n").alias("spread"), F.avg((F.col("n") == 0).cast("int")).alias("none"), F.corr("n", "m").alias("both")).first()
    assert abs(got["mean"] - 1) < 0.03 and abs(got.spread - 1) < 0.05 and abs(got.none - np.exp(-1)) < 0.015 and abs(got.both) < 0.03


def test_out_of_bag_score_against_a_recount(spark):
    rows = classes(spark).where("y < 2").withColumn("y2", F.col("y")).persist()
    grown = learners.forest(rows, "doc_id", trees=5)
    said = [{r.doc_id: r.p for r in t.setPredictionCol("p").transform(rows).collect()} for t in grown]
    bags = [{r.doc_id: r.n for r in rows.select("doc_id", learners.bag(F.col("doc_id"), k).alias("n")).collect()} for k in range(5)]
    right = judged = 0
    for r in rows.collect():
        votes = [said[k][r.doc_id] for k in range(5) if bags[k][r.doc_id] == 0]
        if votes:
            judged += 1
            right += (2 * sum(votes) > len(votes)) == (r.y == 1)
    got = learners.out_of_bag(classes(spark).where("y < 2"), "doc_id", classes=2, trees=5).collect()
    assert [(r.a, r.b, r.n, r.score) for r in got] == [(0, 1, judged, round(right / judged, 6))] and 0 < judged < 200 and right / judged > 0.7


@pytest.mark.parametrize("kind", ["forest", "margin", "logistic"])
def test_pairs_vote(spark, kind):
    rows = classes(spark)
    got = {r.doc_id: r.y for r in learners.one_against_one(rows, rows, "doc_id", kind=kind, trees=5).collect()}
    assert sum(got[r.doc_id] == r.y for r in rows.collect()) > 160
    two = learners.one_against_one(rows.where("y > 0"), rows, "doc_id", kind=kind, trees=2)  # no row of class 0
    assert {r.y for r in two.select("y").distinct().collect()} == {1, 2}


# The run's log.


def test_a_log_equals_counts_by_query(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a"), (2, 1, None), (3, 1, "b"), (4, None, None)], "doc_id int, y int, text string")
    log = RunLog("run")
    seen = log.seen(rows, "read", ("text", "y"), {"y": (0, 1, 2)})
    drawn = log.seen(sampling.drawn(seen.where("y is not null"), {0: 7, 1: 3}, ("doc_id",)), "drawn", classes={"y": (0, 1)})
    never = log.seen(rows, "never ran")
    assert drawn.count() == 10
    deadline = time.time() + 20
    while len(got := {(r.step, r.name): r.n for r in log.lines(spark).collect()}) < 9 and time.time() < deadline:
        time.sleep(0.2)
    assert got[("drawn", "rows")] == 10 and got[("drawn", "y = 0")] == 7 and got[("drawn", "y = 1")] == 3
    assert never is not None and not any(step == "never ran" for step, _ in got)
    rows_read = {k: v for k, v in got.items() if k[0] == "read"}
    assert rows_read[("read", "rows")] in (3, 4) and rows_read[("read", "y = 1")] == 2 and rows_read[("read", "y = 2")] == 0
    log.write(spark, str(tmp_path / "log"))
    log.write(spark, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2 * len(got)


def test_tasks_that_learn_word_vectors_grow_with_the_words(spark, monkeypatch):
    asked, plain = [], learners.Word2Vec
    monkeypatch.setattr(learners, "Word2Vec", lambda **k: asked.append(k["numPartitions"]) or plain(**k))
    rows = spark.createDataFrame([(["a", "b", "c", "d"] * 5,)] * 10 + [(None,)], "w array<string>").where("w is not null")
    for of, parts in ((8_000_000, 8), (20, 10)):
        monkeypatch.setattr(learners, "LEARNED", of)
        assert {r.word for r in learners.word_vectors(rows, "w", size=4).collect()} == set("abcd")
        assert asked.pop() == parts
