import os

import pytest
from pyspark.sql import functions as F

from tonewright import sources
from tonewright.operators import drivers, sampling, threads


@pytest.fixture(scope="module")
def samples(spark):
    """Two genres; the opinion can be read from the words, the belief from the kind."""
    rows = []
    for k in range(240):
        y = k % 4 if k % 4 < 3 else 0
        word = {0: "plain", 1: "awful", 2: "lovely"}[y]
        rows.append((k, "df" if k % 3 else "nw", f"sample {word} number {k % 7} text", ["PER", "ORG", "GPE", "LOC"][k % 4], y, k % 4 if k % 5 else None))
    return spark.createDataFrame(rows, "doc_id long, genre string, text string, kind string, y int, b int").persist()


def test_parts(samples):
    got = drivers.parts(samples).groupBy("wanted", "genre", "part").count().collect()
    assert {(r.wanted, r.genre, r.part): r["count"] for r in got} == {("df", "df", "train"): 128, ("df", "df", "test"): 32, ("nw", "df", "train"): 160, ("nw", "nw", "train"): 16, ("nw", "nw", "test"): 64}


def test_weights_are_the_copies_of_upsampling(samples):
    rows = samples.where("b is not null")
    want = {(r.doc_id, r["count"]) for r in sampling.upsample_cyclic(rows.select("doc_id", "b"), "doc_id", "b").groupBy("doc_id").count().collect()}
    assert {(r.doc_id, r.copies) for r in drivers.weights(rows.select("doc_id", "b"), label="b").collect()} == want
    by = drivers.weights(rows.select("genre", "doc_id", "b"), label="b", by=("genre",))
    for g in ("df", "nw"):
        own = rows.where(F.col("genre") == g).select("doc_id", "b")
        assert {(r.doc_id, r.copies) for r in by.where(F.col("genre") == g).collect()} == {(r.doc_id, r.copies) for r in drivers.weights(own, label="b").collect()}


def test_features_become_arrays_by_name(spark):
    found = spark.createDataFrame([(1, "a", 0.5), (1, "c", 2.0), (2, "b", 1.0), (2, "unknown", 9.0)], "doc_id int, name string, value double")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    got = {r.doc_id: r.x for r in drivers.dense(found, "doc_id", ["a", "b", "c"], keys).collect()}
    assert got == {1: [0.5, 0.0, 2.0], 2: [0.0, 1.0, 0.0], 3: [0.0, 0.0, 0.0]}
    assert [r.x for r in drivers.dense(found, "doc_id", [], keys).collect()] == [[]] * 3


@pytest.mark.parametrize(("wanted", "task", "judge", "least"), [("df", drivers.SENTIMENT, drivers.by_regression, 0.9), ("nw", drivers.BELIEF, drivers.by_regression, 0.9), ("nw", drivers.SENTIMENT, drivers.by_network, 0.8)])
def test_a_run_learns_what_can_be_read(samples, wanted, task, judge, least):
    run = drivers.prepared(samples, wanted, task, terms=20)
    judged = judge(run).persist()
    assert judged.count() == run.test.count() > 0
    scores = {r.task: r for r in drivers.scored(run, judged).collect()}
    assert set(scores) == set(task.classes) and all(r.of == task.name and r.wanted == wanted for r in scores.values())
    assert min(r.accuracy for r in scores.values()) >= least


def test_the_filter_knows_the_two_opinions_alone(samples):
    judged = drivers.by_filter(drivers.prepared(samples, "df", drivers.SENTIMENT, terms=20)).collect()
    told = [r for r in judged if r.gold]
    assert {r.p for r in judged} <= {0, 1, 2} and sum(r.p == r.gold for r in told) >= 0.8 * len(told)


def test_files_come_back(spark, samples, tmp_path):
    for task in drivers.TASKS:
        run = drivers.prepared(samples, "nw", task, terms=20)
        judged = run.test.select("doc_id", "gold", F.col("gold").alias("p")).persist()
        folder = str(tmp_path / task.name)
        drivers.write(run, judged, folder)
        said = {(r.sample_id, r.y_predict) for r in sources.prediction_file(spark, f"{folder}/predictions").collect()}
        assert said == {(str(r.doc_id), r.p) for r in judged.collect()}
        kept = sources.kept_features(spark, f"{folder}/features", judged.select(F.col("doc_id").cast("string").alias("sample_id")))
        assert kept.where("x is null").count() == 0
        rows, _ = sources.result_rows(sources.result_file(spark, f"{folder}/results"), task.name)
        assert {(r.target_id, r.label) for r in rows.collect()} == {(str(r.doc_id), task.classes[r.p]) for r in judged.collect()}
        assert os.path.isdir(f"{folder}/results")


def test_labels_of_nested_blocks(spark):
    text = '<post author="a">one<quote orig_author="b">two</quote>three</post>'
    parts = threads.thread_pieces(spark.createDataFrame([(1, text), (2, "no posts")], "doc_id long, text string"))
    blocks = {r.own: (r.start, r.end, r.offsets) for r in threads.block_segments(parts).where("doc_id = 1").collect()}
    a, b, c = text.index("one"), text.index("two"), text.index("three")
    assert blocks == {"onethree": (a, c + 5, f"{a}:{a + 3} {c}:{c + 5}"), "two": (b, b + 3, f"{b}:{b + 3}")}
    marks = spark.createDataFrame([(1, a, "pos"), (1, a + 1, "pos"), (1, b + 3, "neg"), (1, 0, "none"), (3, 5, "pos")], "doc_id long, at int, label string")
    assert {(r.own, r.label) for r in threads.labelled_blocks(parts, marks).collect()} == {("onethree", "pos"), ("two", "neg")}


def test_tasks_of_equal_nulls_share_their_features(spark, samples, monkeypatch):
    calls, weigh = [], drivers.general_features
    monkeypatch.setattr(drivers, "general_features", lambda *a: calls.append(1) or weigh(*a))
    seen = lambda run: [sorted(tuple(r) for r in df.select("doc_id", "gold", "x").collect()) for df in (run.train, run.test)]
    both = samples.where("b is not null").withColumn("text", F.concat("text", F.lit(" end")))
    for rows, times in ((both, 1), (samples, 2)):
        calls.clear()
        got = drivers.runs(rows, "df", drivers.TASKS, 5)
        assert len(calls) == times
        for run, task in zip(got, drivers.TASKS, strict=True):
            assert run.task is task and seen(run) == seen(drivers.prepared(rows, "df", task, 5))
