"""Mention files through to tables, result and prediction files, saved models, areas and defaults."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright import sources
from tonewright.operators import evaluate, extraction, learners, nets, sampling, sinks

TEXT = 'x<post author="Ann">One fine day. Bob is the boss of us all\nand so on.</post><post>Cy left.</post>'
at = TEXT.index
ERE = f"""<deft_ere><entities><entity id="e1" type="PER" specificity="specific"><entity_mention id="m1" noun_type="NAM" source="f" offset="{at('Ann')}" length="3"><mention_text>Ann</mention_text></entity_mention>
<entity_mention id="m2" noun_type="NAM" source="f" offset="{at('Bob')}" length="3"><mention_text>Bob</mention_text></entity_mention><entity_mention id="m3" noun_type="NAM" source="f" offset="{at('Cy')}" length="2"><mention_text>Cy</mention_text></entity_mention></entity></entities>
<fillers><filler id="f1" type="title" offset="{at('boss')}" length="4">boss</filler></fillers>
<relations><relation id="r1" type="gen" subtype="x"><relation_mention id="rm1" realis="true"><rel_arg1 entity_id="e1" entity_mention_id="m2" role="a">Bob</rel_arg1><rel_arg2 filler_id="f1" role="b">boss</rel_arg2><trigger offset="{at('is the')}" length="2">is</trigger></relation_mention></relation></relations>
<hoppers><hopper id="h1"><event_mention id="ev1" type="t" subtype="s" realis="r" ways="w"><trigger offset="{at('left')}" length="4">left</trigger><em_arg entity_id="e1" entity_mention_id="m3" role="who">Cy</em_arg></event_mention></hopper></hoppers></deft_ere>"""
BEST = f"""<belief_sentiment_doc><sentiment_annotations><entities><entity ere_id="m2" offset="{at('Bob')}" length="3"><text>Bob</text><sentiments><sentiment polarity="pos" sarcasm="no"><source ere_id="m1" offset="{at('Ann')}" length="3">Ann</source></sentiment></sentiments></entity>
<entity ere_id="m3" offset="{at('Cy')}" length="2"><text>Cy</text><sentiments><sentiment polarity="none" sarcasm="no"/></sentiments></entity></entities><relations><relation ere_id="rm1"><sentiments><sentiment polarity="neg" sarcasm="no"/></sentiments></relation></relations></sentiment_annotations></belief_sentiment_doc>"""


@pytest.mark.parametrize("from_files", [True, False])
def test_tables_of_a_file(spark, tmp_path, from_files):
    paths = sources.Catalogue(str(tmp_path))
    name = "ENG_DF_1"
    for folder, end, body in ((paths.mentions, ".rich_ere.xml", ERE), (paths.annotations, ".best.xml", BEST), (paths.sources, ".cmp.txt", TEXT)):
        (tmp_path / folder.removeprefix(f"{tmp_path}/")).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder.removeprefix(f"{tmp_path}/") / f"{name}{end}").write_text(body)
    if from_files:
        read, marks = sources.elements_in(spark, paths.mentions), sources.annotation_file(spark, paths.annotations, "entity").unionByName(sources.annotation_file(spark, paths.annotations, "relation")).where("task = 'sentiment'")
    else:
        one = lambda x: spark.createDataFrame([(name, x)], "file string, xml string")
        read, marks = sources.elements_of(one(ERE)), sources.annotation_documents(one(BEST))
    texts = extraction.with_sources(spark.createDataFrame([(name,)], "file string"), sources.whole_texts(spark, paths.sources))
    made = extraction.extract(read, texts, marks)
    got = {r.mention_id: r for r in made["entity"].collect()}
    assert set(got) == {"m2", "m3"}  # m1 stands inside a tag
    assert got["m2"].context1 == " Bob is the boss of us all " and got["m2"].context3 == "One fine day. Bob is the boss of us all and so on."
    assert got["m2"].window == "Bob is the boss of" and got["m2"].sentence_off == at(" Bob")
    assert (got["m2"].label_polarity, got["m2"].source_id, got["m2"].source_off) == ("pos", "m1", at("Ann"))
    assert got["m3"].context7 == "Cy left." and (got["m3"].label_polarity, got["m3"].source_id, got["m3"].source_len) == ("none", "", 0)
    r, = made["relation"].collect()
    assert (r.arg1_context1, r.arg2_context1, r.trigger_context) == (" Bob is the boss of us all ",) * 3 and (r.arg2_is_filler, r.label_polarity) == (1, "neg")
    assert made["event"].count() == 0  # not annotated
    plain = extraction.extract(read, texts)
    e, = plain["event"].collect()
    assert (e.trigger_context7, e.trigger_window, e.em_arg_num) == ("Cy left.", "Cy left", 1)
    a, = plain["em_args"].collect()
    assert (a.event_mention_id, a.arg_mention, a.arg_context) == ("ev1", "Cy", "Cy left.")
    assert [r.mention_id for r in extraction.extract(read, texts, marks, with_none=False)["entity"].collect()] == ["m2"]
    assert extraction.extract(read, texts, genre="nw")["entity"].count() == 0


def test_sources_by_the_first_32_characters(spark):
    long = "ENG_DF_000183_20150408_F0000009B"
    ere = spark.createDataFrame([(f"{long}_2",), (f"{long}_3",), ("own",), ("lost",)], "file string")
    found = spark.createDataFrame([(long, "shared"), ("own", "mine")], "file string, text string")
    assert sorted(map(tuple, extraction.with_sources(ere, found).collect())) == [(f"{long}_2", "shared"), (f"{long}_3", "shared"), ("own", "mine")]


def test_predictions_and_features_by_name(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, [1.0]), ("a", 0, [2.0])], "sample_id string, y int, x array<double>")
    sinks.write_predictions(rows, str(tmp_path / "p"))
    sinks.write_features(rows, str(tmp_path / "f"))
    assert sorted(map(tuple, sources.prediction_file(spark, str(tmp_path / "p")).collect())) == [("a", 0), ("b", 2)]
    asked = spark.createDataFrame([("a",), ("c",)], "sample_id string")
    assert {r.sample_id: r.x for r in sources.kept_features(spark, str(tmp_path / "f"), asked).collect()} == {"a": [2.0], "c": None}


def test_models_are_saved_and_loaded(spark, tmp_path):
    net = nets.dense(4, 2)
    x = np.random.default_rng(1).normal(size=(3, 2, 2))
    learners.save_model(net, str(tmp_path / "net"), spark)
    assert np.allclose(learners.load_model(str(tmp_path / "net"), spark).probabilities(x), net.probabilities(x))
    rows = spark.createDataFrame([(["x", "y", "x"],)], "w array<string>")
    model = learners.Word2Vec(inputCol="w", outputCol="v", vectorSize=3, minCount=1, seed=1).fit(rows)
    for _ in range(2):
        learners.save_model(model, str(tmp_path / "ml"), spark)
    assert learners.load_model(str(tmp_path / "ml"), spark).transform(rows).first().v == model.transform(rows).first().v


def test_area_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), rng.randint(0, 9)) for _ in range(200)]
    pairs = [(a > b) + 0.5 * (a == b) for g, a in rows if g for h, b in rows if not h]
    got = evaluate.area(spark.createDataFrame(rows, "g int, s int"), "g", "s").first()
    assert got.auc == round(sum(pairs) / len(pairs), 6) and got.positives == sum(g for g, _ in rows)
    none = spark.createDataFrame([], "g int, s int")
    assert tuple(evaluate.area(none, "g", "s").first()) == (0, 0, 0.0)


def test_default_draws(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, 0).when(F.col("id") < 2800, 1).otherwise(2).alias("y"))
    drawn = {r.y: r["count"] for r in sampling.resampled_by_default(rows).groupBy("y").count().collect()}
    assert all(abs(drawn[k] - 800) < 150 for k in range(3))
    two = {r.y: r["count"] for r in sampling.resampled_by_default(rows.where("y < 2"), 2).groupBy("y").count().collect()}
    assert all(abs(two[k] - 1400) < 150 for k in range(2))
