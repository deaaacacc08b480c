"""Cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tonewright import functions as fn
from tonewright import sources
from tonewright.operators import evaluate, features, sampling, sinks, spans, threads
from tonewright.streaming import arriving_sentences


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def authors(spark, text):
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {r.off: (r.author, r.author_off) for r in threads.enclosing_blocks(threads.thread_pieces(frame)).collect()}


def test_authors_of_nested_posts(spark):
    text = '<post author="ann">hi</post>'
    assert authors(spark, text) == {19: ("ann", 14)}
    text = '<post author="ann"><quote orig_author="bob">x</quote>y</post>'
    found = authors(spark, text)
    assert found[text.index(">x<") + 1][0] == "bob" and found[text.index(">y<") + 1] == ("ann", 14)
    text = '<post author="ann"><quote>x</quote></post>'
    assert authors(spark, text)[text.index("x")] == (None, None)


def test_own_text_of_blocks(spark):
    text = '<post author="a">one <quote orig_author="b">inner</quote>two</post>'
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.own: r.segments for r in threads.own_text(threads.thread_pieces(frame)).collect()}
    assert got == {"one two": 2, "inner": 1}


@pytest.mark.parametrize(("off", "hit"), [(8, True), (9, False), (4, False), (5, True)])
def test_asof_bounds(spark, off, hit):
    sents = spark.createDataFrame([(1, 0, 5, "abc"), (1, 1, 20, "later")], "doc_id long, pos int, off int, sent string")
    found = spark.createDataFrame([(1, off)], "doc_id long, off int")
    assert (spans.asof_sentence(found, sents).first()["sent"] == "abc") is hit


def test_cjk_sentences(spark):
    frame = spark.createDataFrame([(1, "甲。乙！丙")], "doc_id long, text string")
    assert [r.sent for r in spans.sentences(frame, fn.SENTENCE_CJK).orderBy("pos").collect()] == ["甲。", "乙！", "丙"]


def test_offsets_give_back_the_text(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(30)
    cut = spans.sentences(docs).join(docs.select("doc_id", "text"), "doc_id")
    assert cut.where("substring(text, off + 1, length(sent)) <> sent").count() == 0
    sizes = cut.groupBy("doc_id").agg(F.sum(F.length("sent")).alias("n"), F.max(F.length("text")).alias("m"))
    assert sizes.where("n <> m").count() == 0


def test_rules(spark):
    cut = lambda v, c: one(spark, fn.cut_class(F.lit(v), c))[0]
    assert [cut(v, (0.7, 1.7)) for v in (0.69, 0.7, 1.69, 1.7)] == [0, 1, 1, 2]
    assert [cut(v, (0.7, 1.7, 2.3)) for v in (2.29, 2.3)] == [2, 3]
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, fn.argmax(arr(0.4, 0.4, 0.2)))[0] == 0
    assert [one(spark, fn.threshold_class(arr(*p)))[0] for p in ((0.5, 0.5), (0.4, 0.6), (0.6, 0.4), (0.52, 0.48))] == [0, 2, 1, 0]
    assert one(spark, fn.clip_pad(arr(1, 2, 3), 2, F.lit(0)))[0] == [1, 2] and one(spark, fn.clip_pad(arr(1.0), 3, F.lit(0.1)))[0] == [1.0, 0.1, 0.1]
    assert [one(spark, fn.encode(F.lit(x), fn.POLARITIES))[0] for x in ("None", "neg", "pos", "?")] == [0, 1, 2, 0]
    assert one(spark, fn.file_genre(F.lit("NYT_ENG_1")), fn.file_genre(F.lit("ENG_NW_1")), fn.file_genre(F.lit("ENG_DF_1")))[:] == ("nw", "nw", "df")
    assert one(spark, fn.kept_for(F.lit("ENG_NW_1"), "df"), fn.kept_for(F.lit("ENG_DF_1"), "nw"), fn.kept_for(F.lit("x"), "both"))[:] == (False, False, True)
    assert one(spark, fn.clean_text(F.lit("A b,\nC<br />d!")))[0] == ["a", "b", ",", "c", "d", "!"]
    assert [round(x, 6) for x in one(spark, *features.signed_sums(arr(0.5, -0.25, 0.125)))] == [0.625, -0.25]


def test_votes_and_targets(spark):
    votes = spark.createDataFrame([(1, 1), (1, 0), (1, 2), (2, 0), (2, 2), (2, 2)], "k long, y int")
    assert {r.k: r.y for r in evaluate.majority(votes, ("k",)).collect()} == {1: 0, 2: 2}
    n = spark.createDataFrame([(0, 100), (1, 20), (2, 5)], "y int, n long")
    assert tuple(sampling.upsample_targets(n).first()) == (100, 100, 25)
    assert tuple(sampling.upsample_targets(n.where("y <> 1")).first()) == (100, 100, 0)


def test_metrics_over_nothing_are_zero(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0)], "g int, p int")
    assert tuple(evaluate.binary_metrics(rows, F.col("g"), F.col("p")).first())[1:] == (1.0, 0.0, 0.0, 0.0)


ERE = """<deft_ere><entities><entity id="e1" type="PER" specificity="specific"><entity_mention id="m1" noun_type="NAM" source="f" offset="3" length="3"><mention_text>Ann</mention_text></entity_mention>
<entity_mention noun_type="NAM" source="f" offset="9" length="3"><mention_text>Bob</mention_text></entity_mention></entity></entities>
<fillers><filler id="f1" type="title" offset="20" length="4">boss</filler></fillers>
<relations><relation id="r1" type="gen" subtype="x"><relation_mention id="rm1" realis="true"><rel_arg1 entity_id="e1" entity_mention_id="m1" role="a">Ann</rel_arg1><rel_arg2 filler_id="f1" role="b">boss</rel_arg2><trigger offset="7" length="2">is</trigger></relation_mention></relation></relations>
<hoppers><hopper id="h1"><event_mention id="ev1" type="t" subtype="s" realis="r" ways="w"><trigger offset="" length="5">speak</trigger><em_arg entity_id="e1" entity_mention_id="m1" role="who">Ann</em_arg></event_mention></hopper></hoppers></deft_ere>"""
BEST = """<belief_sentiment_doc><sentiment_annotations><entities><entity ere_id="m1" offset="3" length="3"><text>Ann</text><sentiments><sentiment polarity="pos" sarcasm="no"><source ere_id="m2" offset="9" length="3">Bob</source></sentiment><sentiment polarity="neg" sarcasm="no"/></sentiments></entity></entities></sentiment_annotations></belief_sentiment_doc>"""


def test_mention_and_annotation_files(spark, tmp_path):
    (tmp_path / "a.rich_ere.xml").write_text(ERE)
    (tmp_path / "a.best.xml").write_text(BEST)
    (tmp_path / "a.cmp.txt").write_text("é\nÜ")
    ere, best = str(tmp_path / "a.rich_ere.xml"), str(tmp_path / "a.best.xml")
    assert [(r.file, r.mention_id, r.off, r.mention) for r in sources.entity_file(spark, ere).collect()] == [("a", "m1", 3, "Ann")]
    r = sources.relation_file(spark, ere).first()
    assert (r.arg1_mention, r.arg1_is_filler, r.arg2_mention, r.arg2_off, r.arg2_is_filler, r.trigger) == ("Ann", 0, "boss", 20, 1, "is")
    events, args = sources.event_file(spark, ere)
    e, a = events.first(), args.first()
    assert (e.event_mention_id, e.trigger_off, e.trigger_len, e.em_arg_num) == ("ev1", None, 5, 1) and (a.arg_mention, a.arg_role) == ("Ann", "who")
    assert [(r.target_id, r.label, r.source_id, r.source_off) for r in sources.annotation_file(spark, best, "entity").collect()] == [("m1", "pos", "m2", 9)]
    assert sources.annotation_file(spark, best, "entity", first=False).count() == 2
    assert tuple(sources.whole_texts(spark, str(tmp_path / "a.cmp.txt")).first()) == ("a", "é\nÜ")


def test_result_documents_and_sinks(spark, tmp_path):
    schema = "file string, kind string, target_id string, off int, len int, text string, label string, source_id string, source_off int, source_len int, source_text string"
    rows = spark.createDataFrame([("f", "entity", "m1", 3, 3, "Ann", "pos", "s", 1, 2, "Bo"), ("f", "entity", "m2", 1, 3, "Cat", "none", "s", 1, 2, "Bo"), ("f", "event", "v", 1, 1, "x", "neg", None, None, None, None)], schema)
    doc = sinks.result_documents(rows, "sentiment").first().doc
    assert [(e._ere_id, e.sentiment.source is not None) for e in doc.entity] == [("m2", False), ("m1", True)] and len(doc.event) == 1
    assert [e.belief.source is not None for e in sinks.result_documents(rows, "belief").first().doc.entity] == [True, True]
    assert "<belief_sentiment_doc>" in sinks.as_xml(sinks.result_documents(rows, "sentiment")).first().xml
    sinks.write_table(rows, str(tmp_path / "t"), ("kind",))
    sinks.write_table(rows.limit(1), str(tmp_path / "t"), ("kind",))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_embedding_lines_and_reviews(spark, tmp_path):
    lines = spark.createDataFrame([("a 1 2.5",), ("b -1 x",)], "value string")
    assert {r.word: r.vec for r in sources.embedding_lines(lines).collect()} == {"a": [1.0, 2.5], "b": [-1.0, None]}
    for y in ("pos", "neg"):
        (tmp_path / y).mkdir()
        (tmp_path / y / "1.txt").write_text(y)
    assert {r.text: r.y for r in sources.review_folders(spark, str(tmp_path / "*")).collect()} == {"pos": 1, "neg": 0}


def test_streamed_sentences(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One. Two!\nThree")
    q = arriving_sentences(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.sents for r in spark.table("arrived").collect()] == [["One.", " Two!", "\n", "Three"]]


def test_bounded_contexts_stop_at_tags(spark):
    frame = spark.createDataFrame([(1, "A. B. <post>C. D.")], "doc_id long, text string")
    parts = spans.bounded(spans.sentences(frame))
    got = [r.context3 for r in spans.frames(parts, (3,), within=("part",)).orderBy("pos").collect()]
    assert got == ["A. B.", "A. B.", " C. D.", " C. D."]
