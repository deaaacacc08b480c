"""Result files written, read back, merged; vectors and samples from files."""

import xml.etree.ElementTree as ET

from pyspark.ml.feature import Word2Vec

from tonewright import sources
from tonewright.operators import sinks

SCHEMA = "file string, kind string, target_id string, off int, len int, text string, label string, source_id string, source_off int, source_len int, source_text string"
SENTIMENT = [
    ("f1", "entity", "m1", 3, 3, "Ann & <Bo>", "pos", "m9", 40, 3, "Cy"),
    ("f1", "entity", "m2", 1, 3, "Dee", "none", None, None, None, None),
    ("f1", "relation", "r1", 8, 2, "is", "neg", None, None, None, None),
    ("f1", "relation", "r2", None, None, None, "none", None, None, None, None),
    ("f2", "event", "v1", 9, 5, "speak", "neg", "m9", 40, 3, "Cy"),
]
BELIEF = [("f1", "relation", "r1", 0, 0, None, "cb", None, None, None, None), ("f1", "event", "v7", 9, 5, "speak", "na", "m9", 40, 3, "Cy")]
ARGS = [("f1", "v7", "a1", 50, 3, "Eve"), ("f1", "v7", "a0", 20, 2, "Al"), ("f1", "v8", "a2", 1, 1, "x")]
ARG_SCHEMA = "file string, event_id string, arg_id string, off int, len int, text string"


def read_back(spark, folder, files):
    for r in files.collect():
        (folder / f"{r.file}.xml").write_text(r.xml)
    return sources.result_file(spark, str(folder))


def test_round_trip_and_merge(spark, tmp_path):
    st, be, args = spark.createDataFrame(SENTIMENT, SCHEMA), spark.createDataFrame(BELIEF, SCHEMA), spark.createDataFrame(ARGS, ARG_SCHEMA)
    be = sinks.with_triggers(be, st)
    files = sinks.result_files(sinks.annotations(st, "sentiment"), sinks.annotations(be, "belief", args=args))
    xml = {r.file: ET.fromstring(r.xml) for r in files.collect()}
    assert [x.tag for x in xml["f1"]] == ["belief_annotations", "sentiment_annotations"] and [x.tag for x in xml["f2"]] == ["sentiment_annotations"]
    assert [e.get("ere_id") for e in xml["f1"].findall("sentiment_annotations/entities/entity")] == ["m2", "m1"]
    assert xml["f1"].find("belief_annotations/relations/relation/trigger").text == "is"
    assert [(a.get("ere_id"), a.find("beliefs/belief").get("type")) for a in xml["f1"].iter("arg")] == [("a0", "na"), ("a1", "na")]
    back = read_back(spark, tmp_path, files)
    rows, none = sources.result_rows(back, "sentiment")
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, SENTIMENT)) and none.count() == 0
    rows, held = sources.result_rows(back, "belief")
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, [("f1", "relation", "r1", 8, 2, "is", "cb", None, None, None, None), BELIEF[1]]))
    assert sorted(map(tuple, held.collect())) == sorted(ARGS[:2])


def test_files_are_written_and_replaced(spark, tmp_path):
    files = sinks.result_files(sinks.annotations(spark.createDataFrame(SENTIMENT, SCHEMA), "sentiment"))
    for kept in (files, files.where("file = 'f2'")):
        sinks.write_files(kept, str(tmp_path / "out"))
    assert [p.name for p in sorted((tmp_path / "out").glob("file=*"))] == ["file=f2"]
    empty = spark.createDataFrame([], SCHEMA)
    assert sinks.result_files(sinks.annotations(empty, "sentiment")).count() == 0


def test_of_repeated_words_the_last_stays(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a 1 1\nb 2 2\na 3 x\n")
    assert {r.word: r.vec for r in sources.embedding_file(spark, str(tmp_path / "v.txt")).collect()} == {"a": [3.0, None], "b": [2.0, 2.0]}


def test_model_vectors_and_samples(spark, tmp_path):
    rows = spark.createDataFrame([(["x", "y", "x"],)], "w array<string>")
    model = Word2Vec(inputCol="w", outputCol="v", vectorSize=3, minCount=1, seed=1).fit(rows)
    assert {r.word: len(r.vec) for r in sources.model_vectors(model).collect()} == {"x": 3, "y": 3}
    (tmp_path / "s.csv").write_text('"two\nlines ""q""",9,pos\nb,8,neg\n')
    assert [tuple(r) for r in sources.sample_csv(spark, str(tmp_path / "s.csv")).collect()] == [('two\nlines "q"', "pos"), ("b", "neg")]
