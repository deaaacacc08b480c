"""The most common terms without counting rare pairs."""

from pyspark.sql import functions as F

from tonewright.operators import features


def test_rare_pairs_are_not_counted(spark):
    """Equal to counting all, ties included, for few and many terms."""
    rows = [(k, " ".join(f"w{(k * 7 + j * j) % (3 + j % 11)}x" for j in range(40)) + f" only{k} alone{k}") for k in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = features.terms(docs, "doc_id", F.col("text"))
    for k in (1, 5, 12, 40, 100_000):
        assert features.most_common(docs, "doc_id", F.col("text"), k).collect() == features.top_terms(every, k).collect()


def test_common_words_may_be_many(spark, monkeypatch):
    """Words are looked for inside the rows or, if they are many, by joins: with the same result."""
    for inside, words in ((0, 20_000), (0, 0), (3, 5)):
        monkeypatch.setattr(features, "INSIDE", inside)
        monkeypatch.setattr(features, "WORDS", words)
        test_rare_pairs_are_not_counted(spark)


def test_a_text_is_cut_once_a_pass(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string").repartition(3)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for pairs in (False, True):
        assert plan(features.terms(docs, "doc_id", F.col("text"), pairs=pairs)).count("regexp_extract_all") == 1
    assert plan(features.tfidf(docs, "doc_id", F.col("text"))).count("regexp_extract_all") == 1


def test_term_weights_of_odd_texts(spark):
    rows = [(1, "The cat and the cat sat"), (2, None), (3, ""), (4, "a b c"), (5, "cat sat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.term): r.weight for r in features.tfidf(docs, "doc_id", F.col("text"), 3).collect()}
    assert set(got) == {(1, "cat"), (1, "cat sat"), (1, "sat"), (5, "cat"), (5, "cat sat"), (5, "sat")}
    assert all(abs(w - 3**-0.5) < 1e-6 for w in got.values())
    assert features.tfidf(docs.where("doc_id = 0"), "doc_id", F.col("text")).collect() == []
