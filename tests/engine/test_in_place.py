"""Offsets, mentions, sentences around them and windows are found in a text's own row: nothing is sorted."""

import pytest

from tonewright import plans
from tonewright.operators import spans

NAMES = ("word_offsets", "asof_sentence", "target_window", "relation_mentions", "offset_text_check", "sentence_offsets")


@pytest.mark.parametrize("name", NAMES)
def test_nothing_is_sorted(spark, small, name):
    plan = plans.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_odd_texts(spark):
    """Nulls, empty texts, characters beyond the basic plane; the as-of join by rows agrees with that by arrays."""
    texts = [None, "", "Alpha", "\U0001f600 Alpha beta. Gamma!\n\nDelta Éa Omega", "no names. at all", "." * 9 + "Sigma"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in spans.tokens(docs).collect():
        assert texts[r.doc_id][r.off : r.off + len(r.tok)] == r.tok
    found = spans.located(docs)
    joined = spans.asof_sentence(spans.mentions(docs), spans.sentences(docs)).select(*found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, joined.collect())) != []
    words = spans.tokens(docs).where("tok rlike '^[A-Za-z]+$'")
    slid = spans.target_window(words, words.tok.rlike("^[A-Z][a-z]{3,}$"))
    assert sorted(map(tuple, spans.windows(docs, "^[A-Z][a-z]{3,}$").collect())) == sorted(map(tuple, slid.collect()))
