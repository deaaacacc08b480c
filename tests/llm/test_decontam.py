import os
import random

import numpy as np

from tonewright.llm import decontam
from tonewright.llm.decontam import words_of


def brute_score(item, text):
    """Smith-Waterman over all cells."""
    last, best = [0] * (len(text) + 1), 0
    for w in item:
        now = [0]
        for j, t in enumerate(text, 1):
            now.append(max(0, last[j - 1] + (1 if w == t else -1), last[j] - 1, now[-1] - 1))
        best = max(best, *now)
        last = now
    return best


def test_alignment_against_all_cells():
    rng = np.random.default_rng(2)
    for _ in range(50):
        item, text = rng.integers(1, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(0, 40))
        assert decontam.align(item, text)[0] == (brute_score(item.tolist(), text.tolist()) if len(text) else 0)
        score, a, b = decontam.span(item, text)
        assert brute_score(item.tolist(), text[a:b].tolist()) == score if b > a else score == 0


def test_documents(spark, small):
    docs, tests = spark.read.parquet(os.path.join(small, "documents.parquet")), spark.read.parquet(os.path.join(small, "benchmark.parquet"))
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, tests).collect()}
    items = [(r.item_id, words_of(r.text)) for r in tests.collect()]
    near = set()
    for r in docs.collect():
        words = words_of(r.text)
        here = set(words)
        for i, w in items:
            if len(here & set(w)) >= 0.5 * len(set(w)) and brute_score(w, words) >= 0.5 * len(w):
                near.add((r.doc_id, i))
    assert set(got) == near
    for (d, i), r in got.items():
        assert 0.5 <= r.score <= 1 and r.stop_word > r.start_word


def test_edited_copies(spark):
    """A fifth of the words changed, dropped or added: found; shuffled words: not."""
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=40))) for k in range(20)]
    rows, want = [], set()
    for d in range(120):
        i, text = rng.choice(items)
        words = text.split()
        kind = d % 4
        if kind == 0:
            rng.shuffle(words)
        elif kind < 3:
            for k in rng.sample(range(40), 4 * kind):
                words[k] = rng.choice([rng.choice(vocabulary), "", f"{words[k]}, new"])
        if kind:
            want.add((d, i))
        rows.append((d, " ".join(rng.choices(vocabulary, k=rng.randint(0, 300))) + ". " + " ".join(words).upper() + "; " + " ".join(rng.choices(vocabulary, k=50))))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_edited_copy_in_many_documents(spark):
    """One edited copy, every fifth word replaced, with over half of the 3-grams gone: found however many documents hold it.

    In the last case the item's lost 3-grams occur elsewhere, once each.
    """
    words = [f"w{k}" for k in range(40)]
    copy = " ".join("new" if k % 5 == 0 else w for k, w in enumerate(words))
    tests = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    lost = [" ".join(words[k : k + 3]) for k in range(38) if {k % 5, (k + 1) % 5, (k + 2) % 5} & {0}]
    for copies, others in ((1, []), (5, []), (1000, []), (1000, lost)):
        rows = [(d, f"before {d} {copy} after") for d in range(copies)] + [(5000 + d, t) for d, t in enumerate(others)]
        got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), tests).collect()
        assert sorted(r.doc_id for r in got) == list(range(copies))
        assert {r.score for r in got} == {0.625}  # 32 words match, 7 between them do not


def test_odd(spark, odd, none, monkeypatch):
    tests = spark.createDataFrame([(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, "one"), (None, "a null id carries words"), (5, "?!")], "item_id long, text string").selectExpr("*", "7 as doc_id")
    want = {(4, 4), (5, 4), (6, 3), (6, 4), (12, 3), (12, 4), (None, None)}
    got = [(r.doc_id, r.item_id) for r in decontam.contaminated(odd, tests).collect()]
    assert set(got) == want and got.count((6, 3)) == 2
    monkeypatch.setattr(decontam, "MOST_BITS", 5)  # most n-grams of documents pass for those of items
    monkeypatch.setattr(decontam, "LEAST_BITS", 5)
    monkeypatch.setattr(decontam, "PART_BITS", 3)
    assert sorted(map(str, ((r.doc_id, r.item_id) for r in decontam.contaminated(odd, tests).collect()))) == sorted(map(str, got))
    assert decontam.contaminated(none, tests).collect() == []
    assert decontam.contaminated(odd, tests.where("false")).collect() == []


def edited(words, share, rng, vocabulary):
    """A copy with so many of its words replaced, dropped or with another one before them, in turn at random."""
    out, at = [], set(rng.sample(range(len(words)), round(share * len(words))))
    for k, w in enumerate(words):
        out += rng.choice([[rng.choice(vocabulary)], [], [rng.choice(vocabulary), w]]) if k in at else [w]
    return out


def test_recall_of_edited_copies(spark):
    """Of copies that reach the threshold nearly all are found, for 10 to 50 % edits, with and without the common n-grams."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, rng.choices(vocabulary, k=rng.randint(20, 60))) for k in range(50)]
    rows, true = [], {}
    for d in range(500):
        share, (i, words) = (1 + d % 5) / 10, items[d % 50]
        copy = edited(words, share, rng, vocabulary)
        text = rng.choices(vocabulary, k=100) + copy + rng.choices(vocabulary, k=100)
        rows.append((d, " ".join(text)))
        if brute_score(words, text) >= 0.5 * len(words):
            true[d] = share
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for common in (8, 10**9):
        got = {r.doc_id for r in decontam.contaminated(docs, tests, common=common).collect()}
        assert got <= set(true)
        recall = {s: sum(d in got for d in true if true[d] == s) / sum(true[d] == s for d in true) for s in set(true.values())}
        print(common, sorted(recall.items()), {s: sum(true[d] == s for d in true) for s in set(true.values())})
        assert all(r >= 0.97 for s, r in recall.items() if s <= 0.3) and len(got) >= 0.97 * len(true)


def test_edited_copies_of_short_items(spark):
    """Items of 4 to 60 words, 10 to 40 % of the words edited: where a copy reaches the score it is found, that of a short item always."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, rng.choices(vocabulary[:40] if k % 3 == 0 else vocabulary, k=4 + k % 57)) for k in range(114)]
    rows, true = [], {}
    for d in range(1600):
        share, (i, words) = (1 + d % 4) / 10, items[d % 60 % 15 if d % 2 else d % 114]
        text = rng.choices(vocabulary, k=20) + edited(words, share, rng, vocabulary) + rng.choices(vocabulary, k=20)
        rows.append((d, " ".join(text)))
        if brute_score(words, text) >= max(3, 0.5 * len(words)):
            true[d, i] = len(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    assert {k for k, n in true.items() if n <= decontam.SHORT} <= got
    long = [k for k, n in true.items() if n > decontam.SHORT]
    assert sum(k in got for k in long) >= 0.97 * len(long) and len(long) > 300 and len(true) - len(long) > 300
    text = dict(rows)
    assert all(brute_score(items[i][1], text[d].split()) >= max(3, 0.5 * len(items[i][1])) for d, i in got)


def test_items_that_repeat_their_pairs(spark):
    tests = spark.createDataFrame([(1, "x y a x y b"), (2, "la la la la"), (3, "who wrote the great novel")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x y c x y d"), (2, "so la la la she sang"), (3, "who wrote the big novel"), (4, "who wrote a great novel"), (5, "the great flood"), (6, "who wrote it")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.score) for r in decontam.contaminated(docs, tests).collect()}
    assert got == {(1, 1, 0.5), (2, 2, 0.75), (3, 3, 0.6), (4, 3, 0.6)}


def test_clean_keeps_rows_and_columns(spark, odd):
    """Rows go by their own text; equal and null ids and columns under the names used inside stay as they are."""
    tests = spark.createDataFrame([(3, "one two three")], "item_id long, text string")
    docs = odd.selectExpr("*", "1 as pid", "2 as words", "3 as grams", "4 as item")
    kept = decontam.clean(docs, tests)
    assert kept.columns == docs.columns
    want = [r for r in docs.collect() if "one two three" not in (r.text or "").lower()]
    assert sorted(map(str, kept.collect())) == sorted(map(str, want)) and len(want) == docs.count() - 3


def test_a_long_text(spark):
    item = "every word of this item is in the long text somewhere"
    rows = [(1, "other words " * 900_000 + item), (2, "x")]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.score, r.start_word, r.stop_word) for r in got] == [(1, 1.0, 1_800_000, 1_800_011)]
