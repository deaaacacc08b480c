import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.operators import lexicon, segmenting, splitting, tagging

# Sentence ends.

SHORT = {"Mr.": ["Brown", "Smith", "Jones"], "Dr.": ["Brown", "Gray"], "approx.": ["ten", "five"], "vol.": ["3", "12"], "p.m.": ["and", "or"]}


def prose(seed, sentences=60):
    """Sentences of random words, abbreviations inside them; the words that end sentences also stand elsewhere."""
    r = random.Random(seed)
    words = "clinic street key door house river garden window letter story summer morning table market bridge winter".split()
    out = []
    for _ in range(sentences):
        inner = [r.choice(words) for _ in range(r.randrange(3, 9))]
        if r.random() < 0.7:
            short = r.choice(list(SHORT))
            inner[1:1] = [short, r.choice(SHORT[short])]
        out.append(" ".join([r.choice(["The", "They", "Then", "He"]), *inner]) + r.choice([".", ".", ".", ".", "!", "?", "..."]))
    return out


def test_abbreviations_are_learned_and_stay_whole(spark):
    texts = [prose(k) for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    known = splitting.learned(docs)
    assert {r.kind for r in known.short.collect()} == {"mr", "dr", "approx", "vol", "p.m"}
    assert {r.kind for r in known.starters.collect()} == {"the", "they", "then", "he"}
    assert {("mr", "brown"), ("vol", "12"), ("approx", "ten")} <= {(r.kind, r.next.replace("#", "12")) for r in known.pairs.collect()}
    got: dict = {}
    for r in splitting.split(docs, known).orderBy("doc_id", "pos").collect():
        assert " ".join(texts[r.doc_id])[r.off : r.off + len(r.sent)] == r.sent
        got.setdefault(r.doc_id, []).append(r.sent.strip())
    assert [got[k] for k in range(40)] == texts


def test_ratio_against_the_binomial_form():
    def told(k, n, p):
        return sum(x * math.log(q) for x, q in ((k, p), (n - k, 1 - p)) if x)

    def ratio(a, b, ab, n):
        return 2 * (told(ab, a, ab / a) + told(b - ab, n - a, (b - ab) / (n - a)) - told(ab, a, b / n) - told(b - ab, n - a, b / n))

    assert ratio(10, 20, 2, 100) == pytest.approx(0, abs=1e-9)  # as often as by chance


def test_counted_words(spark):
    rows = spark.createDataFrame([("He saw (Dr.) Who. 3.5 up\nWhy? no",), ("",), (None,), ("  \n",)], "text string")
    got = {(r.kind, r.stop, r.over, r.next): r.n for r in splitting.words(rows).collect()}
    assert got == {("he", False, False, "saw"): 1, ("saw", False, False, "dr."): 1, ("dr.", False, False, "who"): 1, ("who", True, False, "#"): 1, ("#", False, False, "up"): 1, ("up", False, True, "why?"): 1, ("why?", False, True, "no"): 1, ("no", False, False, None): 1} or ("dr", True, False, "who") in got


def test_pairs_are_counted_at_ends_only(spark):
    rows = spark.createDataFrame([("one two three. Four two three.",), ("one\nfive (six.)",)], "text string")
    got = {(r.kind, r.stop, r.over, r.next): r.n for r in splitting.words(rows).collect()}
    assert got == {("one", False, False, None): 1, ("two", False, False, None): 2, ("three", True, False, "four"): 1, ("three", True, False, None): 1, ("four", False, False, None): 1, ("one", False, True, "five"): 1, ("five", False, False, None): 1, ("six", True, False, None): 1}


def test_sentences_are_cut_in_their_row(spark):
    """Texts move once, to be dealt out; nothing is sorted or grouped.  Letters beyond ASCII are lower-cased as they were when counted."""
    docs = spark.createDataFrame([(1, " \n\u0130x. Then \u00c9t. no Dr. Who... The end"), (2, None), (3, ""), (4, "Dr. The")], "doc_id long, text string")
    one = lambda *rows: spark.createDataFrame(rows, "kind string, score double")
    pairs = spark.createDataFrame([("dr", "the", 9.0)], "kind string, next string, score double")
    found = splitting.split(docs, splitting.Known(one(("i\u0307x", 1.0), ("\u00e9t", 1.0), ("dr", 1.0)), one(("then", 40.0), ("the", 40.0)), pairs))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan
    got = sorted(tuple(r) for r in found.collect())
    assert got == [(1, 0, 0, " \n"), (1, 1, 2, "\u0130x. "), (1, 2, 6, "Then \u00c9t. no Dr. Who... "), (1, 3, 29, "The end"), (4, 0, 0, "Dr. The")]


def test_every_word_that_reaches_its_threshold_is_known(spark):
    found = spark.range(25_000).select(F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("w"))
    ends = found.select(F.lit("went").alias("kind"), F.lit(True).alias("stop"), F.lit(False).alias("over"), F.col("w").alias("next"), F.lit(15).cast("long").alias("n"))
    stands = found.select(F.col("w").alias("kind"), F.lit(False), F.lit(False), F.lit(None).cast("string"), F.lit(15).cast("long"))
    often = spark.createDataFrame([("and", False, False, None, 3_000_000), ("went", False, False, None, 500_000)], "kind string, stop boolean, over boolean, next string, n long")
    patch = pytest.MonkeyPatch()
    patch.setattr(splitting, "words", lambda docs, text: ends.union(stands).union(often))
    try:
        known = splitting.learned(found)
    finally:
        patch.undo()
    assert known.starters.count() == 25_000


def test_knowledge_that_is_not_broadcast_cuts_the_same_sentences(spark, monkeypatch):
    texts = [prose(k, 12) for k in range(30)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)] + [(40, "\u0130x. Then \u00c9t. no Dr. Who... The end"), (41, None), (42, "Dr. The"), (42, "Mr. Brown"), (43, "")], "doc_id long, text string")
    known = splitting.learned(docs)
    want = sorted(tuple(r) for r in splitting.split(docs, known).collect())
    for most in (0, 3, 4):
        monkeypatch.setattr(splitting, "MOST", most)
        assert sorted(tuple(r) for r in splitting.split(docs, known).collect()) == want


def test_odd_texts_split(spark):
    rows = [(1, None), (2, ""), (3, "   "), (4, " one"), (5, "a\n\nbee. C"), (6, "x" * 100_000 + ". Y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = splitting.split(docs, splitting.learned(docs)).orderBy("doc_id", "pos").collect()
    back = {k: "".join(r.sent for r in got if r.doc_id == k) for k, _ in rows}
    assert back == {k: t or "" for k, t in rows}
    assert [r.sent for r in got if r.doc_id == 5] == ["a\n\n", "bee. ", "C"]


# Tags.


def told(pairs, words, ends, spark):
    return tagging.model(spark.createDataFrame(pairs, "before string, tag string, n long"), spark.createDataFrame(words, "word string, tag string, n long"), spark.createDataFrame(ends, "ending string, tag string, n long"))


@pytest.fixture(scope="module")
def known(spark):
    r = random.Random(5)
    tags, words = "ABC", ["dog", "runs", "fast", "cats", "ran"]
    pairs = [(b, t, r.randrange(1, 20)) for b in [*tags, "^"] for t in tags if r.random() < 0.8]
    said = [(w, t, r.randrange(1, 9)) for w in words for t in tags if r.random() < 0.6] + [(f"only{t}", t, 3) for t in tags]
    rows = spark.createDataFrame(said, "word string, tag string, n long")
    return told(pairs, said, [tuple(x) for x in tagging.endings(rows).collect()], spark)


def test_decoding_against_all_tag_paths(known):
    r = random.Random(6)
    words = ["dog", "runs", "Fast", "cats", "ran", "unseen", "xs", "", "dogs"]
    number = {t: k for k, t in enumerate(known.tags)}
    for n in range(1, 6):
        for _ in range(15):
            sentence = [r.choice(words) for _ in range(n)]

            def score(path, sentence=sentence):
                at = [number[t] for t in path]
                return sum(known.pairs[b, t] + known.given(w)[t] for b, t, w in zip([len(number), *at], at, sentence, strict=False))

            best = max(score(p) for p in itertools.product(known.tags, repeat=n))
            assert score(known.tagged(sentence)) == pytest.approx(best, abs=1e-9)
    assert known.tagged([]) == []


def test_counts_and_tags_in_spark(spark, known):
    rows = spark.createDataFrame([(1, ["A", "b", "c"], ["X", None, "Y"]), (2, ["a", "a"], ["X", "X"]), (3, [], []), (4, None, None)], "id long, words array<string>, tags array<string>")
    assert {tuple(r) for r in tagging.transitions(rows).collect()} == {("^", "X", 2), ("X", "X", 1)}
    assert {tuple(r) for r in tagging.emissions(rows).collect()} == {("A", "X", 1), ("a", "X", 2), ("c", "Y", 1)}
    got = {r.id: r.tags for r in tagging.tag(rows.drop("tags"), known).collect()}
    assert got == {1: known.tagged(["A", "b", "c"]), 2: known.tagged(["a", "a"]), 3: [], 4: None}
    nothing = told([], [], [], spark)
    assert nothing.tagged(["a"]) == []


def test_unknown_words_are_judged_by_their_ending(spark):
    words = [(f"{stem}ing", "VBG", 2) for stem in ("go", "sing", "runn", "eat")] + [(f"{stem}s", "NNS", 2) for stem in ("dog", "cat", "tree")] + [("the", "DT", 9)]
    ends = [tuple(r) for r in tagging.endings(spark.createDataFrame(words, "word string, tag string, n long")).collect()]
    m = told([("^", t, 5) for t in ("VBG", "NNS", "DT")] + [("DT", "NNS", 5), ("DT", "VBG", 5)], words, ends, spark)
    assert m.tagged(["swimming"]) == ["VBG"] and m.tagged(["the", "horses"]) == ["DT", "NNS"] and m.tagged(["the", "walking"]) == ["DT", "VBG"]
    assert np.isclose(np.exp(m.endings["inga"]).sum(), 1)


def test_seeds(spark):
    rows = spark.createDataFrame([(["The", "old", "Man", "is", "42", "and", "quickly", "walking", "the", "dog"],)], "w array<string>")
    assert rows.select(tagging.seeded(F.col("w")).alias("t")).first().t == ["DT", "NN", "NNP", "VB", "CD", "CC", "RB", "VBG", "DT", "NN"]


# Words of unspaced script.


def test_paths_against_all_cuts():
    r = random.Random(2)
    shares = {w: math.log(r.random()) for w in ("a", "b", "ab", "ba", "aba", "bab", "abab", "bb")}
    known = segmenting.Dictionary(shares, math.log(1e-4), 4)

    def cuts(run):
        if not run:
            yield []
        for k in range(1, len(run) + 1):
            if k == 1 or run[:k] in shares:
                yield from ([run[:k], *rest] for rest in cuts(run[k:]))

    for n in range(9):
        for letters in itertools.product("abc", repeat=min(n, 5)):
            run = "".join(letters) + "ab" * max(0, n - 5)
            score = lambda ws: sum(shares.get(w, known.least) for w in ws)
            got = known.cut(run)
            assert "".join(got) == run and score(got) == pytest.approx(max(map(score, cuts(run))))


def test_strings_and_spreads_against_plain_counts(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("甲乙丙丁") for _ in range(r.randrange(12))) + r.choice(["", "，x ", "。"]) + "".join(r.choice("甲乙") for _ in range(5)) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    runs, want = [], {}
    for t in texts:
        runs += [f"\n{x}\n" for x in "".join(c if "一" <= c <= "鿿" else " " for c in t).split()]
    for run in runs:
        for i in range(len(run)):
            for k in range(1, 6):
                if i + k <= len(run) and run[i : i + k] != "\n":
                    want[run[i : i + k]] = want.get(run[i : i + k], 0) + 1
    counts = segmenting.strings(segmenting.runs(docs)).persist()
    assert {x.s: x.n for x in counts.collect()} == want
    total = sum(n for s, n in want.items() if len(s) == 1)
    entropy = lambda ns: -sum(n / sum(ns) * math.log(n / sum(ns)) for n in ns)
    for x in segmenting.candidates(counts).collect():
        assert x.n == want[x.word] >= 5
        assert x.cohesion == pytest.approx(min(math.log(x.n * total / (want[x.word[:k]] * want[x.word[k:]])) for k in range(1, len(x.word))))
        assert x.before == pytest.approx(entropy([n for s, n in want.items() if len(s) == len(x.word) + 1 and s[1:] == x.word]))
        assert x.after == pytest.approx(entropy([n for s, n in want.items() if len(s) == len(x.word) + 1 and s[:-1] == x.word]))


def test_words_are_found_again(spark):
    """Texts made of a hidden dictionary: most of its words are learned, offsets are exact."""
    r = random.Random(4)
    letters = [chr(0x4E00 + k) for k in range(300)]
    words = ["".join(r.sample(letters, r.choice([2, 2, 3]))) for _ in range(60)] + letters[:30]
    texts, gold = [], []
    for k in range(300):
        said = [r.choice(words) for _ in range(20)]
        texts.append((k, "序：" + "".join(said[:10]) + "，abc " + "".join(said[10:])))
        gold.append(said)
    docs = spark.createDataFrame([*texts, (900, None), (901, ""), (902, "latin only"), (903, "龘")], "doc_id long, text string")
    counts = segmenting.strings(segmenting.runs(docs)).persist()
    known = segmenting.dictionary(counts, segmenting.candidates(counts))
    got: dict = {}
    text = dict(texts) | {903: "龘"}
    for x in segmenting.segmented(docs, known).orderBy("doc_id", "off").collect():
        assert text[x.doc_id][x.off : x.off + len(x.word)] == x.word
        got.setdefault(x.doc_id, []).append(x.word)
    assert set(got) == set(range(300)) | {903}
    ends = lambda ws: set(itertools.accumulate(map(len, ws)))
    hit = sum(len(ends(got[k][1:]) & ends(gold[k])) for k in range(300)) / sum(len(ends(g)) for g in gold)
    assert hit > 0.95 and all("".join(got[k]) == "序" + "".join(gold[k]) for k in range(300))


# Polarities.


def test_polarities_by_hand(spark):
    rows = spark.createDataFrame([("Good good day", 2), ("good film", 2), ("bad film", 1), ("day film", 0), ("good night", None), (None, 2)], "text string, y int")
    counts = {r.word: (r.none, r.neg, r.pos) for r in lexicon.counted(rows).collect()}
    assert counts == {"good": (0, 0, 2), "day": (1, 0, 1), "film": (1, 1, 1), "bad": (0, 1, 0)}
    got = {r.word: (r.n, r.polarity, r.subjectivity) for r in lexicon.polarities(lexicon.counted(rows), rows, least=1).collect()}
    p = (2 + 3 / 4) / 4, (0 + 1 / 4) / 2
    assert got["good"] == (2, round(math.tanh(math.log(p[0] / p[1]) * 2 / 7 / 2), 6), 1.0) and got["bad"][1] < 0 and got["film"][2] == round(2 / 3, 6)
    assert {r.polarity for r in lexicon.polarities(lexicon.counted(rows.where("y = 2")), rows.where("y = 2"), least=1).collect()} == {0.0}


def test_scopes(spark):
    known = spark.createDataFrame([("good", 0.5), ("bad", -0.4)], "word string, polarity double")
    rows = [(1, "good"), (2, "not good"), (3, "not a very good film"), (4, "not one of the good"), (5, "Not. Good"), (6, "slightly bad good"), (7, "very"), (8, None), (9, ""), (10, "never bad! good")]
    got = {r.id: (r.pos, r.neg, r.words) for r in lexicon.scored(spark.createDataFrame(rows, "id long, text string"), known, ("id",)).collect()}
    assert got == {1: (0.5, 0, 1), 2: (0, -0.5, 1), 3: (0, -0.75, 1), 4: (0.5, 0, 1), 5: (0.5, 0, 1), 6: (0.5, -0.2, 2), 7: (0, 0, 0), 8: (0, 0, 0), 9: (0, 0, 0), 10: (0.9, 0, 2)}
