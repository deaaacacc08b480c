import math
import os

import public_tokenizers

from tonewright.llm import tokencount
from tonewright.llm.tokencount import MARK, Trie, Vocabulary

PATH = public_tokenizers.path(tokencount.VOCABULARY)
V = Vocabulary(PATH)


def brute(word):
    """Fewest pieces among the most probable segmentations, and the log of all segmentations' probability, by a plain forward pass."""
    token = MARK + word
    best, total = [(0.0, 0)], [0.0]
    for end in range(1, len(token) + 1):
        options = [(start, V.scores[token[start:end]], 1) for start in range(max(0, end - V.longest), end) if token[start:end] in V.scores]
        if not any(s == end - 1 for s, _, _ in options):
            n = len(token[end - 1].encode())
            options.append((end - 1, n * V.byte, n))
        best.append(max(((best[s][0] + p, best[s][1] - n) for s, p, n in options)))
        top = max(total[s] + p for s, p, n in options)
        total.append(top + math.log(sum(math.exp(total[s] + p - top) for s, p, n in options)))
    return -best[-1][1], total[-1]


def check(frame):
    got = sorted(((str(r.doc_id), r.n_words, r.n_tokens, r.log_prob) for r in tokencount.token_counts(frame, PATH).collect()))
    want = []
    for r in frame.collect():
        found = [brute(w) for w in (r.text or "").split()]
        want.append((str(r.doc_id), len(found), sum(n for n, _ in found), sum(p for _, p in found)))
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:3] == w[:3]
        assert abs(g[3] - w[3]) < 1e-9 * max(1, abs(w[3]))


def test_odd(odd):
    check(odd)


def test_documents(spark, small):
    check(spark.read.parquet(os.path.join(small, "documents.parquet")))


def test_long_texts_and_words(spark):
    """10 MB of distinct words, and a word of 300,000 characters, in bounded tables."""
    words = [f"w{k:x}q" for k in range(1_200_000)]
    counter = tokencount.Counter(V)
    n, tokens, log = counter.count(" ".join(words))
    assert n == len(words) and len(counter.trie.best) <= tokencount.NODES + 10 * tokencount.RUN
    short = tokencount.Counter(V)
    some = [short.count(w) for w in words[::1000]]
    assert tokens > sum(t for _, t, _ in some) > 0 and log < sum(x for _, _, x in some) < 0
    long = "abcdefghij" * 30_000
    got, want = tokencount.alone(V, MARK + long), brute(long)
    assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9 * abs(want[1])


def test_small_tries_and_long_words(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "alpha beta alphabet alp \U0001f600"), (2, "x" * 30 + " alphabetic")], "doc_id long, text string")
    monkeypatch.setattr(tokencount, "NODES", 3)
    monkeypatch.setattr(tokencount, "RUN", 2)
    monkeypatch.setattr(tokencount, "LONG", 6)
    check(frame)


def test_prefixes_are_scored_once():
    trie = Trie(V)
    trie.insert("abcde")
    n = len(trie.best)
    trie.insert("abcdf")
    assert len(trie.best) == n + 1 and trie.insert("abc") < n


def test_empty(none):
    assert tokencount.token_counts(none, PATH).collect() == []
