import hashlib
import os
import re

from tonewright.llm import substring


def check(frame, size, **more):
    docs = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in frame.collect()]
    rank = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, w in docs:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, rank(i)), rank(i))
    want = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < rank(i):
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring.repeated_windows(frame, size, **more).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert sum(s.stop - s.start for s in r.removed) == r.n_removed
        assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256
    return sum(x[2] for x in want)


def test_odd(odd):
    assert check(odd, 13)
    assert check(odd, 2, block_rows=3)


def test_documents(spark, small):
    docs = spark.read.parquet(os.path.join(small, "documents.parquet"))
    assert check(docs, 13, block_bytes=40_000)
    check(docs.withColumnRenamed("text", "t").withColumnRenamed("t", "text"), 13)


def test_empty(none):
    assert substring.repeated_windows(none).collect() == []
