import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from tonewright.llm import suffix


def check(frame, window, gram, **more):
    docs = [(r.doc_id, (r.text or "").encode()) for r in frame.collect()]
    times = Counter(t[k : k + window] for _, t in docs for k in range(len(t) - window + 1))
    want = []
    for i, t in docs:
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if times[t[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        want.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(t, gone, strict=True) if not x)).hexdigest()))
    got = suffix.repeated_strings(frame, window, gram, **more).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert sum(s.stop - s.start for s in r.removed) == r.n_removed
    return sum(x[2] for x in want)


def test_odd(odd):
    assert check(odd, 200, 100)
    assert check(odd, 12, 6, block_rows=3)


def test_documents(spark, small):
    docs = spark.read.parquet(os.path.join(small, "documents.parquet"))
    assert check(docs, 200, 100, block_bytes=40_000)
    assert check(docs, 200, 100, block_bytes=40_000, hot=1)


@pytest.mark.parametrize(("piece", "hot"), [(1 << 18, 1000), (64, 1000), (1 << 18, 2), (64, 1)])
def test_random_small_alphabet(spark, monkeypatch, piece, hot):
    """Dense overlapping repeats, periods, and documents longer than a piece."""
    monkeypatch.setattr(suffix, "PIECE", piece)
    rng = random.Random(9)
    common = ["".join(rng.choice("abc") for _ in range(rng.randint(20, 60))) for _ in range(5)]
    rows = []
    for i in range(60):
        text = "".join(rng.choice([rng.choice(common), "".join(rng.choice("abcdéf") for _ in range(rng.randint(1, 30))), "ab" * rng.randint(1, 20)]) for _ in range(rng.randint(0, 9)))
        rows.append((i, text))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert check(frame, 24, 10, block_rows=7, hot=hot)


def test_empty(none):
    assert suffix.repeated_strings(none).collect() == []


def test_suffix_sort_against_sorted():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 99, 4000).astype(np.uint8)
    at = rng.integers(0, 3900, 600)
    group = np.sort(rng.integers(0, 7, 600))
    poly = suffix.Poly(1, 4096)
    order = suffix.suffix_sort(raw, at, group, 60, poly, poly.prefix(raw))
    keys = [(int(group[k]), raw[at[k] : at[k] + 60].tobytes()) for k in order]
    assert keys == sorted(keys)
