import hashlib
import math
import os
import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tonewright.llm import fingerprint as fp


def brute(text):
    strong, lanes = [0] * fp.STRONG, [0] * fp.LANES
    for p in text.split("\n"):
        h = hashlib.sha512(p.encode()).hexdigest()
        for k in range(fp.STRONG):
            strong[k] += int(h[16 * k : 16 * k + 16], 16)
        words = [w for w in p.split(" ") if w]
        for a, b in zip(words, [*words[1:], None], strict=False):
            x = xxhash.xxh64_intdigest(a.encode(), 42)
            if b is not None:
                x = xxhash.xxh64_intdigest(b.encode(), x)
            lanes[x & (fp.LANES - 1)] += 1 - 2 * (x >> 20 & 1)
    return "".join(f"{x % 2**64:016x}" for x in strong) + "".join(f"{x % 2**16:04x}" for x in lanes), lanes


def near(a, b):
    if a == b:
        return 1.0
    n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return round(max(0.0, min(1.0, sum(x * y for x, y in zip(a, b, strict=True)) / n)), 6) if n else 0.0


def check(frame, **more):
    rows = sorted(((r.doc_id, r.text or "") for r in frame.collect()), key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1]), reverse=True)
    want = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        (a, x), (b, y), (_, z) = brute(t), brute(edited), brute(nxt)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, near(x, y), near(x, z)))
    got = [tuple(r) for r in fp.fingerprints(frame, **more).collect()]
    key = lambda r: (str(r[0]), *r[1:5])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert abs(g[5] - w[5]) < 2e-6 and abs(g[6] - w[6]) < 2e-6


def test_odd(odd):
    check(odd)
    check(odd, block_rows=2)
    check(odd.where("doc_id = 8"))


def test_documents(spark, small):
    check(spark.read.parquet(os.path.join(small, "documents.parquet")), block_rows=30)


def test_empty(none):
    assert fp.fingerprints(none).collect() == []


def test_order_of_paragraphs_and_insertion(spark):
    frame = spark.createDataFrame([(1, "b c\na"), (2, "a\nb c"), (3, "a\nb c\nb c")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(frame).collect()}
    assert got[1] == got[2] != got[3]
    word = lambda s: [int(s[16 * k : 16 * k + 16], 16) for k in range(fp.STRONG)]
    added = word(spark.range(1).select(fp.strong_lanes(F.lit("b c"))).first()[0])
    assert [(x + y) % 2**64 for x, y in zip(word(got[2]), added, strict=True)] == word(got[3])


def test_lanes_beyond_16_bits(spark):
    """One line 40,000 times: likeness comes from the whole sums."""
    check(spark.createDataFrame([(1, "a b\n" * 40_000 + "c d\n" * 30_000), (2, "a b\nc d e f\n" * 30)], "doc_id long, text string"))


def test_how_near_the_likeness_is():
    """Against the true cosine of the counts of pairs, over texts that share 0 to 90 % of their words: the docstring's error."""
    rng, words, off = random.Random(6), [f"w{k}" for k in range(4000)], {}
    for k in range(400):
        share = k % 10 / 10
        a = rng.choices(words, k=300)
        cut = int(300 * share)
        b = a[:cut] + rng.choices(words, k=300 - cut)
        x, y = (Counter(zip(t, [*t[1:], None], strict=True)) for t in (a, b))
        true = sum(x[p] * y[p] for p in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        sketch = [brute(" ".join(t))[1] for t in (a, b)]
        raw = sum(p * q for p, q in zip(*sketch, strict=True)) / math.sqrt(sum(p * p for p in sketch[0]) * sum(q * q for q in sketch[1]))
        off.setdefault(share, []).append((raw - true) / (1 - true * true))
    for share, errors in off.items():
        spread = math.sqrt(sum(e * e for e in errors) / len(errors))
        assert 0.5 < spread * math.sqrt(fp.LANES) < 1.5, share


def test_a_long_text(spark):
    check(spark.createDataFrame([(1, ("long " + "x" * 1000 + " line\n") * 10_000), (2, "x")], "doc_id long, text string"))


def test_one_id_on_many_rows(spark):
    frame = spark.createDataFrame([(7 if k % 3 else k, f"text {k}") for k in range(300)] + [(None, f"null {k}") for k in range(50)], "doc_id long, text string")
    check(frame, block_rows=20)
