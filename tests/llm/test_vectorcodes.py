import random
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from tonewright.llm import vectorcodes as v


def brute(rows, parts, entries, rounds):
    """Plain Python over all pairs: {row: (code, error)}, codebooks."""
    ints = [[floor(Fraction(x) * 4096) for x in r[1]] for r in rows]
    size = len(ints[0]) // parts
    cut = lambda r, p: tuple(r[p * size : (p + 1) * size])
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[cut(ints[i], p) for i in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda r, p: min((far(cut(r, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[near(r, p)[1] for p in range(parts)] for r in ints]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(r, p) for r, c in zip(ints, codes, strict=True) if c[p] == k]
                if own:
                    books[p][k] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    found = [[near(r, p) for p in range(parts)] for r in ints]
    return [("".join(f"{k:02x}" for _, k in f), min(v.MOST, sum(d for d, _ in f))) for f in found]


def single(x):
    return float(np.float32(x))


def check(spark, rows, parts=2, entries=4, rounds=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code int, error string")
    got = v.codes(df, parts=parts, entries=entries, rounds=rounds).collect()
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    want = brute(kept, parts, entries, rounds) if kept else []
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in got), key=str) == sorted(((r[0], r[2], *w) for r, w in zip(kept, want, strict=True)), key=str)


@pytest.mark.parametrize(("scale", "seed"), [(0.01, 1), (1.0, 2), (100.0, 3), (3e4, 4), (1e7, 5), (1e30, 6)])
def test_against_all_pairs(spark, scale, seed):
    r = random.Random(seed)
    check(spark, [(n // 2, [single(r.gauss(0, 1) * scale) for _ in range(6)], r.choice([1, 2, None]), 0, "x") for n in range(60)])


def test_ties_repeats_nulls_and_broken_vectors(spark):
    r = random.Random(9)
    rows = [(n, [single(r.choice([-1, 0, 1]) / 4096) for _ in range(4)], None, 0, "x") for n in range(80)]
    rows += [(None, [0.0] * 4, 3, 0, "x"), (500, None, 1, 0, "x"), (501, [0.0, None, 0.0, 0.0], 1, 0, "x"), (502, [float("nan"), 0.0, 0.0, 0.0], 1, 0, "x"), (503, [float("-inf"), 0.0, 0.0, 0.0], 1, 0, "x"), (504, [], 1, 0, "x"), *rows[:9]]
    check(spark, rows, entries=16, rounds=6)


def test_few_rows_and_other_lengths(spark):
    check(spark, [(1, [0.5, -0.5], 1, 0, "x"), (0, [0.25, 3.0], 1, 0, "x")], entries=16)
    check(spark, [])
    df = spark.createDataFrame([(1, [0.5, 1.0], 1), (0, [0.25, 1.0], 1), (2, [1.0] * 4, 1), (3, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(r.vec_id for r in v.codes(df, parts=2).collect()) == [0, 1]


def test_label_errors_sum_over_equal_labels(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(n, [r.random() for _ in range(4)], r.choice([1, 2, 2, 2, None])) for n in range(50)], "vec_id long, embedding array<double>, label int")
    got = v.with_label_errors(v.codes(df, parts=2, entries=3)).collect()
    sums: dict = {}
    for x in got:
        sums[x.label] = sums.get(x.label, 0) + x.error
    assert len(got) == 50 and all(x.label_error == sums[x.label] for x in got) and len({x.codebooks_sha256 for x in got}) == 1


def test_the_scan_finds_the_nearest_from_any_start():
    r = np.random.default_rng(1)
    for scale in (3, 50, 1 << 40):
        entries = [tuple(int(x) for x in e) for e in r.integers(-scale, scale, (16, 3))]
        book = v.Codebook(entries)
        rows = r.integers(-scale, scale, (200, 3)).astype(object if scale > 1 << 28 else np.int64)
        want = [min((sum((int(a) - b) ** 2 for a, b in zip(row, e, strict=True)), k) for k, e in enumerate(entries)) for row in rows]
        for start in (np.zeros(200, np.uint8), r.integers(0, 16, 200).astype(np.uint8)):
            code, far = book.nearest(rows, start)
            assert [(int(d), int(k)) for d, k in zip(far, code, strict=True)] == want


@pytest.mark.parametrize("x", [0, 1, -1, 1 << 31, -(1 << 31), (1 << 31) - 1, 1 << 140, -(1 << 140) - 5])
def test_limbs_add_up(x):
    assert sum(k << (v.LIMB * n) for n, k in enumerate(v.limbs(x))) == x
