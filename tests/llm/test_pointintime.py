import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.llm import pointintime

ASKS = "who string, t long, won string, k int"
VERSIONS = "who string, event long, arrival long, expiry long, id long, low int, ask string"


def brute(asks, versions):
    out = []
    for who, t, *_ in asks:
        fit = [v for v in versions if None not in v[:4] and who is not None and t is not None and v[0] == who and v[1] <= t and v[2] <= t < v[3]]
        out.append(((who, t), max(((v[1], -v[2], -1 if v[4] is None else v[4]) for v in fit), default=None)))
    return sorted(out, key=str)


def found(spark, asks, versions, **how):
    got = pointintime.as_of(spark.createDataFrame(asks, ASKS), spark.createDataFrame(versions, VERSIONS), "who", "t", "event", "arrival", "expiry", "id", ("low", "ask"), **how).collect()
    for r in got:
        assert r.won is None or (r.won.low, r.won.ask) == (r.won.event % 7, f"of {r.ask.who}")
    return sorted([((r.ask.who, r.ask.t), r.won and (r.won.event, -r.won.arrival, -1 if r.won.version is None else r.won.version)) for r in got], key=str)


def drawn(n, seed, most=4000, lengths=(1, 50, 900, 5000, 100_000)):
    r = random.Random(seed)
    who = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    versions = []
    for k in range(n):
        w, event = who(), r.randrange(most)
        versions.append((w, event, event + r.randrange(-60, 540), event + r.randrange(r.choice(lengths)), r.choice([k, k // 2]), event % 7, f"of {w}"))
    return [(who(), r.randrange(most + 500), "mine", 3) for _ in range(n // 2)], versions


@pytest.mark.parametrize(("n", "how"), [(400, {}), (400, {"bits": 4, "most": 16, "group": 64}), (60, {"most": 1, "group": 1}), (300, {"bits": 2, "most": 3, "group": 7})])
def test_against_every_pair(spark, n, how):
    asks, versions = drawn(n, n)
    assert found(spark, asks, versions, **how) == brute(asks, versions)


def test_edges_ties_and_extremes(spark):
    top = (1 << 63) - 1
    versions = [("a", 10, 10, 20, 1), ("a", 10, 10, 20, 2), ("a", 10, 9, 20, 0), ("a", 5, 15, 30, 3), ("a", 20, 20, 20, 4), ("a", 30, 25, 28, 5), ("b", 0, 0, top, 6), ("c", -top - 1, -top - 1, top, 7),
                (None, 1, 1, 9, 8), ("a", None, 1, 9, 9), ("a", 1, None, 9, 10), ("a", 1, 1, None, 11), ("d", 1, 1, 5, None), ("d", 1, 1, 5, 12), ("d", 1, 1, 5, 12)]
    versions = [(*v, (v[1] or 0) % 7, f"of {v[0]}") for v in versions]
    moments = (None, -top - 1, 0, 4, 5, 9, 10, 14, 15, 19, 20, 25, 29, 30, 31, top - 1, top)
    asks = [(w, t, "x", 1) for w in ("a", "b", "c", "d", "e", None) for t in moments for _ in range(2)]
    got = found(spark, asks, versions, most=2, group=3)
    assert got == brute(asks, versions)
    assert dict(got)[("a", 10)] == (10, -9, 0) and dict(got)[("a", 19)] == (10, -9, 0) and dict(got)[("b", top - 1)] == (0, 0, 6)


def test_empty_tables(spark):
    asks, versions = drawn(20, 1)
    assert found(spark, [], versions) == [] and found(spark, [], []) == []
    assert [w for _, w in found(spark, asks, [])] == [None] * len(asks)


def test_trees_know_the_greatest_expiry_below():
    r = np.random.default_rng(3)
    low, high = np.array([0, 1, 8]), np.array([1, 8, 40])
    expiry = r.integers(0, 100, 40)
    top = pointintime.forest(low, high, expiry)

    def below(a, b):
        if a < b:
            m = (a + b) // 2
            assert top[m] == expiry[a:b].max()
            below(a, m), below(m + 1, b)

    for a, b in zip(low, high, strict=True):
        below(a, b)


def test_timestamps_and_words_as_versions(spark):
    v = spark.sql("select * from values ('a', 1L, 1L, 9L, 'x', timestamp'2024-01-02 03:04:05'), ('a', 1L, 1L, 9L, 'y', null) t(who, event, arrival, expiry, id, seen)")
    got = pointintime.as_of(spark.sql("select 'a' as who, 3 as t"), v, "who", "t", "event", "arrival", "expiry", "id", ("seen",)).select("won.*").collect()
    assert [(r.version, r.seen) for r in got] == [("y", None)]
    got = pointintime.as_of(spark.sql("select 'a' as who, 3 as t"), v.where("id = 'x'"), "who", "t", "event", "arrival", "expiry", "id", ("seen",)).select(F.col("won.seen").cast("string").alias("s")).collect()
    assert got[0].s == "2024-01-02 03:04:05"
