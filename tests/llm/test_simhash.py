import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tonewright.llm import simhash


def brute_print(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=2):
    """Least id over each group of rows linked by fingerprint distance, by trying all pairs of distinct prints."""
    prints = sorted({p for _, p in rows})
    seen, out = set(), {}
    for start in prints:
        if start in seen:
            continue
        group, todo = set(), [start]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += [y for y in prints if y not in group and (x ^ y).bit_count() <= radius]
        seen |= group
        ids = [i for i, p in rows if p in group and i is not None]
        out |= {p: min(ids, default=None) for p in group}
    return out


def check(spark_rows, source):
    prints = [(i, brute_print(t)) for i, t in source]
    least = brute_components(prints)
    want = sorted(((i, f"{p:016x}", least[p]) for i, p in prints), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in spark_rows), key=str) == want


def test_odd_rows(odd):
    check(simhash.near_duplicates(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])


def test_documents(spark, small):
    docs = spark.read.parquet(os.path.join(small, "documents.parquet"))
    check(simhash.near_duplicates(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_empty(none):
    assert simhash.near_duplicates(none).collect() == []


def test_links_over_many_shards(spark):
    """Planted groups at distance 1 and 2, chains included, over a tree of many small shards."""
    rng = random.Random(5)
    values = set()
    for _ in range(600):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            for b in rng.sample(range(64), rng.choice([1, 2])):
                x ^= 1 << b
            values.add(x)
    rows = [(i, v) for i, v in enumerate(sorted(values))]
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for _, v in rows], "fp long")
    edges = simhash.links(frame, 2, shard=150, sample=500)
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    least = brute_components(rows)
    groups, want = {}, {}
    for _, v in rows:
        groups.setdefault(found.get(v - (1 << 64) if v >> 63 else v, v - (1 << 64) if v >> 63 else v), set()).add(v)
        want.setdefault(least[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert simhash.fit_tree(np.array(sorted(values), np.uint64), len(values), 2, 150)


def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def brute_kept(rows):
    """The first row of each component, by trying all pairs."""
    sets, left, kept = brute_sets([t for _, t in rows]), set(range(len(rows))), []
    while left:
        todo, group = [left.pop()], []
        while todo:
            x = todo.pop()
            group.append(x)
            met = {y for y in left if sets[x] == sets[y] or 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])}
            left -= met
            todo += met
        kept.append(min((rows[x][0] is None, rows[x][0] or 0, rows[x][1] or "") for x in group)[1:])
    return sorted(kept)


def made():
    """Copies with 0 to 8 words changed of 200, chains of copies, texts of one passage and their own words, exact copies."""
    rng, words = random.Random(3), [f"w{k}" for k in range(5000)]
    texts, passage = [], rng.choices(words, k=60)
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(3, 300))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
            base = copy if rng.random() < 0.5 else base
        texts.append(" ".join(passage + rng.choices(words, k=rng.randint(5, 60))))
    return [(i, t) for i, t in enumerate(texts + texts[:10])]


@pytest.mark.parametrize("crowd", [4096, 3])
def test_near_copies_against_all_pairs(spark, monkeypatch, crowd):
    rows = made()
    monkeypatch.setattr(simhash, "ROWS", 200)
    monkeypatch.setattr(simhash, "VERIFY", 20_000)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    got = simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = brute_kept(rows)
    assert sorted((r.doc_id, r.text) for r in got) == want and len(want) < 0.8 * len(rows)


def test_near_copies_of_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = simhash.distinct_documents(odd)
    assert got.columns == odd.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == brute_kept(rows)
    assert simhash.distinct_documents(none).collect() == []


def test_shards_grow_with_the_input(spark):
    """Several rounds of trees: shards stay small while the fingerprints grow fourfold."""
    leaves = []
    for n in (20_000, 80_000):
        frame = spark.range(n).select(F.xxhash64("id").alias("fp"))
        sizes = [r["count"] for r in simhash.shards(frame, 2, 500, 600).groupBy("shard").count().collect()]
        assert max(sizes) <= 1000
        leaves.append(len(sizes))
    assert leaves[1] > 3 * leaves[0]


def test_exact_shares():
    rng = np.random.default_rng(4)
    for n, pool in ((2, 20), (40, 60), (200, 400)):
        base = rng.choice(1 << 40, pool, replace=False).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(pool) < 0.93], rng.integers(0, 50, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(n)]
        label = list(range(n))
        for a in range(n):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((label[a], label[b]))
                    label = [x if z == y else z for z in label]
        assert simhash.alike(sets).tolist() == label
