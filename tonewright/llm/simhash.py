"""SimHash near-duplicates found with vantage-point trees.

Fingerprints: whole texts, A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, 3-word shingles with repeats,
XXH64 (seed 42) of each; a bit is 1 if it is set in over half of the hashes.

Links: all pairs of fingerprints at Hamming distance `radius` or less.  A vantage-point tree routes every fingerprint to
shards.  At each vantage point the ball |x - v| <= mu goes inside and the rest outside; by the triangle inequality a
linked pair that the sphere separates has its outer end within mu + radius, so only that thin shell is sent to both
sides.  Trees are fitted in tasks on a bounded sample of one shard each, and shards that are still large get
a tree of their own in the next round, so that shards stay small and their number grows with the input.  Each shard then
builds its own tree the same way, down to small leaves that are compared whole.  A shard
returns one link from each linked fingerprint to the least of its group there, never the pairs; groups
that span shards are joined by alternating star contractions.

Near copies by share of words (`alike_groups`, the pipeline's stage): texts that have `SHARE` or more of their distinct
five-word shingles in common.  Such pairs differ in up to a fifth of a fingerprint's bits, and at that radius no sphere
divides unrelated texts, so the shards come from the shingles: two such texts have the same least shingle under a
random order with a probability of their likeness, and `ORDERS` orders are tried (one pair in 15,000 at 0.8 has none in
common).  In a shard, `WIDE`-bit fingerprints are searched with a vantage-point tree at `REACH` bits (one pair in 5,000
is farther); these links are candidates.  Every group that they make is then compared on the whole shingle sets, and only
links of that comparison count.

Defined results: null or wordless texts have fingerprint zero and are linked like any other; a text of any length is read
whole, in the memory that its words take; a null doc_id takes part but is never a component's id unless the component has no
other; repeated rows and exact copies share a fingerprint; an empty table gives an empty result; other columns are
not read, and `distinct_documents` returns them as they were.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, hot_bar, looked_up, texts, triangles
from .substring import _Hashes, mixed, rolled, word_hashes

SEED = 42
SHINGLE = 3
#: Near copies: words of a shingle, least likeness in tenths, bits of a fingerprint and its radius, orders of shingles.
WORDS, TENTHS, WIDE, REACH, ORDERS = 5, 8, 256, 58, 6
#: Rows of a shard that one task compares whole at most, and bytes of texts that one task verifies.
CROWD, VERIFY = 2048, 16 << 20
#: Rows that one task groups by shingle.
ROWS = 200_000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        raw = np.frombuffer(b"".join(hashes[at : at + 65_536]), np.uint8)
        ones += np.unpackbits(raw).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every document as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [_signed(fingerprint(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def distances(values: np.ndarray, point) -> np.ndarray:
    """Hamming distances of fingerprints (one number each, or a row of them) to one."""
    apart = np.bitwise_count(values ^ point)
    return (apart.sum(1) if apart.ndim > 1 else apart).astype(np.int64)


def _choose(dist: np.ndarray, radius: int) -> int:
    """The sphere's radius: among those that leave a third of the points on each side, the one with the thinnest shell."""
    low, high = np.quantile(dist, [0.35, 0.65])
    sizes = np.bincount(dist, minlength=int(high) + 3 + radius)
    return min(range(int(low), max(int(low) + 1, int(high))), key=lambda mu: (int(sizes[mu + 1 : mu + 1 + radius].sum()), mu))


def _sides(dist: np.ndarray, mu: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes that go inside (the ball and the shell around it) and outside."""
    return np.flatnonzero(dist <= mu + radius), np.flatnonzero(dist > mu)


def _split(values: np.ndarray, radius: int):
    """(vantage, mu) that divides the values best of a few tries, or None where none makes both sides clearly smaller."""
    best = None
    for k in range(3):
        vantage = values[(len(values) * (2 * k + 1)) // 6]
        dist = distances(values, vantage)
        mu = _choose(dist, radius)
        inner, outer = _sides(dist, mu, radius)
        cost = len(inner) ** 2 + len(outer) ** 2
        if max(len(inner), len(outer)) < 0.9 * len(values) and (best is None or cost < best[0]):
            best = (cost, vantage, mu)
    return best and best[1:]


def fit_tree(sample: np.ndarray, total: int, radius: int, shard: int) -> list:
    """Nodes [vantage, mu, inside, outside]; leaves are None in place of a child's index."""
    nodes: list = []
    sample = np.unique(sample)
    scale = total / max(1, len(sample))

    def grow(values: np.ndarray) -> int | None:
        found = _split(values, radius) if len(values) * scale > shard and len(values) >= 32 else None
        if not found:
            return None
        vantage, mu = found
        at = len(nodes)
        nodes.append([int(vantage), int(mu), None, None])
        inner, outer = _sides(distances(values, vantage), mu, radius)
        nodes[at][2], nodes[at][3] = grow(values[inner]), grow(values[outer])
        return at

    grow(sample)
    return nodes


def route(nodes: list, values: np.ndarray, radius: int):
    """Yields (leaf, values there): 2 * node + side."""
    todo = [(0, values)] if nodes else []
    while todo:
        at, here = todo.pop()
        vantage, mu, *children = nodes[at]
        for side, (child, index) in enumerate(zip(children, _sides(distances(here, np.uint64(vantage)), mu, radius), strict=True)):
            if len(index):
                if child is None:
                    yield 2 * at + side, here[index]
                else:
                    todo.append((child, here[index]))


def local_groups(values: np.ndarray, radius: int, leaf: int = 384) -> np.ndarray:
    """For distinct fingerprints, the least index of each one's group of links."""
    label = np.arange(len(values))

    def join(rows: np.ndarray, columns: np.ndarray) -> None:
        apart = np.bitwise_count(values[rows][:, None] ^ values[columns][None, :])
        near = (apart.sum(2) if apart.ndim > 2 else apart) <= radius
        for r in np.flatnonzero(near.sum(1) > 1):
            met = label[columns[near[r]]]
            least = met.min()
            if met.max() != least:
                label[np.isin(label, np.unique(met))] = least

    todo = [np.arange(len(values))]
    while todo:
        index = todo.pop()
        found = _split(values[index], radius) if len(index) > leaf else None
        if found:
            dist = distances(values[index], found[0])
            todo += [index[side] for side in _sides(dist, found[1], radius)]
        else:
            for at in range(0, len(index), 256):
                join(index[at : at + 256], index)
    return label


def shards(distinct: DataFrame, radius: int, shard: int, sample: int, chunk: int = 1 << 20) -> DataFrame:
    """(shard, fp): every fingerprint in each shard that a tree routes it to; a shard holds some `shard` of them, or lies in a small ball.

    In each round every shard of over twice `shard` rows is divided by a tree fitted in one task on some `sample` of its
    rows, and its rows are routed `chunk` at a time.  One that no sphere divides is left whole.
    """
    total = distinct.count()
    rows = distinct.select(F.lit(0).cast("long").alias("shard"), "fp", F.lit(False).alias("whole"))
    known, more = rows.withColumn("n", F.lit(total).cast("long")), total > shard

    def fit(table: pa.Table) -> pa.Table:
        values = table.column("fp").to_numpy().view(np.uint64)
        nodes = fit_tree(values, table.column("n")[0].as_py(), radius, shard)
        return pa.table({"tree_of": table.column("shard")[:1], "n": table.column("n")[:1], "tree": pa.array([pickle.dumps(nodes)], pa.binary())})

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({"shard": pa.array([], pa.int64()), "leaf": pa.array([], pa.int32()), "fp": pa.array([], pa.int64())})
        nodes, at = pickle.loads(right.column("tree")[0].as_py()), left.column("shard")[0].as_py()
        parts = list(route(nodes, left.column("fp").to_numpy().view(np.uint64), radius)) if nodes else [(-1, left.column("fp").to_numpy().view(np.uint64))]
        leaf = np.repeat(np.array([k for k, _ in parts], np.int32), [len(x) for _, x in parts])
        return pa.table({"shard": pa.array(np.full(len(leaf), at)), "leaf": pa.array(leaf), "fp": pa.array(np.concatenate([x for _, x in parts]).view(np.int64))})

    while more:
        wide = known.where("n is not null").drop("whole")
        picked = wide.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1 << 30)) < F.lit(1.0 * sample * (1 << 30)) / F.col("n"))
        trees = cut(picked.groupBy("shard").applyInArrow(fit, "tree_of long, n long, tree binary"))
        chunks = F.ceil(F.col("n") / chunk).cast("int")
        left = wide.withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(9)), chunks).cast("int")).drop("n")
        right = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        sent = left.groupBy("shard", "chunk").cogroup(right.groupBy("tree_of", "chunk")).applyInArrow(send, "shard long, leaf int, fp long")
        now = sent.select(F.when(F.col("leaf") < 0, F.col("shard")).otherwise(F.xxhash64("shard", "leaf")).alias("shard"), "fp", (F.col("leaf") < 0).alias("whole"))
        rows = cut(known.where("n is null").select("shard", "fp", "whole").unionByName(now))
        sizes = rows.where("not whole").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        large = sizes.where(f"n > {2 * shard}")
        # A shard that is left whole needs no lookup, whatever its size.
        whole = rows.where("whole").withColumn("n", F.lit(None).cast("long"))
        known = looked_up(rows.where("not whole"), large, ("shard",), "n", hot_bar(rows.count()), "left").unionByName(whole)
        more = not large.isEmpty()
    return rows.select("shard", "fp")


def links(distinct: DataFrame, radius: int = 2, shard: int = 8192, sample: int = 8192) -> DataFrame:
    """(a, b): from distinct `fp`, edges whose components are those of all pairs at distance `radius` or less."""

    def search(table: pa.Table) -> pa.Table:
        values = np.unique(table.column("fp").to_numpy().view(np.uint64))
        label = local_groups(values, radius)
        tied = np.flatnonzero(label != np.arange(len(values)))
        return pa.table({"a": values[tied].view(np.int64), "b": values[label[tied]].view(np.int64)})

    sent = triangles(shards(distinct, radius, shard, sample), ("shard",), F.count(F.lit(1)), 4 * shard, F.col("fp"))
    return sent.groupBy("part_of").applyInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b), by alternating large-star and small-star contraction.

    Edges and minima are checkpointed after every half round, as both paths of the lookup read them; minima are aggregated before
    they are shuffled, and those of hubs are broadcast.
    """

    def state(rows: DataFrame):
        return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last, known = None, state(now)
    while known != last:
        bar = hot_bar(2 * known["n"])
        up = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = cut(now.union(up).groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = looked_up(up, least, ("a",), "n", bar).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = cut(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        root = cut(down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        small = looked_up(down, root, ("a",), "n", bar).select(F.explode(F.array(F.struct(F.col("b").alias("a"), "m"), F.struct("a", "m"))).alias("e"))
        now = cut(small.select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct())
        last, known = known, state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document; component_id is the least doc_id reachable by links."""
    prints = cut(fingerprints(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct.select("fp"), radius))
    known = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    known = cut(known)
    least = known.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    named = looked_up(known, least, ("root",), "prints", hot_bar(known.count())).select("fp", "component_id", "n")
    out = looked_up(prints, named, ("fp",), "n", hot_bar(prints.count()))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def name_of(text: Column) -> Column:
    """What tells texts apart: 128 bits; texts without words have one name."""
    wordless = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return F.unhex(F.md5(F.when(wordless, "").otherwise(text)))


def shingles(text: str, known: dict) -> np.ndarray:
    """The ascending distinct hashes of a text's five-word shingles (of all its words, if they are fewer)."""
    each = word_hashes(text.encode("utf-8", "surrogatepass").lower().split(), known)
    return np.unique(rolled(each, min(WORDS, len(each)), 0x9E3779B97F4A7C15)) if len(each) else np.empty(0, np.uint64)


def wide_print(found: np.ndarray) -> bytes:
    """The SimHash of a set of hashes, `WIDE` bits."""
    ones, h = np.zeros(WIDE, np.int64), found
    for at in range(0, len(found), 16_384):
        part, columns = h[at : at + 16_384], []
        for _ in range(WIDE // 64):
            part = mixed(part + np.uint64(0x9E3779B97F4A7C15))
            columns.append(part)
        ones += np.unpackbits(np.stack(columns, 1).view(np.uint8).reshape(len(part), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(found)).tobytes()


_ORDER = np.random.default_rng(64).integers(0, 1 << 63, ORDERS, np.uint64) * np.uint64(2) + np.uint64(1)


def crowds(docs: DataFrame) -> DataFrame:
    """(h, name, print): each distinct text with words under its least shingle in each order; a text may come once a task."""

    def run(batches):
        known, seen = _Hashes(), set()
        for b in batches:
            names, least, prints = [], [], []
            for name, text in zip(b.column("name").to_pylist(), b.column("text").to_pylist(), strict=True):
                if name not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(name)
                    found = shingles(text, known)
                    if not len(found):
                        continue
                    names.append(name)
                    prints.append(wide_print(found))
                    least += [int(mixed(found * k).min()) ^ j for j, k in enumerate(_ORDER)]
            each = pa.array(np.repeat(np.arange(len(names)), ORDERS))
            h = np.array(least, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(names, pa.binary()).take(each), pa.array(prints, pa.binary()).take(each)], ["h", "name", "print"])

    rows = docs.select(name_of(F.col("text")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "h long, name binary, print binary")


def _numbers(cells: pa.ChunkedArray, kind: str, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), kind).reshape(-1, wide)


def _runs(of: np.ndarray):
    """(start, stop) of runs of two and more equal values."""
    edges = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)]))
    wide = np.flatnonzero(np.diff(edges) > 1)
    return zip(edges[wide].tolist(), edges[wide + 1].tolist(), strict=True)


def candidates(docs: DataFrame) -> DataFrame:
    """(a, b): names of texts, links between those that share a least shingle and whose fingerprints are within `REACH`."""
    rows = cut(crowds(docs))
    parts = max(1, -(-rows.count() // ROWS))

    def search(table: pa.Table) -> pa.Table:
        of = table.column("part_of").to_numpy()
        names, prints = _numbers(table.column("name"), ">u8", 2), _numbers(table.column("print"), "<u8", WIDE // 64)
        order = np.lexsort((names[:, 1], names[:, 0], of))
        fresh = np.ones(len(order), bool)  # a text that several tasks sent counts once
        fresh[1:] = (np.diff(of[order]) != 0) | (names[order[1:]] != names[order[:-1]]).any(1)
        order = order[fresh]
        of, names, prints = of[order], names[order], prints[order]
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in _runs(of):
            label = local_groups(prints[a:b], REACH)
            tied = np.flatnonzero(label != np.arange(b - a))
            ends.append((tied + a, label[tied] + a))
        said = lambda k: pa.array([x.tobytes() for x in names[np.concatenate([np.empty(0, np.int64), *(e[k] for e in ends)])]], pa.binary())
        return pa.table({"a": said(0), "b": said(1)})

    met = triangles(rows, ("h",), F.count(F.lit(1)), CROWD, F.col("name")).drop("h")
    placed = met.withColumn("part", F.pmod("part_of", F.lit(parts)).cast("int"))
    return placed.groupBy("part").applyInArrow(search, "a binary, b binary").distinct()


def alike(sets: list[np.ndarray]) -> np.ndarray:
    """The least index of each set's group of links, by all pairs' shares: counts of what few hold, and products of what many do."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, cell, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(cell, kind="stable")  # by element, owners ascending
    owner, starts = owner[order], np.cumsum(times) - times
    both = np.zeros((n, n), np.float32)
    many = np.flatnonzero(times > max(8, n // 16))
    for at in range(0, len(many), 1024):
        some = many[at : at + 1024]
        held = np.zeros((n, len(some)), np.float32)
        for k, e in enumerate(some.tolist()):
            held[owner[starts[e] : starts[e] + times[e]], k] = 1
        both += held @ held.T
    for t in np.unique(times[(times > 1) & (times <= max(8, n // 16))]).tolist():
        elements = np.flatnonzero(times == t)
        left, right = np.triu_indices(t, 1)
        for at in range(0, len(elements), max(1, 1_000_000 // len(left))):
            held = owner[starts[elements[at : at + max(1, 1_000_000 // len(left))], None] + np.arange(t)]
            found, count = np.unique(held[:, left].ravel() * n + held[:, right].ravel(), return_counts=True)
            both.ravel()[found] += count
    both = np.maximum(both, both.T)
    label = np.arange(n)
    for r in range(n):
        near = both[r] * 10 >= TENTHS * (sizes[r] + sizes - both[r])
        near[r] = True
        met = label[near]
        least = met.min()
        if met.max() != least:
            label[np.isin(label, np.unique(met))] = least
    return label


def verified(members: DataFrame) -> DataFrame:
    """(a, b) from (root, name, text): in each root's group, links between texts that share enough, by their whole sets."""
    members = cut(members)
    total = members.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    weight = F.greatest(F.count(F.lit(1)).cast("double"), F.sum(F.octet_length("text")) * (CROWD / VERIFY))

    def judge(table: pa.Table) -> pa.Table:
        of, names, known = table.column("part_of").to_numpy(), table.column("name").to_pylist(), _Hashes()
        texts_, order, ends = table.column("text"), np.argsort(of, kind="stable"), []
        for a, b in _runs(of[order]):
            mine = order[a:b]
            label = alike([shingles(texts_[int(k)].as_py(), known) for k in mine])
            tied = np.flatnonzero(label != np.arange(b - a))
            ends += zip(mine[tied].tolist(), mine[label[tied]].tolist(), strict=True)
        return pa.table({"a": pa.array([names[x] for x, _ in ends], pa.binary()), "b": pa.array([names[y] for _, y in ends], pa.binary())})

    parts = max(1, -(-total // VERIFY))
    placed = triangles(members, ("root",), weight, CROWD, F.col("name")).withColumn("part", F.pmod("part_of", F.lit(parts)).cast("int"))
    return placed.select("part", "part_of", "name", "text").groupBy("part").applyInArrow(judge, "a binary, b binary")


def alike_groups(docs: DataFrame) -> DataFrame:
    """(node, root): the name of each text that is like another one, and that of its group."""
    bounded_batches(docs.sparkSession)
    roots = components(candidates(docs))
    # Copies of one text become one row before they meet, so that no text is a hot key.
    named = docs.groupBy(name_of(F.col("text")).alias("name")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    members = named.join(roots, F.col("name") == F.col("node")).select("root", "name", "text")
    return components(verified(members))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, that of the least doc_id (null ids last), then of the least other columns.

    Columns whose type has no order (maps) are compared by their JSON, which then travels beside the row.
    """
    loose = [f for f in docs.schema if "map<" in (kind := f.dataType.simpleString()) or kind in ("variant", "interval")]
    key = (F.col("doc_id").isNull().alias("none"), F.col("doc_id"))
    row = lambda names: F.struct(*(F.col(f"`{c}`") for c in names))
    tight = [f.name for f in docs.schema if f.name != "doc_id" and f not in loose]
    held = row(f.name for f in loose) if loose else F.lit(None).cast("struct<>")
    rank = F.struct(*key, row(tight).alias("row"), *([F.to_json(held).alias("json")] if loose else []))
    named = docs.select(name_of(F.col("text")).alias("name"), rank.alias("rank"), held.alias("held"))

    def least(rows: DataFrame, by: str) -> DataFrame:
        return rows.groupBy(by).agg(F.min("rank").alias("rank"), *([F.min_by("held", "rank").alias("held")] if loose else []))

    # Copies become one row before they meet.
    grouped = least(named, "name").join(alike_groups(docs), F.col("name") == F.col("node"), "left").withColumn("root", F.coalesce("root", "name"))
    kept = least(grouped, "root")
    where = {c: f"held.`{c}`" for c in (f.name for f in loose)} | {c: f"rank.row.`{c}`" for c in tight} | {"doc_id": "rank.doc_id"}
    return kept.select(*(F.col(where[c]).alias(c) for c in docs.columns))
