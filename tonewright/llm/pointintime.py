"""Point-in-time feature join: of all versions of a key that can be known and are still valid at a moment, the latest.

A version is usable from its start, the later of event and arrival, up to its expiry, which is not included.  Versions and
questions are dealt to chunks of one key and one stretch of time.  In a chunk the versions are a balanced interval tree: nodes
are keyed by start and know the greatest expiry below them, so a question skips whatever has ended or not begun, walks
over every interval that holds its moment, and keeps the lexicographic maximum: the latest event, of these
the earliest arrival, of these the largest version.

No key, moment or chunk has to fit into a task: a chunk of over `most` versions or questions becomes several trees, each
with a part of its versions and of its questions; the best of them wins.  Equal questions are asked once.  A version is
copied to at most nine chunks, as longer ones go to wider stretches; each question goes to one chunk a width.

Defined results: a version with a null key or a null, empty or reversed time range is never usable; a question with a null key or
moment has no winner; repeated questions each get their answer, repeated versions are a tie of equal rows; empty tables give no rows
or no winners; other columns, under any name, stay inside the structs `ask` and `won`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut

#: Binary digits of a moment that the narrowest stretches leave out (256 units of time), how many more each wider kind does, and at most.
BITS, MORE, ALL = 8, 4, 60
#: Versions and questions in a tree, rows that a group of trees has on average, and pairs of question and node held at a time.
MOST, GROUP, PAIRS = 8192, 8192, 1 << 22
CHUNK = ("k", "bits", "at")
NEVER = (1 << 63) - 1


def forest(low: np.ndarray, high: np.ndarray, expiry: np.ndarray) -> np.ndarray:
    """The greatest expiry below every node of the trees over the ranges [low, high); a range's middle is its root."""
    top, levels = expiry.copy(), []
    while len(low):
        mid = (low + high) // 2
        left, right = low < mid, mid + 1 < high
        levels.append((mid[left], (low[left] + mid[left]) // 2, mid[right], (mid[right] + 1 + high[right]) // 2))
        low, high = np.concatenate([low[left], mid[right] + 1]), np.concatenate([mid[left], high[right]])
    for over, left, also, right in reversed(levels):
        top[over] = np.maximum(top[over], top[left])
        top[also] = np.maximum(top[also], top[right])
    return top


def stabbed(t: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, expiry: np.ndarray, top: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The greatest rank of all intervals of the tree over [low, high) that hold `t`, for every question; -1 where there is none."""
    best, who = np.full(len(t), -1, np.int64), np.flatnonzero(low < high)
    low, high = low[who], high[who]
    while len(who):
        mid = (low + high) // 2
        live = top[mid] > t[who]
        who, low, mid, high = who[live], low[live], mid[live], high[live]
        begun = start[mid] <= t[who]
        hit = begun & (expiry[mid] > t[who])
        np.maximum.at(best, who[hit], rank[mid[hit]])
        left, right = low < mid, begun & (mid + 1 < high)
        who, low, high = np.concatenate([who[left], who[right]]), np.concatenate([low[left], mid[right] + 1]), np.concatenate([mid[left], high[right]])
    return best


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _answers(schema: pa.Schema):
    """A function from the versions and questions of a group of trees to the questions that have a winner."""

    def run(versions: pa.Table, asks: pa.Table) -> pa.Table:
        versions = versions.take(pc.sort_indices(versions, sort_keys=[(c, "ascending") for c in ("chunk", "i", "j", "start")]))
        trees = [_numbers(versions, c) for c in ("chunk", "i", "j")]
        edge = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in trees], axis=0)])) if len(versions) else np.empty(0, np.int64)
        ends = np.append(edge[1:], len(versions))
        known = {key: n for n, key in enumerate(zip(*(x[edge].tolist() for x in trees), strict=True))}
        mine = np.array([known.get(key, -1) for key in zip(*(_numbers(asks, c).tolist() for c in ("chunk", "i", "j")), strict=True)], np.int64)
        asks, mine = asks.filter(pa.array(mine >= 0)), mine[mine >= 0]
        start, expiry, t = _numbers(versions, "start"), _numbers(versions, "expiry"), _numbers(asks, "t")
        top = forest(edge, ends, expiry)
        order = pc.sort_indices(versions, sort_keys=[("event", "ascending"), ("arrival", "descending"), ("version", "ascending")], null_placement="at_start").to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        each = max(1, PAIRS // max(1, int((ends - edge).max(initial=1))))
        best = [stabbed(t[a : a + each], edge[mine[a : a + each]], ends[mine[a : a + each]], start, expiry, top, rank) for a in range(0, len(t), each)]
        best = np.concatenate([np.empty(0, np.int64), *best])
        asks, won = asks.filter(pa.array(best >= 0)), versions.take(pa.array(order[best[best >= 0]]))
        inside = schema.field("won").type
        held = pa.StructArray.from_arrays([won.column(f.name).combine_chunks().cast(f.type) for f in inside], fields=list(inside))
        return pa.Table.from_arrays([asks.column("k").combine_chunks(), asks.column("t").combine_chunks(), held], schema=schema)

    return run


def as_of(asks: DataFrame, versions: DataFrame, key: str, at: str, event: str, arrival: str, expiry: str, version: str, carry: tuple[str, ...] = (), bits: int = BITS, most: int = MOST, group: int = GROUP) -> DataFrame:
    """(ask, won): each row of `asks`, and the event, arrival, expiry, version and `carry`ed columns of its winner (null: none).

    Times are whole numbers; an expiry of 2^63 - 1 is never reached.  Versions are compared by any type that has an order.
    """
    times = {"event": event, "arrival": arrival, "expiry": expiry}
    v = versions.select(F.col(key).alias("k"), *(F.col(c).cast("long").alias(n) for n, c in times.items()), F.col(version).alias("version"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    v = v.where("k is not null and event is not null and arrival is not null and expiry is not null").withColumn("start", F.greatest("event", "arrival")).where("start < expiry")
    length = F.coalesce(F.try_subtract("expiry", "start"), F.lit(NEVER))
    kinds = list(range(bits, ALL + 1, MORE))
    kind = F.lit(kinds[-1])
    for n in reversed(kinds[:-1]):
        kind = F.when(length <= 4 << n, n).otherwise(kind)
    stretch = lambda at: F.expr(f"shiftright({at}, bits)")
    v = cut(v.withColumn("bits", kind).withColumn("at", F.explode(F.sequence(stretch("start"), stretch("(expiry - 1)")))))

    known = asks.select(F.col(key).alias("k"), F.col(at).cast("long").alias("t"), F.struct(*asks.columns).alias("ask"))
    used = sorted(r["bits"] for r in v.select("bits").distinct().collect())  # 14 numbers at most
    q = known.where("k is not null and t is not null").select("k", "t").distinct()
    q = cut(q.withColumn("bits", F.explode(F.array(*map(F.lit, used or kinds[:1])))).withColumn("at", stretch("t")))

    n = lambda rows, name: rows.groupBy(*CHUNK).agg(F.count(F.lit(1)).alias(name))
    parts = lambda c: F.ceil(F.col(c) / most).cast("int")
    plan = n(v, "nv").join(n(q, "nq"), list(CHUNK)).select(*CHUNK, (F.col("nv") * parts("nq") + F.col("nq") * parts("nv")).alias("load"), parts("nv").alias("pv"), parts("nq").alias("pq"))
    plan = cut(plan.withColumn("chunk", F.monotonically_increasing_id()))
    load = plan.agg(F.sum("load")).first()[0] or 0
    groups = max(1, -(-int(load) // group))

    mine = lambda name, of: F.pmod(F.xxhash64(name), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    where = F.pmod(F.xxhash64("chunk", "i", "j"), F.lit(groups)).alias("grp")
    tree = ("chunk", "i", "j")
    left = v.join(plan, list(CHUNK)).withColumn("i", mine("version", "pv")).withColumn("j", each("pq")).select(where, *tree, "start", "event", "arrival", "expiry", "version", "carried")
    right = q.join(plan, list(CHUNK)).withColumn("j", mine("t", "pq")).withColumn("i", each("pv")).select(where, *tree, "k", "t")
    won = F.struct("event", "arrival", "expiry", "version", "carried")
    shape = left.select(won.alias("won")).schema
    out = known.select("k", "t").schema.add(shape["won"])
    found = left.groupBy("grp").cogroup(right.groupBy("grp")).applyInArrow(_answers(to_arrow_schema(out)), out)
    best = found.groupBy("k", "t").agg(F.max_by("won", F.struct("won.event", F.bitwise_not("won.arrival"), "won.version")).alias("won"))
    flat = F.when(F.col("won").isNotNull(), F.struct("won.event", "won.arrival", "won.expiry", "won.version", *(F.col(f"won.carried.`{c}`") for c in carry)))
    return known.join(best, ["k", "t"], "left").select("ask", flat.alias("won"))
