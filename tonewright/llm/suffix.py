"""Repeated byte strings found by a hash-compared suffix sort.

Every byte covered by a `WINDOW`-byte string that also starts anywhere else (same document included, overlaps
count) goes, as judged on the input; matches never cross documents.

A suffix array of the whole corpus is cut into independent small ones by content:

1. Anchors.  The minimizer of a window is the leftmost of its `GRAM`-byte grams with the least polynomial hash.
   Equal windows have equal minimizers at equal places, so windows need comparing only with windows around
   an equal gram.  Consecutive windows of one anchor form a run; its context is the text they cover.
2. Rows lie in blocks drawn by their place in the input, so that no id and no copied text fills one.  A block sends each
   bucket of the gram space its distinct (gram, context hash) pairs, packed, and the bucket answers with a state for
   each: the gram is nowhere else; or all its contexts are one context that occurs again; or it has several contexts,
   and who sends the text.  Blocks and buckets grow with the square root of the input beyond 400 GB (`row_blocks`).
3. Suffix sort.  Distinct contexts of grams with several are sorted: the suffixes that start at each
   window's place, up to the window's length.  Prefix polynomial hashes and a binary search give the common
   extension of two suffixes in a logarithmic number of steps; merges compare with it.  Neighbours in the
   sorted order with a common extension of a whole window are the repeats, verified byte by byte.  Windows at
   different distances from the gram can't be equal, so each distance of each gram is sorted by itself.
   A gram with over `HOT` contexts (the edge of a passage that a third of all documents share, say) would be an
   unbounded sort, so its suffixes are first dealt out by the prefix hash of their whole window, the one that the sort compares
   with at full length: equal ones meet and others part, and what meets is sorted by hash.  The answer is the same
   for every bound; no context and no window is left out.
4. The blocks, laid out by the same exchange, get the answers and cut their texts.

Collisions: where texts meet (the sort), equal hashes are checked byte by byte.  Where only hashes travel (a context
that occurs again as a whole, the dealt windows) two independent polynomial hashes of 64 bits each have to agree.

Defined results: null texts are empty; texts shorter than a window are kept; a text of any length is read whole, scanned
in pieces of 256 KB; repeated rows are repeats of each other; null doc_ids are kept; empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BLOCK_BYTES, bounded_batches, pack_sorted, row_blocks, unpack_sorted

WINDOW, GRAM = 200, 100
BLOCK_ROWS = 100_000
#: Bytes scanned at once.
PIECE = 1 << 18
_BITS = 22
#: Suffixes sorted at once, but for a single gram with more.
CHUNK = 400_000
#: Contexts of one gram that are sorted in one task at most: a bound of memory, not of what is compared.
HOT = 1000
_SORTED, _DEALT, _TOLD = 0, 1, 2  # kinds of answers
_HEAD = np.dtype([("g", "<u8"), ("r", "<u8"), ("off", "u1"), ("runs", "u1"), ("twice", "u1")])
_PAIR = np.dtype([("g", "<u8"), ("r", "<u8")])
_FOUND = np.dtype([("g", "<u8"), ("r", "<u8"), ("bits", "u1", (13,))])


class Poly:
    """Prefix polynomial hashes modulo 2**64 over random byte values; `seed` picks values and base.

    Strings compared here have at most some 300 bytes, far below the lengths at which this modulus
    is known to fail, and equalities are verified besides.
    """

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, np.uint64)
        self.base = int(rng.integers(0, 1 << 61, dtype=np.uint64)) * 8 + 5
        self.grow(size)

    def grow(self, size: int) -> None:
        def powers(b: int) -> np.ndarray:
            out = np.full(size + 1, b, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        self.power, self.inverse = powers(self.base), powers(pow(self.base, -1, 1 << 64))

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        if len(raw) >= len(self.power):
            self.grow(2 * len(raw))
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.power[: len(raw)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of raw[start:stop], whatever their places."""
        return (prefix[stop] - prefix[start]) * self.inverse[start]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Scanner:
    """Finds the runs of windows that share a minimizer."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.grams, self.contexts = Poly(11, PIECE + window), Poly(23, PIECE + window)

    def runs(self, raw: np.ndarray, ends: np.ndarray):
        """(first window, number of windows, anchor - first window, gram hash, context hash) of every run; ends: each byte's document end."""
        n, w = len(raw), self.window
        if n < w:
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
        prefix = self.grams.prefix(raw)
        m = n - self.gram + 1
        at = np.arange(m, dtype=np.int64)
        hashes = _mix((prefix[self.gram :] - prefix[:-self.gram]) * self.grams.inverse[:m])
        low = np.uint64((1 << _BITS) - 1)
        least = (hashes & ~low) | at.astype(np.uint64)
        span, have = w - self.gram + 1, 1
        while 2 * have <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[: m - span + 1], least[span - have : span - have + m - span + 1])
        anchor = (least & low).astype(np.int64)
        starts = at[: n - w + 1]
        valid = starts + w <= ends[: n - w + 1]
        fresh = valid.copy()
        fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        first = np.flatnonzero(fresh)
        last = valid.copy()
        last[:-1] &= fresh[1:] | ~valid[1:]
        count = np.flatnonzero(last) - first + 1
        off = anchor[first] - first
        second = self.contexts.prefix(raw)
        context = self.contexts.of(second, first, first + count + w - 1)
        tag = (off * 256 + count).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        # Minimizers are small by choice; mixed once more, they spread over the buckets.
        return first, count, off, _mix(hashes[anchor[first]]), _mix(context ^ tag)


class Block:
    """The documents of a block and all their runs; places are in the block's concatenated bytes."""

    def __init__(self, table: pa.Table, scanner: Scanner):
        self.ids = table.column("doc_id").to_pylist()
        self.raw = [t.encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        self.sizes = np.array([len(x) for x in self.raw], np.int64)
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        del self.raw
        stops = np.cumsum(self.sizes)
        self.starts = stops - self.sizes
        found, lo, w = [], 0, scanner.window
        while lo < len(self.bytes):
            # A piece ends with a document, or inside a long one and then reads on for the windows that start in it.
            k = int(np.searchsorted(stops, lo + PIECE, "right"))
            whole = k > 0 and stops[k - 1] > lo
            hi = int(stops[k - 1]) if whole else min(lo + PIECE, len(self.bytes))
            reach = hi if whole else min(hi + w - 1, int(stops[k]))
            a, b = int(np.searchsorted(stops, lo, "right")), int(np.searchsorted(stops, reach - 1, "right"))
            cuts = np.minimum(stops[a : b + 1], reach) - lo
            ends = np.repeat(cuts, np.diff(np.concatenate(([0], cuts))))
            first, *rest = scanner.runs(self.bytes[lo:reach], ends)
            found.append((first + lo, *rest))
            lo = hi
        self.first, self.count, self.off, self.g, self.r = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ((np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2)
        order = np.lexsort((self.r, self.g))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(self.g[order]) != 0) | (np.diff(self.r[order]) != 0)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(fresh) - 1
        #: One run for each distinct (gram, context), ascending, and whether there are more.
        self.one = order[fresh]
        self.twice = np.diff(np.concatenate((np.flatnonzero(fresh), [len(order)]))) > 1 if len(order) else np.empty(0, bool)


def _slices(g: np.ndarray, buckets: int):
    """(bucket, start, stop) of ascending gram hashes by their high bits."""
    which = (g >> np.uint64(64 - (buckets - 1).bit_length())).astype(np.int64) if buckets > 1 else np.zeros(len(g), np.int64)
    edges = np.searchsorted(which, np.arange(buckets + 1)).tolist()
    return [(b, edges[b], edges[b + 1]) for b in range(buckets) if edges[b] < edges[b + 1]]


class HotWindows:
    """The windows of a block's hot contexts: distinct hash pairs, ascending, and each window's place among them."""

    def __init__(self, block: Block, state: np.ndarray, window: int):
        self.contexts = np.flatnonzero(state == 5)
        run = block.one[self.contexts]
        self.counts = block.count[run]
        polys, found = (Poly(41, 1 << 16), Poly(43, 1 << 16)), []
        for k in range(0, len(run), 4000):
            raw, starts, at = [], [], 0
            for a, n in zip(block.first[run[k : k + 4000]].tolist(), self.counts[k : k + 4000].tolist(), strict=True):
                raw.append(block.bytes[a : a + n + window - 1])
                starts.append(np.arange(at, at + n))
                at += n + window - 1
            raw, starts = np.concatenate(raw), np.concatenate(starts)
            found.append([_mix(p.of(p.prefix(raw), starts, starts + window)) for p in polys])
        self.g, self.r = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64),) * 2
        order = np.lexsort((self.r, self.g))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(self.g[order]) != 0) | (np.diff(self.r[order]) != 0)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(fresh) - 1
        self.g, self.r = self.g[order][fresh], self.r[order][fresh]
        times = 1 + np.repeat(block.twice[self.contexts], self.counts)
        self.twice = np.bincount(self.place, times, len(self.g)) > 1 if len(self.g) else np.empty(0, bool)


def _counted(table: pa.Table):
    """Pairs of hashes of all blocks, grouped: (sizes by row, order, pair of each, times of pairs, gram of each, times and kinds of grams)."""
    blk = table.column("blk").to_numpy()
    g = [unpack_sorted(x) for x in table.column("grams").to_pylist()]
    sizes = [len(x) for x in g]
    r = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("contexts").to_pylist()])
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("twice").to_pylist(), sizes, strict=True)])
    g, owner = np.concatenate(g), np.repeat(blk, sizes)
    order = np.lexsort((owner, r, g))
    g, r, times = g[order], r[order], 1 + twice[order].astype(np.int64)
    new_g, new_r = np.ones(len(g), bool), np.ones(len(g), bool)
    new_g[1:] = g[1:] != g[:-1]
    new_r[1:] = new_g[1:] | (r[1:] != r[:-1])
    of_g, of_r = np.cumsum(new_g) - 1, np.cumsum(new_r) - 1
    return sizes, order, new_r, np.bincount(of_r, times)[of_r], np.bincount(of_g, times)[of_g], np.bincount(of_g, new_r)[of_g]


def _answers(table: pa.Table, kind: int, column: str, parts: list[bytes]) -> pa.Table:
    """A row for each row of `table`, with its answer in `column`."""
    n = len(parts)
    other = "found" if column == "states" else "states"
    return pa.table({
        "blk": table.column("blk"), "bucket": table.column("bucket"), "kind": pa.array([kind] * n, pa.int32()), column: pa.array(parts, pa.binary()), other: pa.array([None] * n, pa.binary()),
    }).select(["blk", "bucket", "kind", "states", "found"])


def _states(table: pa.Table, hot: int) -> pa.Table:
    """0: the gram is nowhere else.  1: one context, again.  2: several contexts.  3, 4: and this block sends the text (4: it occurs again).  5: too many contexts."""
    sizes, order, new_r, total_r, total_g, kinds = _counted(table)
    state = np.where(total_g < 2, 0, np.where(kinds < 2, 1, np.where(kinds > hot, 5, 2))).astype(np.uint8)
    sends = (state == 2) & new_r
    state[sends] = np.where(total_r[sends] > 1, 4, 3)
    back = np.empty_like(state)
    back[order] = state
    return _answers(table, _TOLD, "states", [x.tobytes() for x in np.split(back, np.cumsum(sizes)[:-1])])


def _dealt(table: pa.Table) -> pa.Table:
    """For hash pairs of hot windows, whether each occurs again."""
    sizes, order, _, total_r, _, _ = _counted(table)
    back = np.empty(len(order), np.uint8)
    back[order] = total_r > 1
    return _answers(table, _DEALT, "states", [x.tobytes() for x in np.split(back, np.cumsum(sizes)[:-1])])


def _extension(poly: Poly, prefix: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Length of the common extension of suffixes x and y, up to `most`: binary search over prefix hashes."""
    same = lambda a, b, n: poly.of(prefix, a, a + n) == poly.of(prefix, b, b + n)
    out = np.full(len(x), most, np.int64)
    todo = np.flatnonzero(~same(x, y, most))
    low, high = np.zeros(len(todo), np.int64), np.full(len(todo), most, np.int64)  # low is common, high is not
    a, b = x[todo], y[todo]
    while len(todo) and (high - low).max() > 1:
        mid = (low + high) // 2
        eq = same(a, b, mid)
        low, high = np.where(eq, mid, low), np.where(eq, high, mid)
    out[todo] = low
    return out


def suffix_sort(raw: np.ndarray, at: np.ndarray, group: np.ndarray, most: int, poly: Poly, prefix: np.ndarray) -> np.ndarray:
    """Order of suffixes `at` by (group, first `most` bytes): a bottom-up mergesort, all groups side by side."""
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group)
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = np.repeat(sizes, sizes)
    local = np.arange(len(at)) - base
    width = 1
    while len(sizes) and width < sizes.max():
        pair = local // (2 * width) * (2 * width)
        right = local - pair >= width
        lo = np.where(right, pair, np.minimum(pair + width, size))
        hi = np.where(right, pair + width, np.minimum(pair + 2 * width, size))
        here = np.flatnonzero(hi > lo)
        low, high = (base + lo)[here], (base + hi)[here]
        mine, is_right = at[order[here]], right[here]
        go = np.arange(len(here))
        while len(go):
            mid = (low[go] + high[go]) // 2
            x, y = mine[go], at[order[mid]]
            n = _extension(poly, prefix, x, y, most)
            end = n >= most
            other, own = raw[np.where(end, y, y + n)], raw[np.where(end, x, x + n)]
            less = np.where(end, is_right[go], other < own)  # equal ones keep the left run first
            low[go], high[go] = np.where(less, mid + 1, low[go]), np.where(less, high[go], mid)
            go = go[low[go] < high[go]]
        rank = np.zeros(len(at), np.int64)
        rank[here] = low - (base + lo)[here]
        to = base + pair + (local - pair - np.where(right, width, 0)) + rank
        merged = np.empty_like(order)
        merged[to] = order
        order = merged
        width *= 2
    return order


def repeated(heads: np.ndarray, body: list[bytes], window: int) -> list[np.ndarray]:
    """For contexts ascending by gram, which of each one's windows also occur in another, or in one that occurs again."""
    runs = heads["runs"].astype(np.int64)
    out: list[np.ndarray] = []
    poly = Poly(37, 1 << 16)
    edges = np.concatenate((np.flatnonzero(np.concatenate(([True], heads["g"][1:] != heads["g"][:-1]))), [len(heads)]))
    at = 0
    while at + 1 < len(edges):
        upto = np.cumsum(np.add.reduceat(runs, edges[at:-1]))
        to = at + max(1, int(np.searchsorted(upto, CHUNK, "right")))
        a, b = int(edges[at]), int(edges[to])
        out += _repeated(heads[a:b], body[a:b], runs[a:b], window, poly)
        at = to
    return out


def _repeated(heads, body, runs, window, poly) -> list[np.ndarray]:
    raw = np.frombuffer(b"".join(body), np.uint8)
    prefix = poly.prefix(raw)
    start = np.cumsum(runs + window - 1) - (runs + window - 1)
    owner = np.repeat(np.arange(len(heads)), runs)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    place = start[owner] + step
    gram = np.cumsum(np.concatenate(([0], heads["g"][1:] != heads["g"][:-1])))
    group = np.unique(gram[owner] * 512 + heads["off"].astype(np.int64)[owner] - step + 256, return_inverse=True)[1]
    order = suffix_sort(raw, place, group, window, poly, prefix)
    x, y = place[order[:-1]], place[order[1:]]
    same = group[order[:-1]] == group[order[1:]]
    same[same] = _extension(poly, prefix, x[same], y[same], window) >= window
    views = np.lib.stride_tricks.sliding_window_view(raw, window)
    pairs = np.flatnonzero(same)
    for k in range(0, len(pairs), 20_000):  # hashes agree: do the bytes?
        p = pairs[k : k + 20_000]
        same[p] = (views[x[p]] == views[y[p]]).all(1)
    hit = heads["twice"].astype(bool)[owner]
    hit[order[:-1]] |= same
    hit[order[1:]] |= same
    return np.split(hit, np.cumsum(runs)[:-1])


def repeated_strings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS, carry: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """(doc_id, text, removed array<struct<start, stop>>, n_bytes, n_removed, n_spans, kept_sha256, carried); intervals are byte places.

    `text` is what is left, without characters that lost some of their bytes; `carried` is a struct of the
    columns in `carry`, as they were.
    """
    if window - gram + 1 > 101:
        raise ValueError("runs of over 101 windows don't fit their bitmaps")
    bounded_batches(docs.sparkSession)
    carried = F.struct(F.lit(None).cast("int").alias("_"), *carry).alias("carried")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), carried)
    placed, blocks, _ = row_blocks(plain, block_bytes, block_rows)
    buckets = 1 << (blocks - 1).bit_length()
    base = placed.select("blk", "doc_id", "text", "carried")

    def packed(blk: int, g: np.ndarray, r: np.ndarray, twice: np.ndarray) -> dict:
        """Columns that _counted() reads."""
        cuts = _slices(g, buckets)
        return {
            "blk": pa.array([blk] * len(cuts), pa.int32()),
            "bucket": pa.array([b for b, _, _ in cuts], pa.int32()),
            "grams": pa.array([pack_sorted(g[s:t]) for _, s, t in cuts], pa.binary()),
            "contexts": pa.array([r[s:t].astype("<u8").tobytes() for _, s, t in cuts], pa.binary()),
            "twice": pa.array([np.packbits(twice[s:t]).tobytes() for _, s, t in cuts], pa.binary()),
        }

    def send(table: pa.Table) -> pa.Table:
        block = Block(table, Scanner(window, gram))
        return pa.table(packed(table.column("blk")[0].as_py(), block.g[block.one], block.r[block.one], block.twice))

    def read(g: np.ndarray, right: pa.Table, kind: int) -> np.ndarray:
        """The states that answer ascending hashes."""
        rows = zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), right.column("states").to_pylist(), strict=True)
        got = {b: s for k, b, s in rows if k == kind}
        state = np.zeros(len(g), np.uint8)
        for b, s, t in _slices(g, buckets):
            state[s:t] = np.frombuffer(got[b], np.uint8)
        return state

    def offer(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, Scanner(window, gram))
        g = block.g[block.one]
        state = read(g, right, _TOLD)
        asked = np.flatnonzero((state >= 2) & (state < 5))
        out = {"blk": [], "bucket": [], "asked": [], "heads": [], "body": []}
        for b, s, t in _slices(g[asked], buckets):
            some = asked[s:t]
            pairs = np.empty(len(some), _PAIR)
            pairs["g"], pairs["r"] = g[some], block.r[block.one[some]]
            mine = some[state[some] >= 3]
            run = block.one[mine]
            heads = np.empty(len(mine), _HEAD)
            heads["g"], heads["r"], heads["off"], heads["runs"], heads["twice"] = block.g[run], block.r[run], block.off[run], block.count[run], state[mine] == 4
            body = b"".join(block.bytes[a : a + n + window - 1].tobytes() for a, n in zip(block.first[run].tolist(), block.count[run].tolist(), strict=True))
            for k, v in (("blk", left.column("blk")[0].as_py()), ("bucket", b), ("asked", pairs.tobytes()), ("heads", heads.tobytes()), ("body", body)):
                out[k].append(v)
        kinds = {"blk": pa.int32(), "bucket": pa.int32()}
        sorts = pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})
        sorts = sorts.append_column("kind", pa.array([_SORTED] * len(sorts), pa.int32()))
        many = HotWindows(block, state, window)
        deals = pa.table(packed(left.column("blk")[0].as_py(), many.g, many.r, many.twice))
        deals = deals.append_column("kind", pa.array([_DEALT] * len(deals), pa.int32()))
        return pa.concat_tables([sorts, deals], promote_options="default").select(["kind", "blk", "bucket", "asked", "heads", "body", "grams", "contexts", "twice"])

    def sort(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == _DEALT:
            return _dealt(table)
        heads = np.concatenate([np.frombuffer(x, _HEAD) for x in table.column("heads").to_pylist()])
        whole = b"".join(table.column("body").to_pylist())
        ends = np.cumsum(heads["runs"].astype(np.int64) + window - 1).tolist()
        order = np.lexsort((heads["r"], heads["g"]))
        body = [whole[(ends[k - 1] if k else 0) : ends[k]] for k in order.tolist()]
        heads = heads[order]
        found = np.zeros(len(heads), _FOUND)
        found["g"], found["r"] = heads["g"], heads["r"]
        for k, hit in enumerate(repeated(heads, body, window) if len(heads) else []):
            bits = np.packbits(hit)
            found["bits"][k, : len(bits)] = bits
        keys = found[["g", "r"]].astype(_PAIR) if len(found) else np.empty(0, _PAIR)
        answers = []
        for raw in table.column("asked").to_pylist():
            asked = np.frombuffer(raw, _PAIR)
            answers.append(found[np.searchsorted(keys, asked)].tobytes())
        return _answers(table, _SORTED, "found", answers)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, Scanner(window, gram))
        g = block.g[block.one]
        state = read(g, right, _TOLD)
        bits = np.zeros((len(block.one), 13), np.uint8)
        where = (g >> np.uint64(64 - (buckets - 1).bit_length())).astype(np.int64) if buckets > 1 else np.zeros(len(g), np.int64)
        for k, b, raw in zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), right.column("found").to_pylist(), strict=True):
            if k == _SORTED:
                # Asked for in ascending order, so the answers of a bucket stand beside its states of 2 to 4.
                bits[(state >= 2) & (state < 5) & (where == b)] = np.frombuffer(raw, _FOUND)["bits"]
        many = HotWindows(block, state, window)
        again, ends = read(many.g, right, _DEALT)[many.place], np.cumsum(many.counts).tolist()
        for k, (c, n) in enumerate(zip(many.contexts.tolist(), many.counts.tolist(), strict=True)):
            part = np.packbits(again[ends[k] - n : ends[k]])
            bits[c, : len(part)] = part
        edge = np.zeros(len(block.bytes) + 1, np.int32)
        mine = state[block.place] if len(block.place) else np.zeros(0, np.uint8)
        whole = np.flatnonzero(mine == 1)
        np.add.at(edge, block.first[whole], 1)
        np.add.at(edge, block.first[whole] + block.count[whole] + window - 1, -1)
        part = np.flatnonzero(mine >= 2)
        if len(part):
            for k in range(0, len(part), 100_000):
                some = part[k : k + 100_000]
                run, step = np.nonzero(np.unpackbits(bits[block.place[some]], axis=1))
                places = block.first[some][run] + step
                np.add.at(edge, places, 1)
                np.add.at(edge, places + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = {k: [] for k in ("doc_id", "text", "removed", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for i, a, n in zip(block.ids, block.starts.tolist(), block.sizes.tolist(), strict=True):
            mask = gone[a : a + n]
            kept = block.bytes[a : a + n][~mask].tobytes()
            turns = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))).reshape(-1, 2)
            text = kept.decode("utf-8", "ignore")
            for k, v in (("doc_id", i), ("text", text), ("removed", [{"start": s, "stop": t} for s, t in turns.tolist()]), ("n_bytes", n), ("n_removed", int(mask.sum())), ("n_spans", len(turns)), ("kept_sha256", hashlib.sha256(kept).hexdigest())):
                out[k].append(v)
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = {"text": pa.string(), "removed": spans, "kept_sha256": pa.string()}
        table = pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})
        return table.append_column("carried", left.column("carried"))

    answer = "blk int, bucket int, kind int, states binary, found binary"
    sent = base.groupBy("blk").applyInArrow(send, "blk int, bucket int, grams binary, contexts binary, twice binary")
    told = sent.groupBy("bucket").applyInArrow(lambda table: _states(table, hot), answer)
    asks = "kind int, blk int, bucket int, asked binary, heads binary, body binary, grams binary, contexts binary, twice binary"
    offered = base.groupBy("blk").cogroup(told.groupBy("blk")).applyInArrow(offer, asks)
    sorted_ = offered.groupBy("kind", "bucket").applyInArrow(sort, answer)
    schema = "doc_id long, text string, removed array<struct<start: long, stop: long>>, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema = StructType([*StructType.fromDDL(schema).fields, base.schema["carried"]])
    return base.groupBy("blk").cogroup(told.unionByName(sorted_).groupBy("blk")).applyInArrow(apply, schema)
