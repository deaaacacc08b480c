"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Arrow batch holds at most (a longer single text is a batch of its own).
BATCH_BYTES = 8 << 20
#: Bytes of text in a block of rows, and bytes that a block and a bucket send each other at least.
BLOCK_BYTES, LEAST_BLOCK, MESSAGE = 8 << 20, 1 << 20, 160
#: A key is hot if it has over one in so many rows.
HOT_KEYS = 1000
#: The steps of Spark's hash of an int (Murmur3, 32 bits, seed 42).
_SEED, _M1, _M2, _ADD, _F1, _F2 = 42, 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
_MASK = 0xFFFFFFFF


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows, so that long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpoint_ready(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; only a local session, all of which is one machine, may do without."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
            import tempfile

            named = tempfile.mkdtemp(prefix="tonewright-")
        spark.sparkContext.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from there: lineage ends, lost executors cost nothing."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint()


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and text columns alone, under fixed names; null texts become empty ones."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def at_home(place: Column) -> Column:
    """The int whose Spark hash is `place`: rows dealt out by it to n > place partitions land in partition `place`.

    The hash of an int can be undone step by step; products are made in halves, since longs must not overflow.
    """

    def times(b: int):
        high = lambda a: F.shiftleft((a * F.lit(b >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
        return lambda a: (high(a) + a * F.lit(b & 0xFFFF)).bitwiseAND(F.lit(_MASK))

    def folded(*by: int):
        def step(a: Column) -> Column:
            out = a
            for n in by:
                out = out.bitwiseXOR(F.shiftright(a, n))
            return out

        return step

    def back(by: int):
        return lambda a: F.shiftright(a, by).bitwiseOR(F.shiftleft(a, 32 - by).bitwiseAND(F.lit(_MASK)))

    undo = lambda m: times(pow(m, -1, 1 << 32))
    minus = lambda n: lambda a: (a - F.lit(n)).bitwiseAND(F.lit(_MASK))
    other = lambda n: lambda a: a.bitwiseXOR(F.lit(n))
    signed = lambda a: F.when(a >= 1 << 31, a - (1 << 32)).otherwise(a)
    held = F.array(place.cast("long"))
    for step in (folded(16), undo(_F2), folded(13, 26), undo(_F1), folded(16), other(4), minus(_ADD), undo(5), back(13), other(_SEED), undo(_M2), back(15), undo(_M1), signed):
        held = F.transform(held, step)  # one array cell, so that a step's input is worked out once
    return held[0].cast("int")


def row_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_rows: int = 100_000) -> tuple[DataFrame, int, int]:
    """(`docs` with `blk`, dealt out by it; blocks; bytes of text): blocks of rows drawn by their place in the input.

    Neither ids nor texts choose the block, so equal or null ids and copies spread like all others; block k is alone in
    partition k.  A block has `block_bytes`, less where there is little text (but `LEAST_BLOCK`), and more where as many blocks as
    buckets would exchange messages of under `MESSAGE` bytes: 8 MB up to 400 GB of text, 126 MB for 100 TB.
    Rows are told apart by their place, so `docs` should be files or a checkpoint, which are read the same each time.
    """
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    total = size["bytes"] or 0
    few = max(min(LEAST_BLOCK, block_bytes), total // (4 * docs.sparkSession.sparkContext.defaultParallelism))
    block = max(min(block_bytes, few), math.isqrt(MESSAGE * total))
    blocks = max(1, -(-total // block), -(-size["n"] // block_rows))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    return docs.withColumn("blk", at_home(place)).repartition(blocks, "blk"), blocks, total


def id_blocks(docs: DataFrame, block_bytes: int, block_rows: int, each: int = 30, most: int = 1_000_000) -> tuple[DataFrame, int]:
    """Add `blk`: blocks of neighbouring doc_ids, in ascending order and none of them empty, cut at ids of a sample.

    The sample has some `each` ids a block and `most` in all; it is weighted by bytes, since a row is drawn the likelier the longer
    its text is.  Only these ids reach the driver.  Rows with equal ids share a block.
    """
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min(key).alias("low")).first()
    blocks = max(1, -(-(size["bytes"] or 0) // block_bytes), -(-size["n"] // block_rows))
    cuts: list[float] = []
    if blocks > 1:
        mean = max(1.0, (size["bytes"] or 0) / size["n"])
        rate = min(1.0, min(each * blocks, most) / size["n"])
        likely = F.lit(rate) * (F.octet_length("text") + mean) / (2 * mean)
        drawn = docs.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) < likely * (1 << 20))
        found = sorted(r["key"] for r in drawn.select(key.alias("key")).collect())
        cuts = sorted({found[i * len(found) // blocks] for i in range(1, blocks)} - {size["low"]}) if found else []
    splits = [-float("inf"), *cuts, float("inf")]
    if len(splits) < 3:
        return docs.withColumn("blk", F.lit(0)), 1
    # A bucket holds [low, high), so ids equal to a cut open the next block.
    known = docs.withColumn("_key", key)
    out = Bucketizer(splits=splits, inputCol="_key", outputCol="_blk").transform(known)
    return out.withColumn("blk", F.col("_blk").cast("int")).drop("_key", "_blk"), len(splits) - 1


def hot_bar(total: int) -> int:
    """Keys with more rows than this are hot: there are fewer than `HOT_KEYS` of them among `total` rows."""
    return max(HOT_KEYS, total // HOT_KEYS)


def looked_up(rows: DataFrame, table: DataFrame, keys: tuple[str, ...], count: str, bar: int, how: str = "inner") -> DataFrame:
    """`rows` with the columns of `table`, which has one row a key and counts in `count` the rows of that key.

    Keys of over `bar` rows are looked up by broadcast, all others by a shuffle, so no key's rows meet in one task;
    with `hot_bar` the broadcast has fewer than `HOT_KEYS` rows.
    """
    hot = F.broadcast(table.where(F.col(count) > bar))
    cold = rows.join(hot.select(*keys), list(keys), "left_anti")
    return rows.join(hot, list(keys)).unionByName(cold.join(table.where(F.col(count) <= bar), list(keys), how))


def triangles(rows: DataFrame, keys: tuple[str, ...], size: Column, most: int, name: Column) -> DataFrame:
    """Add `part_of`, a number for each key's group: groups of over `most` by `size` are cut into blocks, and every two blocks meet in one.

    `name` chooses the block.  A group of g blocks is copied g times, so that no two rows of it miss each other and
    none of its parts is over twice `most`.  The sizes are one row a large group; those of the largest `HOT_KEYS` are broadcast.
    """
    large = cut(rows.groupBy(*keys).agg(size.alias("_size")).where(F.col("_size") > most))
    large = large.withColumn("_g", F.ceil(F.col("_size") / most).cast("int"))
    top = large.select("_size").orderBy(F.col("_size").desc()).limit(HOT_KEYS).collect()
    known = looked_up(rows, large, keys, "_size", top[-1][0] if len(top) == HOT_KEYS else 0, "left")
    mine = F.pmod(F.xxhash64(name), F.coalesce("_g", F.lit(1))).cast("int")
    met = known.withColumn("_i", mine).withColumn("_j", F.explode(F.sequence(F.lit(0), F.coalesce("_g", F.lit(1)) - 1)))
    part = F.xxhash64(*keys, F.least("_i", "_j"), F.greatest("_i", "_j"))
    return met.select(*rows.columns, part.alias("part_of"))


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as their differences, in as few whole bytes each as the widest needs."""
    if not len(values):
        return b""
    steps = np.empty(len(values), np.uint64)
    steps[0] = 0
    np.subtract(values[1:], values[:-1], out=steps[1:])
    wide = max(1, (int(steps.max()).bit_length() + 7) // 8)
    body = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()
    return bytes([wide]) + int(values[0]).to_bytes(8, "little") + body


def unpack_sorted(blob: bytes) -> np.ndarray:
    """What pack_sorted() packed."""
    if not blob:
        return np.empty(0, np.uint64)
    wide, body = blob[0], np.frombuffer(blob, np.uint8, offset=9)
    steps = np.zeros((len(body) // wide, 8), np.uint8)
    steps[:, :wide] = body.reshape(-1, wide)
    out = steps.reshape(-1).view(np.uint64)
    out[0] = int.from_bytes(blob[1:9], "little")
    return np.cumsum(out, dtype=np.uint64)


def covered(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """Boolean mask over `total` places: those that a span of `width` from any of `starts` covers."""
    edge = np.zeros(total + 1, np.int32)
    if len(starts):
        np.add.at(edge, starts, 1)
        np.add.at(edge, np.minimum(starts + width, total), -1)
    return np.cumsum(edge[:total]) > 0
