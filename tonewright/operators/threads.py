"""Nested posts and quotes: depth, own text, and the author that encloses an offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tags of a thread or any text between them.
_PIECE = r"<post[^>]*>|</post>|<quote[^>]*>|</quote>|[^<]+|<"


def thread_texts(conversations: DataFrame) -> DataFrame:
    """(doc_id, text): a conversation as a thread; every turn is a post by its role and quotes the turn before."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "[<>]", " ")
    rows = conversations.select("conv_id", "turn", "role", clean.alias("body"))
    before, who = F.lag("body").over(order), F.lag("role").over(order)
    quote = F.when(before.isNotNull(), F.concat(F.lit('<quote orig_author="'), who, F.lit('">'), before, F.lit("</quote>"))).otherwise("")
    post = F.concat(F.lit('<post author="'), "role", F.lit('">'), quote, "body", F.lit("</post>"))
    posts = rows.withColumn("post", post)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "post"))), lambda x: x["post"]), "")
    return posts.groupBy(F.col("conv_id").alias("doc_id")).agg(joined.alias("text"))


def thread_pieces(threads: DataFrame) -> DataFrame:
    """Tags and texts in order: (doc_id, pos, off, piece, step, depth); depth counts blocks open after the piece."""
    from .spans import pieces

    step = F.when(F.col("piece").rlike("^<(post|quote)"), 1).when(F.col("piece").rlike("^</"), -1).otherwise(0)
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return pieces(threads, _PIECE, "piece").withColumn("step", step).withColumn("depth", F.sum("step").over(upto).cast("int"))


def enclosing_blocks(parts: DataFrame) -> DataFrame:
    """Each piece of text with the block that holds it: block_off, author, author_off (null for an anonymous quote).

    The block open at depth d is the last one opened to that depth; depth resets with each post, so the scan
    stays within a post, whatever the thread's length.
    """
    post = F.sum(F.col("piece").startswith("<post").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    named = F.regexp_extract("piece", 'author="([^"]*)"', 1)
    opened = F.when(F.col("step") == 1, F.struct(F.col("off").alias("block_off"), named.alias("author"), (F.col("off") + F.instr("piece", 'author="') + 7).cast("int").alias("author_off")))
    level = Window.partitionBy("doc_id", "post", "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumn("post", post).withColumn("block", F.last(opened, ignorenulls=True).over(level))
    name = F.when(F.col("block.author") != "", F.col("block.author"))
    return out.where("step = 0").select("doc_id", "post", "pos", "off", "piece", "depth", F.col("block.block_off").alias("block_off"), name.alias("author"), F.when(name.isNotNull(), F.col("block.author_off")).alias("author_off"))


def own_text(parts: DataFrame) -> DataFrame:
    """(doc_id, block_off, own, segments): a block's text without the blocks inside it."""
    held = enclosing_blocks(parts).groupBy("doc_id", "block_off")
    ordered = F.sort_array(F.collect_list(F.struct("off", "piece")))
    return held.agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("own"), F.count(F.lit(1)).alias("segments"))


def block_segments(parts: DataFrame) -> DataFrame:
    """(doc_id, block_off, own, start, end, offsets) of every block of every file: its own text, and the places of its segments as `a:b` pairs, ends included."""
    held = enclosing_blocks(parts).groupBy("doc_id", "block_off")
    ordered = F.sort_array(F.collect_list(F.struct("off", "piece")))
    out = held.agg(ordered.alias("s"))
    end = lambda x: x["off"] + F.length(x["piece"])
    own = F.array_join(F.transform("s", lambda x: x["piece"]), "")
    pairs = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["off"], end(x))), " ")
    return out.select("doc_id", "block_off", own.alias("own"), F.col("s")[0]["off"].alias("start"), end(F.element_at("s", -1)).alias("end"), pairs.alias("offsets"))


def labelled_blocks(parts: DataFrame, annotations: DataFrame) -> DataFrame:
    """(own, label): the set of blocks' own texts with the labels of the annotations (doc_id, at, label) that point into them.

    A place on the border of two segments counts for the earlier one; annotations that point nowhere have no row.
    """
    inner = enclosing_blocks(parts).select("doc_id", "block_off", "off", (F.col("off") + F.length("piece")).alias("to"))
    met = annotations.withColumnRenamed("doc_id", "_doc").join(inner, (F.col("_doc") == F.col("doc_id")) & F.col("at").between(F.col("off"), F.col("to")))
    first = met.groupBy("doc_id", "at", "label").agg(F.min_by("block_off", "off").alias("block_off"))
    return first.join(own_text(parts), ["doc_id", "block_off"]).select("own", "label").distinct()
