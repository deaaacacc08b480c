"""Tokens, sentences, mentions and their contexts, all by exact character offset (0-based, code points)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import MARKED, SENTENCE, TOKEN, WORD, strip_tags


@F.arrow_udf(ArrayType(IntegerType()))
def starts(sizes: pa.Array) -> pa.Array:
    """Where each piece of a text begins: the running sums of the sizes before it, list by list."""
    lengths = pc.fill_null(pc.list_value_length(sizes), 0).to_numpy(zero_copy_only=False)
    bounds, flat = np.concatenate([[0], np.cumsum(lengths)]), sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(flat)])
    found = before[:-1] - np.repeat(before[bounds[:-1]], lengths)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found, pa.int32()), mask=sizes.is_null())


@F.arrow_udf(ArrayType(IntegerType()))
def last_before(places: pa.Array, ends: pa.Array) -> pa.Array:
    """For each place of a text the last of its ascending starts that is no greater, from 0; -1 where none is."""
    both = zip(places.to_pylist(), ends.to_pylist(), strict=True)
    return pa.array([None if x is None or y is None else np.searchsorted(np.array(y, np.int64), np.array(x, np.int64), "right") - 1 for x, y in both], pa.list_(pa.int32()))


def dealt(docs: DataFrame, also: tuple[str, ...], text: str) -> DataFrame:
    """Texts dealt out by their key, the first of `also`: files may have few row groups, and so few tasks."""
    return docs.select(*dict.fromkeys((*also, text))).repartition(F.col(also[0]))


def in_place(docs: DataFrame, pattern: str, name: str, also: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """(also, name, name_at): a text's pieces, the matches of a pattern that covers all of it, and their offsets, as arrays of its row."""
    found = dealt(docs, also, text).select(*also, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias(name))
    return found.withColumn(f"{name}_at", starts(F.transform(name, lambda x: F.length(x))))


def pieces(docs: DataFrame, pattern: str, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, off, name): the matches of a pattern that covers the whole text, with their offsets.

    Offsets are summed up in the text's own row, so that texts move once, before they are cut, and nothing is sorted.
    """
    each = F.transform(name, lambda x, i: F.struct(F.get(f"{name}_at", i).alias("off"), x.alias(name)))
    out = in_place(docs, pattern, name, (key,), text).select(key, F.posexplode(each).alias("pos", "_x"))
    return out.select(key, "pos", F.col(f"_x.{name}").alias(name), F.col("_x.off").alias("off"))


def sentences(docs: DataFrame, pattern: str = SENTENCE, key: str = "doc_id") -> DataFrame:
    return pieces(docs, pattern, "sent", key)


def tokens(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return pieces(docs, TOKEN, "tok", key)


def _capitalised() -> Column:
    """The mentions among a row's tokens, as structs."""
    each = F.transform("tok", lambda x, i: F.struct(x.alias("mention"), F.get("tok_at", i).alias("off"), F.length(x).alias("len")))
    return F.filter(each, lambda m: m["mention"].rlike("^[A-Z][a-z]{3,}$"))


def mention_arrays(docs: DataFrame, *also: str) -> DataFrame:
    """(also, found): the mentions of each text in order, in its own row."""
    return in_place(docs, TOKEN, "tok", also).select(*also, _capitalised().alias("found"))


def mentions(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, mention, off, len): capitalised words of four letters or more."""
    return mention_arrays(docs, key).select(key, F.inline("found"))


def located(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """`asof_sentence` of a text's own mentions and sentences, found in its row: (key, mention, off, len, sent_pos, sent_off, sent_len, sent)."""
    both = dealt(docs, (key,), "text").select(key, *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(n) for p, n in ((TOKEN, "tok"), (SENTENCE, "sent"))))
    size = lambda n: F.transform(n, lambda x: F.length(x))
    both = both.withColumns({"tok_at": starts(size("tok")), "sent_at": starts(size("sent"))})
    found = both.select(key, _capitalised().alias("found"), "sent", "sent_at")
    found = found.withColumn("which", last_before(F.transform("found", lambda m: m["off"]), F.col("sent_at")))

    def beside(m: Column, i: Column) -> Column:
        sent, off = F.get("sent", F.get("which", i)), F.get("sent_at", F.get("which", i))
        there = m["off"] <= off + F.length(sent)
        named = {"sent_pos": F.get("which", i), "sent_off": off, "sent_len": F.length(sent), "sent": sent}
        return F.struct(*(m[c].alias(c) for c in ("mention", "off", "len")), *(F.when(there, c).alias(n) for n, c in named.items()))

    return found.select(key, F.inline(F.transform("found", beside)))


def asof_sentence(found: DataFrame, sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each mention with the last sentence that starts at or before it and reaches it, its end included; null where none does.

    An equi-join on the document with a range over [start, next start): never a comparison across documents.
    """
    nxt = F.lead("off").over(Window.partitionBy(key).orderBy("pos"))
    s = sents.select(F.col(key).alias("_key"), F.col("pos").alias("sent_pos"), F.col("off").alias("sent_off"), F.length("sent").alias("sent_len"), "sent", F.coalesce(nxt, F.lit(2147483647)).alias("_next"))
    held = (F.col(key) == F.col("_key")) & (F.col("off") >= F.col("sent_off")) & (F.col("off") < F.col("_next")) & (F.col("off") <= F.col("sent_off") + F.col("sent_len"))
    return found.join(s, held, "left").drop("_key", "_next")


def frames(sents: DataFrame, widths: tuple[int, ...] = (7, 5, 3, 1), key: str = "doc_id", within: tuple[str, ...] = ()) -> DataFrame:
    """Contexts of each sentence: it and its neighbours joined without separator, line breaks as spaces, tags stripped."""
    order, most = Window.partitionBy(key, *within).orderBy("pos"), max(widths) // 2
    # Neighbours by place, in one pass over the sorted rows; only texts with a bracket are searched for tags.
    near = [F.coalesce(F.lag("sent", -k).over(order), F.lit("")).alias(f"_{k + most}") if k else F.col("sent").alias(f"_{most}") for k in range(-most, most + 1)]
    out = sents.select("*", *near)
    for w in widths:
        joined = F.replace(F.concat(*(F.col(f"_{k}") for k in range(most - w // 2, most + w // 2 + 1))), F.lit("\n"), F.lit(" "))
        out = out.withColumn(f"context{w}", F.when(joined.contains("<"), strip_tags(joined)).otherwise(joined))
    return out.drop(*(f"_{k}" for k in range(2 * most + 1)))


def bounded(sents: DataFrame, boundary: str = "</?(post|quote)", key: str = "doc_id") -> DataFrame:
    """Add `part`: sentences between two that hold a boundary tag share a number, so that contexts can stop there."""
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return sents.withColumn("part", F.sum(F.col("sent").rlike(boundary).cast("int")).over(upto).cast("int"))


def marked_pieces(texts: DataFrame, key: str = "file") -> DataFrame:
    """(key, pos, off, sent, tag, part): tags as pieces of their own and sentences between them; `part` counts the tags so far."""
    cut = pieces(texts, MARKED, "sent", key)
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = cut.withColumn("tag", F.col("sent").rlike("^<[^<>]*>$").cast("int"))
    return marked.withColumn("part", F.sum("tag").over(upto).cast("int"))


def in_context(found: DataFrame, parts: DataFrame, key: str = "file", off: str = "off", widths: tuple[int, ...] = (7, 5, 3, 1), prefix: str = "", n: int = 10) -> DataFrame:
    """Mentions with {prefix}sentence, {prefix}sentence_off, {prefix}context<w> and {prefix}window of the `n` words around them.

    Contexts stop at tags.  What stands inside a tag, beyond the text or nowhere (a null offset) has nulls.
    """
    framed = frames(parts.where("tag = 0"), widths, key, ("part",))
    s = framed.select(F.col(key).alias("_key"), F.col("off").alias("_from"), (F.col("off") + F.length("sent")).alias("_to"), F.col("sent").alias(f"{prefix}sentence"), F.col("off").alias(f"{prefix}sentence_off"), *(F.col(f"context{w}").alias(f"{prefix}context{w}") for w in widths))
    held = (F.col(key) == F.col("_key")) & (F.col(off) >= F.col("_from")) & (F.col(off) < F.col("_to"))
    words = lambda a: F.expr(f"regexp_extract_all({a}, '{WORD}', 0)")
    before, after = words(f"left({prefix}sentence, {off} - _from)"), words(f"substring({prefix}sentence, {off} - _from + 1)")
    near = F.concat(F.slice(before, F.greatest(F.size(before) - (n // 2 - 1), F.lit(1)), n // 2), F.slice(after, 1, n - n // 2))
    out = found.join(s, held, "left").withColumn(f"{prefix}window", F.array_join(near, " "))
    return out.drop("_key", "_from", "_to")


def target_window(words: DataFrame, target: Column, n: int = 10, key: str = "doc_id") -> DataFrame:
    """The n words around each word for which `target` holds: (key, off, window)."""
    near = Window.partitionBy(key).orderBy("off").rowsBetween(-(n // 2), n - 1 - n // 2)
    return words.withColumn("_hit", target).withColumn("window", F.collect_list("tok").over(near)).where("_hit").select(key, "off", F.array_join("window", " ").alias("window"))


def windows(docs: DataFrame, target: str, n: int = 10, key: str = "doc_id") -> DataFrame:
    """`target_window` of the words that match `target`, found in each text's own row."""
    cut = in_place(docs, TOKEN, "tok", (key,))
    each = F.transform("tok", lambda x, i: F.struct(F.get("tok_at", i).alias("off"), x.alias("tok")))
    words = cut.select(key, F.filter(each, lambda w: w["tok"].rlike("^[A-Za-z]+$")).alias("w"))
    around = lambda i: F.transform(F.slice("w", F.greatest(i + (1 - n // 2), F.lit(1)), F.least(i, F.lit(n // 2)) + (n - n // 2)), lambda w: w["tok"])
    placed = F.filter(F.transform("w", lambda w, i: F.struct(w["off"].alias("off"), i.alias("i"), w["tok"].alias("tok"))), lambda w: w["tok"].rlike(target))
    return words.select(key, F.inline(F.transform(placed, lambda w: F.struct(w["off"].alias("off"), F.array_join(around(w["i"]), " ").alias("window")))))
