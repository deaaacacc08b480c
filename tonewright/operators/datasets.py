"""Labelled data sets for document vectors: a corpus's own opinions, and external ones besides.

Texts with an opinion, positive ones first, are split by a hash of their key and tagged by part and place (`TRAIN_0`); the tags of an
external corpus start with `EXTERNAL_`, and its texts without an opinion are `UNSUP` and not split.  Texts become words by `clean_text`.
A null text has no words; equal keys are ordered by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean_text
from .ranks import ranked


def hashed(key: Column, of: int) -> Column:
    """A bucket of a key that other engines draw as well: by the first digits of its md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % of


def tagged(rows: DataFrame, key: str, text: str, opinion: Column, prefix: str = "", test: int = 5, unsupervised: bool = False) -> DataFrame:
    """(tag, y, words) of the rows whose `opinion` is 1 or 0; with `unsupervised` those without any too."""
    given = rows.select(F.col(key).cast("string").alias("key"), F.length(F.col(key).cast("string")).alias("wide"), F.coalesce(text, F.lit("")).alias("text"), opinion.cast("int").alias("y"))
    kept = given if unsupervised else given.where("y is not null")
    part = F.when(F.col("y").isNull(), "UNSUP").when(hashed(F.col("key"), test) == 0, "TEST").otherwise("TRAIN")
    each = kept.select(F.concat(F.lit(prefix), part).alias("part"), (1 - F.coalesce("y", F.lit(0))).alias("late"), "wide", "key", "text", "y")
    numbered = ranked(each, ("late", "wide", "key", "text"), ("part",))
    return numbered.select(F.concat_ws("_", "part", F.col("rn") - 1).alias("tag"), "y", clean_text(F.col("text")).alias("words"))


def with_external(own: DataFrame, external: DataFrame) -> DataFrame:
    """Both under each other; the document vectors' vocabulary and training see all of them."""
    return own.unionByName(external)
