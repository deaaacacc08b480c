"""The stateless extraction steps over a folder that grows: each document is split and located as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import SENTENCE


def arriving_sentences(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """(file, sents): new texts of a folder as arrays of sentences; joined in order they are the text."""
    texts = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path, wholetext=True)
    return texts.select(F.input_file_name().alias("file"), F.regexp_extract_all("value", F.lit(SENTENCE), F.lit(0)).alias("sents"))
