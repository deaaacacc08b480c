import pytest

#: Texts with nulls, emptiness, ties, repeats, odd spaces, scripts and lengths.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "one two three"), (6, "one two three"),
    (7, "Ünïcode wörds ärë 漢字 \U0001f600 here"), (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 40),
    (None, "a null id carries words of its own"), (9, "x" * 5000), (10, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 40),
    (11, "no\u00a0break and\u2003em spaces are letters of words"), (12, "ONE two THREE"),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    base = spark.createDataFrame(ODD, "doc_id long, text string")
    # Further columns under names that the operators use inside.
    clash = ("blk", "fp", "shard", "row", "key", "host", "path", "piece", "root", "score", "n", "bucket")
    return base.select("doc_id", "text", *(F.lit(7).alias(c) for c in clash))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
