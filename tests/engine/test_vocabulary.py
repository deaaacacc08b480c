"""Words beyond the 20,000 most frequent ones have vectors too, where there are embeddings for them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tonewright import plans
from tonewright.plans import features

NAMES = ("embedding_lookup", "embedding_matrix", "mention_matrix", "relation_matrix", "flatten_matrix", "matrix_features", "vocab_embedding")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    word = lambda k: "".join(chr(97 + k // 26**e % 26) for e in (3, 2, 1, 0))
    rows = [(c, turn, "user" if turn % 2 else "assistant", " ".join(word(k) for k in reversed(range(c * 10_100)))) for c in (1, 2) for turn in (0, 1)]
    rows.append((3, 1, "user", "unheard zzzz pad aaab"))
    out = tmp_path_factory.mktemp("words")
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{out}/conversations.parquet")
    vec = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.col("id") / 8 + i).cast("float"))
    spark.range(20_190).select(F.col("id").alias("vec_id"), vec.alias("embedding"), F.lit(0).alias("label")).coalesce(1).write.parquet(f"{out}/embeddings.parquet")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_rare_words_have_their_vectors(spark, folder, name):
    c = duckdb.connect()
    for t in ("conversations", "embeddings"):
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    found = plans.queries()[name](spark, folder)
    said = lambda rows: sorted(map(repr, rows))
    assert said(tuple(r) for r in found.collect()) == said(c.sql(plans.oracle_sql()[name]).select(*(f'"{x}"' for x in found.columns)).fetchall())


def test_common_words_may_be_few(spark, folder, monkeypatch):
    """The result doesn't depend on how many words are broadcast."""
    monkeypatch.setattr(features, "COMMON", 7)
    test_rare_words_have_their_vectors(spark, folder, "embedding_matrix")


def test_flat_cells_know_their_place(spark, tmp_path):
    """A turn that is there twice has all its cells twice, as the SQL says; rows of a matrix are not brought together for it."""
    rows = [(1, 0, "user", "one two"), (1, 0, "user", "three"), (2, 5, "user", "")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    vec = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.col("id") / 8 + i).cast("float"))
    spark.range(2).select(F.col("id").alias("vec_id"), vec.alias("embedding"), F.lit(0).alias("label")).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    test_rare_words_have_their_vectors(spark, str(tmp_path), "flatten_matrix")
    assert "collect_list" not in plans.queries()["flatten_matrix"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
