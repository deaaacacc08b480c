"""Metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)


def binary_metrics(rows: DataFrame, gold: Column, pred: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """accuracy, prec, recall, f1 of 0/1 columns, positive 1; a ratio over nothing is 0."""
    t = rows.select(*by, gold.cast("int").alias("_g"), pred.cast("int").alias("_p"))
    n = t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.expr("count_if(_g = _p)").alias("right"), F.expr("count_if(_g = 1 and _p = 1)").alias("tp"), F.expr("count_if(_g = 0 and _p = 1)").alias("fp"), F.expr("count_if(_g = 1 and _p = 0)").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select(*by, "n", _ratio(F.col("right"), F.col("n")).alias("accuracy"), _ratio(tp, tp + fp).alias("prec"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def one_against_rest(rows: DataFrame, gold: str, pred: str, classes: dict[str, int], by: tuple[str, ...] = (), invert: tuple[str, ...] = ("none", "na")) -> DataFrame:
    """binary_metrics of each class against the rest; of the classes in `invert`, the rest is positive."""
    task = F.explode(F.array(*(F.struct(F.lit(n).alias("task"), F.lit(k).alias("k"), F.lit(n in invert).alias("inv")) for n, k in classes.items())))
    t = rows.select(*by, gold, pred, task.alias("t")).select(*by, gold, pred, "t.*")
    hit = lambda c: (F.col(c) == F.col("k")) != F.col("inv")
    return binary_metrics(t, hit(gold), hit(pred), (*by, "task"))


def roc(rows: DataFrame, gold: str, score: str) -> DataFrame:
    """(score, tpr, fpr) at each threshold, highest first.  Scores are counted before they are ordered."""
    n = rows.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(gold)).alias("p"), F.sum(1 - F.col(gold)).alias("n"))
    up = running(n, ("score",), {"_p": F.col("p"), "_n": F.col("n")})
    share = lambda c: _ratio(F.col(f"_{c}_total") - F.col(f"_{c}") + F.col(c), F.col(f"_{c}_total"))
    return up.select("score", share("p").alias("tpr"), share("n").alias("fpr"))


def area(rows: DataFrame, gold: str, score: str) -> DataFrame:
    """(positives, negatives, auc): the share of pairs that the score orders rightly, ties by half; 0 where there are none."""
    n = rows.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(gold)).cast("long").alias("p"), F.sum(1 - F.col(gold)).cast("long").alias("n"))
    up = running(n, ("score",), {"_p": F.col("p"), "_n": F.col("n")})
    # Twice the pairs, so that halves stay whole numbers: a negative has the positives above it, and half of those beside it.
    wins = F.col("n") * (2 * (F.col("_p_total") - F.col("_p")) + F.col("p"))
    sums = up.agg(F.sum(wins.cast("decimal(38,0)")).alias("wins"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return sums.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("positives", "negatives")), _ratio(F.col("wins").cast("double") / 2, pairs).alias("auc"))


def majority(votes: DataFrame, by: tuple[str, ...], vote: str = "y") -> DataFrame:
    """The most frequent vote, the least of ties."""
    n = votes.groupBy(*by, vote).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by).agg(F.max_by(F.col(vote), F.struct("_n", -F.col(vote))).alias("y"))
