"""Predictions and metrics.  Stand-in scores come from text statistics, so that every rule has something to decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import BELIEFS, POLARITIES, argmax, cut_class, decode, threshold_class
from ..operators import evaluate
from .registry import Tables, query
from .scans import GOLD, gold, metrics_sql

#: Three class scores of a document, from its length and id.
SCORED = f"{GOLD}, scored AS (SELECT g.doc_id, g.genre, g.y, g.b, [(length(text) % 7)::DOUBLE, (length(text) % 5)::DOUBLE, (g.doc_id % 6)::DOUBLE] AS p FROM gold g JOIN documents d ON d.doc_id = g.doc_id)"
SUM1 = "(p[1] + p[2] + p[3] + 1)"


def scored(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.array((F.length("text") % 7).cast("double"), (F.length("text") % 5).cast("double"), (F.col("doc_id") % 6).cast("double")).alias("p"))
    return gold(t).join(d, "doc_id")


ARG = "list_position(p, list_max(p)) - 1"


@query(f"WITH {GOLD} SELECT doc_id, 1 AS neg, 3 AS cb, 'neg' AS predict_polarity, 'cb' AS predict_type FROM gold")
def baseline_predict(t):
    return gold(t).select("doc_id", F.lit(1).alias("neg"), F.lit(3).alias("cb"), decode(F.lit(1), POLARITIES).alias("predict_polarity"), decode(F.lit(3), BELIEFS).alias("predict_type"))


@query(f"WITH {GOLD}, r AS (SELECT 'sentiment' AS task, (y <> 0)::INT AS g, 1 AS p FROM gold WHERE y IS NOT NULL UNION ALL SELECT 'belief', (b <> 0)::INT, 1 FROM gold WHERE b IS NOT NULL) " + metrics_sql("r", "task"))
def baseline_metrics(t):
    g = gold(t).where("y is not null")
    rows = g.select(F.lit("sentiment").alias("task"), (F.col("y") != 0).alias("g")).unionByName(g.select(F.lit("belief").alias("task"), (F.col("b") != 0).alias("g")))
    return evaluate.binary_metrics(rows, F.col("g"), F.lit(1), ("task",))


@query(f"WITH {SCORED} SELECT doc_id, ({ARG})::INT AS y FROM scored")
def argmax_predict(t):
    return scored(t).select("doc_id", argmax(F.col("p")).alias("y"))


@query(f"WITH {SCORED} SELECT doc_id, CASE WHEN p[2] - p[1] > 0.0 THEN 2 WHEN p[1] - p[2] > 0.1 THEN 1 ELSE 0 END AS y, CASE WHEN p[2] - p[1] > 1.5 THEN 2 WHEN p[1] - p[2] > 1.5 THEN 1 ELSE 0 END AS y_wide FROM scored")
def threshold_predict(t):
    return scored(t).select("doc_id", threshold_class(F.col("p")).alias("y"), threshold_class(F.col("p"), 1.5, 1.5).alias("y_wide"))


@query(f"WITH {SCORED} SELECT doc_id, CASE WHEN v >= 1.7 THEN 2 WHEN v >= 0.7 THEN 1 ELSE 0 END AS y, CASE WHEN v >= 2.3 THEN 3 WHEN v >= 1.7 THEN 2 WHEN v >= 0.7 THEN 1 ELSE 0 END AS b FROM (SELECT doc_id, p[1] / 2 AS v FROM scored)")
def regression_bins(t):
    v = F.col("p")[0] / 2
    return scored(t).select("doc_id", cut_class(v, (0.7, 1.7)).alias("y"), cut_class(v, (0.7, 1.7, 2.3)).alias("b"))


@query(f"WITH {SCORED}, v AS (SELECT doc_id, unnest([p[1]::INT % 3, p[2]::INT % 3, p[3]::INT % 3]) AS y FROM scored), n AS (SELECT doc_id, y, count(*) AS n FROM v GROUP BY doc_id, y) SELECT doc_id, y FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, y) = 1")
def majority_vote(t):
    votes = scored(t).select("doc_id", F.explode(F.transform("p", lambda x: (x.cast("int") % 3))).alias("y"))
    return evaluate.majority(votes, ("doc_id",))


@query(f"WITH {SCORED} SELECT doc_id, CASE ({ARG}) WHEN 0 THEN 'none' WHEN 1 THEN 'neg' ELSE 'pos' END AS predict_polarity, CASE (p[3]::INT % 4) WHEN 0 THEN 'na' WHEN 1 THEN 'rob' WHEN 2 THEN 'ncb' ELSE 'cb' END AS predict_type FROM scored")
def attach_predictions(t):
    made = scored(t).select("doc_id", argmax(F.col("p")).alias("y"), (F.col("p")[2].cast("int") % 4).alias("b"))
    return t.documents.select("doc_id").join(made, "doc_id").select("doc_id", decode(F.col("y"), POLARITIES).alias("predict_polarity"), decode(F.col("b"), BELIEFS).alias("predict_type"))


@query(f"WITH {SCORED} " + metrics_sql(f"(SELECT (y = 2)::INT AS g, (({ARG}) = 2)::INT AS p FROM scored WHERE y IS NOT NULL)"))
def binary_metrics(t):
    return evaluate.binary_metrics(scored(t).where("y is not null"), F.col("y") == 2, argmax(F.col("p")) == 2)


@query(f"WITH {SCORED} " + metrics_sql("(SELECT genre, task, ((b = k) <> inv)::INT AS g, ((p[3]::INT % 4 = k) <> inv)::INT AS p FROM scored, (VALUES ('na', 0, true), ('rob', 1, false), ('ncb', 2, false), ('cb', 3, false)) v(task, k, inv) WHERE b IS NOT NULL)", "genre, task"))
def belief_metrics(t):
    rows = scored(t).where("b is not null").withColumn("pred", F.col("p")[2].cast("int") % 4)
    return evaluate.one_against_rest(rows, "b", "pred", {k: n for n, k in enumerate(BELIEFS)}, ("genre",))


@query(f"WITH {SCORED}, f AS (SELECT *, doc_id % 3 AS fold FROM scored WHERE y IS NOT NULL), m AS (SELECT k AS param, fold, 2.0 * count(*) FILTER (y = 2 AND p[1] >= k) / nullif(count(*) FILTER (y = 2) + count(*) FILTER (p[1] >= k), 0) AS f1 FROM f, (VALUES (1), (3), (5)) v(k) GROUP BY k, fold), a AS (SELECT param, round(avg(coalesce(f1, 0)), 6) AS f1 FROM m GROUP BY param) SELECT param, f1, (param = arg_max(param, f1 * 1000 + param / 1e9) OVER ())::INT AS best FROM a")
def cv_mean(t):
    from pyspark.sql import Window

    rows = scored(t).where("y is not null").select((F.col("doc_id") % 3).alias("fold"), "y", "p", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("param"))
    m = evaluate.binary_metrics(rows, F.col("y") == 2, F.col("p")[0] >= F.col("param"), ("param", "fold"))
    hits = rows.groupBy("param", "fold").agg(F.expr("count_if(y = 2 and p[0] >= param)").alias("tp"), F.expr("count_if(y = 2) + count_if(p[0] >= param)").alias("all"))
    exact = m.join(hits, ["param", "fold"]).groupBy("param").agg(F.round(F.avg(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("all")), F.lit(0.0))), 6).alias("f1"))
    best = F.max_by("param", F.struct("f1", "param")).over(Window.partitionBy())  # a row a parameter
    return exact.select("param", "f1", (F.col("param") == best).cast("int").alias("best"))


@query("WITH s AS (SELECT l.quality AS y, length(d.text) % 50 AS score FROM labels l JOIN documents d USING (doc_id)), n AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY score) SELECT score, round(sum(p) OVER w / sum(p) OVER ()::DOUBLE, 6) AS tpr, round(sum(n) OVER w / sum(n) OVER ()::DOUBLE, 6) AS fpr FROM n WINDOW w AS (ORDER BY score DESC)")
def roc_curve(t):
    rows = t.labels.select("doc_id", "quality").join(t.documents.select("doc_id", (F.length("text") % 50).cast("long").alias("score")), "doc_id")
    return evaluate.roc(rows, "quality", "score")
