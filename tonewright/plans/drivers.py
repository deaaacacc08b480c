"""Whole runs: split, features, resampling, fit, cut, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import POLARITIES, decode
from ..operators import drivers, evaluate, sampling
from .features import STOP
from .registry import query
from .scans import GOLD, gold, metrics_sql

RANKED = "r AS (SELECT doc_id, genre, y, row_number() OVER (PARTITION BY genre ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY genre) AS n FROM gold)"
PARTS = f"WITH {GOLD}, {RANKED}, parts AS (SELECT 'df' AS wanted, doc_id, y, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM r WHERE genre = 'df' UNION ALL SELECT 'nw', doc_id, y, CASE WHEN genre = 'df' OR rn <= floor(n * 0.2) THEN 'train' ELSE 'test' END FROM r)"


def parts(t):
    """(wanted, doc_id, y, part): for each genre that is judged, what trains and what is judged."""
    return drivers.parts(gold(t).select("doc_id", "genre", "y")).drop("genre")


@query(f"{PARTS} SELECT wanted, doc_id, y, part FROM parts")
def driver_parts(t):
    return parts(t)


@query(f"{PARTS}, t AS (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY y) AS n FROM parts WHERE wanted = 'df' AND part = 'train' AND y IS NOT NULL), top AS (SELECT max(n) AS top FROM t) SELECT doc_id, y, unnest(range(0, (top - rn) // n + 1)) AS copy FROM t, top")
def driver_train_rows(t):
    """What the forum driver learns from: its part, each class brought up to the largest."""
    train = parts(t).where("wanted = 'df' and part = 'train' and y is not null").select("doc_id", "y")
    return sampling.upsample_cyclic(train, "doc_id")


@query(f"WITH {GOLD} SELECT 'df' AS wanted, doc_id FROM gold WHERE genre = 'df' UNION ALL SELECT 'nw', doc_id FROM gold")
def test_time_train(t):
    """For unseen files: forum is judged by what forum teaches, newswire by both."""
    rows = gold(t).select("doc_id", "genre")
    return rows.where("genre = 'df'").select(F.lit("df").alias("wanted"), "doc_id").unionByName(rows.select(F.lit("nw").alias("wanted"), "doc_id"))


WEIGHTS = "".join(f"""{" UNION ALL " if k else ""}SELECT wanted, '{name}' AS of, doc_id, (top - rn) // n + 1 AS copies FROM (SELECT *, max(n) OVER (PARTITION BY wanted) AS top FROM (SELECT wanted, doc_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY wanted, {label}) AS n FROM both_parts WHERE part = 'train' AND {label} IS NOT NULL WINDOW w AS (PARTITION BY wanted, {label} ORDER BY doc_id)))""" for k, (name, label) in enumerate((("sentiment", "y"), ("belief", "b"))))


@query(f"{PARTS}, both_parts AS (SELECT p.*, g.b FROM parts p JOIN gold g USING (doc_id)) {WEIGHTS}")
def driver_weights(t):
    """How often upsampling takes each training row, for both genres and both tasks."""
    both = drivers.parts(gold(t)).where("part = 'train'")
    each = F.explode(F.array(*(F.struct(F.lit(k.name).alias("of"), F.col(k.label).alias("gold")) for k in drivers.TASKS)))
    train = both.select("wanted", "doc_id", each.alias("k")).select("wanted", "doc_id", "k.*").where("gold is not null")
    return drivers.weights(train, label="gold", by=("wanted", "of")).drop("gold")


@query(f"""{PARTS}, said AS (SELECT wanted, p.doc_id, lang, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}'), lambda w: w NOT IN ({STOP})) AS w FROM parts p JOIN documents d ON d.doc_id = p.doc_id WHERE y IS NOT NULL),
found AS (SELECT DISTINCT wanted, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM said), top AS (SELECT * FROM (SELECT wanted, term, count(*) AS df FROM found GROUP BY wanted, term) QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY df DESC, term) <= 300),
idf AS (SELECT wanted, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM top JOIN (SELECT wanted, count(*) AS n FROM said GROUP BY wanted) USING (wanted))
SELECT wanted, doc_id, 'term ' || term AS name, round(idf / sqrt(sum(idf * idf) OVER (PARTITION BY wanted, doc_id)), 6) AS value FROM found JOIN idf USING (wanted, term) UNION ALL SELECT wanted, doc_id, 'kind ' || lang, 1.0 FROM said WHERE lang IS NOT NULL""")
def driver_features(t):
    """What the drivers know of each sample: term weights over a run's own texts, and the kind."""
    every, out = samples(t).where("y is not null"), None
    for wanted, share in drivers.SHARES.items():  # both parts of a run are weighed together, so its texts need not be split
        mine = every.where(F.col("genre").isin(list(share)))
        rows = drivers.general_features(mine, "doc_id", "text", "kind").select(F.lit(wanted).alias("wanted"), "doc_id", "name", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def samples(t):
    """(doc_id, genre, y, b, text, kind): annotated documents; the language stands for the kind of a mention."""
    return gold(t).join(t.documents.select("doc_id", "text", F.col("lang").alias("kind")), "doc_id")


def _scores(t, judge, tasks=drivers.TASKS):
    out = None
    for wanted in drivers.SHARES:
        for run in drivers.runs(samples(t), wanted, tasks):
            rows = drivers.scored(run, judge(run))
            out = rows if out is None else out.unionByName(rows)
    return out


@query()
def regression_driver(t):
    """Metrics of ridge regression for both genres and both tasks."""
    return _scores(t, drivers.by_regression)


@query()
def network_driver(t):
    """Metrics of a network over all classes, for both genres and both tasks."""
    return _scores(t, drivers.by_network)


@query()
def filter_driver(t):
    """Metrics of a network that knows the two opinions alone and is cut by thresholds, for both genres."""
    return _scores(t, drivers.by_filter, (drivers.SENTIMENT,))


@query(f"WITH {GOLD} SELECT doc_id, CASE y WHEN 0 THEN 'none' WHEN 1 THEN 'neg' ELSE 'pos' END AS predict_polarity FROM gold WHERE y IS NOT NULL")
def gold_predictions(t):
    """Gold labels as predictions: the upper bound."""
    return gold(t).where("y is not null").select("doc_id", decode(F.col("y"), POLARITIES).alias("predict_polarity"))


@query(f"WITH {GOLD} " + metrics_sql("(SELECT genre, (y <> 0)::INT AS g, (y <> 0)::INT AS p FROM gold WHERE y IS NOT NULL)", "genre"))
def gold_metrics(t):
    g = gold(t).where("y is not null")
    return evaluate.binary_metrics(g, F.col("y") != 0, F.col("y") != 0, ("genre",))


@query(f"WITH {GOLD}, c AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM gold) SELECT 3 AS classes, k AS y, n1 AS target FROM c, (VALUES (0), (1), (2)) v(k) UNION ALL SELECT 2, k, (n0 + n1) // 2 FROM c, (VALUES (0), (1)) v(k)")
def default_targets(t):
    return sampling.default_targets(gold(t).where("y is not null").groupBy("y").agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {GOLD}, c AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 2) AS n2 FROM gold) SELECT 3 AS classes, k AS y, n1 AS n FROM c, (VALUES (0), (1), (2)) v(k) WHERE n1 > 0 AND [n0, n1, n2][k + 1] > 0 UNION ALL SELECT 2, k, (n0 + n1) // 2 FROM c, (VALUES (0), (1)) v(k) WHERE (n0 + n1) // 2 > 0 AND [n0, n1][k + 1] > 0")
def resampled_sizes(t):
    """Class sizes after drawing with replacement to the default targets: exactly these."""
    rows = gold(t).where("y is not null").select("doc_id", "y")
    sizes = lambda k: sampling.resampled_by_default(rows, k).groupBy("y").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("classes"), "y", "n")
    return sizes(3).unionByName(sizes(2))


@query()
def default_resample(t):
    """Draws with replacement to the default targets, seeded: rows only."""
    return sampling.resampled_by_default(gold(t).where("y is not null").select("doc_id", "y"))


@query("WITH s AS (SELECT l.quality AS y, length(d.text) % 50 AS score FROM labels l JOIN documents d USING (doc_id)), n AS (SELECT score, sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS n FROM s GROUP BY score), up AS (SELECT *, coalesce(sum(p) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM n) SELECT sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives, round(coalesce((sum(n * (2 * above + p)))::DOUBLE / 2 / nullif(sum(p)::DOUBLE * sum(n)::DOUBLE, 0), 0), 6) AS auc FROM up")
def roc_area(t):
    rows = t.labels.select("doc_id", "quality").join(t.documents.select("doc_id", (F.length("text") % 50).cast("long").alias("score")), "doc_id")
    return evaluate.area(rows, "quality", "score")
