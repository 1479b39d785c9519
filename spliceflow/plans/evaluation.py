"""Queries of detection and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spliceflow.operators import metrics
from spliceflow.plans.domain import sql, view
from spliceflow.plans.registry import query

_S = sql("scored")


@query("auc", _S + """, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM scored)
SELECT CAST(sum((label = 1)::INT) AS BIGINT) AS n_pos, CAST(sum((label = 0)::INT) AS BIGINT) AS n_neg, round((sum(CASE WHEN label = 1 THEN k ELSE 0 END) - sum((label = 1)::INT) * (sum((label = 1)::INT) + 1) / 2.0) / (sum((label = 1)::INT) * sum((label = 0)::INT)), 9) AS auc FROM r""")
def auc(spark, sf_dir):
    return metrics.auc(view(spark, sf_dir, "scored"), []).select("n_pos", "n_neg", F.round("auc", 9).alias("auc"))


@query("average_ranks", _S + " SELECT id, CAST(rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS DOUBLE) AS avg_rank FROM scored")
def average_ranks(spark, sf_dir):
    return metrics.average_ranks(view(spark, sf_dir, "scored"), ["grp"], "score").select("id", F.col("avg_rank").cast("double").alias("avg_rank"))


_CONF = _S + """, c AS (SELECT grp, CAST(sum((score >= 0.6 AND label = 1)::INT) AS BIGINT) AS tp, CAST(sum((score >= 0.6 AND label = 0)::INT) AS BIGINT) AS fp, CAST(sum((score < 0.6 AND label = 1)::INT) AS BIGINT) AS fn, CAST(sum((score < 0.6 AND label = 0)::INT) AS BIGINT) AS tn FROM scored GROUP BY grp)"""


@query("confusion_mcc", _CONF + """ SELECT grp, tp, fp, fn, tn, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt(CAST((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) AS DOUBLE)) ELSE 0 END, 9) AS mcc FROM c""")
def confusion_mcc(spark, sf_dir):
    c = metrics.confusion(view(spark, sf_dir, "scored"), ["grp"], F.col("score") >= 0.6, F.col("label") == 1)
    return c.withColumn("mcc", F.round(metrics.mcc(*map(F.col, ("tp", "fp", "fn", "tn"))), 9))


_GRID = [round(0.1 * k, 1) for k in range(1, 12)]


@query("threshold_grid", _S + f""", g AS (SELECT unnest({_GRID}::DOUBLE[]) AS threshold) SELECT threshold, CAST(sum((score >= threshold AND label = 1)::INT) AS BIGINT) AS tp, CAST(sum((score >= threshold AND label = 0)::INT) AS BIGINT) AS fp FROM scored, g GROUP BY threshold""")
def threshold_grid(spark, sf_dir):
    """The grid is an array in each row's code: no join, and the counts are combined before the shuffle."""
    rows = view(spark, sf_dir, "scored").select("score", "label", F.explode(F.array(*map(F.lit, _GRID))).alias("threshold"))
    called = F.col("score") >= F.col("threshold")
    return rows.groupBy("threshold").agg(F.sum((called & (F.col("label") == 1)).cast("long")).alias("tp"), F.sum((called & (F.col("label") == 0)).cast("long")).alias("fp"))


@query("pareto_front", _S + f""", g AS (SELECT unnest({_GRID}::DOUBLE[]) AS threshold), p AS (SELECT threshold, CAST(sum((score >= threshold AND label = 1)::INT) AS BIGINT) AS tp, CAST(sum((score < threshold AND label = 0)::INT) AS BIGINT) AS tn FROM scored, g GROUP BY threshold)
SELECT threshold, tp, tn FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.tp >= a.tp AND b.tn >= a.tn AND (b.tp > a.tp OR b.tn > a.tn))""")
def pareto_front(spark, sf_dir):
    rows = view(spark, sf_dir, "scored").select("score", "label", F.explode(F.array(*map(F.lit, _GRID))).alias("threshold"))
    points = rows.groupBy("threshold").agg(F.sum(((F.col("score") >= F.col("threshold")) & (F.col("label") == 1)).cast("long")).alias("tp"), F.sum(((F.col("score") < F.col("threshold")) & (F.col("label") == 0)).cast("long")).alias("tn"))
    return metrics.pareto_front(points, "tp", "tn")


@query("mcnemar_counts", _S + """ SELECT CAST(sum((a AND NOT b)::INT) AS BIGINT) AS only_first, CAST(sum((b AND NOT a)::INT) AS BIGINT) AS only_second, count(*) AS n FROM (SELECT (score >= 0.6) = (label = 1) AS a, (score >= 0.4) = (label = 1) AS b FROM scored)""")
def mcnemar_counts(spark, sf_dir):
    right = lambda t: (F.col("score") >= t) == (F.col("label") == 1)
    rows = view(spark, sf_dir, "scored").select(right(0.6).alias("a"), right(0.4).alias("b"))
    return rows.agg(F.sum((F.col("a") & ~F.col("b")).cast("long")).alias("only_first"), F.sum((F.col("b") & ~F.col("a")).cast("long")).alias("only_second"), F.count(F.lit(1)).alias("n"))


@query("holm", _S + """, p AS (SELECT grp, cast(count(*) % 7 + 1 as double) / 100 AS p FROM scored GROUP BY grp), r AS (SELECT grp, p, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, grp) + 1) * p) AS step, row_number() OVER (ORDER BY p, grp) AS k FROM p)
SELECT grp, round(max(step) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING), 9) AS p_holm FROM r""")
def holm(spark, sf_dir):
    p = view(spark, sf_dir, "scored").groupBy("grp").agg(((F.count(F.lit(1)) % 7 + 1).cast("double") / 100).alias("p"))
    return metrics.holm(p).select("grp", F.round("p_holm", 9).alias("p_holm"))


@query("stratify", _S + " SELECT grp, count(*) AS n, round(avg(label), 6) AS positive_rate, round(avg(score), 6) AS mean_score, round(quantile_cont(score, 0.5), 6) AS median_score FROM scored GROUP BY grp")
def stratify(spark, sf_dir):
    return view(spark, sf_dir, "scored").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 6).alias("positive_rate"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.percentile("score", F.lit(0.5)), 6).alias("median_score"))


@query("correlation", sql("cal") + " SELECT event_type, round(corr(estimate, truth), 6) AS r, round(avg(abs(estimate - truth)), 6) AS mae, round(avg((sign(estimate) = sign(truth))::INT), 6) AS direction FROM cal GROUP BY event_type")
def correlation(spark, sf_dir):
    return view(spark, sf_dir, "cal").groupBy("event_type").agg(F.round(F.corr("estimate", "truth"), 6).alias("r"), F.round(F.avg(F.abs(F.col("estimate") - F.col("truth"))), 6).alias("mae"), F.round(metrics.share(F.signum("estimate") == F.signum("truth")), 6).alias("direction"))
