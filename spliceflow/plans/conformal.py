"""Queries of conformal calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from spliceflow.functions import calibration as C
from spliceflow.operators import conformal, metrics
from spliceflow.operators.ranks import running
from spliceflow.plans.domain import sql, view
from spliceflow.plans.registry import query

_BIN = "CASE WHEN support >= 250 THEN '250+' WHEN support >= 100 THEN '100-249' WHEN support >= 50 THEN '50-99' WHEN support >= 20 THEN '20-49' ELSE '<20' END"
_SCORES = sql("cal") + f", s AS (SELECT *, abs(truth - estimate) / greatest(scale, 1e-9) AS score, {_BIN} AS bin FROM cal)"
_RANK = "CAST(ceil((n + 1) * 0.950000) AS BIGINT)"


def _ranked(keys: str, source: str = "s") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"(SELECT {keys + ', ' if keys else ''}n, score AS q FROM (SELECT *, row_number() OVER ({part} ORDER BY score) AS r, count(*) OVER ({part}) AS n FROM {source}) WHERE r = {_RANK})"


def _bins(keys: str) -> str:
    return f"(SELECT {keys}, count(*) AS n FROM s GROUP BY {keys})"


@query("conformal_quantile", _SCORES + f" SELECT n, round(q, 9) AS q FROM {_ranked('')}")
def conformal_quantile(spark, sf_dir):
    rows = view(spark, sf_dir, "cal").select(conformal.score(F.col("estimate"), F.col("truth"), F.col("scale")).alias("score"))
    return conformal.quantiles(rows, []).select("n", F.round("q", 9).alias("q"))


@query("fit_mondrian", _SCORES + f""", w AS (SELECT score, 'global' AS level, '' AS key FROM s UNION ALL SELECT score, 'bin', bin FROM s UNION ALL SELECT score, 'type', event_type FROM s UNION ALL SELECT score, 'group', event_type || '|' || bin FROM s)
SELECT level, key, n, round(max(q), 9) AS q FROM (SELECT level, key, n, CASE WHEN r = {_RANK} THEN score END AS q FROM (SELECT *, row_number() OVER (PARTITION BY level, key ORDER BY score) AS r, count(*) OVER (PARTITION BY level, key) AS n FROM w)) WHERE level <> 'group' OR n >= 20 GROUP BY level, key, n""")
def fit_mondrian(spark, sf_dir):
    return conformal.levels(view(spark, sf_dir, "cal")).select("level", "key", "n", F.round("q", 9).alias("q"))


@query("apply_split", _SCORES + f""", g AS (SELECT q FROM {_ranked('', '(SELECT * FROM s WHERE fold <> 0)')})
SELECT id, round(least(greatest(estimate - q * scale, -1e0), 1e0), 9) AS low, round(least(greatest(estimate + q * scale, -1e0), 1e0), 9) AS high FROM s, g WHERE fold = 0""")
def apply_split(spark, sf_dir):
    rows = view(spark, sf_dir, "cal")
    cal = rows.where("fold <> 0").select(conformal.score(F.col("estimate"), F.col("truth"), F.col("scale")).alias("score"))
    q = float(conformal.quantiles(cal, []).first()["q"])  # one number
    ci = C.plain_interval(F.col("estimate"), F.col("scale"), F.lit(q), -1.0, 1.0)
    return rows.where("fold = 0").select("id", F.round(ci["low"], 9).alias("low"), F.round(ci["high"], 9).alias("high"))


@query("apply_mondrian", _SCORES + f""", b AS (SELECT * FROM {_ranked('bin', '(SELECT * FROM s WHERE fold <> 0)')}), g AS (SELECT q FROM {_ranked('', '(SELECT * FROM s WHERE fold <> 0)')})
SELECT id, s.bin, round(coalesce(b.q, g.q), 9) AS q FROM s LEFT JOIN b USING (bin), g WHERE fold = 0""")
def apply_mondrian(spark, sf_dir):
    rows = view(spark, sf_dir, "cal").withColumn("event_type", F.lit(None).cast("string")).withColumn("bin", C.support_bin(F.col("support")))
    cal = conformal.fit(rows.where("fold <> 0"))
    return rows.where("fold = 0").select("id", "bin", F.round(C.quantile_for(C.Calibrator(cal.q_global, cal.by_bin), F.col("support")), 9).alias("q"))


_CROSS = _SCORES + f""", c AS (SELECT s.score, s.bin, f.held FROM s, (SELECT unnest([0, 1, 2]) AS held) f WHERE s.fold <> f.held), qb AS (SELECT * FROM {_ranked('held, bin', 'c')}), qa AS (SELECT * FROM {_ranked('held', 'c')}),
x AS (SELECT s.*, coalesce(qb.q, qa.q) AS q FROM s LEFT JOIN qb ON qb.held = s.fold AND qb.bin = s.bin LEFT JOIN qa ON qa.held = s.fold),
i AS (SELECT *, least(greatest(estimate - q * scale, -1e0), 1e0) AS low, least(greatest(estimate + q * scale, -1e0), 1e0) AS high FROM x)
"""


def _crossfit(spark, sf_dir):
    rows = conformal.crossfit(view(spark, sf_dir, "cal"))
    ci = C.plain_interval(F.col("estimate"), F.col("scale"), F.col("q"), -1.0, 1.0)
    return rows.withColumns({"low": ci["low"], "high": ci["high"]})


@query("crossfit", _CROSS + "SELECT id, fold, bin, round(q, 9) AS q FROM i")
def crossfit(spark, sf_dir):
    return _crossfit(spark, sf_dir).select("id", "fold", "bin", F.round("q", 9).alias("q"))


_MISS = "(high - low) + 40.0e0 * (greatest(low - truth, 0e0) + greatest(truth - high, 0e0))"


@query("coverage_metrics", _CROSS + f"""SELECT bin, count(*) AS n, CAST(sum((truth BETWEEN low AND high)::INT) AS BIGINT) AS covered, round(avg((truth BETWEEN low AND high)::INT), 6) AS coverage, round(avg(high - low), 6) AS mean_width, round(avg({_MISS}), 6) AS interval_score FROM i GROUP BY bin""")
def coverage_metrics(spark, sf_dir):
    out = metrics.coverage(_crossfit(spark, sf_dir), ["bin"])
    return out.select("bin", "n", "covered", *(F.round(c, 6).alias(c) for c in ("coverage", "mean_width", "interval_score")))


@query("interval_score", _CROSS + f"SELECT id, round({_MISS}, 9) AS interval_score FROM i")
def interval_score(spark, sf_dir):
    return _crossfit(spark, sf_dir).select("id", F.round(C.interval_score(F.col("low"), F.col("high"), F.col("truth")), 9).alias("interval_score"))


@query("wilson", _CROSS + """, w AS (SELECT event_type, count(*) AS n, CAST(sum((truth BETWEEN low AND high)::INT) AS DOUBLE) AS k FROM i GROUP BY event_type)
SELECT event_type, n, round((k / n + 3.841458820694124e0 / (2 * n)) / (1 + 3.841458820694124e0 / n) - 1.959963984540054e0 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124e0 / (4e0 * n * n)) / (1 + 3.841458820694124e0 / n), 8) AS low,
round((k / n + 3.841458820694124e0 / (2 * n)) / (1 + 3.841458820694124e0 / n) + 1.959963984540054e0 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124e0 / (4e0 * n * n)) / (1 + 3.841458820694124e0 / n), 8) AS high FROM w""")
def wilson(spark, sf_dir):
    out = metrics.coverage(_crossfit(spark, sf_dir), ["event_type"]).withColumn("w", metrics.wilson(F.col("covered").cast("double"), F.col("n")))
    return out.select("event_type", "n", F.round("w.low", 8).alias("low"), F.round("w.high", 8).alias("high"))


@query("transfer", _SCORES + f""", b AS (SELECT bin, n, q FROM (SELECT bin, n, r, score AS q FROM (SELECT bin, abs(truth - estimate) AS score, row_number() OVER (PARTITION BY bin ORDER BY abs(truth - estimate)) AS r, count(*) OVER (PARTITION BY bin) AS n FROM s WHERE event_type = 'SE')) WHERE r = {_RANK})
SELECT s.bin, count(*) AS n, CAST(sum((abs(truth - estimate) <= b.q)::INT) AS BIGINT) AS covered FROM s JOIN b USING (bin) WHERE event_type <> 'SE' GROUP BY s.bin""")
def transfer(spark, sf_dir):
    """Absolute residuals fitted on one class of events, deployed on the others."""
    rows = view(spark, sf_dir, "cal").withColumns({"bin": C.support_bin(F.col("support")), "score": F.abs(F.col("truth") - F.col("estimate"))})
    q = conformal.quantiles(rows.where("event_type = 'SE'"), ["bin"]).where("q is not null").select("bin", "q")
    return rows.where("event_type <> 'SE'").join(q, "bin").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("score") <= F.col("q")).cast("long")).alias("covered"))


@query("variance_decomposition", _SCORES + """ SELECT event_type, round(sqrt(avg((truth - estimate) * (truth - estimate))), 6) AS sigma_total, round(sqrt(avg(scale * scale)), 6) AS sigma_sampling FROM s GROUP BY event_type""")
def variance_decomposition(spark, sf_dir):
    d = F.col("truth") - F.col("estimate")
    return view(spark, sf_dir, "cal").groupBy("event_type").agg(F.round(F.sqrt(F.avg(d * d)), 6).alias("sigma_total"), F.round(F.sqrt(F.avg(F.col("scale") * F.col("scale"))), 6).alias("sigma_sampling"))


@query("null_threshold", _SCORES + """, r AS (SELECT bin, abs(estimate) AS v, row_number() OVER (PARTITION BY bin ORDER BY abs(estimate)) AS k, count(*) OVER (PARTITION BY bin) AS n FROM s) SELECT bin, n, round(v, 9) AS threshold FROM r WHERE k = CAST(ceil((n - 1) * 0.95) AS BIGINT) + 1""")
def null_threshold(spark, sf_dir):
    """Per bin the order statistic at or above the 95 % place, as the higher of its two neighbours."""
    rows = view(spark, sf_dir, "cal").select(C.support_bin(F.col("support")).alias("bin"), F.abs("estimate").alias("v"))
    ranked = running(rows.groupBy("bin", "v").agg(F.count(F.lit(1)).alias("here")), ["bin"], "v", "here").withColumnRenamed("total_here", "n")
    place = F.ceil((F.col("n") - 1).cast("decimal(18,0)") * F.lit("0.95").cast("decimal(4,2)")).cast("long") + 1
    return ranked.where(F.col("before_here") + F.col("here") >= place).groupBy("bin", "n").agg(F.round(F.min("v"), 9).alias("threshold"))
