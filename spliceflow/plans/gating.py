"""Queries of gate and filter searches and of reports on intervals and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from spliceflow.functions import calibration as C
from spliceflow.operators import conformal, gating as G
from spliceflow.plans.calibration import SCORED_SQL, scored
from spliceflow.plans.conformal import _CROSS, _crossfit
from spliceflow.plans.domain import sql, view
from spliceflow.plans.registry import query
from spliceflow.plans.transcripts import _T, _transcripts

_CAL, _EV, _S = sql("cal"), sql("ev"), sql("scored")
_GATE = _CAL + ", g AS (SELECT event_type, scale AS width, (id % 11 + 1) / 10e0 AS cv, abs(round(estimate, 1)) AS effect, (id % 13) / 4e0 AS snr, abs(truth - estimate) <= 0.8 + (17 - scale * 16) / 40 AS ok FROM cal)"


def _gate_rows(spark, sf_dir):
    return view(spark, sf_dir, "cal").selectExpr("event_type", "scale AS width", "(id % 11 + 1) / 10D AS cv", "abs(round(estimate, 1)) AS effect", "(id % 13) / 4D AS snr", "abs(truth - estimate) <= 0.8 + (17 - scale * 16) / 40 AS ok")


@query("confidence_gate", _GATE + """, w AS (SELECT DISTINCT event_type, width AS a FROM g), v AS (SELECT DISTINCT event_type, cv AS b FROM g),
c AS (SELECT w.event_type, a, b, count(*) AS n, sum(ok::INT) AS k FROM w JOIN v USING (event_type) JOIN g ON g.event_type = w.event_type AND g.width <= a AND g.cv <= b GROUP BY 1, 2, 3)
SELECT event_type, greatest(0.2e0, a) AS width, least(0.5e0, b) AS cv FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, k / n DESC, a, b) AS r FROM c WHERE n >= 10 AND k >= 0.74 * n) WHERE r = 1""")
def confidence_gate(spark, sf_dir):
    return G.confidence_gate(_gate_rows(spark, sf_dir), ["event_type"], "width", "cv", "ok", 0.74, 10, 0.2, 0.5)


@query("effect_gate", _GATE + """, t AS (SELECT DISTINCT event_type, effect AS a FROM g), u AS (SELECT DISTINCT event_type, snr AS b FROM g), v AS (SELECT DISTINCT event_type, cv AS c FROM g UNION ALL SELECT DISTINCT event_type, NULL FROM g),
x AS (SELECT t.event_type, a, b, c, count(*) AS n, sum(ok::INT) AS k FROM t JOIN u USING (event_type) JOIN v USING (event_type) JOIN g ON g.event_type = t.event_type AND g.effect >= a AND g.snr >= b AND (c IS NULL OR g.cv <= c) GROUP BY 1, 2, 3, 4)
SELECT event_type, n AS selected, round(k / n, 9) AS accuracy, a AS effect, b AS snr, c AS cv FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, k / n DESC, c IS NULL, a DESC, b DESC, c) AS r FROM x WHERE n >= 10 AND k >= 0.78 * n) WHERE r = 1""")
def effect_gate(spark, sf_dir):
    out = G.effect_gate(_gate_rows(spark, sf_dir), ["event_type"], "effect", "snr", "cv", "ok", 0.78, 10)
    return out.withColumn("accuracy", F.round("accuracy", 9))


_GRID = ([0.1, 0.2, 0.3, 0.4, 0.5], [0.5, 1.0, 2.0, 5.0], [1, 2, 3, 5])
_FILTER = _T + f""", cfg AS (SELECT s AS min_score, c AS min_coverage, n AS min_support FROM (SELECT unnest({_GRID[0]}::DOUBLE[]) AS s), (SELECT unnest({_GRID[1]}::DOUBLE[]) AS c), (SELECT unnest({_GRID[2]}::INT[]) AS n)),
ref AS (SELECT DISTINCT gene_id, chain FROM t WHERE tx % 3 <> 1 AND chain <> ''), p AS (SELECT DISTINCT min_score, min_coverage, min_support, gene_id, chain FROM cfg, t WHERE chain <> '' AND (score >= min_score OR (cov >= greatest(20, 10 * min_coverage) AND score >= min_score / 2)) AND cov >= min_coverage AND (n_exons < 2 OR support >= min_support) AND length >= 50),
f AS (SELECT min_score, min_coverage, min_support, count(p.chain) AS found, count(ref.chain) AS hits FROM cfg LEFT JOIN p USING (min_score, min_coverage, min_support) LEFT JOIN ref USING (gene_id, chain) GROUP BY 1, 2, 3),
h AS (SELECT *, round(2 * hits / greatest(found + (SELECT count(*) FROM ref), 1), 9) AS f1 FROM f)"""


def _filter_grid(spark, sf_dir):
    rows = _transcripts(spark, sf_dir).where("chain <> ''").withColumn("n_exons", F.size("exons"))
    return G.filter_grid(rows, rows.where("tx % 3 <> 1"), ["gene_id"], *_GRID).withColumn("f1", F.round("f1", 9))


@query("filter_grid", _FILTER + " SELECT * FROM h")
def filter_grid(spark, sf_dir):
    return _filter_grid(spark, sf_dir)


@query("best_filter", _FILTER + " SELECT * FROM h ORDER BY f1 DESC, min_score, min_coverage, min_support LIMIT 1")
def best_filter(spark, sf_dir):
    return G.best_filter(_filter_grid(spark, sf_dir))


_U = "(CAST('0x' || substring(md5('42:' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0)"


@query("sharpness_report", _CROSS + f""", w AS (SELECT *, (high - low) / 2 AS h, -1 + 2 * {_U} AS c FROM i) SELECT event_type, count(*) AS n, round(avg((truth BETWEEN low AND high)::INT), 8) AS coverage, round(avg(high - low), 8) AS mean_width,
round(avg((high - low) + 40.0e0 * (greatest(low - truth, 0e0) + greatest(truth - high, 0e0))), 6) AS interval_score, round(avg((truth >= greatest(estimate - h, -1) AND truth <= least(estimate + h, 1))::INT), 8) AS estimate_centred, round(avg((truth >= greatest(c - h, -1) AND truth <= least(c + h, 1))::INT), 8) AS random_centred FROM w GROUP BY event_type""")
def sharpness_report(spark, sf_dir):
    out = G.sharpness(_crossfit(spark, sf_dir), ["event_type"], "id", (-1.0, 1.0))
    return out.select("event_type", "n", *(F.round(c, 8).alias(c) for c in ("coverage", "mean_width")), F.round("interval_score", 6).alias("interval_score"), *(F.round(c, 8).alias(c) for c in ("estimate_centred", "random_centred")))


_W = "(k / n + 3.841458820694124e0 / (2 * n)) / (1 + 3.841458820694124e0 / n)", "1.959963984540054e0 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124e0 / (4e0 * n * n)) / (1 + 3.841458820694124e0 / n)"
_TABLE = _CROSS + f", b AS (SELECT event_type || '|' || bin AS part, count(*) AS n, CAST(sum((truth BETWEEN low AND high)::INT) AS BIGINT) AS k, avg(high - low) AS mean_width FROM i GROUP BY 1), w AS (SELECT *, {_W[0]} - {_W[1]} AS wl, {_W[0]} + {_W[1]} AS wh, n < 20 AS descriptive FROM b)"


def _table(spark, sf_dir):
    return G.coverage_table(_crossfit(spark, sf_dir).withColumn("part", F.concat_ws("|", "event_type", "bin")), ["part"], 20)


@query("coverage_table", _TABLE + " SELECT part, n, k, round(k / n, 9) AS coverage, round(wl, 8) AS low, round(wh, 8) AS high, round(mean_width, 8) AS mean_width, descriptive FROM w")
def coverage_table(spark, sf_dir):
    return _table(spark, sf_dir).select("part", "n", "k", F.round("coverage", 9).alias("coverage"), *(F.round(c, 8).alias(c) for c in ("low", "high", "mean_width")), "descriptive")


@query("partition_gate", _TABLE + ", e AS (SELECT * FROM w WHERE NOT descriptive) SELECT count(*) AS eligible, count(CASE WHEN wl > 0.95 OR wh < 0.95 THEN 1 END) AS excluding, EXISTS (SELECT 1 FROM e a JOIN e b ON a.wh < b.wl) AS disjoint, round(max(abs(k / n - 0.95)), 9) AS max_gap, round(min(k / n), 9) AS worst, round(max(k / n), 9) AS best, EXISTS (SELECT 1 FROM e a JOIN e b ON a.wh < b.wl) AND count(CASE WHEN wl > 0.95 OR wh < 0.95 THEN 1 END) > 0 AS go FROM e")
def partition_gate(spark, sf_dir):
    return G.partition_gate(_table(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("max_gap", "worst", "best")})


_ROWS = _CAL + ", r AS (SELECT event_type, (estimate + 1) / 2 AS psi, greatest((estimate + 1) / 2 - scale / 3, 0) AS low, least((estimate + 1) / 2 + scale / 4, 1) AS high, (truth + 1) / 2 AS truth, id % 3 <> 0 AS raw, abs(estimate - truth) < 0.5 AS correct FROM cal), w AS (SELECT *, (high - low) * 1.5e0 AS width FROM r)"


@query("inflated_summary", _ROWS + " SELECT event_type, count(*) AS n, round(avg((truth >= psi - 1.5e0 * (psi - low) AND truth <= psi + 1.5e0 * (high - psi))::INT), 8) AS coverage, round(quantile_cont(width, 0.5), 8) AS median_width, count(CASE WHEN raw AND width < 0.4 THEN 1 END) AS confident, round(avg(CASE WHEN raw AND width < 0.4 THEN correct::INT END), 8) AS confident_accuracy FROM w GROUP BY event_type")
def inflated_summary(spark, sf_dir):
    rows = view(spark, sf_dir, "cal").selectExpr("event_type", "(estimate + 1) / 2 AS psi", "greatest((estimate + 1) / 2 - scale / 3, 0D) AS low", "least((estimate + 1) / 2 + scale / 4, 1D) AS high", "(truth + 1) / 2 AS truth", "id % 3 <> 0 AS raw_confident", "abs(estimate - truth) < 0.5 AS correct")
    out = G.inflated_summary(rows, ["event_type"], 1.5, F.lit(0.4))
    return out.select("event_type", "n", F.round("coverage", 8).alias("coverage"), F.round("median_width", 8).alias("median_width"), "confident", F.round("confident_accuracy", 8).alias("confident_accuracy"))


@query("detection_metrics", _S + """, c AS (SELECT grp, CAST(sum((score >= 0.6 AND label = 1)::INT) AS BIGINT) AS tp, CAST(sum((score >= 0.6 AND label = 0)::INT) AS BIGINT) AS fp, CAST(sum((score < 0.6 AND label = 1)::INT) AS BIGINT) AS fn, CAST(sum((score < 0.6 AND label = 0)::INT) AS BIGINT) AS tn FROM scored GROUP BY grp)
SELECT grp, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(fp / nullif(fp + tn, 0), 9) AS fpr FROM c""")
def detection_metrics(spark, sf_dir):
    return G.detection_metrics(view(spark, sf_dir, "scored"), ["grp"], F.col("score") >= 0.6, F.col("label") == 1).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "fpr")})


@query("method_report", _CROSS + """, m AS (SELECT *, abs(truth) > 0.3 AS pos, low > 0 OR high < 0 AS called FROM i) SELECT event_type, round(sqrt(avg((truth - estimate) * (truth - estimate))), 8) AS rmse, round(avg(CASE WHEN pos AND abs(truth) > 0.05 THEN (sign(estimate) = sign(truth))::INT END), 8) AS direction,
round(avg(CASE WHEN pos THEN called::INT END), 8) AS sensitivity, round(avg(CASE WHEN NOT pos THEN called::INT END), 8) AS fpr FROM m GROUP BY event_type""")
def method_report(spark, sf_dir):
    """Error, direction of the positives, and how often intervals of positives and negatives leave zero out."""
    rows = _crossfit(spark, sf_dir).withColumns({"pos": F.abs("truth") > 0.3, "called": C.reliable(F.struct("low", "high"))})
    d = F.col("truth") - F.col("estimate")
    rate = lambda of, where: F.round(F.avg(F.when(where, of.cast("int"))), 8)
    return rows.groupBy("event_type").agg(F.round(F.sqrt(F.avg(d * d)), 8).alias("rmse"), rate(F.sign("estimate") == F.sign("truth"), F.col("pos") & (F.abs("truth") > 0.05)).alias("direction"), rate(F.col("called"), F.col("pos")).alias("sensitivity"), rate(F.col("called"), ~F.col("pos")).alias("fpr"))


@query("pooled_coverage", _CROSS + " SELECT fold, count(*) AS n, CAST(sum((truth BETWEEN low AND high)::INT) AS BIGINT) AS k FROM i GROUP BY GROUPING SETS ((fold), ())")
def pooled_coverage(spark, sf_dir):
    """Held-out coverage of each fold and over all (null)."""
    hit = F.col("truth").between(F.col("low"), F.col("high"))
    return _crossfit(spark, sf_dir).cube("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("long")).alias("k"))


@query("two_estimators", _CAL + """, e AS (SELECT id, fold, event_type, abs(truth - estimate) AS r1, abs(truth - estimate * 0.5) AS r2 FROM cal), h AS (SELECT unnest([0, 1, 2]) AS held), c AS (SELECT held, 'a' AS m, r1 AS r FROM e, h WHERE fold <> held UNION ALL SELECT held, 'b', r2 FROM e, h WHERE fold <> held),
q AS (SELECT held, m, r AS q FROM (SELECT *, row_number() OVER (PARTITION BY held, m ORDER BY r) AS k, count(*) OVER (PARTITION BY held, m) AS n FROM c) WHERE k = CAST(ceil((n + 1) * 0.950000) AS BIGINT))
SELECT m, count(*) AS n, CAST(sum((r <= q)::INT) AS BIGINT) AS covered FROM (SELECT fold, 'a' AS m, r1 AS r FROM e UNION ALL SELECT fold, 'b', r2 FROM e) x JOIN q USING (m) WHERE fold = held GROUP BY m""")
def two_estimators(spark, sf_dir):
    """The same cross-fit half-widths for two point estimates of the same truth."""
    residual = lambda m, e: F.struct(F.lit(m).alias("m"), F.abs(F.col("truth") - e).alias("r"))
    rows = view(spark, sf_dir, "cal").select("fold", F.explode(F.array(residual("a", F.col("estimate")), residual("b", F.col("estimate") * 0.5))).alias("x")).select("fold", "x.m", "x.r")
    copies = rows.select("m", F.col("r").alias("score"), "fold", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("held")).where("fold <> held")
    q = conformal.quantiles(copies, ["held", "m"]).select(F.col("held").alias("fold"), "m", "q")
    return rows.join(q, ["fold", "m"]).groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("r") <= F.col("q")).cast("long")).alias("covered"))


@query("cluster_interval")
def cluster_interval(spark, sf_dir):
    return G.cluster_interval(_crossfit(spark, sf_dir).withColumns({"hit": F.col("truth").between(F.col("low"), F.col("high")).cast("int"), "cluster": F.col("id") % 211}), "hit", "cluster")


_APP = SCORED_SQL + ", ap AS (SELECT *, ci_high - ci_low AS ci_width, abs(dpsi) AS abs_dpsi, CASE WHEN ci_low > 0 THEN ci_low WHEN ci_high < 0 THEN ci_high ELSE 0 END AS signed_margin, (k % 100) / 100e0 AS p_large, gene IN ('G3', 'G7', 'G11') AS anchor FROM t), s AS (SELECT *, abs(signed_margin) * p_large AS score FROM ap)"


def _application(spark, sf_dir):
    """margin is the distance of the interval from zero, below zero where it holds zero: from center and half-width, as the interval's
    expression would stand in it many times."""
    margin = F.least(F.abs("dpsi") - F.hypot(F.col("q"), C.Z95 * F.col("sd")), F.lit(1.0))
    rows = scored(spark, sf_dir).withColumns({"p_large": F.col("k") % 100 / 100, "anchor": F.col("gene").isin("G3", "G7", "G11"), "margin": margin})
    return rows.withColumn("score", F.greatest("margin", F.lit(0.0)) * F.col("p_large"))


def _candidates(spark, sf_dir):
    """Rows of the tier high-confidence (an interval apart from zero has a margin above it), without anchors."""
    return _application(spark, sf_dir).where("margin > 0 and effect and coalesce(sig, true) and not anchor")


@query("application_columns", _APP + " SELECT event_id, round(ci_width, 9) AS ci_width, round(abs_dpsi, 9) AS abs_dpsi, round(signed_margin, 9) AS signed_margin, round(score, 9) AS score, anchor FROM s")
def application_columns(spark, sf_dir):
    rows = _application(spark, sf_dir).withColumn("ci_width", F.col("ci.high") - F.col("ci.low"))
    signed = F.sign("dpsi") * F.greatest("margin", F.lit(0.0))
    return rows.select("event_id", F.round("ci_width", 9).alias("ci_width"), F.round(F.abs("dpsi"), 9).alias("abs_dpsi"), F.round(signed + 0.0, 9).alias("signed_margin"), F.round("score", 9).alias("score"), "anchor")


@query("top_candidates", _APP + " SELECT event_id, gene, round(score, 9) AS score, support FROM s WHERE tier = 'high-confidence' AND NOT anchor AND fdr < 0.5 ORDER BY round(score, 9) DESC, p_large DESC, support DESC, k LIMIT 100")
def top_candidates(spark, sf_dir):
    good = _candidates(spark, sf_dir).where("fdr < 0.5").withColumn("score", F.round("score", 9))
    return good.orderBy(F.desc("score"), F.desc("p_large"), F.desc("support"), "k").limit(100).select("event_id", "gene", "score", "support")


@query("candidate_gene_table", _APP + ", g AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY round(score, 9) DESC, p_large DESC, support DESC, k) AS r FROM s WHERE tier = 'high-confidence' AND NOT anchor) SELECT gene, max(CASE WHEN r = 1 THEN event_id END) AS event_id, round(max(score), 9) AS max_score, round(max(abs_dpsi), 9) AS max_abs_dpsi, round(max(CASE WHEN r = 1 THEN dpsi END), 9) AS best_dpsi, min(fdr) AS min_fdr, max(support) AS max_support, count(*) AS events FROM g GROUP BY gene ORDER BY max_score DESC, max_support DESC, gene LIMIT 30")
def candidate_gene_table(spark, sf_dir):
    good = _candidates(spark, sf_dir).select("gene", "event_id", "k", "support", "fdr", "p_large", "dpsi", "score", F.abs("dpsi").alias("abs_dpsi"))
    first = F.struct(F.round("score", 9).alias("a"), "p_large", "support", (-F.col("k")).alias("b"))
    out = good.groupBy("gene").agg(F.max_by("event_id", first).alias("event_id"), F.round(F.max("score"), 9).alias("max_score"), F.round(F.max("abs_dpsi"), 9).alias("max_abs_dpsi"), F.round(F.max_by("dpsi", first), 9).alias("best_dpsi"), F.min("fdr").alias("min_fdr"), F.max("support").alias("max_support"), F.count(F.lit(1)).alias("events"))
    return out.orderBy(F.desc("max_score"), F.desc("max_support"), "gene").limit(30)


_BAND = "CASE WHEN support < 50 THEN '<50' WHEN support < 100 THEN '50-99' WHEN support < 250 THEN '100-249' ELSE '250+' END"


@query("summary_by_type_and_support", _CROSS + f", m AS (SELECT *, {_BAND} AS band, truth BETWEEN low AND high AS hit, high - low AS width FROM i) SELECT event_type, band, count(*) AS n, round(avg(hit::INT), 8) AS coverage, round(quantile_cont(width, 0.5), 8) AS median_width, round(corr(estimate, truth), 6) AS r, round(avg(abs(estimate - truth)), 8) AS mae FROM m GROUP BY GROUPING SETS ((), (event_type), (band))")
def summary_by_type_and_support(spark, sf_dir):
    rows = _crossfit(spark, sf_dir).withColumns({"band": F.expr(_BAND), "hit": F.col("truth").between(F.col("low"), F.col("high")).cast("int"), "width": F.col("high") - F.col("low")})
    return rows.groupingSets([[], [F.col("event_type")], [F.col("band")]], "event_type", "band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 8).alias("coverage"), F.round(F.percentile("width", F.lit(0.5)), 8).alias("median_width"), F.round(F.corr("estimate", "truth"), 6).alias("r"), F.round(F.avg(F.abs(F.col("estimate") - F.col("truth"))), 8).alias("mae"))


@query("stage_summary", SCORED_SQL + " SELECT gene, count(*) AS events, CAST(sum(support) AS BIGINT) AS support, count(CASE WHEN tier = 'high-confidence' THEN 1 END) AS kept, count(CASE WHEN NOT reliable THEN 1 END) AS unreliable, count(CASE WHEN NOT effect THEN 1 END) AS small FROM t GROUP BY gene")
def stage_summary(spark, sf_dir):
    """Counts by locus of what each stage let through and why the rest went."""
    n = lambda c: F.count(F.when(c, 1))
    return scored(spark, sf_dir).groupBy("gene").agg(F.count(F.lit(1)).alias("events"), F.sum("support").alias("support"), n(F.col("tier") == "high-confidence").alias("kept"), n(~F.col("reliable")).alias("unreliable"), n(~F.col("effect")).alias("small"))


@query("summary_table", _T + " SELECT gene_id, count(*) FILTER (tx % 3 = 0) AS n_a, count(*) FILTER (tx % 3 = 1) AS n_b, count(*) FILTER (tx % 3 = 2) AS n_c, CAST(sum(cov) FILTER (tx % 3 = 0) AS BIGINT) AS cov_a, CAST(sum(cov) FILTER (tx % 3 = 1) AS BIGINT) AS cov_b, CAST(sum(cov) FILTER (tx % 3 = 2) AS BIGINT) AS cov_c, (count(*) FILTER (tx % 3 = 0) > 0)::INT + (count(*) FILTER (tx % 3 = 1) > 0)::INT + (count(*) FILTER (tx % 3 = 2) > 0)::INT AS detected FROM t GROUP BY gene_id")
def summary_table(spark, sf_dir):
    """One row a gene with the columns of each sample side by side."""
    sample = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("tx") % 3 + 1).cast("int"))
    wide = _transcripts(spark, sf_dir).withColumn("sample", sample).groupBy("gene_id").pivot("sample", ["a", "b", "c"]).agg(F.count(F.lit(1)).alias("n"), F.sum("cov").alias("cov"))
    named = wide.select("gene_id", *(F.coalesce(f"{x}_n", F.lit(0)).alias(f"n_{x}") for x in "abc"), *(F.col(f"{x}_cov").alias(f"cov_{x}") for x in "abc"))
    return named.withColumn("detected", sum(((F.col(f"n_{x}") > 0).cast("int") for x in "bc"), (F.col("n_a") > 0).cast("int")))


@query("effective_replicates", _EV + " SELECT event_type, min(least(1 + k % 4, 1 + k % 3)) AS replicates FROM ev GROUP BY event_type")
def effective_replicates(spark, sf_dir):
    """The least number of replicates that both count vectors of any event have."""
    rows = view(spark, sf_dir, "ev").select("event_type", F.array_repeat("inc1", (1 + F.col("k") % 4).cast("int")).alias("inc"), F.array_repeat("exc1", (1 + F.col("k") % 3).cast("int")).alias("exc"))
    return rows.groupBy("event_type").agg(F.min(F.least(F.size("inc"), F.size("exc"))).cast("long").alias("replicates"))


@query("refined_boundaries", sql("iv") + ", b AS (SELECT chrom, s // 50 AS p, count(*) AS n FROM iv GROUP BY 1, 2), t AS (SELECT id, chrom, s // 50 AS mid FROM iv), m AS (SELECT t.id, b.p, b.n, row_number() OVER (PARTITION BY t.id ORDER BY b.n DESC, b.p) AS r FROM t JOIN b ON b.chrom = t.chrom AND b.p BETWEEN mid - 2 AND mid + 2) SELECT id, p FROM m WHERE r = 1")
def refined_boundaries(spark, sf_dir):
    """Each start moved to the bin with most starts within two bins: an equi join on the five bins it can reach."""
    rows = view(spark, sf_dir, "iv")
    bins = rows.groupBy("chrom", F.expr("s div 50").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    reach = rows.select("id", "chrom", F.explode(F.expr("sequence(s div 50 - 2, s div 50 + 2)")).alias("p"))
    return reach.join(bins, ["chrom", "p"]).groupBy("id").agg(F.max_by("p", F.struct("n", (-F.col("p")).alias("b"))).alias("p"))


_NULL = f"{_CAL}, r AS (SELECT CASE WHEN support >= 250 THEN '250+' WHEN support >= 100 THEN '100-249' WHEN support >= 50 THEN '50-99' WHEN support >= 20 THEN '20-49' ELSE '<20' END AS bin, abs(estimate) AS v FROM cal)"
_HIGHER = "CAST(ceil((n - 1) * 0.95) AS BIGINT) + 1"


@query("pooled_null_thresholds", _NULL + f""", b AS (SELECT bin, v, row_number() OVER (PARTITION BY bin ORDER BY v) AS k, count(*) OVER (PARTITION BY bin) AS n FROM r), p AS (SELECT v, row_number() OVER (ORDER BY v) AS k, count(*) OVER () AS n FROM r)
SELECT bin, n, n < 200 AS pooled, round(greatest(0.1, CASE WHEN n < 200 THEN (SELECT v FROM p WHERE k = {_HIGHER}) ELSE v END), 9) AS threshold FROM b WHERE k = {_HIGHER}""")
def pooled_null_thresholds(spark, sf_dir):
    rows = view(spark, sf_dir, "cal").select(C.support_bin(F.col("support")).alias("bin"), F.abs("estimate").alias("v"))
    return G.null_thresholds(rows, "bin", "v", 0.05, 200, 0.1).withColumn("threshold", F.round("threshold", 9))
