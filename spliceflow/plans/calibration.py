"""Queries of the calibration layer over two-group event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceflow.functions import calibration as C
from spliceflow.plans.domain import sql, view
from spliceflow.plans.registry import query

_BIN = "CASE WHEN {0} >= 250 THEN '250+' WHEN {0} >= 100 THEN '100-249' WHEN {0} >= 50 THEN '50-99' WHEN {0} >= 20 THEN '20-49' ELSE '<20' END"
_TOTAL = "(inc1 + exc1 + inc2 + exc2)"
_VAR = "((i + 0.5e0) * (e + 0.5e0) / ((i + 0.5e0 + e + 0.5e0) * (i + 0.5e0 + e + 0.5e0) * (i + 0.5e0 + e + 0.5e0 + 1.0e0)))"
_VAR1, _VAR2 = (_VAR.replace("i +", f"inc{g} +").replace("e +", f"exc{g} * len_ratio +") for g in (1, 2))
_Q = "coalesce(" + f"CASE {_BIN.format(_TOTAL)} " + " ".join(f"WHEN '{k}' THEN {v!r}e0" for k, v in C.DPSI_Q.items()) + f" END, {C.DPSI_Q_GLOBAL!r}e0)"
_D = "((inc1 + 0.5e0) / (inc1 + exc1 * len_ratio + 1.0e0) - (inc2 + 0.5e0) / (inc2 + exc2 * len_ratio + 1.0e0))"

#: Events scored: mean and deviation of the change, quantile, interval, flags and tier.
SCORED_SQL = f"""{sql("ev")},
a AS (SELECT *, {_TOTAL} AS support, {_BIN.format(_TOTAL)} AS bin, {_D} AS dpsi, sqrt({_VAR1} + {_VAR2}) AS sd, {_Q} AS q FROM ev WHERE inc1 + exc1 >= 5 AND inc2 + exc2 >= 5),
b AS (SELECT *, sqrt(q * q + ({C.Z95!r}e0 * sd) * ({C.Z95!r}e0 * sd)) AS half FROM a),
c AS (SELECT *, least(greatest(dpsi - half, -1.0e0), 1.0e0) AS ci_low, least(greatest(dpsi + half, -1.0e0), 1.0e0) AS ci_high FROM b),
d AS (SELECT *, (ci_low > 0 OR ci_high < 0) AS reliable, abs(dpsi) >= 0.1 AS effect, fdr < 0.05 AS sig FROM c),
t AS (SELECT *, CASE WHEN reliable AND effect AND coalesce(sig, true) THEN 'high-confidence' WHEN reliable AND effect THEN 'supported' WHEN sig THEN 'caller-significant-only'
  WHEN sig IS NULL AND NOT reliable THEN 'not-reliable' ELSE 'not-significant' END AS tier FROM d)
"""


def scored(spark: SparkSession, sf_dir: str, min_support: int = 5, effect_cutoff: float = 0.1) -> DataFrame:
    """Two-group events with at least min_support reads in each group, calibrated: one pass, no shuffle beyond the counts'."""
    ev = view(spark, sf_dir, "ev").where(f"inc1 + exc1 >= {min_support} AND inc2 + exc2 >= {min_support}")
    e1, e2 = F.col("exc1") * F.col("len_ratio"), F.col("exc2") * F.col("len_ratio")
    rows = ev.withColumn("support", F.expr("inc1 + exc1 + inc2 + exc2")).withColumn("bin", C.support_bin(F.col("support")))
    rows = rows.withColumns({"dpsi": C.beta_mean(F.col("inc1"), e1) - C.beta_mean(F.col("inc2"), e2), "sd": C.beta_dpsi_std(F.col("inc1"), e1, F.col("inc2"), e2), "q": C.quantile_for(C.SHIPPED_DPSI, F.col("support"))})
    rows = rows.withColumn("ci", C.robust_interval(F.col("dpsi"), F.col("sd"), F.col("q")))
    rows = rows.withColumns({"reliable": C.reliable(F.col("ci")), "effect": F.abs("dpsi") >= effect_cutoff, "sig": C.caller_significant(F.col("fdr"), F.lit(None).cast("double"))})
    return rows.withColumn("tier", C.tier(F.col("reliable"), F.col("effect"), F.col("sig")))


def _r(*names: str) -> list:
    return [F.round(n, 9).alias(n) for n in names]


@query("support_bins", f"{sql('ev')} SELECT event_id, {_TOTAL} AS support, {_BIN.format(_TOTAL)} AS bin FROM ev")
def support_bins(spark, sf_dir):
    total = F.expr("inc1 + exc1 + inc2 + exc2")
    return view(spark, sf_dir, "ev").select("event_id", total.alias("support"), C.support_bin(total).alias("bin"))


@query("beta_dpsi_std", SCORED_SQL + "SELECT event_id, round(dpsi, 9) AS dpsi, round(sd, 9) AS sd FROM t")
def beta_dpsi_std(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", *_r("dpsi", "sd"))


@query("psi_length_normalized", f"{sql('ev')} SELECT event_id, round(CASE WHEN inc1 + exc1 * len_ratio > 0 THEN inc1 / (inc1 + exc1 * len_ratio) END, 9) AS psi1, round(CASE WHEN inc2 + exc2 * len_ratio > 0 THEN inc2 / (inc2 + exc2 * len_ratio) END, 9) AS psi2 FROM ev")
def psi_length_normalized(spark, sf_dir):
    ratio = F.col("len_ratio")
    return view(spark, sf_dir, "ev").select("event_id", F.round(C.psi(F.col("inc1"), F.col("exc1"), ratio), 9).alias("psi1"), F.round(C.psi(F.col("inc2"), F.col("exc2"), ratio), 9).alias("psi2"))


_CASCADE = C.Calibrator(0.31, {"<20": 0.4, "100-249": 0.29}, {"RI": 0.36, "MXE": 0.33}, {"SE|250+": 0.27, "RI|<20": 0.5})


@query("q_cascade", f"""{sql('ev')}, b AS (SELECT event_id, event_type, {_BIN.format(_TOTAL)} AS bin FROM ev)
SELECT event_id, event_type, bin, coalesce(CASE event_type || '|' || bin WHEN 'SE|250+' THEN 0.27e0 WHEN 'RI|<20' THEN 0.5e0 END, CASE event_type WHEN 'RI' THEN 0.36e0 WHEN 'MXE' THEN 0.33e0 END, CASE bin WHEN '<20' THEN 0.4e0 WHEN '100-249' THEN 0.29e0 END, 0.31e0) AS q FROM b""")
def q_cascade(spark, sf_dir):
    total = F.expr("inc1 + exc1 + inc2 + exc2")
    return view(spark, sf_dir, "ev").select("event_id", "event_type", C.support_bin(total).alias("bin"), C.quantile_for(_CASCADE, total, F.col("event_type")).alias("q"))


@query("plain_interval", SCORED_SQL + "SELECT event_id, round(least(greatest(dpsi - q, -1.0e0), 1.0e0), 9) AS ci_low, round(least(greatest(dpsi + q, -1.0e0), 1.0e0), 9) AS ci_high FROM t")
def plain_interval(spark, sf_dir):
    ci = C.plain_interval(F.col("dpsi"), F.lit(1.0), F.col("q"), -1.0, 1.0)
    return scored(spark, sf_dir).select("event_id", F.round(ci["low"], 9).alias("ci_low"), F.round(ci["high"], 9).alias("ci_high"))


@query("robust_interval", SCORED_SQL + "SELECT event_id, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM t")
def robust_interval(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", F.round("ci.low", 9).alias("ci_low"), F.round("ci.high", 9).alias("ci_high"))


@query("confidence_tiers", SCORED_SQL + "SELECT event_id, event_type, gene, support, bin, round(dpsi, 9) AS dpsi, reliable, effect, sig, tier FROM t")
def confidence_tiers(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", "event_type", "gene", "support", "bin", *_r("dpsi"), "reliable", "effect", "sig", "tier")


@query("tier_counts", SCORED_SQL + "SELECT tier, count(*) AS n FROM t GROUP BY tier")
def tier_counts(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


_MARGIN = "CASE WHEN ci_low > 0 THEN ci_low WHEN ci_high < 0 THEN -ci_high ELSE -1.0e0 END"


@query("filter_ranked", SCORED_SQL + f"SELECT event_id, tier, round({_MARGIN}, 9) AS margin FROM t ORDER BY {_MARGIN} DESC, k LIMIT 50")
def filter_ranked(spark, sf_dir):
    """Top-50 report: a bounded sort in each task, then one merge."""
    margin = C.margin(F.col("ci"))
    return scored(spark, sf_dir).withColumn("m", margin).orderBy(F.desc("m"), "k").limit(50).select("event_id", "tier", F.round("m", 9).alias("margin"))


@query("flip_sign", SCORED_SQL + "SELECT event_id, round(0 - dpsi, 9) AS dpsi, round(0 - ci_high, 9) AS ci_low, round(0 - ci_low, 9) AS ci_high FROM t")
def flip_sign(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", F.round(0 - F.col("dpsi"), 9).alias("dpsi"), F.round(0 - F.col("ci.high"), 9).alias("ci_low"), F.round(0 - F.col("ci.low"), 9).alias("ci_high"))


@query("swap_groups", SCORED_SQL + f"SELECT event_id, inc2 AS inc1, exc2 AS exc1, inc1 AS inc2, exc1 AS exc2, round(0 - dpsi, 9) AS dpsi FROM t")
def swap_groups(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", F.col("inc2").alias("inc1"), F.col("exc2").alias("exc1"), F.col("inc1").alias("inc2"), F.col("exc1").alias("exc2"), F.round(0 - F.col("dpsi"), 9).alias("dpsi"))


@query("shift_check", f"{sql('ev')} SELECT quantile_cont({_TOTAL}, 0.5) AS median_support, NOT quantile_cont({_TOTAL}, 0.5) < 0.5 * {C.DPSI_SUPPORT_MEDIAN!r} AS ok FROM ev")
def shift_check(spark, sf_dir):
    one = view(spark, sf_dir, "ev").agg(F.percentile(F.expr("inc1 + exc1 + inc2 + exc2"), F.lit(0.5)).alias("median_support"))
    return one.select("median_support", (~(F.col("median_support") < 0.5 * C.DPSI_SUPPORT_MEDIAN)).alias("ok"))


def _case(key: str, table: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}e0" for k, v in table.items()) + " END"


_NATIVE = "event_type IN ('A3SS', 'A5SS')"
_STEPS = "CASE WHEN n < 20 THEN 0.85e0 WHEN n < 50 THEN 1.0e0 WHEN n < 100 THEN 1.2e0 WHEN n < 200 THEN 1.5e0 ELSE 1.75e0 END"


@query("count_scale", f"""{sql('ev')}, b AS (SELECT event_id, event_type, inc1 + exc1 AS n, {_BIN.format('(inc1 + exc1)')} AS bin FROM ev),
c AS (SELECT *, {_case('bin', C.AUDIT_FACTORS)} AS audit FROM b)
SELECT event_id, round(CASE WHEN {_NATIVE} THEN least(1.0e0, 0.01e0 / (audit * audit)) ELSE least(1.0e0, 0.01e0 * {_case('event_type', C.TYPE_FACTORS)} * {_STEPS}) END, 9) AS scale FROM c""")
def count_scale(spark, sf_dir):
    return view(spark, sf_dir, "ev").select("event_id", F.round(C.count_scale(F.expr("inc1 + exc1"), F.col("event_type")), 9).alias("scale"))


@query("inflation", f"""{sql('ev')}, b AS (SELECT event_id, event_type, {_BIN.format('(inc1 + exc1)')} AS bin FROM ev)
SELECT event_id, CASE WHEN {_NATIVE} THEN {_case('bin', C.INFLATION_FACTORS)} ELSE 1.0e0 END AS factor, CASE WHEN {_NATIVE} AND bin = '250+' THEN 0.6e0 ELSE 0.2e0 END AS width_threshold FROM b""")
def inflation(spark, sf_dir):
    n = F.expr("inc1 + exc1")
    return view(spark, sf_dir, "ev").select("event_id", C.inflation(n, F.col("event_type")).alias("factor"), C.width_threshold(n, F.col("event_type")).alias("width_threshold"))


@query("confident_psi", f"""{sql('ev')}, a AS (SELECT event_id, event_type, inc1 + exc1 AS n, (inc1 + 0.5e0) / (inc1 + exc1 + 1.0e0) AS p, sqrt((inc1 + 0.5e0) * (exc1 + 0.5e0) / ((inc1 + 0.5e0 + exc1 + 0.5e0) * (inc1 + 0.5e0 + exc1 + 0.5e0) * (inc1 + 0.5e0 + exc1 + 0.5e0 + 1.0e0))) AS sd FROM ev),
b AS (SELECT *, {_BIN.format('n')} AS bin FROM a), c AS (SELECT *, {_case('bin', C.PSI_Q)} AS q FROM b),
d AS (SELECT *, least(greatest(p - q * sd, 0.0e0), 1.0e0) AS lo, least(greatest(p + q * sd, 0.0e0), 1.0e0) AS hi FROM c)
SELECT event_id, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high, hi - lo < (CASE WHEN {_NATIVE} AND bin = '250+' THEN 0.6e0 ELSE 0.2e0 END) AND sd / p <= 0.5 AS confident FROM d""")
def confident_psi(spark, sf_dir):
    n = F.expr("inc1 + exc1")
    p, sd = C.beta_mean(F.col("inc1"), F.col("exc1")), F.sqrt(C.beta_variance(F.col("inc1"), F.col("exc1")))
    rows = view(spark, sf_dir, "ev").withColumn("ci", C.plain_interval(p, sd, C.quantile_for(C.SHIPPED_PSI, n)))
    return rows.select("event_id", F.round("ci.low", 9).alias("ci_low"), F.round("ci.high", 9).alias("ci_high"), C.confident(F.col("ci"), sd / p, n, F.col("event_type")).alias("confident"))


@query("differential_report", SCORED_SQL + """SELECT event_type, tier, count(*) AS n, count(DISTINCT gene) AS genes, CAST(sum(support) AS BIGINT) AS support, quantile_cont(support, 0.5) AS median_support FROM t GROUP BY event_type, tier""")
def differential_report(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("event_type", "tier").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("gene").alias("genes"), F.sum("support").alias("support"), F.percentile("support", F.lit(0.5)).alias("median_support"))
