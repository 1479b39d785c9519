"""Queries of hand-set and trained scores, threshold searches and junction proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from spliceflow.functions import calibration as C
from spliceflow.functions import scoring as S
from spliceflow.operators import events, gates, learning
from spliceflow.plans.domain import sql, view
from spliceflow.plans.registry import query

_IV, _EV, _CAL = sql("iv"), sql("ev"), sql("cal")


@query("junction_score", _IV + " SELECT id, round(1 / (1 + exp(-(ln(1 + id % 50) * 0.35 + (id % 11) / 10e0 * 0.25 + (id % 2) * 0.15 + (id % 3 = 0)::INT * 0.15 + greatest(0, 1 - ln(1 + e - s) / 15) * 0.10 - 0.5))), 8) AS score FROM iv")
def junction_score(spark, sf_dir):
    rows = view(spark, sf_dir, "iv")
    return rows.select("id", F.round(S.junction_score(F.col("id") % 50, F.col("e") - F.col("s"), F.col("id") % 11 / 10, F.col("id") % 2, (F.col("id") % 3 == 0).cast("int")), 8).alias("score"))


_TX = """, f AS (SELECT id, (id % 13) / 12e0 AS u, id % 7 AS nj, (id % 9) / 6e0 AS jr, id % 2 AS weak, (id % 10) / 9e0 AS ef, id % 80 + 1 AS ne, (e - s) * 3 AS len, (id % 17) / 16e0 AS sh, id % 41 AS cov, id % 2 AS safe, (id % 5) / 4e0 AS sf FROM iv)"""


@query("transcript_score", _IV + _TX + """ SELECT id, round(0.30 * u + 0.25 * CASE WHEN nj > 0 THEN exp(-0.5 * ((jr - 1) / 0.5) * ((jr - 1) / 0.5)) * CASE WHEN weak > 0.5 THEN 0.7 ELSE 1 END ELSE 0.5 END + 0.20 * ef * CASE WHEN ne > 50 THEN 50e0 / ne ELSE 1 END * CASE WHEN len < 200 THEN len / 200e0 ELSE 1 END
+ 0.15 * (0.5 * least(1, sh * 2) + 0.5 / (1 + exp(-(ln(1 + cov) - 2.5)))) + 0.10 * (0.6 * safe + 0.4 * sf), 8) AS score FROM f""")
def transcript_score(spark, sf_dir):
    i = F.col("id")
    rows = view(spark, sf_dir, "iv")
    return rows.select("id", F.round(S.transcript_score(i % 13 / 12, i % 7, i % 9 / 6, i % 2, i % 10 / 9, i % 80 + 1, (F.col("e") - F.col("s")) * 3, i % 17 / 16, i % 41, i % 2, i % 5 / 4), 8).alias("score"))


@query("path_plausibility", _IV + " SELECT id, round(least(1, least((id % 9) / 5e0, 1) * 0.2 + (id % 13) / 12e0 * 0.3 + greatest(0, 1 - (id % 20) / 10e0) * 0.2 + (id % 6) / 5e0 * 0.3), 8) AS score FROM iv")
def path_plausibility(spark, sf_dir):
    i = F.col("id")
    return view(spark, sf_dir, "iv").select("id", F.round(S.path_plausibility(i % 9, i % 13 / 12, i % 20 / 10, i % 6 / 5), 8).alias("score"))


@query("beta_summary", _EV + " SELECT event_id, round((inc1 + 1e0) / (inc1 + exc1 + 2), 9) AS mean, round(CASE WHEN inc1 > 0 AND exc1 > 0 THEN inc1 / greatest(CAST(inc1 + exc1 AS DOUBLE), 1e-10) ELSE (inc1 + 1e0) / (inc1 + exc1 + 2) END, 9) AS mode, round(sqrt((inc1 + 1e0) * (exc1 + 1e0) / ((inc1 + exc1 + 2e0) * (inc1 + exc1 + 2e0) * (inc1 + exc1 + 3e0))), 9) AS sd FROM ev")
def beta_summary(spark, sf_dir):
    b = S.beta_summary(F.col("inc1"), F.col("exc1"))
    return view(spark, sf_dir, "ev").select("event_id", *(F.round(b[c], 9).alias(c) for c in ("mean", "mode", "sd")))


_NEED = ", r AS (SELECT id, event_type, scale, truth, estimate - scale / 2 AS lo, estimate + scale AS hi, estimate FROM cal), q AS (SELECT *, CASE WHEN truth < lo THEN greatest(1, abs(estimate - truth) / greatest(abs(estimate - lo), 1e-9)) WHEN truth > hi THEN greatest(1, abs(truth - estimate) / greatest(abs(hi - estimate), 1e-9)) ELSE 1e0 END AS need FROM r)"


def _need(spark, sf_dir):
    rows = view(spark, sf_dir, "cal").withColumns({"lo": F.col("estimate") - F.col("scale") / 2, "hi": F.col("estimate") + F.col("scale")})
    return rows.withColumn("need", S.required_inflation(F.col("estimate"), F.col("lo"), F.col("hi"), F.col("truth")))


@query("required_inflation", _CAL + _NEED + " SELECT id, round(need, 8) AS need FROM q")
def required_inflation(spark, sf_dir):
    return _need(spark, sf_dir).select("id", F.round("need", 8).alias("need"))


@query("calibration_factor", _CAL + _NEED + ", k AS (SELECT event_type, need, row_number() OVER (PARTITION BY event_type ORDER BY need) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM q) SELECT event_type, n, round(greatest(1, need), 8) AS factor FROM k WHERE r = greatest(CAST(ceil(n * 0.95) AS BIGINT), 1)")
def calibration_factor(spark, sf_dir):
    return gates.calibration_factor(_need(spark, sf_dir), ["event_type"], "need", 0.95).select("event_type", "n", F.round("factor", 8).alias("factor"))


@query("width_gate", _CAL + ", w AS (SELECT event_type, support AS v, count(*) AS n, sum((abs(truth - estimate) <= 0.8)::INT) AS k FROM cal GROUP BY 1, 2), c AS (SELECT event_type, v, sum(n) OVER o AS rn, sum(k) OVER o AS rk FROM w WINDOW o AS (PARTITION BY event_type ORDER BY v)) SELECT event_type, max(v) AS threshold FROM c WHERE rn >= 20 AND rk >= 0.65 * rn GROUP BY event_type")
def width_gate(spark, sf_dir):
    rows = view(spark, sf_dir, "cal").withColumn("ok", F.abs(F.col("truth") - F.col("estimate")) <= 0.8)
    return gates.largest_threshold(rows, ["event_type"], "support", "ok", 0.65, 20)


_JN = sql("exons") + ", x AS (SELECT *, lead(s) OVER (PARTITION BY tx ORDER BY s) AS ds FROM exons), j AS (SELECT e AS js, ds AS je, count(*) AS cnt FROM x WHERE ds IS NOT NULL GROUP BY 1, 2)"


def _junctions(spark, sf_dir):
    return events.introns(events.with_neighbours(view(spark, sf_dir, "exons"))).groupBy("chrom", "js", "je").agg(F.count(F.lit(1)).alias("count"))


@query("grouped_junctions", _JN + ", d AS (SELECT 'A3SS' AS event_type, js, je, cnt, count(*) OVER (PARTITION BY js) AS k, sum(cnt) OVER (PARTITION BY js) - cnt AS o FROM j UNION ALL SELECT 'A5SS', js, je, cnt, count(*) OVER (PARTITION BY je), sum(cnt) OVER (PARTITION BY je) - cnt FROM j) SELECT event_type, js, je, CAST(o AS BIGINT) AS others FROM d WHERE k >= 2")
def grouped_junctions(spark, sf_dir):
    return gates.grouped_junctions(_junctions(spark, sf_dir)).select("event_type", "js", "je", "others")


@query("merge_evidence", _EV + ", m AS (SELECT gene, 'exc' AS k, sum(exc1 + exc2) AS v FROM ev GROUP BY gene UNION ALL SELECT gene, 'inc', sum(inc1 + inc2) FROM ev GROUP BY gene) SELECT gene, string_agg(k || '=' || CAST(v AS BIGINT), ',' ORDER BY k) AS evidence FROM m GROUP BY gene")
def merge_evidence(spark, sf_dir):
    rows = view(spark, sf_dir, "ev").select("gene", F.create_map(F.lit("inc"), F.expr("inc1 + inc2"), F.lit("exc"), F.expr("exc1 + exc2")).alias("evidence"))
    merged = gates.merge_evidence(rows, ["gene"], "evidence")
    return merged.select("gene", F.array_join(F.transform(F.map_entries("evidence"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("evidence"))


@query("event_table", _EV + ", p AS (SELECT event_id, event_type, gene, inc1 + exc1 AS reads, CASE WHEN inc1 + exc1 > 0 THEN inc1 / (inc1 + exc1) END AS psi FROM ev) SELECT event_id FROM p WHERE event_type IN ('SE', 'RI') AND (psi IS NULL OR psi BETWEEN 0.2 AND 0.9) AND reads >= 10 AND contains(lower(gene), 'g1')")
def event_table(spark, sf_dir):
    rows = view(spark, sf_dir, "ev").select("event_id", "event_type", "gene", F.expr("inc1 + exc1").alias("reads"), C.psi(F.col("inc1"), F.col("exc1")).alias("psi"))
    return gates.event_table(rows, ["SE", "RI"], 0.2, 0.9, 10, "G1").select("event_id")


@query("gene_list", _EV + " SELECT DISTINCT gene FROM ev WHERE gene IS NOT NULL")
def gene_list(spark, sf_dir):
    return view(spark, sf_dir, "ev").select("gene").where("gene is not null").distinct()


_NEARBY = _IV.replace("WITH ", "WITH RECURSIVE ", 1) + """, r AS (SELECT CAST(chrom AS BIGINT) AS locus, s AS js, e AS je, id % 50 AS cnt, id FROM iv),
ja AS MATERIALIZED (SELECT locus, je, coalesce(je - lag(je) OVER (PARTITION BY locus ORDER BY je) > 20, true) AS begins FROM (SELECT DISTINCT locus, je FROM r)), jn AS MATERIALIZED (SELECT a.locus, a.je, min(b.je) AS nx FROM ja a JOIN ja b ON a.locus = b.locus AND b.je > a.je + 20 AND b.je <= a.je + 500 GROUP BY 1, 2), jk AS MATERIALIZED (SELECT jn.* FROM jn JOIN ja ON ja.locus = jn.locus AND ja.je = nx AND NOT begins),
wa AS (SELECT locus, je AS c FROM ja WHERE begins UNION ALL SELECT wa.locus, nx FROM wa JOIN jk ON wa.locus = jk.locus AND wa.c = jk.je),
p AS (SELECT r.*, m.c FROM r JOIN (SELECT ja.locus, je, max(c) AS c FROM ja JOIN wa ON ja.locus = wa.locus AND c <= je AND c >= je - 20 GROUP BY 1, 2) m USING (locus, je)),
da AS MATERIALIZED (SELECT DISTINCT locus, c, js FROM p), dn AS MATERIALIZED (SELECT a.locus, a.c, a.js, min(b.js) AS nx FROM da a JOIN da b ON a.locus = b.locus AND a.c = b.c AND b.js > a.js + 20 GROUP BY 1, 2, 3),
wd AS (SELECT locus, c, min(js) AS d FROM da GROUP BY locus, c UNION ALL SELECT wd.locus, wd.c, nx FROM wd JOIN dn ON wd.locus = dn.locus AND wd.c = dn.c AND wd.d = dn.js),
q AS (SELECT p.*, m.d FROM p JOIN (SELECT da.locus, da.c, js, max(d) AS d FROM da JOIN wd ON da.locus = wd.locus AND da.c = wd.c AND d <= js GROUP BY 1, 2, 3) m USING (locus, c, js)),
k AS (SELECT *, row_number() OVER (PARTITION BY locus, c, d ORDER BY cnt DESC, js, je) AS nth FROM q)
SELECT locus, js, je, cnt AS "count" FROM k WHERE nth = 1"""


@query("merge_nearby", _NEARBY)
def merge_nearby(spark, sf_dir):
    rows = view(spark, sf_dir, "iv").selectExpr("cast(chrom as bigint) AS locus", "s AS js", "e AS je", "id % 50 AS count")
    return gates.merge_nearby(rows)


@query("forest_score")
def forest_score(spark, sf_dir):
    rows = view(spark, sf_dir, "ev").selectExpr("event_id", "cast(inc1 as double) AS a", "cast(exc1 as double) AS b", "cast(inc2 as double) AS c", "cast(coalesce(fdr, 1) < 0.3 as int) AS label")
    return learning.score(learning.train(rows, ["a", "b", "c"], "label", trees=10, depth=4), rows).select("event_id", "score")
