"""Queries of draws and graph searches. Draws and searches have no SQL; tests hold them against moments and exhaustive search."""

from __future__ import annotations

from pyspark.sql import functions as F

from spliceflow.functions import calibration as C
from spliceflow.functions import special
from spliceflow.operators import events, flows, graph, posterior
from spliceflow.operators.tables import written
from spliceflow.plans.domain import sql, view
from spliceflow.plans.registry import query


@query("psi_bootstrap")
def psi_bootstrap(spark, sf_dir):
    n = F.expr("inc1 + exc1")
    rows = view(spark, sf_dir, "ev").select("event_id", F.col("inc1").alias("inc"), F.col("exc1").alias("exc"), F.col("len_ratio").alias("ratio"), C.count_scale(n, F.col("event_type")).alias("scale"), C.inflation(n, F.col("event_type")).alias("inflation"))
    return posterior.psi_posterior(rows)


@query("dpsi_posterior")
def dpsi_posterior(spark, sf_dir):
    """Counts dealt to three replicates, the last one empty for some events."""
    thirds = lambda c: F.expr(f"array({c} - {c} div 2, {c} div 2, CASE WHEN k % 4 = 0 THEN 0 ELSE {c} div 3 END)")
    rows = view(spark, sf_dir, "ev").where("inc1 + exc1 >= 5 AND inc2 + exc2 >= 5")
    return posterior.dpsi_posterior(rows.select("event_id", F.col("len_ratio").alias("ratio"), *(thirds(c).alias(c) for c in ("inc1", "exc1", "inc2", "exc2"))))


@query("beta_ci")
def beta_ci(spark, sf_dir):
    rows = view(spark, sf_dir, "ev").withColumn("ci", special.beta_interval(F.col("inc1") + 1.0, F.col("exc1") + 1.0))
    none = F.col("inc1") + F.col("exc1") == 0
    return rows.select("event_id", F.when(none, 0.0).otherwise(F.col("ci.low")).alias("ci_low"), F.when(none, 1.0).otherwise(F.col("ci.high")).alias("ci_high"))


@query("replicate_combine", sql("ev") + """, r AS (SELECT event_id, (inc1 + 0.5e0) / (inc1 + exc1 + 1) AS psi, inc1 AS inc, exc1 AS exc FROM ev UNION ALL SELECT event_id, (inc2 + 0.5e0) / (inc2 + exc2 + 1), inc2, exc2 FROM ev),
i AS (SELECT *, greatest(psi - 0.1, 0e0) AS lo, least(psi + 0.1, 1e0) AS hi FROM r),
c AS (SELECT event_id, avg(psi) AS psi, sqrt(coalesce(var_samp(psi), 0) + avg(((hi - lo) / (2 * 1.959963984540054e0)) * ((hi - lo) / (2 * 1.959963984540054e0)))) AS sd, CAST(sum(inc) AS BIGINT) AS inc, CAST(sum(exc) AS BIGINT) AS exc FROM i GROUP BY event_id)
SELECT event_id, round(psi, 8) AS psi, round(greatest(0e0, psi - 1.959963984540054e0 * sd), 8) AS ci_low, round(least(1e0, psi + 1.959963984540054e0 * sd), 8) AS ci_high, inc, exc FROM c""")
def replicate_combine(spark, sf_dir):
    ev = view(spark, sf_dir, "ev")
    one = lambda g: ev.select("event_id", C.beta_mean(F.col(f"inc{g}"), F.col(f"exc{g}")).alias("psi"), F.col(f"inc{g}").alias("inc"), F.col(f"exc{g}").alias("exc"))
    rows = one(1).union(one(2)).withColumns({"ci_low": F.greatest(F.col("psi") - 0.1, F.lit(0.0)), "ci_high": F.least(F.col("psi") + 0.1, F.lit(1.0))})
    out = posterior.combine_replicates(rows).drop("replicates")
    return out.withColumns({c: F.round(c, 8) for c in ("psi", "ci_low", "ci_high")})


@query("thin_counts")
def thin_counts(spark, sf_dir):
    return posterior.thin_counts(view(spark, sf_dir, "ev").select("event_id", "inc1", "exc1"), 0.25, ["inc1", "exc1"])


@query("bootstrap_coverage")
def bootstrap_coverage(spark, sf_dir):
    rows = view(spark, sf_dir, "cal").select("id", "event_type", (F.abs(F.col("truth") - F.col("estimate")) <= F.col("scale")).cast("double").alias("hit"))
    return posterior.bootstrap_interval(rows, ["event_type"], "hit", 100)


@query("mcnemar_p", sql("scored") + """, r AS (SELECT grp, (score >= 0.6) = (label = 1) AS x, (score >= 0.4) = (label = 1) AS y FROM scored), n AS (SELECT grp, CAST(sum((x AND NOT y)::INT) AS BIGINT) AS b, CAST(sum((y AND NOT x)::INT) AS BIGINT) AS c FROM r GROUP BY grp)
SELECT grp, b, c, round(least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))), 6) AS p FROM n""")
def mcnemar_p(spark, sf_dir):
    right = lambda t: (F.col("score") >= t) == (F.col("label") == 1)
    rows = view(spark, sf_dir, "scored").select("grp", right(0.6).alias("x"), right(0.4).alias("y"))
    n = lambda c: F.sum(c.cast("long"))
    counts = rows.groupBy("grp").agg(n(F.col("x") & ~F.col("y")).alias("b"), n(F.col("y") & ~F.col("x")).alias("c"))
    return counts.withColumn("p", F.round(special.mcnemar_p(F.col("b"), F.col("c")), 6))


@query("detection_p")
def detection_p(spark, sf_dir):
    from spliceflow.plans.calibration import scored

    return scored(spark, sf_dir).select("event_id", special.two_sided_p(F.col("dpsi"), F.col("sd")).alias("p"))


def _graph(spark, sf_dir):
    near = events.with_neighbours(view(spark, sf_dir, "exons"))
    js = events.introns(near).withColumn("locus", F.expr("cast(substring(gene_id, 2) as bigint)")).groupBy("locus", "js", "je").agg(F.count(F.lit(1)).alias("count"))
    loci = near.withColumn("locus", F.expr("cast(substring(gene_id, 2) as bigint)")).groupBy("locus").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return loci, js


def _parts(spark, sf_dir):
    """Segments and junctions, each written once: nodes, edges and supports all read them."""
    loci, js = _graph(spark, sf_dir)
    js = written(js)
    return written(graph.segments(loci, js)), js


_SEG = sql("exons") + """, x AS (SELECT *, gene AS locus, lead(s) OVER (PARTITION BY tx ORDER BY s) AS ds FROM exons), j AS (SELECT DISTINCT locus, e AS js, ds AS je FROM x WHERE ds IS NOT NULL), l AS (SELECT locus, min(s) AS s, max(e) AS e FROM x GROUP BY locus),
p AS (SELECT locus, s AS p FROM l UNION SELECT locus, e FROM l UNION SELECT locus, js FROM j UNION SELECT locus, je FROM j), g AS (SELECT locus, p AS s, lead(p) OVER (PARTITION BY locus ORDER BY p) AS e FROM p)
SELECT locus, s, e FROM g WHERE e IS NOT NULL AND (EXISTS (SELECT 1 FROM j WHERE j.locus = g.locus AND je = s) OR EXISTS (SELECT 1 FROM j WHERE j.locus = g.locus AND js = e) OR (e - s >= 20 AND NOT EXISTS (SELECT 1 FROM j WHERE j.locus = g.locus AND js <= s AND je >= e)))"""


@query("exon_segments", _SEG)
def exon_segments(spark, sf_dir):
    return graph.segments(*_graph(spark, sf_dir))


def _edges(spark, sf_dir):
    return graph.graph(*_parts(spark, sf_dir))[1]


@query("graph_paths")
def graph_paths(spark, sf_dir):
    out = graph.decompose(_edges(spark, sf_dir))
    return out.select("locus", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), "weight", "bottleneck")


@query("edge_bootstrap")
def edge_bootstrap(spark, sf_dir):
    out = graph.decompose(_edges(spark, sf_dir), resamples=20)
    return out.select("locus", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), "weight", "low", "high", "presence")


@query("locus_flow")
def locus_flow(spark, sf_dir):
    return graph.locus_flow(_edges(spark, sf_dir))


def _supported(spark, sf_dir):
    """The edges with the number of exons across each continuation as its weight."""
    parts, js = _parts(spark, sf_dir)
    exons = view(spark, sf_dir, "exons").groupBy(F.col("gene").alias("locus"), "s", "e").agg(F.count(F.lit(1)).alias("count"))
    return graph.supported(graph.graph(parts, js)[1], parts, exons)


# Edges with their support; then every walk from a start with its probability.
_SUPPORTED = _SEG.replace("SELECT locus, s, e FROM g WHERE", ", sg AS (SELECT locus, s, e, row_number() OVER (PARTITION BY locus ORDER BY s) AS node FROM g WHERE") + """),
jc AS (SELECT locus, e AS js, ds AS je, CAST(count(*) AS DOUBLE) AS w FROM x WHERE ds IS NOT NULL GROUP BY 1, 2, 3),
ed AS (SELECT l.locus, CAST(l.node AS INT) AS a, CAST(r.node AS INT) AS b, jc.w FROM jc JOIN sg l ON l.locus = jc.locus AND l.e = js JOIN sg r ON r.locus = jc.locus AND r.s = je
 UNION ALL SELECT l.locus, CAST(l.node AS INT), CAST(r.node AS INT), CAST((SELECT count(*) FROM x WHERE x.locus = l.locus AND x.s < l.e AND x.e > l.e) AS DOUBLE) FROM sg l JOIN sg r ON r.locus = l.locus AND r.s = l.e),
oe AS (SELECT * FROM ed WHERE w > 0), st AS (SELECT DISTINCT locus, a AS node FROM oe WHERE NOT EXISTS (SELECT 1 FROM oe o WHERE o.locus = oe.locus AND o.b = oe.a)), en AS (SELECT DISTINCT locus, b AS node FROM oe WHERE NOT EXISTS (SELECT 1 FROM oe o WHERE o.locus = oe.locus AND o.a = oe.b))"""


@query("graph_psi", _SUPPORTED.replace("WITH ", "WITH RECURSIVE ", 1) + """, ou AS (SELECT locus, a, sum(w) AS w FROM oe GROUP BY 1, 2),
walk AS (SELECT st.locus, node, ou.w / sum(ou.w) OVER (PARTITION BY st.locus) AS p FROM st JOIN ou ON ou.locus = st.locus AND ou.a = node UNION ALL SELECT oe.locus, oe.b, p * oe.w / ou.w FROM walk JOIN oe ON oe.locus = walk.locus AND oe.a = node JOIN ou ON ou.locus = oe.locus AND ou.a = oe.a)
SELECT locus, node, round(sum(p), 8) AS psi FROM walk GROUP BY 1, 2""")
def graph_psi(spark, sf_dir):
    return flows.node_shares(_supported(spark, sf_dir)).withColumn("psi", F.round("psi", 8))


@query("widest_paths", _SUPPORTED.replace("WITH ", "WITH RECURSIVE ", 1) + """, lo AS (SELECT locus, a, b, w, false AS stays FROM oe UNION ALL SELECT locus, node, node, NULL, true FROM st),
way AS (SELECT 0 AS r, locus, node, CAST('inf' AS DOUBLE) AS k, 0e0 AS score, [node] AS path FROM st
 UNION ALL SELECT r, locus, node, best.k, best.score, best.path FROM (SELECT way.r + 1 AS r, lo.locus, lo.b AS node, max(CASE WHEN stays THEN {'k': k, 'score': score, 'last': 0, 'path': path} ELSE {'k': least(k, w), 'score': score + w, 'last': -lo.a, 'path': list_append(path, lo.b)} END) AS best
 FROM way JOIN lo ON lo.locus = way.locus AND lo.a = way.node WHERE way.r < 60 GROUP BY 1, 2, 3)),
fin AS (SELECT way.locus, max({'k': k, 'score': score, 'last': -way.node, 'path': path}) AS best FROM way JOIN en ON en.locus = way.locus AND en.node = way.node WHERE r = 60 GROUP BY 1)
SELECT locus, array_to_string(best.path, '-') AS path, best.k AS bottleneck, best.score AS score FROM fin""")
def widest_paths(spark, sf_dir):
    out = flows.widest_paths(_supported(spark, sf_dir))
    return out.select("locus", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), "bottleneck", "score")


@query("residual_paths")
def residual_paths(spark, sf_dir):
    out = graph.peeled(_supported(spark, sf_dir))
    return out.select("locus", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), "weight", "nth")
