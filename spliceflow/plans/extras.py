"""Further queries: regions, gaps, node and edge coverage, detection p values, dispersion, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from spliceflow.functions import calibration as C
from spliceflow.operators import intervals, regions
from spliceflow.operators.crowded import half_covered
from spliceflow.plans.calibration import SCORED_SQL, scored
from spliceflow.plans.domain import sql, view
from spliceflow.plans.registry import query

_EV, _IV, _X = sql("ev"), sql("iv"), sql("exons")
_GENES = _X + ", g AS (SELECT chrom, gene_id AS gene, min(s) + gene * 9000 AS s, max(e) + gene * 9000 AS e FROM exons GROUP BY chrom, gene_id, gene)"


@query("flanking_region", _GENES + ", w AS (SELECT *, min(s) OVER n AS rs, max(e) OVER n AS re FROM g WINDOW n AS (PARTITION BY chrom ORDER BY s, e, gene ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT gene, greatest(rs - 5000, 0) AS s, re + 5000 AS e FROM w WHERE gene LIKE '%7'")
def flanking_region(spark, sf_dir):
    genes = view(spark, sf_dir, "exons").groupBy("chrom", F.col("gene_id").alias("gene"), F.col("gene").alias("k")).agg(F.min("s").alias("s"), F.max("e").alias("e")).selectExpr("chrom", "gene", "s + k * 9000 AS s", "e + k * 9000 AS e")
    return regions.flanking_region(genes, F.col("gene").endswith("7"), 2, 5000).select("gene", "s", "e")


@query("single_exon_candidates", _IV + ", b AS (SELECT chrom, s // 50 AS bin, count(*) AS n FROM iv GROUP BY 1, 2), r AS (SELECT *, bin - row_number() OVER (PARTITION BY chrom ORDER BY bin) AS g FROM b WHERE n >= 2) SELECT chrom, min(bin) * 50 AS s, (max(bin) + 1) * 50 AS e FROM r GROUP BY chrom, g HAVING (max(bin) + 1 - min(bin)) * 50 >= 150")
def single_exon_candidates(spark, sf_dir):
    bins = view(spark, sf_dir, "iv").groupBy("chrom", F.expr("s div 50").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return regions.single_exon_candidates(bins, ["chrom"], 50, 2, 150)


@query("boundary_contrast", _IV + ", b AS (SELECT chrom, s // 500 AS p, count(*) AS n FROM iv GROUP BY 1, 2) SELECT chrom, p, round(abs(coalesce(avg(n) OVER (PARTITION BY chrom ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), 0) - coalesce(avg(n) OVER (PARTITION BY chrom ORDER BY p ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)), 8) AS contrast FROM b")
def boundary_contrast(spark, sf_dir):
    bins = view(spark, sf_dir, "iv").groupBy("chrom", F.expr("s div 500").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return intervals.boundary_contrast(bins, ["chrom"], "p", "n").select("chrom", "p", F.round("contrast", 8).alias("contrast"))


@query("loss_accounting", sql("iv", "blocks") + """, l AS (SELECT chrom, s AS rs, e AS re FROM blocks)
SELECT id, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.chrom = t.chrom AND s < re AND rs < e AND least(e, re) - greatest(s, rs) >= 0.5 * (e - s)) THEN 'found' WHEN EXISTS (SELECT 1 FROM l WHERE l.chrom = t.chrom AND s < re AND rs < e) THEN 'no_match' ELSE 'no_locus' END AS stage FROM iv t""")
def loss_accounting(spark, sf_dir):
    """All intervals are the truth, the reads' first blocks the loci; what one of them covers by half is found."""
    truth = view(spark, sf_dir, "iv")
    loci = view(spark, sf_dir, "blocks").selectExpr("chrom", "s AS rs", "e AS re")
    found = half_covered(truth, loci, ["chrom"]).select("id")
    return regions.lost_at(truth, loci, found, ["chrom"], "id").select("id", "stage")


@query("conformal_p", sql("scored") + ", d AS (SELECT DISTINCT grp, score FROM scored) SELECT grp, score, round((1 + (SELECT count(*) FROM scored s WHERE s.grp = d.grp AND label = 0 AND s.score >= d.score)) / (1 + (SELECT count(*) FROM scored s WHERE s.grp = d.grp AND label = 0)), 9) AS p FROM d")
def conformal_p(spark, sf_dir):
    return regions.detection_p(view(spark, sf_dir, "scored"), ["grp"], "score", "label").select("grp", "score", F.round("p", 9).alias("p"))


@query("replicate_dispersion", _EV + ", r AS (SELECT gene, inc1 / (inc1 + exc1) AS p FROM ev WHERE inc1 + exc1 > 0) SELECT gene, count(*) AS n, round(avg(p), 8) AS mean, round(var_samp(p), 8) AS variance, round(var_samp(p) / (avg(p) * (1 - avg(p))), 6) AS ratio FROM r GROUP BY gene")
def replicate_dispersion(spark, sf_dir):
    p = view(spark, sf_dir, "ev").where("inc1 + exc1 > 0").select("gene", (F.col("inc1") / (F.col("inc1") + F.col("exc1"))).alias("p"))
    m, v = F.avg("p"), F.var_samp("p")
    return p.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.round(m, 8).alias("mean"), F.round(v, 8).alias("variance"), F.round(F.try_divide(v, m * (1 - m)), 6).alias("ratio"))


@query("boundary_proximity", _EV + " SELECT event_id, round(least((inc1 + 0.5e0) / (inc1 + exc1 + 1), 1 - (inc1 + 0.5e0) / (inc1 + exc1 + 1), (inc2 + 0.5e0) / (inc2 + exc2 + 1), 1 - (inc2 + 0.5e0) / (inc2 + exc2 + 1)), 9) AS proximity FROM ev")
def boundary_proximity(spark, sf_dir):
    a, b = C.beta_mean(F.col("inc1"), F.col("exc1")), C.beta_mean(F.col("inc2"), F.col("exc2"))
    return view(spark, sf_dir, "ev").select("event_id", F.round(F.least(a, 1 - a, b, 1 - b), 9).alias("proximity"))


@query("significance_filter", _EV + ", p AS (SELECT event_id, inc1 + exc1 AS n, sqrt((inc1 + 0.5e0) * (exc1 + 0.5e0) / ((inc1 + exc1 + 1e0) * (inc1 + exc1 + 1e0) * (inc1 + exc1 + 2e0))) AS sd FROM ev WHERE inc1 + exc1 > 0) SELECT event_id, n FROM p WHERE n >= 10 AND 2 * 1.959963984540054e0 * sd <= 0.3")
def significance_filter(spark, sf_dir):
    n = F.expr("inc1 + exc1")
    width = F.sqrt(C.beta_variance(F.col("inc1"), F.col("exc1"))) * (2 * C.Z95)
    return view(spark, sf_dir, "ev").where((n > 0) & (n >= 10) & (width <= 0.3)).select("event_id", n.alias("n"))


@query("psi_summary", _EV + ", p AS (SELECT event_type, inc1 + exc1 AS n, inc1 / (inc1 + exc1) AS p FROM ev WHERE inc1 + exc1 > 0) SELECT event_type, count(*) AS events, round(avg(p), 8) AS mean_psi, round(quantile_cont(p, 0.5), 8) AS median_psi, round(avg(n), 6) AS mean_reads FROM p GROUP BY event_type")
def psi_summary(spark, sf_dir):
    p = view(spark, sf_dir, "ev").where("inc1 + exc1 > 0").select("event_type", F.expr("inc1 + exc1").alias("n"), (F.col("inc1") / (F.col("inc1") + F.col("exc1"))).alias("p"))
    return p.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("p"), 8).alias("mean_psi"), F.round(F.percentile("p", F.lit(0.5)), 8).alias("median_psi"), F.round(F.avg("n"), 6).alias("mean_reads"))


@query("overview", _EV + " SELECT count(*) AS events, count(DISTINCT gene) AS genes, count(DISTINCT event_type) AS types, CAST(sum(inc1 + exc1 + inc2 + exc2) AS BIGINT) AS reads FROM ev")
def overview(spark, sf_dir):
    return view(spark, sf_dir, "ev").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("gene").alias("genes"), F.countDistinct("event_type").alias("types"), F.sum(F.expr("inc1 + exc1 + inc2 + exc2")).alias("reads"))


@query("candidate_genes", SCORED_SQL + ", cg AS (SELECT *, abs(dpsi) AS a, row_number() OVER (PARTITION BY gene ORDER BY support DESC, k) AS r FROM t WHERE tier = 'high-confidence') SELECT gene, count(*) AS n, max(support) AS support, max(CASE WHEN r = 1 THEN event_id END) AS best FROM cg GROUP BY gene")
def candidate_genes(spark, sf_dir):
    good = scored(spark, sf_dir).where("tier = 'high-confidence'")
    return good.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.max("support").alias("support"), F.max_by("event_id", F.struct("support", -F.col("k"))).alias("best"))


@query("category_counts", SCORED_SQL + " SELECT event_type, count(DISTINCT gene) AS genes, string_agg(DISTINCT gene, ',' ORDER BY gene) AS names FROM t WHERE tier = 'high-confidence' AND support >= 250 GROUP BY event_type")
def category_counts(spark, sf_dir):
    good = scored(spark, sf_dir).where("tier = 'high-confidence' and support >= 250")
    return good.groupBy("event_type").agg(F.countDistinct("gene").alias("genes"), F.array_join(F.sort_array(F.collect_set("gene")), ",").alias("names"))


@query("edge_coverage", _X + ", x AS (SELECT *, lead(s) OVER (PARTITION BY tx ORDER BY s) AS ds FROM exons), i AS (SELECT gene_id, e AS js, ds AS je, count(*) AS n FROM x WHERE ds IS NOT NULL GROUP BY 1, 2, 3) SELECT gene_id, CAST(sum(n) AS BIGINT) AS weight, count(*) AS edges, max(n) AS strongest FROM i GROUP BY gene_id")
def edge_coverage(spark, sf_dir):
    from spliceflow.operators import events

    edges = events.introns(events.with_neighbours(view(spark, sf_dir, "exons"))).groupBy("gene_id", "js", "je").agg(F.count(F.lit(1)).alias("n"))
    return edges.groupBy("gene_id").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("edges"), F.max("n").alias("strongest"))
