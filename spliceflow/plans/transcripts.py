"""Queries over transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spliceflow.operators import transcripts as T
from spliceflow.plans.domain import sql, view
from spliceflow.plans.registry import query

_T = sql("exons") + """, near AS (SELECT *, lead(s) OVER (PARTITION BY tx ORDER BY s) AS down_s FROM exons),
t AS (SELECT gene_id, transcript_id, strand, tx, min(s) AS tx_start, max(e) AS tx_end, sum(e - s) AS length, count(*) AS n_exons, coalesce(string_agg(e || '-' || down_s, ',' ORDER BY s), '') AS chain, min(e - s) AS min_exon, max(e - s) AS max_exon, coalesce(max(down_s - e), 0) AS max_intron,
 CAST(tx * 7 % 50 + 1 AS BIGINT) AS cov, CAST(tx % 97 AS DOUBLE) / 96 AS score, CAST(tx % 5 AS BIGINT) AS support FROM near GROUP BY gene_id, transcript_id, strand, tx)"""


def _transcripts(spark, sf_dir):
    tx = F.expr("cast(substring(transcript_id, 2) as bigint)")
    return T.chains(view(spark, sf_dir, "exons")).withColumns({"tx": tx, "cov": tx * 7 % 50 + 1, "score": (tx % 97).cast("double") / 96, "support": tx % 5})


@query("intron_chains", _T + " SELECT gene_id, transcript_id, chain, CAST(length AS BIGINT) AS length FROM t")
def intron_chains(spark, sf_dir):
    return _transcripts(spark, sf_dir).select("gene_id", "transcript_id", "chain", "length")


@query("merge_chains", _T + " SELECT gene_id, chain, min(tx_start) AS tx_start, max(tx_end) AS tx_end, CAST(sum(cov) AS BIGINT) AS weight, count(*) AS members, max_by(transcript_id, (cov, transcript_id)) AS representative FROM t WHERE chain <> '' GROUP BY gene_id, strand, chain")
def merge_chains(spark, sf_dir):
    return T.merge_chains(_transcripts(spark, sf_dir), "cov").drop("strand")


_PASS = "(score >= 0.3 OR (cov >= 20 AND score >= 0.15)) AND cov >= 1 AND (n_exons < 2 OR support >= 2) AND length >= 50"


@query("filter_cascade", _T + f", p AS (SELECT *, row_number() OVER (PARTITION BY gene_id, chain ORDER BY score DESC, transcript_id) AS r FROM t WHERE {_PASS}), q AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY score DESC, transcript_id) AS k FROM p WHERE r = 1 OR chain = '') SELECT gene_id, transcript_id FROM q WHERE k <= 5")
def filter_cascade(spark, sf_dir):
    good = T.passes(F.col("score"), F.col("cov"), F.col("support"), F.size("exons"), F.col("length"))
    return T.locus_cap(T.best_per_chain(_transcripts(spark, sf_dir).where(good), "score"), "score", 5).select("gene_id", "transcript_id")


@query("filter_stages", _T + " SELECT count(*) AS n, CAST(sum((score >= 0.3 OR (cov >= 20 AND score >= 0.15))::INT) AS BIGINT) AS by_score, CAST(sum((n_exons < 2 OR support >= 2)::INT) AS BIGINT) AS by_support, CAST(sum((" + _PASS + ")::INT) AS BIGINT) AS kept FROM t")
def filter_stages(spark, sf_dir):
    n = lambda c: F.sum(c.cast("long"))
    rows = _transcripts(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("n"), n((F.col("score") >= 0.3) | ((F.col("cov") >= 20) & (F.col("score") >= 0.15))).alias("by_score"), n((F.size("exons") < 2) | (F.col("support") >= 2)).alias("by_support"), n(T.passes(F.col("score"), F.col("cov"), F.col("support"), F.size("exons"), F.col("length"))).alias("kept"))


@query("locus_cap", _T + ", q AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY score DESC, transcript_id) AS k FROM t) SELECT gene_id, transcript_id FROM q WHERE k <= 3")
def locus_cap(spark, sf_dir):
    return T.locus_cap(_transcripts(spark, sf_dir), "score", 3).select("gene_id", "transcript_id")


@query("fpkm_tpm", _T + " SELECT transcript_id, round(cov * 1e9 / (2000000e0 * 100), 6) AS fpkm, round(cov / sum(cov) OVER () * 1e6, 6) AS tpm FROM t")
def fpkm_tpm(spark, sf_dir):
    out = T.expression(_transcripts(spark, sf_dir), "cov", 2_000_000)
    return out.select("transcript_id", F.round("fpkm", 6).alias("fpkm"), F.round("tpm", 6).alias("tpm"))


@query("structure_features", _T + " SELECT gene_id, transcript_id, n_exons, CAST(length AS BIGINT) AS length, tx_end - tx_start AS span, min_exon, max_exon, max_intron, round(length / (tx_end - tx_start), 9) AS exon_fraction FROM t")
def structure_features(spark, sf_dir):
    return T.structure(_transcripts(spark, sf_dir)).withColumn("exon_fraction", F.round("exon_fraction", 9))


@query("coverage_features", _T + " SELECT gene_id, count(*) AS n, round(avg(cov), 6) AS mean_cov, quantile_cont(cov, 0.5) AS median_cov, round(stddev_pop(cov), 6) AS sd_cov, quantile_cont(cov, 0.75) - quantile_cont(cov, 0.25) AS iqr FROM t GROUP BY gene_id")
def coverage_features(spark, sf_dir):
    q = lambda p: F.percentile("cov", F.lit(p))
    return _transcripts(spark, sf_dir).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cov"), 6).alias("mean_cov"), q(0.5).alias("median_cov"), F.round(F.stddev_pop("cov"), 6).alias("sd_cov"), (q(0.75) - q(0.25)).alias("iqr"))


@query("rank_in_locus", _T + " SELECT transcript_id, rank() OVER (PARTITION BY gene_id ORDER BY cov DESC) AS place, round(cov / sum(cov) OVER (PARTITION BY gene_id), 9) AS part FROM t")
def rank_in_locus(spark, sf_dir):
    from pyspark.sql import Window

    by = Window.partitionBy("gene_id")
    return _transcripts(spark, sf_dir).select("transcript_id", F.rank().over(by.orderBy(F.desc("cov"))).cast("long").alias("place"), F.round(F.col("cov") / F.sum("cov").over(by), 9).alias("part"))


@query("shared_junctions", _T + ", i AS (SELECT gene_id, transcript_id, e AS js, down_s AS je FROM near WHERE down_s IS NOT NULL), u AS (SELECT *, count(*) OVER (PARTITION BY gene_id, js, je) AS users FROM i) SELECT gene_id, transcript_id, CAST(sum((users > 1)::INT) AS BIGINT) AS shared, CAST(sum((users = 1)::INT) AS BIGINT) AS own FROM u GROUP BY gene_id, transcript_id")
def shared_junctions(spark, sf_dir):
    return T.shared_junctions(_transcripts(spark, sf_dir))


@query("cap_terminal", _T + ", c AS (SELECT transcript_id, s, e, row_number() OVER w AS k, row_number() OVER (PARTITION BY tx ORDER BY s DESC) AS b, count(*) OVER (PARTITION BY tx) AS n FROM exons WINDOW w AS (PARTITION BY tx ORDER BY s)) SELECT transcript_id, CASE WHEN k = 1 AND n > 1 THEN greatest(s, e - 300) ELSE s END AS s, CASE WHEN b = 1 AND n > 1 THEN least(e, s + 300) ELSE e END AS e FROM c")
def cap_terminal(spark, sf_dir):
    return _transcripts(spark, sf_dir).select("transcript_id", F.explode(T.cap_terminal(F.col("exons"), 300)).alias("x")).select("transcript_id", "x.s", "x.e")


@query("merge_close_exons", _T + ", g AS (SELECT *, sum(CASE WHEN up IS NULL OR s - up > 620 THEN 1 ELSE 0 END) OVER (PARTITION BY tx ORDER BY s) AS k FROM (SELECT *, lag(e) OVER (PARTITION BY tx ORDER BY s) AS up FROM exons)) SELECT transcript_id, min(s) AS s, max(e) AS e FROM g GROUP BY transcript_id, k")
def merge_close_exons(spark, sf_dir):
    return _transcripts(spark, sf_dir).select("transcript_id", F.explode(T.merge_close(F.col("exons"), 620)).alias("x")).select("transcript_id", "x.s", "x.e")


_REF = _T + """, ref AS (SELECT * FROM t WHERE tx % 3 = 0), qry AS (SELECT * FROM t WHERE tx % 3 <> 0), ri AS (SELECT DISTINCT gene_id, e AS js, down_s AS je FROM near WHERE tx % 3 = 0 AND down_s IS NOT NULL), rx AS (SELECT gene_id, s, e FROM exons WHERE tx % 3 = 0)"""


@query("classify_isoforms", _REF + """, h AS (SELECT n.transcript_id, count(ri.js) AS known, count(*) AS n FROM near n LEFT JOIN ri ON ri.gene_id = n.gene_id AND ri.js = n.e AND ri.je = n.down_s WHERE n.down_s IS NOT NULL GROUP BY n.transcript_id),
nx AS (SELECT DISTINCT transcript_id FROM exons x WHERE NOT EXISTS (SELECT 1 FROM rx WHERE rx.gene_id = x.gene_id AND rx.s < x.e AND x.s < rx.e)),
l AS (SELECT gene_id, transcript_id, tx, list(e ORDER BY s) AS js, list(down_s ORDER BY s) AS je, list(e || '-' || down_s ORDER BY s) AS ch FROM near WHERE down_s IS NOT NULL GROUP BY 1, 2, 3),
ex AS (SELECT DISTINCT q.transcript_id FROM l q JOIN l r ON q.gene_id = r.gene_id AND q.tx % 3 <> 0 AND r.tx % 3 = 0 WHERE (len(q.js) = len(r.js) AND len(list_filter(range(1, len(q.js) + 1), lambda i: abs(q.js[i] - r.js[i]) > 5 OR abs(q.je[i] - r.je[i]) > 5)) = 0) OR (len(r.js) >= 2 AND len(r.js) >= len(q.js) - 2 AND list_has_all(q.ch, r.ch)))
SELECT qry.gene_id, qry.transcript_id, CASE WHEN n_exons < 2 THEN 'single_exon' WHEN ex.transcript_id IS NOT NULL THEN 'exact_match' WHEN h.known = h.n THEN 'novel_combination' WHEN nx.transcript_id IS NOT NULL THEN 'novel_exon' ELSE 'novel_junction' END AS category
FROM qry LEFT JOIN h USING (transcript_id) LEFT JOIN nx USING (transcript_id) LEFT JOIN ex USING (transcript_id)""")
def classify_isoforms(spark, sf_dir):
    rows = _transcripts(spark, sf_dir)
    return T.classify(rows.where("tx % 3 <> 0"), rows.where("tx % 3 = 0"))


@query("merge_compatible", _T + ", x AS (SELECT tx, string_agg(s || '-' || e, ',' ORDER BY s) AS ex FROM exons GROUP BY tx) SELECT gene_id, min(transcript_id) AS transcript_id, CAST(sum(cov) AS BIGINT) AS weight, bool_and(tx % 5 <> 0) AS safe, count(*) AS members FROM t JOIN x USING (tx) GROUP BY gene_id, ex")
def merge_compatible(spark, sf_dir):
    return T.merge_compatible(_transcripts(spark, sf_dir).withColumn("safe", F.col("tx") % 5 != 0), "cov", "safe").select("gene_id", "transcript_id", "weight", "safe", "members")


@query("junction_support", _T + """, i AS (SELECT gene_id, transcript_id, tx, e AS js, down_s AS je FROM near WHERE down_s IS NOT NULL), j AS (SELECT gene_id, js, je, count(*) AS cnt, js % 4 <> 0 AS canonical FROM i WHERE tx % 3 <> 0 GROUP BY 1, 2, 3),
m AS (SELECT i.gene_id, i.transcript_id, coalesce(cnt, 0) AS c, coalesce(canonical::INT, 0) AS k FROM i LEFT JOIN j USING (gene_id, js, je))
SELECT gene_id, transcript_id, count(*) AS n, min(c) AS least, round(avg(c), 9) AS mean, max(c) AS most, count(CASE WHEN c = 0 THEN 1 END) AS unsupported, round(avg(k), 9) AS canonical, round(CASE WHEN max(c) > 0 THEN min(c) / max(c) ELSE 0 END, 9) AS balance FROM m GROUP BY 1, 2""")
def junction_support(spark, sf_dir):
    """Two of three transcripts are the evidence for all."""
    rows = _transcripts(spark, sf_dir)
    j = rows.where("tx % 3 <> 0").select("gene_id", F.explode("introns").alias("i")).groupBy("gene_id", F.col("i.s").alias("js"), F.col("i.e").alias("je")).agg(F.count(F.lit(1)).alias("count")).withColumn("canonical", F.col("js") % 4 != 0)
    return T.junction_support(rows, j).withColumns({c: F.round(c, 9) for c in ("mean", "canonical", "balance")})


@query("gtf_sens_prec", _REF + """, a AS (SELECT DISTINCT gene_id, chain FROM qry WHERE chain <> ''), b AS (SELECT DISTINCT gene_id, chain FROM ref WHERE chain <> '') SELECT (SELECT count(*) FROM a JOIN b USING (gene_id, chain)) AS hits, (SELECT count(*) FROM b) AS n_truth, (SELECT count(*) FROM a) AS n_found, round((SELECT count(*) FROM a JOIN b USING (gene_id, chain)) / (SELECT count(*) FROM b), 9) AS sensitivity, round((SELECT count(*) FROM a JOIN b USING (gene_id, chain)) / (SELECT count(*) FROM a), 9) AS precision""")
def gtf_sens_prec(spark, sf_dir):
    rows = _transcripts(spark, sf_dir).where("chain <> ''")
    out = T.sensitivity_precision(rows.where("tx % 3 <> 0"), rows.where("tx % 3 = 0"), ["gene_id", "chain"])
    return out.withColumns({c: F.round(c, 9) for c in ("sensitivity", "precision")})
