"""Queries of proposed events, their evidence, features and matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from spliceflow.operators import events as E
from spliceflow.operators import evidence as V
from spliceflow.plans.domain import sql, view
from spliceflow.plans.events import _X
from spliceflow.plans.registry import query

_IV, _EV = sql("iv"), sql("ev")
_READS = ", gr AS (SELECT concat('G', CAST(l_orderkey // 32 AS VARCHAR)) AS gene_id, l_orderkey * 13 % 8000 AS rs, l_orderkey * 13 % 8000 + 40 + l_partkey % 900 AS re, l_suppkey % 3 = 0 AS spliced FROM lineitem)"
_ARMS = """, arms AS (SELECT DISTINCT gene_id, s, e, 'left' AS arm, up_e AS js, s AS je FROM near WHERE up_e IS NOT NULL AND down_s IS NOT NULL UNION SELECT DISTINCT gene_id, s, e, 'right', e, down_s FROM near WHERE up_e IS NOT NULL AND down_s IS NOT NULL
UNION SELECT DISTINCT gene_id, s, e, 'skip', up_e, down_s FROM near WHERE up_e IS NOT NULL AND down_s IS NOT NULL), jn AS (SELECT gene_id, js, je, count(*) AS cnt FROM intr GROUP BY 1, 2, 3)"""
_BODY = ", body AS (SELECT x.gene_id, x.s, x.e, count(*) AS body FROM (SELECT DISTINCT gene_id, s, e FROM arms) x JOIN gr ON gr.gene_id = x.gene_id AND NOT spliced AND rs < e AND re > s AND least(re, e) - greatest(rs, s) >= least(greatest(25, (e - s) // 2), e - s) GROUP BY 1, 2, 3)"


def _reads(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("concat('G', cast(l_orderkey div 32 as string)) AS gene_id", "l_orderkey * 13 % 8000 AS rs", "l_orderkey * 13 % 8000 + 40 + l_partkey % 900 AS re", "l_suppkey % 3 = 0 AS spliced")


def _near(spark, sf_dir):
    return E.with_neighbours(view(spark, sf_dir, "exons"))


def _junctions(spark, sf_dir):
    return E.introns(_near(spark, sf_dir)).groupBy("gene_id", "js", "je").agg(F.count(F.lit(1)).alias("count"))


@query("annotation_se", _X + _ARMS + " SELECT gene_id, s, e, string_agg(CASE WHEN arm = 'left' THEN js || '-' || je END, ',' ORDER BY js, je) AS inclusion, string_agg(CASE WHEN arm = 'right' THEN js || '-' || je END, ',' ORDER BY js, je) AS auxiliary, string_agg(CASE WHEN arm = 'skip' THEN js || '-' || je END, ',' ORDER BY js, je) AS exclusion, count(*) AS candidates FROM arms GROUP BY gene_id, s, e")
def annotation_se(spark, sf_dir):
    side = lambda arm: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("arm") == arm, F.struct("js", "je")))), lambda j: F.concat_ws("-", j["js"], j["je"])), ",")
    return V.annotated_skips(_near(spark, sf_dir)).groupBy("gene_id", "s", "e").agg(side("left").alias("inclusion"), side("right").alias("auxiliary"), side("skip").alias("exclusion"), F.count(F.lit(1)).alias("candidates"))


@query("ri_proposals", _X + _ARMS + " SELECT gene_id, js, je, cnt AS \"count\" FROM jn WHERE je - js BETWEEN 50 AND 50000")
def ri_proposals(spark, sf_dir):
    return V.proposed_retentions(_junctions(spark, sf_dir))


@query("exon_body_reads", _X + _READS + _ARMS + _BODY + " SELECT x.gene_id, x.s, x.e, coalesce(body, 0) AS body FROM (SELECT DISTINCT gene_id, s, e FROM arms) x LEFT JOIN body USING (gene_id, s, e)")
def exon_body_reads(spark, sf_dir):
    exons = V.annotated_skips(_near(spark, sf_dir)).select("gene_id", "s", "e").distinct()
    return V.exon_body_reads(exons, _reads(spark, sf_dir), ["gene_id"]).select("gene_id", "s", "e", "body")


@query("event_evidence", _X + _READS + _ARMS + _BODY + """, b AS (SELECT gene_id, s, e, max(CASE WHEN arm = 'left' THEN coalesce(cnt, 0) END) AS l, max(CASE WHEN arm = 'right' THEN coalesce(cnt, 0) END) AS r, max(CASE WHEN arm = 'skip' THEN coalesce(cnt, 0) END) AS k, count(*) AS candidates, count(DISTINCT CASE WHEN cnt > 0 THEN js || '-' || je END) AS supported FROM arms LEFT JOIN jn USING (gene_id, js, je) GROUP BY 1, 2, 3)
SELECT gene_id, s, e, greatest(CASE WHEN l > 0 AND r > 0 THEN least(l, r) ELSE 0 END, CASE WHEN coalesce(body, 0) > 0 AND (l > 0 OR r > 0) THEN least(body, greatest(l, r)) ELSE 0 END) AS inclusion, k AS exclusion, candidates, supported FROM b LEFT JOIN body USING (gene_id, s, e)""")
def event_evidence(spark, sf_dir):
    return V.skip_evidence(V.annotated_skips(_near(spark, sf_dir)), _junctions(spark, sf_dir), _reads(spark, sf_dir), ["gene_id"])


@query("ri_evidence", _X + _READS + _ARMS + " SELECT p.gene_id, js AS s, je AS e, cnt AS exclusion, count(rs) AS inclusion FROM (SELECT * FROM jn WHERE je - js BETWEEN 50 AND 50000) p LEFT JOIN gr ON gr.gene_id = p.gene_id AND NOT spliced AND rs < je AND re > js AND ((rs <= js + 10 AND re >= je - 10) OR (rs >= js AND re <= je AND re - rs > 50)) GROUP BY 1, 2, 3, 4")
def ri_evidence(spark, sf_dir):
    return V.retention_evidence(_junctions(spark, sf_dir), _reads(spark, sf_dir), ["gene_id"])


@query("known_junctions", _IV + ", q AS (SELECT DISTINCT chrom, s AS js, e AS je FROM iv WHERE id % 2 = 0), r AS (SELECT DISTINCT chrom, s AS js, e AS je FROM iv WHERE id % 2 = 1) SELECT * FROM q WHERE EXISTS (SELECT 1 FROM r WHERE r.chrom = q.chrom AND abs(r.js - q.js) <= 20 AND abs(r.je - q.je) <= 20)")
def known_junctions(spark, sf_dir):
    """Junctions with even ids are the query, those with odd ids the reference: together all rows."""
    rows = view(spark, sf_dir, "iv").select("id", "chrom", F.col("s").alias("js"), F.col("e").alias("je"))
    return V.known_junctions(rows.where("id % 2 = 0").drop("id").distinct(), rows.where("id % 2 = 1").drop("id"), ["chrom"], 20)


@query("long_read_psi", _X + """, se AS (SELECT DISTINCT n.gene_id, n.strand, up_e AS js, s, e, down_s AS je FROM near n JOIN intr i ON i.gene_id = n.gene_id AND i.js = up_e AND i.je = down_s AND i.tx <> n.tx),
ev AS (SELECT gene_id, gene_id || ':' || js || '_' || s || '_' || e || '_' || je AS event_id, js, s, e, je FROM se),
m AS (SELECT ev.event_id, i.tx, bool_or((abs(i.js - ev.js) <= 10 AND abs(i.je - ev.s) <= 10) OR (abs(i.js - ev.e) <= 10 AND abs(i.je - ev.je) <= 10)) AS inc, bool_or(abs(i.js - ev.js) <= 10 AND abs(i.je - ev.je) <= 10) AS exc FROM ev JOIN intr i ON i.gene_id = ev.gene_id GROUP BY 1, 2)
SELECT event_id, CAST(sum((inc AND NOT exc)::INT) AS BIGINT) AS inc, CAST(sum((exc AND NOT inc)::INT) AS BIGINT) AS exc FROM m GROUP BY event_id""")
def long_read_psi(spark, sf_dir):
    """Transcripts as long reads over the skipped exons of their genes."""
    near = _near(spark, sf_dir)
    coordinates = F.concat_ws(":", "gene_id", F.element_at(F.split("event_id", ":"), -1))
    events = E.skipped_exons(near).select("gene_id", coordinates.alias("event_id"), "inclusion", "exclusion")
    return V.event_reads(events, E.introns(near).select("gene_id", F.col("tx").alias("read"), "js", "je"), ["gene_id"])


@query("best_locus", _X + """, t AS (SELECT transcript_id, strand, gene, min(s) + gene * 9000 AS s, max(e) + gene * 9000 AS e FROM exons GROUP BY 1, 2, 3), l AS (SELECT gene AS locus, min(s) + gene * 9000 - 500 AS rs, max(e) + gene * 9000 + 2500 AS re, CASE WHEN gene % 3 = 0 THEN '.' ELSE min(strand) END AS ls FROM exons GROUP BY gene),
m AS (SELECT transcript_id, locus, least(e, re) - greatest(s, rs) AS shared FROM t JOIN l ON s < re AND rs < e AND (ls = '.' OR ls = t.strand)) SELECT transcript_id, locus, shared FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY shared DESC, locus) AS r FROM m) WHERE r = 1""")
def best_locus(spark, sf_dir):
    exons = view(spark, sf_dir, "exons")
    spans = exons.groupBy("chrom", "transcript_id", "strand", "gene").agg(F.min("s").alias("s"), F.max("e").alias("e")).selectExpr("chrom", "transcript_id", "strand", "s + gene * 9000 AS s", "e + gene * 9000 AS e")
    loci = exons.groupBy("chrom", F.col("gene").alias("locus")).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("strand").alias("strand"))
    loci = loci.selectExpr("chrom", "locus", "s + locus * 9000 - 500 AS rs", "e + locus * 9000 + 2500 AS re", "CASE WHEN locus % 3 = 0 THEN '.' ELSE strand END AS locus_strand")
    return V.best_locus(spans, loci, ["chrom"], "transcript_id").select("transcript_id", "locus", "shared")


_TWO = sql("iv", "blocks") + ", a AS (SELECT *, 'G' || (id % 7) AS gene FROM iv), b AS (SELECT chrom, id, s, e, 'g' || (id % 5) AS gene, id % 9 AS support FROM blocks)"


def _two(spark, sf_dir):
    targets = view(spark, sf_dir, "iv").selectExpr("*", "concat('G', id % 7) AS gene")
    return targets, view(spark, sf_dir, "blocks").selectExpr("chrom", "id AS rid", "s AS rs", "e AS re", "concat('g', id % 5) AS rgene", "id % 9 AS support")


_BEST = "SELECT id, rid FROM (SELECT a.id, b.id AS rid, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.s - b.s) + abs(a.e - b.e), lower(a.gene) <> lower(b.gene), b.support DESC, b.id) AS r FROM a JOIN b ON a.chrom = b.chrom AND {0}) WHERE r = 1"


@query("match_event", _TWO + _BEST.format("abs(a.s - b.s) <= 60 AND abs(a.e - b.e) <= 60"))
def match_event(spark, sf_dir):
    return V.matched(*_two(spark, sf_dir), ["chrom"], "id", 60).select("id", "rid")


@query("match_event_or_overlap", _TWO + _BEST.format("((abs(a.s - b.s) <= 20 AND abs(a.e - b.e) <= 20) OR (a.s < b.e AND b.s < a.e AND least(a.e, b.e) - greatest(a.s, b.s) >= 0.8 * least(a.e - a.s, b.e - b.s)))"))
def match_event_or_overlap(spark, sf_dir):
    return V.matched(*_two(spark, sf_dir), ["chrom"], "id", 20, 0.8).select("id", "rid")


@query("events_deduplicated", _EV + " SELECT event_type, gene, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, gene ORDER BY inc1 + exc1 DESC, k) AS r FROM ev) WHERE r = 1")
def events_deduplicated(spark, sf_dir):
    return V.deduplicated(view(spark, sf_dir, "ev"), ["event_type", "gene"], [F.desc(F.expr("inc1 + exc1")), "k"]).select("event_type", "gene", "event_id")


_HOT = "[" + ", ".join(f"(event_type = '{t}')::INT" for t in V.TYPES) + "]"


@query("event_features", _EV + f""" SELECT event_id, inc1 + exc1 AS total, round(CASE WHEN inc1 + exc1 > 0 THEN inc1 / (inc1 + exc1) ELSE 0.5 END, 9) AS psi, round(ln(1e0 + inc1 + exc1), 9) AS log_total, round(inc1 / greatest(inc1 + exc1, 1), 9) AS ratio,
round(CASE WHEN inc1 + exc1 > 0 THEN least(inc1, exc1) / greatest(inc1, exc1) ELSE 0 END, 9) AS balance, array_to_string({_HOT}, '') AS one_hot FROM ev""")
def event_features(spark, sf_dir):
    f = V.event_features(F.col("inc1"), F.col("exc1"), F.lit(0.0), F.lit(1.0), F.col("event_type"), F.lit(2), F.lit(1))
    rows = view(spark, sf_dir, "ev").select("event_id", f.alias("f"))
    return rows.select("event_id", "f.total", *(F.round(f"f.{c}", 9).alias(c) for c in ("psi", "log_total", "ratio", "balance")), F.array_join(F.col("f.one_hot").cast("array<string>"), "").alias("one_hot"))


@query("psi_features", _EV + " SELECT event_id, round(ln(1e0 + inc1), 9) AS a, round(ln(1e0 + exc1), 9) AS b, round(ln(1e0 + inc1 + exc1), 9) AS c, round(inc1 / greatest(inc1 + exc1, 1), 9) AS d, (k % 7) / 6e0 AS t, round(1 / greatest(sqrt(inc1 + exc1), 1), 9) AS u FROM ev")
def psi_features(spark, sf_dir):
    x = V.psi_features(F.col("inc1"), F.col("exc1"), F.lit(2), F.lit(1), F.col("k") % 7)
    rows = view(spark, sf_dir, "ev").select("event_id", x.alias("x"))
    return rows.select("event_id", *(F.round(F.col("x")[i], 9).alias(n) for i, n in ((0, "a"), (1, "b"), (2, "c"), (3, "d"))), F.col("x")[6].alias("t"), F.round(F.col("x")[7], 9).alias("u"))


@query("alt_junctions", _EV + ", r AS (SELECT event_id, 1000 + k % 90 AS les, 1400 + k % 70 AS lee, 1000 + k % 90 + 30 AS ses, 1400 + k % 70 - 30 AS see, CASE WHEN k % 2 = 0 THEN 2000 ELSE 100 END AS fes, CASE WHEN k % 2 = 0 THEN 2300 ELSE 400 END AS fee FROM ev) SELECT event_id, CASE WHEN fes >= lee THEN lee ELSE fee END AS is_, CASE WHEN fes >= lee THEN fes ELSE les END AS ie, CASE WHEN fes >= lee THEN see ELSE fee END AS xs, CASE WHEN fes >= lee THEN fes ELSE ses END AS xe FROM r")
def alt_junctions(spark, sf_dir):
    """The long and the short form's junction from the side on which the flanking exon lies."""
    rows = view(spark, sf_dir, "ev").selectExpr("event_id", "1000 + k % 90 AS les", "1400 + k % 70 AS lee", "1000 + k % 90 + 30 AS ses", "1400 + k % 70 - 30 AS see", "CASE WHEN k % 2 = 0 THEN 2000 ELSE 100 END AS fes", "CASE WHEN k % 2 = 0 THEN 2300 ELSE 400 END AS fee")
    down = F.col("fes") >= F.col("lee")
    pick = lambda a, b: F.when(down, F.col(a)).otherwise(F.col(b))
    return rows.select("event_id", pick("lee", "fee").alias("is_"), pick("fes", "les").alias("ie"), pick("see", "fee").alias("xs"), pick("fes", "ses").alias("xe"))


@query("jeffreys_dpsi", _EV + " SELECT event_id, round((inc1 + 0.5e0) / (inc1 + exc1 * len_ratio + 1) - (inc2 + 0.5e0) / (inc2 + exc2 * len_ratio + 1), 9) AS dpsi, inc1 + exc1 + inc2 + exc2 AS support FROM ev")
def jeffreys_dpsi(spark, sf_dir):
    from spliceflow.functions import calibration as C

    mean = lambda g: C.beta_mean(F.col(f"inc{g}"), F.col(f"exc{g}") * F.col("len_ratio"))
    return view(spark, sf_dir, "ev").select("event_id", F.round(mean(1) - mean(2), 9).alias("dpsi"), F.expr("inc1 + exc1 + inc2 + exc2").alias("support"))
