"""Queries of the event detectors and of junction counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spliceflow.operators import events as E
from spliceflow.plans.domain import sql, view
from spliceflow.plans.registry import query

_X = sql("exons") + """, near AS (SELECT *, lag(e) OVER w AS up_e, lead(s) OVER w AS down_s, row_number() OVER w AS nth, row_number() OVER (PARTITION BY tx ORDER BY s DESC) AS nth_last FROM exons WINDOW w AS (PARTITION BY tx ORDER BY s)),
intr AS (SELECT gene_id, strand, tx, e AS js, down_s AS je FROM near WHERE down_s IS NOT NULL)"""


def _near(spark, sf_dir):
    return E.with_neighbours(view(spark, sf_dir, "exons"))


def _ids(rows):
    return rows.select("gene_id", "event_id").distinct()


_SE = " SELECT DISTINCT n.gene_id, 'SE:chr1:' || n.strand || ':' || up_e || '_' || s || '_' || e || '_' || down_s AS event_id FROM near n JOIN intr i ON i.gene_id = n.gene_id AND i.js = up_e AND i.je = down_s AND i.tx <> n.tx"
_A5 = " SELECT DISTINCT a.gene_id, CASE WHEN a.strand = '-' THEN 'A3SS' ELSE 'A5SS' END || ':chr1:' || a.strand || ':' || a.js || '_' || b.js || '_' || a.je AS event_id FROM intr a JOIN intr b ON a.gene_id = b.gene_id AND a.je = b.je AND a.js < b.js AND a.tx <> b.tx"
_A3 = " SELECT DISTINCT a.gene_id, CASE WHEN a.strand = '-' THEN 'A5SS' ELSE 'A3SS' END || ':chr1:' || a.strand || ':' || a.js || '_' || a.je || '_' || b.je AS event_id FROM intr a JOIN intr b ON a.gene_id = b.gene_id AND a.js = b.js AND a.je < b.je AND a.tx <> b.tx"
_MX = " SELECT DISTINCT a.gene_id, 'MXE:chr1:' || a.strand || ':' || a.up_e || '_' || a.s || '_' || a.e || '_' || b.s || '_' || b.e || '_' || a.down_s AS event_id FROM near a JOIN near b ON a.gene_id = b.gene_id AND a.up_e = b.up_e AND a.down_s = b.down_s AND a.tx <> b.tx AND b.s > a.e"
_RI = " SELECT DISTINCT i.gene_id, 'RI:chr1:' || i.strand || ':' || js || '_' || je AS event_id FROM near n JOIN intr i ON i.gene_id = n.gene_id AND n.s <= js AND n.e >= je AND i.tx <> n.tx"
_AF = " SELECT DISTINCT a.gene_id, 'AFE:chr1:' || a.strand || ':' || a.s || '_' || a.e || '_' || b.s || '_' || b.e || '_' || a.down_s AS event_id FROM near a JOIN near b ON a.gene_id = b.gene_id AND a.nth = 1 AND b.nth = 1 AND a.down_s = b.down_s AND a.tx < b.tx AND a.s <= b.s AND (a.s, a.e) <> (b.s, b.e)"
_AL = " SELECT DISTINCT a.gene_id, 'ALE:chr1:' || a.strand || ':' || a.up_e || '_' || a.s || '_' || a.e || '_' || b.s || '_' || b.e AS event_id FROM near a JOIN near b ON a.gene_id = b.gene_id AND a.nth_last = 1 AND b.nth_last = 1 AND a.up_e = b.up_e AND a.tx < b.tx AND a.s <= b.s AND (a.s, a.e) <> (b.s, b.e)"
_ALL = " UNION ".join(x for x in (_SE, _A5, _A3, _MX, _RI, _AF, _AL))


@query("detect_se", _X + _SE)
def detect_se(spark, sf_dir):
    return _ids(E.skipped_exons(_near(spark, sf_dir)))


@query("detect_a5ss", _X + _A5)
def detect_a5ss(spark, sf_dir):
    return _ids(E.alternative_donors(_near(spark, sf_dir)))


@query("detect_a3ss", _X + _A3)
def detect_a3ss(spark, sf_dir):
    return _ids(E.alternative_acceptors(_near(spark, sf_dir)))


@query("detect_mxe", _X + _MX)
def detect_mxe(spark, sf_dir):
    return _ids(E.mutually_exclusive(_near(spark, sf_dir)))


@query("detect_ri", _X + _RI)
def detect_ri(spark, sf_dir):
    return _ids(E.retained_introns(_near(spark, sf_dir)))


@query("detect_afe", _X + _AF)
def detect_afe(spark, sf_dir):
    return _ids(E.alternative_first(_near(spark, sf_dir)))


@query("detect_ale", _X + _AL)
def detect_ale(spark, sf_dir):
    return _ids(E.alternative_last(_near(spark, sf_dir)))


@query("event_type_summary", _X + f", v AS ({_ALL}) SELECT split_part(event_id, ':', 1) AS event_type, count(*) AS n, count(DISTINCT gene_id) AS genes FROM v GROUP BY 1")
def event_type_summary(spark, sf_dir):
    return E.detect(view(spark, sf_dir, "exons")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("gene_id").alias("genes"))


@query("top_genes", _X + f", v AS ({_ALL}) SELECT gene_id, count(*) AS n FROM v GROUP BY gene_id ORDER BY n DESC, gene_id LIMIT 20")
def top_genes(spark, sf_dir):
    return E.detect(view(spark, sf_dir, "exons")).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gene_id").limit(20)


_JN = ", jn AS (SELECT js, je, count(*) * (js % 7 + 1) AS cnt, CASE (js // 50) % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS st FROM intr GROUP BY js, je)"


def _junctions(spark, sf_dir):
    rows = E.introns(_near(spark, sf_dir)).groupBy("chrom", "js", "je").agg(F.count(F.lit(1)).alias("n"))
    return rows.selectExpr("chrom", "js", "je", "n * (js % 7 + 1) AS count", "CASE (js div 50) % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS strand")


_PSI = _X + _JN + """, se AS (SELECT DISTINCT n.gene_id, n.strand, up_e AS js, s, e, down_s AS je FROM near n JOIN intr i ON i.gene_id = n.gene_id AND i.js = up_e AND i.je = down_s AND i.tx <> n.tx),
k AS (SELECT *, CASE strand WHEN '+' THEN 0 ELSE 1 END AS code FROM se),
c AS (SELECT gene_id, 'SE:chr1:' || strand || ':' || js || '_' || s || '_' || e || '_' || je AS event_id, coalesce((SELECT sum(cnt) FROM jn WHERE jn.js = k.js AND jn.je = k.s AND st IN (code, -1)), 0) + coalesce((SELECT sum(cnt) FROM jn WHERE jn.js = k.e AND jn.je = k.je AND st IN (code, -1)), 0) AS inc, coalesce((SELECT sum(cnt) FROM jn WHERE jn.js = k.js AND jn.je = k.je AND st IN (code, -1)), 0) AS exc FROM k)"""


@query("junction_psi", _PSI + " SELECT gene_id, event_id, CAST(inc AS BIGINT) AS inc, CAST(exc AS BIGINT) AS exc, round(CASE WHEN inc + exc > 0 THEN inc / 2 / (inc / 2 + exc) END, 9) AS psi FROM c")
def junction_psi(spark, sf_dir):
    out = E.junction_counts(E.skipped_exons(_near(spark, sf_dir)), _junctions(spark, sf_dir))
    return out.select("gene_id", "event_id", "inc", "exc", F.round("psi", 9).alias("psi"))


@query("event_score", _PSI + " SELECT gene_id, event_id, round(1 / (1 + exp(-(ln(1 + inc + exc) * 0.3 + (1 - 1e0 / (1 + inc + exc)) * 0.4 + CASE WHEN greatest(inc, exc) > 0 THEN least(inc, exc) / greatest(inc, exc) ELSE 0 END * 0.3))), 6) AS score FROM c")
def event_score(spark, sf_dir):
    out = E.junction_counts(E.skipped_exons(_near(spark, sf_dir)), _junctions(spark, sf_dir))
    total = F.col("inc") + F.col("exc")
    return out.select("gene_id", "event_id", F.round(E.score(total, F.lit(1.0) / (1 + total), F.col("inc"), F.col("exc")), 6).alias("score"))


@query("denovo_se", _X + _JN + " SELECT j.js, a.je AS s, b.js AS e, j.je FROM jn j JOIN jn a ON a.js = j.js JOIN jn b ON b.je = j.je WHERE a.je < b.js AND b.js <= a.je + 50000 AND a.je < j.je AND b.js > j.js")
def denovo_se(spark, sf_dir):
    return E.de_novo_skips(_junctions(spark, sf_dir)).select("js", "s", "e", "je")


@query("intron_body_reads", _X + ", r AS (SELECT concat('G', CAST(l_orderkey // 32 AS VARCHAR)) AS gene_id, l_orderkey * 13 % 8000 AS rs, l_orderkey * 13 % 8000 + 40 + l_partkey % 900 AS re, l_suppkey % 3 = 0 AS spliced FROM lineitem), i AS (SELECT DISTINCT gene_id, js AS s, je AS e FROM intr) SELECT i.gene_id, s, e, count(rs) AS body FROM i LEFT JOIN r ON i.gene_id = r.gene_id AND NOT spliced AND rs < e AND re > s AND ((rs <= s + 10 AND re >= e - 10) OR (rs >= s AND re <= e AND re - rs > 50)) GROUP BY i.gene_id, s, e")
def intron_body_reads(spark, sf_dir):
    reads = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("concat('G', cast(l_orderkey div 32 as string)) AS gene_id", "l_orderkey * 13 % 8000 AS rs", "l_orderkey * 13 % 8000 + 40 + l_partkey % 900 AS re", "l_suppkey % 3 = 0 AS spliced")
    spans = E.introns(_near(spark, sf_dir)).select("gene_id", F.col("js").alias("s"), F.col("je").alias("e")).distinct()
    return E.body_reads(spans, reads, ["gene_id"]).select("gene_id", "s", "e", "body")
