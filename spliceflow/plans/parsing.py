"""Queries of the caller-field parsers, over fields written from the event counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spliceflow.functions import parsing as P
from spliceflow.plans.domain import sql, view
from spliceflow.plans.registry import query

_FIELDS = """SELECT event_id, event_type, gene,
  CASE k % 6 WHEN 0 THEN concat(cast(inc1 as string), ',', cast(exc1 as string)) WHEN 1 THEN concat(cast(inc1 as string), ',NA') WHEN 2 THEN concat(cast(inc1 as string), ',,', cast(exc1 as string)) WHEN 3 THEN '' WHEN 4 THEN concat('-', cast(inc1 + 1 as string)) ELSE concat('"', cast(inc2 as string), '", 3,') END AS vec,
  CASE k % 5 WHEN 0 THEN concat('0.', cast(k % 89 as string), ',NA,0.5') WHEN 1 THEN 'NA' WHEN 2 THEN 'inf,0.25' WHEN 3 THEN 'x,0.125,"0.75"' ELSE NULL END AS lvl,
  CASE k % 4 WHEN 0 THEN concat('0.', cast(k % 9 + 1 as string), ';-0.', cast(k % 7 + 1 as string), ';0.', cast(k % 9 + 1 as string)) WHEN 1 THEN concat('NA,-0.', cast(k % 8 + 1 as string)) WHEN 2 THEN 'NA' ELSE '-0.5;0.5' END AS dp,
  CASE k % 3 WHEN 0 THEN '0.9;0.8;0.7' WHEN 1 THEN '0.6' ELSE NULL END AS pr,
  concat(gene, CASE k % 6 WHEN 0 THEN ';A3:chr1:' WHEN 1 THEN ';a5:chr1:' WHEN 2 THEN ';MX:chr1:' WHEN 3 THEN ';AF:chr1:' WHEN 4 THEN ';ZZ:chr1:' ELSE ':chr1:' END, cast(k as string)) AS tagged,
  CASE k % 5 WHEN 0 THEN concat('=', gene) WHEN 1 THEN '-1' WHEN 2 THEN '@x' ELSE gene END AS cell,
  CASE k % 4 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN concat('"', gene, '"') ELSE NULL END AS symbol, inc1, exc1, inc2, exc2, k FROM {ev}"""


def _rows(spark, sf_dir):
    return spark.sql(_FIELDS, ev=view(spark, sf_dir, "ev"))


_SQL = sql("ev") + ", f AS (" + _FIELDS.replace("{ev}", "ev").replace(" as string)", " as varchar)") + ")"
_NUM = "CASE WHEN upper(trim(replace({0}, '\"', ''))) NOT IN ('', 'NA', 'NAN', 'NULL') AND isfinite(try_cast(trim(replace({0}, '\"', '')) AS DOUBLE)) THEN try_cast(trim(replace({0}, '\"', '')) AS DOUBLE) END"


@query("count_vector", _SQL + r""", p AS (SELECT event_id, regexp_replace(replace(replace(vec, '"', ''), ' ', ''), '(^|,)((NA)?(,(NA)?)*)$', '') AS t FROM f)
SELECT event_id, CASE WHEN t = '' THEN '' WHEN regexp_full_match(t, '\d+(,\d+)*') THEN t END AS counts FROM p""")
def count_vector(spark, sf_dir):
    return _rows(spark, sf_dir).select("event_id", P.count_vector(F.col("vec")).alias("v")).select("event_id", F.when(F.col("v").isNotNull(), F.array_join(F.col("v").cast("array<string>"), ",")).alias("counts"))


@query("inc_level_mean", _SQL + f""", u AS (SELECT event_id, unnest(string_split(lvl, ',')) AS x FROM f WHERE lvl IS NOT NULL), m AS (SELECT event_id, avg({_NUM.format('x')}) AS psi FROM u GROUP BY event_id)
SELECT f.event_id, round(psi, 9) AS psi FROM f LEFT JOIN m USING (event_id)""")
def inc_level_mean(spark, sf_dir):
    return _rows(spark, sf_dir).select("event_id", F.round(P.inclusion_mean(F.col("lvl")), 9).alias("psi"))


@query("majiq_pick", _SQL + f""", d AS (SELECT event_id, i, {_NUM.format('x')} AS x FROM (SELECT event_id, unnest(string_split(replace(dp, ',', ';'), ';')) AS x, generate_subscripts(string_split(replace(dp, ',', ';'), ';'), 1) AS i FROM f)),
p AS (SELECT event_id, i, {_NUM.format('x')} AS pr FROM (SELECT event_id, unnest(string_split(replace(pr, ',', ';'), ';')) AS x, generate_subscripts(string_split(replace(pr, ',', ';'), ';'), 1) AS i FROM f WHERE pr IS NOT NULL)),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(x) DESC, i) AS r FROM d WHERE x IS NOT NULL)
SELECT f.event_id, b.x AS dpsi, p.pr AS probability FROM f LEFT JOIN b ON f.event_id = b.event_id AND r = 1 LEFT JOIN p ON p.event_id = b.event_id AND p.i = b.i""")
def majiq_pick(spark, sf_dir):
    return _rows(spark, sf_dir).select("event_id", P.most_changing(F.col("dp"), F.col("pr")).alias("b")).select("event_id", "b.dpsi", "b.probability")


@query("suppa_tag", _SQL + " SELECT event_id, CASE upper(regexp_extract(tagged, ';([A-Za-z0-9]+):', 1)) WHEN 'A3' THEN 'A3SS' WHEN 'A5' THEN 'A5SS' WHEN 'MX' THEN 'MXE' WHEN 'RI' THEN 'RI' WHEN 'AF' THEN 'AFE' WHEN 'AL' THEN 'ALE' ELSE 'SE' END AS event_type FROM f")
def suppa_tag(spark, sf_dir):
    return _rows(spark, sf_dir).select("event_id", P.event_type_of_tag(F.col("tagged")).alias("event_type"))


@query("csv_guard", _SQL + r" SELECT event_id, CASE WHEN regexp_matches(cell, '^[=+\-@\t\r\n'']') THEN '''' || cell ELSE cell END AS cell FROM f")
def csv_guard(spark, sf_dir):
    return _rows(spark, sf_dir).select("event_id", P.safe_cell(F.col("cell")).alias("cell"))


@query("gene_name", _SQL + """ SELECT event_id, CASE WHEN trim(replace(coalesce(symbol, ''), '"', '')) NOT IN ('', 'NA') THEN trim(replace(symbol, '"', '')) ELSE gene END AS gene FROM f""")
def gene_name(spark, sf_dir):
    return _rows(spark, sf_dir).select("event_id", P.gene_name(F.col("symbol"), F.col("gene")).alias("gene"))


@query("event_id", _SQL + " SELECT event_type || ':chr1:' || inc1 || '-' || exc1 || '-' || inc2 || ':+' AS id, event_id FROM f")
def event_id(spark, sf_dir):
    return _rows(spark, sf_dir).select(P.event_id(F.col("event_type"), F.lit("chr1"), F.lit("+"), F.col("inc1"), F.col("exc1"), F.col("inc2")).alias("id"), "event_id")


@query("float_na", _SQL + f" SELECT event_id, {_NUM.format('dp')} AS a, {_NUM.format('lvl')} AS b FROM f")
def float_na(spark, sf_dir):
    return _rows(spark, sf_dir).select("event_id", P.float_or_null(F.col("dp")).alias("a"), P.float_or_null(F.col("lvl")).alias("b"))


@query("betas_sd", _SQL + " SELECT event_id, round(CASE WHEN inc1 <= exc1 THEN (exc1 - inc1) / 100e0 / (2 * 1.959963984540054e0) END, 9) AS sd FROM f")
def betas_sd(spark, sf_dir):
    return _rows(spark, sf_dir).select("event_id", F.round(P.interval_std(F.col("inc1") / 100, F.col("exc1") / 100), 9).alias("sd"))


@query("csv_restore", _SQL + " SELECT event_id, cell FROM f")
def csv_restore(spark, sf_dir):
    """What the guard was given comes back."""
    return _rows(spark, sf_dir).select("event_id", P.restored_cell(P.safe_cell(F.col("cell"))).alias("cell"))


@query("region_strings", sql("iv") + " SELECT id, 'chr' || chrom AS chrom, s, e FROM iv")
def region_strings(spark, sf_dir):
    """Places written as text with thousands separated, and read again."""
    rows = view(spark, sf_dir, "iv").select("id", P.region(F.format_string("chr%d:%,d-%,d", F.col("chrom"), F.col("s") + 1, F.col("e"))).alias("r"))
    return rows.select("id", "r.chrom", "r.s", "r.e")
