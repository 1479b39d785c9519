"""Splicing tables derived from the driver's star schema.

Each view is one text for both engines: {table} names an input and `div` is integer division.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_Q = "cast(l_quantity as bigint)"
VIEWS: dict[str, str] = {
    # Two-group event counts.
    "ev": f"""
        SELECT k, concat('E', cast(k as string)) AS event_id,
               CASE k % 5 WHEN 0 THEN 'SE' WHEN 1 THEN 'A3SS' WHEN 2 THEN 'A5SS' WHEN 3 THEN 'MXE' ELSE 'RI' END AS event_type,
               concat('G', cast(k % 97 as string)) AS gene,
               i1 div s AS inc1, e1 div s AS exc1, i2 div s AS inc2, e2 div s AS exc2,
               CASE WHEN k % 3 = 0 THEN 2.0E0 ELSE 1.0E0 END AS len_ratio,
               CASE WHEN k % 11 = 0 THEN NULL ELSE cast((k * 37) % 100 as double) / 100 END AS fdr
        FROM (SELECT l_partkey AS k, cast(power(2, l_partkey % 7) as bigint) AS s,
                     cast(sum(CASE WHEN l_linestatus = 'O' AND (l_returnflag = 'N' OR l_partkey % 4 = 0) THEN {_Q} ELSE 0 END) as bigint) AS i1,
                     cast(sum(CASE WHEN l_linestatus = 'O' AND NOT (l_returnflag = 'N' OR l_partkey % 4 = 0) THEN {_Q} ELSE 0 END) as bigint) AS e1,
                     cast(sum(CASE WHEN l_linestatus <> 'O' AND (l_returnflag = 'N' OR (l_partkey % 4 = 1 AND l_returnflag = 'A')) THEN {_Q} ELSE 0 END) as bigint) AS i2,
                     cast(sum(CASE WHEN l_linestatus <> 'O' AND NOT (l_returnflag = 'N' OR (l_partkey % 4 = 1 AND l_returnflag = 'A')) THEN {_Q} ELSE 0 END) as bigint) AS e2
              FROM {{lineitem}} GROUP BY l_partkey) g""",
    # Estimates with truth, scale and support for calibration; one row an order.
    "cal": """
        SELECT o_orderkey AS id, cast(o_orderkey % 3 as int) AS fold,
               cast((o_custkey * 13 + o_orderkey) % 201 - 100 as double) / 100 AS estimate,
               cast((o_custkey * 13 + o_orderkey * 7) % 201 - 100 as double) / 100 AS truth,
               cast(o_orderkey % 17 + 1 as double) / 16 AS scale,
               cast(o_custkey % 400 as double) AS support,
               CASE o_orderkey % 5 WHEN 0 THEN 'SE' WHEN 1 THEN 'A3SS' WHEN 2 THEN 'A5SS' WHEN 3 THEN 'MXE' ELSE 'RI' END AS event_type
        FROM {orders}""",
    # Genomic intervals, half open: clusters on five chromosomes, as dense whatever the number of orders, and a sixth of all rows piled up on
    # 100,000 bases of a sixth chromosome, where some are a megabase long.
    "iv": """
        SELECT id, chrom, s, s + CASE WHEN id % 6000 = 5 THEN 1000000 ELSE 1 + c % 200 END AS e FROM
          (SELECT o_orderkey AS id, o_custkey AS c, cast(CASE WHEN o_orderkey % 6 = 5 THEN 5 ELSE o_custkey % 5 END as int) AS chrom,
                  CASE WHEN o_orderkey % 6 = 5 THEN o_orderkey * 7 % 100000 ELSE o_orderkey * 7 + (o_orderkey div 64) * 4000 END AS s FROM {orders}) o""",
    # Exons of transcripts, at most one row for each order and line number.
    "exons": """
        SELECT concat('T', cast(o as string)) AS transcript_id, concat('G', cast(o div 32 as string)) AS gene_id, 'chr1' AS chrom,
               CASE WHEN (o div 32) % 2 = 0 THEN '+' ELSE '-' END AS strand, o AS tx, o div 32 AS gene,
               ln * 1000 + (p % 3) * 50 AS s, CASE WHEN p % 7 = 0 THEN ln * 1000 + 1400 ELSE ln * 1000 + 300 + (su % 3) * 50 END AS e
        FROM (SELECT *, lag(p) OVER (PARTITION BY o ORDER BY ln) AS before, lag(ln) OVER (PARTITION BY o ORDER BY ln) AS ln_before FROM
               (SELECT l_orderkey AS o, cast(l_linenumber as bigint) AS ln, l_partkey AS p, l_suppkey AS su,
                       row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS r FROM {lineitem}) a WHERE r = 1) b
        WHERE p % 5 <> 0 AND NOT coalesce(before % 7 = 0 AND ln_before = ln - 1, false)""",
    # Aligned reads as alternating match and skip lengths, piled up on the sixth chromosome too.
    "reads": """
        SELECT event_id AS id, cast(CASE WHEN event_id % 6 = 5 THEN 5 ELSE user_id % 5 END as int) AS chrom, CASE WHEN event_id % 6 = 5 THEN event_id * 7 % 50000 ELSE event_id * 7 + (event_id div 64) * 4000 END AS s, cast(event_id % 60 as int) AS mapq, cast((user_id % 3) * 16 + (event_id % 2) * 256 as int) AS flag,
               20 + event_id % 30 AS m1, 60 + user_id % 90 AS n1, 5 + event_id % 41 AS m2, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 80 + user_id % 50 END AS n2, 10 + user_id % 25 AS m3
        FROM {events}""",
    # Nucleotide sequences from the whole texts of the documents.
    "dna": """
        SELECT doc_id AS id, translate(lower(text), 'etaoinshrdlucmfwypvbgkjqxz .,' , 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM {documents}""",
    # Scores with two-class labels.
    "scored": """
        SELECT l.doc_id AS id, cast(l.quality as int) AS label, cast(d.n_chars % 1000 as double) / 1000 + cast(l.quality as double) / 4 AS score, d.source AS grp
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL""",
}

# All aligned blocks of the reads; without a second skip the last two are one.
_R = f"({VIEWS['reads']}) r"
VIEWS["blocks"] = f"""
        SELECT id * 4 AS id, chrom, s, s + m1 AS e FROM {_R} UNION ALL
        SELECT id * 4 + 1, chrom, s + m1 + n1, s + m1 + n1 + m2 + CASE WHEN n2 = 0 THEN m3 ELSE 0 END FROM {_R} UNION ALL
        SELECT id * 4 + 2, chrom, s + m1 + n1 + m2 + n2, s + m1 + n1 + m2 + n2 + m3 FROM {_R} WHERE n2 > 0"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **tables)


def sql(*names: str) -> str:
    """The views as the beginning of a DuckDB query."""
    bodies = []
    for name in names:
        text = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name]).replace(" div ", " // ").replace(" as string)", " as varchar)")
        bodies.append(f"{name} AS ({text})")
    return "WITH " + ", ".join(bodies)
