"""Caller tables as event DataFrames of one schema. Every field is read as text and cast; headers are read on the driver.

Columns: event_id, event_type, gene, chrom, caller, dpsi, fdr, pvalue, total_support, sampling_std, group1_psi, group2_psi, caller_low,
caller_high. What a caller doesn't give is null, never a stand-in number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceflow.functions import parsing as P
from spliceflow.functions.calibration import beta_dpsi_std

EVENT_COLUMNS = ("event_id", "event_type", "gene", "chrom", "caller", "dpsi", "fdr", "pvalue", "total_support", "sampling_std", "group1_psi", "group2_psi", "caller_low", "caller_high")
RMATS_TYPES = ("SE", "A3SS", "A5SS", "MXE", "RI")
#: Suffixes of the event tables, in order of preference; count columns that must be there; coordinates by type.
RMATS_SUFFIXES = ("MATS.JunctionCountOnly.txt", "MATS.JC.txt", "MATS.JCEC.txt")
COUNT_COLUMNS = ("IJC_SAMPLE_1", "SJC_SAMPLE_1", "IJC_SAMPLE_2", "SJC_SAMPLE_2")
COORDINATES = {
    "SE": ("upstreamEE", "exonStart_0base", "exonEnd", "downstreamES"),
    "RI": ("upstreamEE", "downstreamES"),
    "A3SS": ("longExonStart_0base", "longExonEnd", "shortES", "shortEE", "flankingES", "flankingEE"),
    "A5SS": ("longExonStart_0base", "longExonEnd", "shortES", "shortEE", "flankingES", "flankingEE"),
    "MXE": ("upstreamEE", "1stExonStart_0base", "1stExonEnd", "2ndExonStart_0base", "2ndExonEnd", "downstreamES"),
}


def _table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table of text columns; a byte-order mark and spaces around header cells go."""
    rows = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote="", escape="")
    return rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))


def _find(names: list[str], *candidates: str, override: str | None = None) -> str | None:
    """The column named exactly so by an override, else the first whose name contains a candidate, in the candidates' order."""
    if override is not None:
        found = [n for n in names if n.strip() == override.strip()]
        if len(found) != 1:
            raise ValueError(f"column {override!r} is in the header {len(found)} times")
        return found[0]
    return next((n for c in candidates for n in names if c.lower() in n.lower()), None)


def _number(name: str | None) -> Column:
    return P.float_or_null(F.col(f"`{name}`")) if name else F.lit(None).cast("double")


def _text(name: str | None) -> Column:
    return F.trim(F.translate(F.col(f"`{name}`"), '"', "")) if name else F.lit(None).cast("string")


def _as_events(rows: DataFrame, **columns: Column) -> DataFrame:
    kind = {"event_id": "string", "event_type": "string", "gene": "string", "chrom": "string", "caller": "string"}
    return rows.select(*(columns.get(c, F.lit(None)).cast(kind.get(c, "double")).alias(c) for c in EVENT_COLUMNS))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def rmats_counts(spark: SparkSession, folder: str, types: tuple[str, ...] = RMATS_TYPES, min_total: int = 0, strict: bool = False) -> DataFrame:
    """Events with their replicate vectors: event_id, event_type, gene, chrom, strand, inc1, exc1, inc2, exc2, inc_len, skip_len, fdr, dpsi, total.

    Rows whose vectors can't be read are left out, or raise when strict. Tables lacking a count column raise.
    """
    parts = []
    for kind in types:
        path = next((p for s in RMATS_SUFFIXES if _exists(spark, p := f"{folder}/{kind}.{s}")), None)
        if path is None:
            continue
        rows = _table(spark, path)
        lacking = [c for c in COUNT_COLUMNS if c not in rows.columns]
        if lacking:
            raise ValueError(f"{path} lacks the columns {lacking}")
        have = lambda c, rows=rows: F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string")
        vectors = {n: P.count_vector(F.col(c)) for n, c in zip(("inc1", "exc1", "inc2", "exc2"), COUNT_COLUMNS, strict=True)}
        made = rows.withColumns(vectors)
        good = reduce(lambda a, n: a & F.col(n).isNotNull(), vectors, F.lit(True))
        if strict:
            made = made.withColumn("inc1", F.when(good, F.col("inc1")).otherwise(F.raise_error(F.lit(f"{path} has a row with unreadable counts")).cast("array<int>")))
        made = made.where(good)
        total = sum((F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x) for n in vectors), F.lit(0).cast("long"))
        parts.append(made.select(
            P.event_id(F.lit(kind), _text("chr") if "chr" in rows.columns else F.lit(""), _text("strand") if "strand" in rows.columns else F.lit("."), *(have(c) for c in COORDINATES[kind])).alias("event_id"),
            F.lit(kind).alias("event_type"), P.gene_name(have("geneSymbol"), have("GeneID")).alias("gene"), have("chr").alias("chrom"), have("strand").alias("strand"), *vectors,
            P.float_or_null(have("IncFormLen")).alias("inc_len"), P.float_or_null(have("SkipFormLen")).alias("skip_len"), P.float_or_null(have("FDR")).alias("fdr"), P.float_or_null(have("PValue")).alias("pvalue"), P.float_or_null(have("IncLevelDifference")).alias("dpsi"),
            P.inclusion_mean(have("IncLevel1")).alias("psi1"), P.inclusion_mean(have("IncLevel2")).alias("psi2"), total.alias("total"),
        ).where(F.col("total") >= min_total))
    if not parts:
        raise FileNotFoundError(f"no event tables in {folder}")
    return reduce(DataFrame.unionByName, parts)


def rmats(spark: SparkSession, folder: str, min_support: int = 0, strict: bool = False) -> DataFrame:
    """Events with a finite change between -1 and 1; the deviation is that of the pooled counts, exclusion scaled by form lengths."""
    rows = rmats_counts(spark, folder, min_total=min_support, strict=strict).where("dpsi between -1 and 1")
    total = lambda n: F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
    ratio = F.when(F.col("skip_len") > 0, F.col("inc_len") / F.col("skip_len")).otherwise(F.lit(1.0))
    ratio = F.coalesce(ratio, F.lit(1.0))
    std = beta_dpsi_std(total("inc1"), total("exc1") * ratio, total("inc2"), total("exc2") * ratio)
    return _as_events(rows, event_id=F.col("event_id"), event_type=F.col("event_type"), gene=F.col("gene"), chrom=F.col("chrom"), caller=F.lit("rmats"), dpsi=F.col("dpsi"), fdr=F.col("fdr"), pvalue=F.col("pvalue"), total_support=F.col("total"), sampling_std=std, group1_psi=F.col("psi1"), group2_psi=F.col("psi2"))


def majiq(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """One event a row: the junction with the largest change and its own probability; p is one minus it."""
    rows, own = _table(spark, path), columns or {}
    n = rows.columns
    dpsi = _find(n, "E(dPSI)", "mean_dpsi", "dpsi", override=own.get("dpsi"))
    prob = _find(n, "P(|dPSI|", "P(abs", "probability_changing", "prob", override=own.get("probability"))
    if dpsi is None:
        raise ValueError(f"{path}: no column of changes")
    picked = rows.withColumn("__p", P.most_changing(F.col(f"`{dpsi}`"), F.col(f"`{prob}`") if prob else F.lit(None).cast("string")))
    p = F.when(F.col("__p.probability").between(0, 1), 1 - F.col("__p.probability"))
    out = _as_events(picked, event_id=_text(_find(n, "lsv_id", "event_id", override=own.get("id"))), event_type=F.lit("LSV"), gene=_text(_find(n, "gene_name", "gene", override=own.get("gene"))), caller=F.lit("majiq"), dpsi=F.col("__p.dpsi"), pvalue=p, total_support=_number(_find(n, "num_reads", "support", override=own.get("support"))))
    return out.where("dpsi between -1 and 1")


def suppa2(spark: SparkSession, path: str, contrast: str | None = None) -> DataFrame:
    """A .dpsi table, whose id column has no header: each row holds the id and then a value for each header cell."""
    lines = spark.read.text(path)
    header = [h.strip() for h in lines.first()[0].lstrip("﻿").split("\t")]
    wide = header[0] == "" or not header[0].lower().endswith(("_dpsi", "_p-val"))
    names = header[1:] if wide else header
    dpsi = _find(names, f"{contrast}_dpsi" if contrast else "_dpsi")
    if dpsi is None:
        raise ValueError(f"{path}: no column of changes")
    pval = _find(names, dpsi[: -len("_dPSI")] + "_p-val")
    cells = F.split("value", "\t")
    rows = lines.where((F.col("value") != lines.first()[0]) & (F.trim("value") != "")).select(F.get(cells, 0).alias("id"), *(F.get(cells, i + 1).alias(c) for i, c in enumerate(names)))
    out = _as_events(rows, event_id=F.col("id"), event_type=P.event_type_of_tag(F.col("id")), gene=F.substring_index("id", ";", 1), caller=F.lit("suppa2"), dpsi=_number(dpsi), pvalue=_number(pval))
    return out.where("dpsi between -1 and 1")


def betas(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """A table with interval bounds; the deviation is that of a normal 95 % interval."""
    rows, own = _table(spark, path), columns or {}
    n = rows.columns
    low, high = (_number(_find(n, *c, override=own.get(c[0]))) for c in (("lower", "low"), ("upper", "high")))
    out = _as_events(rows, event_id=_text(_find(n, "event_id", "event", override=own.get("id"))), event_type=F.lit("SE"), gene=_text(_find(n, "gene", override=own.get("gene"))), caller=F.lit("betas"), dpsi=_number(_find(n, "deltapsi", "dpsi", override=own.get("dpsi"))), fdr=_number(_find(n, "fdr", override=own.get("fdr"))), sampling_std=P.interval_std(low, high), caller_low=low, caller_high=high)
    return out.where("dpsi between -1 and 1")


CALLERS: dict[str, Callable[..., DataFrame]] = {"rmats": rmats, "majiq": majiq, "suppa2": suppa2, "betas": betas}


def read_caller(spark: SparkSession, caller: str, path: str, **how) -> DataFrame:
    """Events of a registered caller; register more by adding to CALLERS."""
    if caller not in CALLERS:
        raise ValueError(f"unknown caller {caller!r}; known: {sorted(CALLERS)}")
    return CALLERS[caller](spark, path, **how)
