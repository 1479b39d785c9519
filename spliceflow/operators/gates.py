"""Searches for thresholds and factors, from counted values, and proposals from junctions alone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.operators.intervals import islands, overlap_join
from spliceflow.operators.ranks import running


def calibration_factor(rows: DataFrame, keys: list[str], factor: str, target: float) -> DataFrame:
    """keys, n, factor: the order statistic at ceil(target * n) of the required factors, at least 1."""
    counts = rows.groupBy(*keys, factor).agg(F.count(F.lit(1)).alias("here"))
    ranked = running(counts, keys, factor, "here").withColumn("n", F.col("total_here"))
    place = F.greatest(F.ceil(F.col("n").cast("decimal(18,0)") * F.lit(f"{target:.6f}").cast("decimal(8,6)")).cast("long"), F.lit(1))
    return ranked.where(F.col("before_here") + F.col("here") >= place).groupBy(*keys, "n").agg(F.greatest(F.lit(1.0), F.min(factor)).alias("factor"))


def largest_threshold(rows: DataFrame, keys: list[str], value: str, success: str, accuracy: float, least: int) -> DataFrame:
    """keys, threshold: the largest value up to which at least `least` rows succeed at the given rate."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("here"), F.sum(F.col(success).cast("long")).alias("good"))
    run = running(counts, keys, value, "here", "good").withColumns({"upto": F.col("before_here") + F.col("here"), "right": F.col("before_good") + F.col("good")})
    return run.where((F.col("upto") >= least) & (F.col("right") >= accuracy * F.col("upto"))).groupBy(*keys).agg(F.max(value).alias("threshold"))


def grouped_junctions(junctions: DataFrame) -> DataFrame:
    """event_type, chrom, js, je, count, others: junctions that share a donor (A3SS) or an acceptor (A5SS), with the summed count of the others."""
    out = []
    for kind, site in (("A3SS", "js"), ("A5SS", "je")):
        part = Window.partitionBy("chrom", site)
        rows = junctions.withColumns({"__n": F.count(F.lit(1)).over(part), "others": F.sum("count").over(part) - F.col("count")})
        out.append(rows.where("__n >= 2").select(F.lit(kind).alias("event_type"), "chrom", "js", "je", "count", "others"))
    return out[0].union(out[1])


def merge_evidence(rows: DataFrame, keys: list[str], evidence: str) -> DataFrame:
    """keys and a map with the sum of each entry of the maps in `evidence`."""
    each = rows.select(*keys, F.explode(evidence).alias("__k", "__v")).groupBy(*keys, "__k").agg(F.sum("__v").alias("__v"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__v")))).alias(evidence))


def merge_nearby(junctions: DataFrame, distance: int = 20) -> DataFrame:
    """junctions(locus, js, je, count) without those near a better one.

    Acceptors within `distance` of the first of their cluster stand together, then donors within it likewise; the best of each stays (of
    equals that with the least donor, then acceptor). A cluster can't reach over a gap of more than `distance` between neighbouring
    acceptors, so what is read in order are the stretches between such gaps, not whole loci; neighbouring ones share a group.
    """
    rows = junctions.select("locus", "js", "je", "count")
    stretches = islands(rows.select("locus", "je").distinct().select("locus", F.col("je").alias("s"), F.col("je").alias("e")), ["locus"], distance)
    stretches = stretches.withColumn("island", F.floor(F.col("island") / 50_000))
    rows = overlap_join(rows.withColumns({"s": F.col("je"), "e": F.col("je") + 1}), stretches.select("locus", "island", F.col("s").alias("rs"), (F.col("e") + 1).alias("re")), ["locus"])

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["je", "js"], kind="stable").reset_index(drop=True)
        cluster, anchor = [], None
        for je in rows["je"]:
            if anchor is None or je - anchor > distance:
                anchor = je
            cluster.append(anchor)
        rows["c"] = cluster
        rows = rows.sort_values(["c", "js"], kind="stable").reset_index(drop=True)
        group, last = [], (None, None)
        for c, js in zip(rows["c"], rows["js"], strict=True):
            if last[0] != c or js - last[1] > distance:
                last = (c, js)
            group.append(last[1])
        rows["d"] = group
        best = rows.groupby(["c", "d"])["count"].idxmax()
        return rows.loc[sorted(best), ["locus", "js", "je", "count"]]

    return rows.select("locus", "island", "js", "je", "count").groupBy("locus", "island").applyInPandas(pick, "locus long, js long, je long, count long")


def event_table(rows: DataFrame, types: list[str], low: float, high: float, min_reads: int, gene: str) -> DataFrame:
    """rows(event_type, psi, reads, gene) of some types (none: all), a range of psi (null stays), reads, and a part of the gene's name."""
    out = rows.where(F.col("event_type").isin(types)) if types else rows
    out = out.where((F.col("psi").isNull() | F.col("psi").between(low, high)) & (F.col("reads") >= min_reads))
    return out.where(F.contains(F.lower("gene"), F.lit(gene.lower()))) if gene else out
