"""Regions around genes, gaps with reads, depth contrasts and what became of true transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.operators.intervals import overlapped


def flanking_region(genes: DataFrame, target: Column, n_genes: int, bases: int) -> DataFrame:
    """chrom, gene, s, e: the span from n_genes before the target genes to n_genes behind, widened by bases; genes(chrom, gene, s, e) are few."""
    order = Window.partitionBy("chrom").orderBy("s", "e", "gene")
    near = order.rowsBetween(-n_genes, n_genes)
    spans = genes.withColumns({"rs": F.min("s").over(near), "re": F.max("e").over(near)})
    return spans.where(target).select("chrom", "gene", F.greatest(F.col("rs") - bases, F.lit(0)).alias("s"), (F.col("re") + bases).alias("e"))


def single_exon_candidates(depths: DataFrame, keys: list[str], bin_width: int, least: int, length: int) -> DataFrame:
    """keys, s, e of runs of neighbouring bins (keys, bin, n) with n >= least that are at least `length` long."""
    good = depths.where(F.col("n") >= least)
    runs = good.withColumn("__g", F.col("bin") - F.row_number().over(Window.partitionBy(*keys).orderBy("bin")))
    out = runs.groupBy(*keys, "__g").agg((F.min("bin") * bin_width).alias("s"), ((F.max("bin") + 1) * bin_width).alias("e"))
    return out.drop("__g").where(F.col("e") - F.col("s") >= length)


def lost_at(truth: DataFrame, loci: DataFrame, found: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """truth with the stage at which each was lost: no_locus, no_match or found. found holds ids."""
    hit = found.select(id_col).distinct().withColumn("__found", F.lit(True))
    out = overlapped(truth, loci, keys, "__locus").join(hit, id_col, "left")
    return out.withColumn("stage", F.when(F.col("__found"), "found").when(F.col("__locus"), "no_match").otherwise("no_locus")).drop("__locus", "__found")


def detection_p(rows: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """keys, score, p = (1 + negatives that score as much) / (negatives + 1), a row for each different score."""
    counts = rows.groupBy(*keys, score).agg(F.sum((F.col(label) == 0).cast("long")).alias("neg"))
    part = Window.partitionBy(*keys)
    return counts.select(*keys, score, ((1 + F.sum("neg").over(part.orderBy(F.desc(score)))) / (1 + F.sum("neg").over(part))).alias("p"))
