"""Hand-set quality scores of junctions, transcripts and paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def junction_score(reads: Column, intron: Column, coverage_ratio: Column, strand_agreement: Column, canonical: Column) -> Column:
    """From log support, coverage, strand agreement and motif; long introns lose."""
    short = F.greatest(F.lit(0.0), 1 - F.log1p(intron) / 15)
    return sigmoid(F.log1p(reads) * 0.35 + coverage_ratio * 0.25 + strand_agreement * 0.15 + canonical * 0.15 + short * 0.10 - 0.5)


def transcript_score(uniformity: Column, n_junctions: Column, junction_ratio: Column, weak: Column, exon_fraction: Column, n_exons: Column, length: Column, share: Column, coverage: Column, safe: Column, safe_fraction: Column) -> Column:
    """Uniform coverage, junction coverage near the exons', plausible structure, abundance and safety, weighted."""
    off = (junction_ratio - 1) / 0.5
    junction = F.when(n_junctions > 0, F.exp(-0.5 * off * off) * F.when(weak > 0.5, 0.7).otherwise(1.0)).otherwise(F.lit(0.5))
    structure = F.least(F.lit(1.0), exon_fraction) * F.when(n_exons > 50, 50 / n_exons).otherwise(1.0) * F.when(length < 200, length / 200).otherwise(1.0)
    abundance = 0.5 * F.least(F.lit(1.0), share * 2) + 0.5 * sigmoid(F.log1p(coverage) - 2.5)
    return unit(0.30 * unit(uniformity) + 0.25 * junction + 0.20 * unit(structure) + 0.15 * unit(abundance) + 0.10 * unit(0.6 * safe + 0.4 * safe_fraction))


def path_plausibility(n_exons: Column, uniformity: Column, cv: Column, edge_consistency: Column) -> Column:
    return F.least(F.lit(1.0), F.least(n_exons / 5, F.lit(1.0)) * 0.2 + uniformity * 0.3 + F.greatest(F.lit(0.0), 1 - cv) * 0.2 + edge_consistency * 0.3)


def beta_summary(inc: Column, exc: Column, a: float = 1.0, b: float = 1.0) -> Column:
    """struct(mean, mode, sd) of Beta(a + inc, b + exc)."""
    x, y = inc + a, exc + b
    mean = x / (x + y)
    mode = F.when((x > 1) & (y > 1), unit((x - 1) / F.greatest(x + y - 2, F.lit(1e-10)))).otherwise(mean)
    return F.struct(mean.alias("mean"), mode.alias("mode"), F.sqrt(x * y / ((x + y) * (x + y) * (x + y + 1))).alias("sd"))


def required_inflation(center: Column, low: Column, high: Column, truth: Column) -> Column:
    """Least factor on the interval's arms that makes it hold the truth."""
    below = F.greatest(F.lit(1.0), F.abs(center - truth) / F.greatest(F.abs(center - low), F.lit(1e-9)))
    above = F.greatest(F.lit(1.0), F.abs(truth - center) / F.greatest(F.abs(high - center), F.lit(1e-9)))
    return F.when(truth < low, below).when(truth > high, above).otherwise(F.lit(1.0))
