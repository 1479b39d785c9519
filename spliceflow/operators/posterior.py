"""Posterior draws of inclusion fractions, in Arrow batches. An event's seed is a hash of its id, so draws don't depend on partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceflow.operators.tables import spread


def _generator(seed: int) -> np.random.Generator:
    return np.random.default_rng(int(seed) % (1 << 63))


def seed_of(id_: Column, seed: int = 0) -> Column:
    return F.xxhash64(id_.cast("string"), F.lit(seed))


def informative(inc: Column, exc: Column) -> Column:
    """array<struct<inc, exc>> of the replicates with reads; null if the vectors differ in length or fewer than two are left."""
    pairs = F.filter(F.zip_with(inc, exc, lambda a, b: F.struct(a.cast("double").alias("inc"), b.cast("double").alias("exc"))), lambda p: p["inc"] + p["exc"] > 0)
    return F.when((F.size(inc) == F.size(exc)) & (F.size(pairs) >= 2), pairs)


def psi_posterior(rows: DataFrame, draws: int = 500, level: float = 0.95, seed: int = 0) -> DataFrame:
    """rows(event_id, inc, exc, ratio, scale, inflation) with psi, sd, cv and a percentile interval widened by inflation.

    Draws are Beta(scale * inc + 1/2, scale * exc * ratio + 1/2). Without reads: zeros and no cv.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.inc + r.exc <= 0:
                    out.append((r.event_id, 0.0, 0.0, None, 0.0, 0.0))
                    continue
                exc = r.exc * r.ratio
                psi = r.inc / (r.inc + exc)
                x = _generator(r.seed).beta(r.scale * r.inc + 0.5, r.scale * exc + 0.5, size=draws)
                low, high = np.quantile(x, [(1 - level) / 2, (1 + level) / 2])
                if r.inflation > 1:
                    low, high = max(0.0, psi - r.inflation * max(0.0, psi - low)), min(1.0, psi + r.inflation * max(0.0, high - psi))
                out.append((r.event_id, psi, x.std(), x.std() / x.mean(), low, high))
            yield pd.DataFrame(out, columns=["event_id", "psi", "sd", "cv", "ci_low", "ci_high"]).astype({"event_id": object, "cv": "float64"})

    columns = ["event_id", *(F.col(c).cast("double").alias(c) for c in ("inc", "exc", "ratio", "scale", "inflation"))]
    return spread(rows.select(*columns, seed_of(F.col("event_id"), seed).alias("seed")), "event_id").mapInPandas(draw, "event_id string, psi double, sd double, cv double, ci_low double, ci_high double")


def dpsi_posterior(rows: DataFrame, draws: int = 2000, cutoff: float = 0.1, model: str = "auto", seed: int = 0) -> DataFrame:
    """rows(event_id, inc1, exc1, inc2, exc2 arrays of replicates, ratio) to mean, sd, P(|change| >= cutoff), group means and the model.

    rep resamples replicates with reads and averages their draws; it needs two in both groups. sum pools counts; auto is rep where
    it can be, else sum.
    """
    if model not in ("auto", "rep", "sum"):
        raise ValueError("model must be auto, rep or sum")
    schema = "event_id string, dpsi double, sd double, p_large double, psi1 double, psi2 double, model string"

    def group(rng: np.random.Generator, pairs, ratio: float, inc: float, exc: float) -> np.ndarray:
        if pairs is None:
            return rng.beta(inc + 0.5, exc * ratio + 0.5, size=draws)
        a, b = np.array([p["inc"] for p in pairs]), np.array([p["exc"] for p in pairs]) * ratio
        pick = rng.integers(0, len(a), size=(draws, len(a)))
        return rng.beta(a[pick] + 0.5, b[pick] + 0.5).mean(axis=1)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                both = r.r1 is not None and r.r2 is not None and model != "sum"
                if model == "rep" and not both:
                    raise ValueError(f"event {r.event_id} has fewer than two replicates with reads in a group")
                rng = _generator(r.seed)
                x1 = group(rng, r.r1 if both else None, r.ratio, r.i1, r.e1)
                x2 = group(rng, r.r2 if both else None, r.ratio, r.i2, r.e2)
                d = x1 - x2
                out.append((r.event_id, d.mean(), d.std(), (np.abs(d) >= cutoff).mean(), x1.mean(), x2.mean(), "rep" if both else "sum"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"event_id": object, "model": object})

    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x)
    made = rows.select("event_id", F.col("ratio").cast("double").alias("ratio"), informative(F.col("inc1"), F.col("exc1")).alias("r1"), informative(F.col("inc2"), F.col("exc2")).alias("r2"), total("inc1").alias("i1"), total("exc1").alias("e1"), total("inc2").alias("i2"), total("exc2").alias("e2"), seed_of(F.col("event_id"), seed).alias("seed"))
    return spread(made, "event_id").mapInPandas(draw, schema)


def combine_replicates(rows: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """rows(event_id, psi, ci_low, ci_high, inc, exc), one a replicate, to an event each: biological plus mean sampling variance."""
    sampling = F.avg(F.pow((F.col("ci_high") - F.col("ci_low")) / (2 * z), 2))
    out = rows.groupBy("event_id").agg(F.avg("psi").alias("psi"), F.coalesce(F.var_samp("psi"), F.lit(0.0)).alias("b"), sampling.alias("s"), F.sum("inc").alias("inc"), F.sum("exc").alias("exc"), F.count(F.lit(1)).alias("replicates"))
    sd = F.sqrt(F.col("b") + F.col("s"))
    return out.select("event_id", "psi", F.greatest(F.lit(0.0), F.col("psi") - z * sd).alias("ci_low"), F.least(F.lit(1.0), F.col("psi") + z * sd).alias("ci_high"), "inc", "exc", "replicates")


def thin_counts(rows: DataFrame, fraction: float, columns: list[str], seed: int = 0) -> DataFrame:
    """Counts kept with the given chance each: binomial draws, seeded by event_id."""
    names = list(columns)

    @F.pandas_udf(", ".join(f"{c} long" for c in names))
    def thin(key: pd.Series, counts: pd.DataFrame) -> pd.DataFrame:
        draws = [_generator(k).binomial(c, fraction) for k, c in zip(key, counts.to_numpy(dtype=np.int64), strict=True)]
        return pd.DataFrame(np.array(draws, dtype=np.int64).reshape(-1, len(names)), columns=names)

    made = rows.withColumn("__t", thin(seed_of(F.col("event_id"), seed), F.struct(*(F.col(c).cast("long").alias(c) for c in names))))
    return made.withColumns({c: F.col(f"__t.{c}") for c in names}).drop("__t")


def bootstrap_interval(rows: DataFrame, keys: list[str], value: str, draws: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean by a Poisson bootstrap: weights come from hashes, sums are combined before the shuffle."""
    u = lambda b: (F.pmod(F.xxhash64(F.col("__row"), b, F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    edges = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 8)]))
    wide = rows.withColumn("__row", F.xxhash64(*rows.columns)).select(*keys, value, "__row", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b")).withColumn("u", u(F.col("b")))
    weight = sum(((F.col("u") > float(e)).cast("int") for e in edges), F.lit(0))
    means = wide.withColumn("w", weight).groupBy(*keys, "b").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    q = lambda p: F.percentile("m", F.lit(p))
    return means.groupBy(*keys).agg(q((1 - level) / 2).alias("low"), q((1 + level) / 2).alias("high"))
