"""The calibration layer over a stream: row-wise, so the batch expressions hold without state; counts by tier keep state in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceflow.functions import calibration as C


def calibrated(events: DataFrame, calibrator: C.Calibrator = C.SHIPPED_DPSI, effect_cutoff: float = 0.1, threshold: float = 0.05) -> DataFrame:
    """events(dpsi, sampling_std, total_support, fdr, pvalue), batch or stream, with q, interval, flags and tier.

    Unknown support takes the global quantile; an unknown deviation the plain half-width.
    """
    known = F.col("total_support").isNotNull()
    rows = events.withColumn("q", C.quantile_for(calibrator, F.coalesce("total_support", F.lit(0.0)), None, known))
    robust, plain = C.robust_interval(F.col("dpsi"), F.col("sampling_std"), F.col("q")), C.plain_interval(F.col("dpsi"), F.lit(1.0), F.col("q"), -1.0, 1.0)
    rows = rows.withColumn("ci", F.when(C.finite(F.col("sampling_std")).isNotNull(), robust).otherwise(plain))
    rows = rows.withColumns({"ci_low": F.col("ci.low"), "ci_high": F.col("ci.high"), "reliable": C.reliable(F.col("ci")), "effect": F.abs("dpsi") >= effect_cutoff, "caller_significant": C.caller_significant(F.col("fdr"), F.col("pvalue"), threshold)})
    return rows.withColumn("tier", C.tier(F.col("reliable"), F.col("effect"), F.col("caller_significant"))).drop("ci")


def tiers_by_window(events: DataFrame, time: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tier counts in event-time windows; rows later than `late` are passed over, so state is bounded."""
    return calibrated(events).withWatermark(time, late).groupBy(F.window(time, width), "tier").count()
