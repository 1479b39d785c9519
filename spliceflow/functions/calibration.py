"""Column expressions of the calibration layer: support bins, posterior moments, conformal intervals and confidence tiers."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Support bins by their lower edge, the normal quantile, and the shipped calibrators' half-widths and multipliers.
BINS = (("<20", 0), ("20-49", 20), ("50-99", 50), ("100-249", 100), ("250+", 250))
Z95 = 1.959963984540054
DPSI_Q = {"20-49": 0.3406603587376566, "50-99": 0.3406603587376566, "100-249": 0.2818155432887207, "250+": 0.34412221552071665}
DPSI_Q_GLOBAL = 0.3406603587376566
DPSI_SUPPORT_MEDIAN = 627.5
PSI_Q = {"<20": 0.897045817905903, "20-49": 0.6683088702888771, "50-99": 0.5093940037159687, "100-249": 0.6040594446180603, "250+": 0.9069276312199057}
PSI_Q_GLOBAL = 0.8342175283914359
#: Count scale of overdispersed posteriors, its factors by event type and by support, and the native schedule.
BASE_SCALE = 0.01
TYPE_FACTORS = {"A3SS": 1.0, "A5SS": 1.0, "SE": 0.9, "RI": 0.85, "MXE": 0.95}
SUPPORT_FACTORS = ((20, 0.85), (50, 1.0), (100, 1.2), (200, 1.5))
SUPPORT_FACTOR_ABOVE = 1.75
AUDIT_FACTORS = {"<20": 1.0648875689615864, "20-49": 1.0648875689615864, "50-99": 1.1834802282272903, "100-249": 1.3553905316339745, "250+": 1.9906365530112617}
INFLATION_FACTORS = {"<20": 1.022158102170707, "20-49": 1.022158102170707, "50-99": 1.0255363419919137, "100-249": 1.2001565486593335, "250+": 1.2001565486593335}
WIDTH_THRESHOLD, CV_THRESHOLD, WIDE_BIN_WIDTH = 0.2, 0.5, 0.6
NATIVE_TYPES = ("A3SS", "A5SS")


@dataclass(frozen=True)
class Calibrator:
    """Quantiles from the finest level to the coarsest: composite group (type|bin), event type, support bin, global."""

    q_global: float
    by_bin: dict[str, float] = field(default_factory=dict)
    by_type: dict[str, float] = field(default_factory=dict)
    by_group: dict[str, float] = field(default_factory=dict)

    def to_json(self) -> str:
        """Version 2 of the calibrator's file: infinite quantiles are null."""
        bounded = lambda q: q if math.isfinite(q) else None
        table = lambda t: {k: bounded(v) for k, v in t.items()}
        return json.dumps({"version": 2, "q_global": bounded(self.q_global), "q_by_bin": table(self.by_bin), "q_by_type": table(self.by_type), "q_by_group": table(self.by_group)}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Calibrator:
        """A calibrator of version 1 (global and bins) or 2; raises for another version, unknown bins and quantiles below zero."""
        d = json.loads(text)
        if d.get("version", 1) not in (1, 2):
            raise ValueError(f"unknown version {d['version']!r}")

        def quantile(q: object) -> float:
            value = float("inf") if q is None else float(q)
            if not value >= 0:
                raise ValueError(f"{q!r} is no quantile")
            return value

        table = lambda name: {k: quantile(v) for k, v in (d.get(name) or {}).items()}
        if unknown := set(table("q_by_bin")) - {b for b, _ in BINS}:
            raise ValueError(f"unknown support bins {sorted(unknown)}")
        return cls(quantile(d["q_global"]), table("q_by_bin"), table("q_by_type"), table("q_by_group"))


SHIPPED_DPSI = Calibrator(DPSI_Q_GLOBAL, DPSI_Q)
SHIPPED_PSI = Calibrator(PSI_Q_GLOBAL, PSI_Q)


def lookup(key: Column, table: dict[str, float]) -> Column:
    """The table's value for key, null if it has none: a folded map literal, so that key stands in the expression once."""
    if not table:
        return F.lit(None).cast("double")
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, float(v)))), key)


def finite(x: Column) -> Column:
    """x, or null for null, NaN and infinity."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def support_bin(support: Column) -> Column:
    """Right-open bins; null, NaN and negative support fall into the lowest."""
    s = F.nanvl(support.cast("double"), F.lit(-1.0))
    return F.when(s >= 250, "250+").when(s >= 100, "100-249").when(s >= 50, "50-99").when(s >= 20, "20-49").otherwise("<20")


def beta_variance(inc: Column, exc: Column) -> Column:
    """Variance of the Jeffreys posterior Beta(inc + 1/2, exc + 1/2)."""
    a, b = F.greatest(inc.cast("double"), F.lit(0.0)) + 0.5, F.greatest(exc.cast("double"), F.lit(0.0)) + 0.5
    return a * b / ((a + b) * (a + b) * (a + b + 1.0))


def beta_mean(inc: Column, exc: Column) -> Column:
    return (inc + 0.5) / (inc + exc + 1.0)


def beta_dpsi_std(inc1: Column, exc1: Column, inc2: Column, exc2: Column) -> Column:
    return F.sqrt(beta_variance(inc1, exc1) + beta_variance(inc2, exc2))


def psi(inc: Column, exc: Column, ratio: Column | float = 1.0) -> Column:
    """inc / (inc + exc * ratio); null without reads."""
    r = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    total = inc.cast("double") + exc.cast("double") * r
    return F.when(total > 0, inc / total)


def quantile_for(cal: Calibrator, support: Column, event_type: Column | None = None, known: Column | None = None) -> Column:
    """Composite group, then type, then bin, then global; where known is false, global at once."""
    bin_ = support_bin(support)
    levels = [lookup(bin_, cal.by_bin)]
    if event_type is not None:
        levels = [lookup(F.concat(event_type, F.lit("|"), bin_), cal.by_group), lookup(event_type, cal.by_type), *levels]
    q = F.coalesce(*map(finite, levels), F.lit(float(cal.q_global)))
    return q if known is None else F.when(known, q).otherwise(F.lit(float(cal.q_global)))


def _around(center: Column, half: Column, low: float, high: float) -> Column:
    """Null and NaN give the whole range, and so does an infinite center, whose difference with itself is NaN."""
    c = center + (center - center)

    def clip(x: Column, otherwise: float) -> Column:
        return F.least(F.greatest(F.nanvl(F.coalesce(x, F.lit(otherwise)), F.lit(otherwise)), F.lit(low)), F.lit(high))

    return F.struct(clip(c - half, low).alias("low"), clip(c + half, high).alias("high"))


def _not_negative(x: Column) -> Column:
    """x, at least 0; null and NaN stay."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def plain_interval(center: Column, scale: Column, q: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """center -/+ q * scale, clipped; the whole range where something isn't finite."""
    return _around(center, q * _not_negative(scale), low, high)


def robust_interval(center: Column, std: Column, q: Column, z: float = Z95, low: float = -1.0, high: float = 1.0) -> Column:
    """Half-width q and z standard deviations added in quadrature."""
    return _around(center, F.hypot(q, F.lit(z) * _not_negative(std)), low, high)


def reliable(interval: Column) -> Column:
    return (interval["low"] > 0) | (interval["high"] < 0)


def caller_significant(fdr: Column, pvalue: Column, threshold: float = 0.05) -> Column:
    """fdr < threshold, else p < threshold, else null."""
    return F.coalesce(finite(fdr) < threshold, finite(pvalue) < threshold)


def tier(is_reliable: Column, effect: Column, significant: Column) -> Column:
    strong = is_reliable & effect
    return (
        F.when(strong & F.coalesce(significant, F.lit(True)), "high-confidence")
        .when(strong, "supported")
        .when(significant, "caller-significant-only")
        .when(significant.isNull() & ~is_reliable, "not-reliable")
        .otherwise("not-significant")
    )


def margin(interval: Column) -> Column:
    """Distance of the interval from zero; -1 where it holds zero."""
    return F.when(interval["low"] > 0, interval["low"]).when(interval["high"] < 0, -interval["high"]).otherwise(F.lit(-1.0))


def count_scale(total: Column, event_type: Column, mode: str = "native", base: float = BASE_SCALE) -> Column:
    """Scale on the counts of an overdispersed posterior, at most 1."""
    one = F.lit(1.0)
    if mode == "fixed":
        return F.least(one, F.lit(base))
    steps = reduce(lambda c, s: c.when(total < s[0], s[1]), SUPPORT_FACTORS[1:], F.when(total < SUPPORT_FACTORS[0][0], SUPPORT_FACTORS[0][1])).otherwise(SUPPORT_FACTOR_ABOVE)
    general = F.least(one, F.lit(base) * F.coalesce(lookup(event_type, TYPE_FACTORS), one) * steps)
    if mode != "native":
        return general
    audit = lookup(support_bin(total), AUDIT_FACTORS)
    return F.when(event_type.isin(*NATIVE_TYPES), F.least(one, F.lit(base) / (audit * audit))).otherwise(general)


def inflation(total: Column, event_type: Column) -> Column:
    return F.when(event_type.isin(*NATIVE_TYPES), lookup(support_bin(total), INFLATION_FACTORS)).otherwise(F.lit(1.0))


def width_threshold(total: Column, event_type: Column) -> Column:
    return F.when(event_type.isin(*NATIVE_TYPES) & (support_bin(total) == "250+"), F.lit(WIDE_BIN_WIDTH)).otherwise(F.lit(WIDTH_THRESHOLD))


def confident(interval: Column, cv: Column, total: Column, event_type: Column) -> Column:
    """Narrow enough and of a finite, small enough coefficient of variation."""
    return (interval["high"] - interval["low"] < width_threshold(total, event_type)) & F.coalesce(finite(cv) <= CV_THRESHOLD, F.lit(False))


def interval_score(low: Column, high: Column, truth: Column, alpha: float = 0.05) -> Column:
    """Width plus 2/alpha for each unit by which the interval misses."""
    return (high - low) + F.lit(2.0 / alpha) * (F.greatest(low - truth, F.lit(0.0)) + F.greatest(truth - high, F.lit(0.0)))
