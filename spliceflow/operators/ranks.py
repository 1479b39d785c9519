"""Running sums over ordered values. A group isn't gathered: values are dealt to buckets in their order, each bucket is summed by itself, and what lies below it comes from the small table of buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each doubling of a value.
STEPS = 256
_ZERO = 300_000  # above the bucket number of the least positive double


def bucket(value: Column) -> Column:
    """Grows with the value and depends on nothing else; NaN is with the infinite ones, where it comes last. The value is named twice only:
    an expression that is long itself would otherwise make code that is too long to be compiled."""
    v = F.nanvl(value.cast("double"), F.lit(float("inf")))
    size = F.floor(F.log2(F.greatest(F.least(F.abs(v), F.lit(1.7e308)), F.lit(5e-324))) * STEPS) + _ZERO
    return (F.signum(v) * size).cast("long")


def running(counts: DataFrame, keys: list[str], value: str, *columns: str) -> DataFrame:
    """counts (a row for each value of a group, values not null) with before_c and total_c for each of columns: the sums of c over the
    group's smaller values and over all of them. Null keys are a group."""
    dealt = counts.withColumn("__bucket", bucket(F.col(value)))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    below = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy(*keys, "__bucket").agg(*(F.sum(c).alias(c) for c in columns))
    handed = per.select(
        *(F.col(k).alias(f"__{k}") for k in keys), F.col("__bucket").alias("__at"),
        *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"before_{c}") for c in columns), *(F.sum(c).over(whole).alias(f"total_{c}") for c in columns),
    )
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.col("__bucket") == F.col("__at"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(handed, same).withColumns({f"before_{c}": F.col(f"before_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    return out.select(*counts.columns, *(f"{kind}_{c}" for c in columns for kind in ("before", "total")))


def best_below(rows: DataFrame, value: str, column: str, out: str) -> DataFrame:
    """rows (a row for each value, values not null) with the greatest of column over the rows of smaller values; null where there are none.
    The buckets' maxima are one small table; the rows are only sorted within their bucket."""
    dealt = rows.withColumn("__bucket", bucket(F.col(value)))
    below = Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy("__bucket").agg(F.max(column).alias("__most")).select("__bucket", F.max("__most").over(below).alias("__handed"))
    inside = Window.partitionBy("__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(per, "__bucket").withColumn(out, F.greatest("__handed", F.max(column).over(inside))).select(*rows.columns, out)
