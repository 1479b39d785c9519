"""Evaluation of intervals, detections and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceflow.functions.calibration import interval_score
from spliceflow.operators.ranks import best_below, running


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high) of the Wilson interval; null without trials."""
    p = k / n
    center = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.struct((center - half).alias("low"), (center + half).alias("high")))


def coverage(rows: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Coverage, mean width and mean interval score of rows(low, high, truth) by keys, in one aggregation."""
    inside = (F.col("truth") >= F.col("low")) & (F.col("truth") <= F.col("high"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(inside.cast("long")).alias("covered"), share(inside).alias("coverage"),
        F.avg(F.col("high") - F.col("low")).alias("mean_width"), F.avg(interval_score(F.col("low"), F.col("high"), F.col("truth"), alpha)).alias("interval_score"),
    )


def auc(rows: DataFrame, keys: list[str], score_col: str = "score", label_col: str = "label") -> DataFrame:
    """keys, n_pos, n_neg, auc: Mann-Whitney with half for ties; null without both classes. Scores are counted before they are ranked."""
    counts = rows.groupBy(*keys, score_col).agg(F.sum((F.col(label_col) == 1).cast("long")).alias("pos"), F.sum((F.col(label_col) == 0).cast("long")).alias("neg"))
    won = running(counts, keys, score_col, "neg").withColumn("won", F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    out = won.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("won").alias("won"))
    return out.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("won") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def confusion(rows: DataFrame, keys: list[str], call: Column, label: Column) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy(*keys).agg(n(call & label).alias("tp"), n(call & ~label).alias("fp"), n(~call & label).alias("fn"), n(~call & ~label).alias("tn"))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation; 0 where a margin is empty."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    d = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(d > 0, (tp * tn - fp * fn) / d).otherwise(F.lit(0.0))


def average_ranks(rows: DataFrame, keys: list[str], value_col: str, out_col: str = "avg_rank") -> DataFrame:
    """rows with the average rank of their value within keys; ranks come from counted values, joined back."""
    counts = rows.groupBy(*keys, value_col).agg(F.count(F.lit(1)).alias("__n"))
    ranks = running(counts, keys, value_col, "__n").select(*keys, value_col, (F.col("before___n") + (F.col("__n") + 1) / 2).alias(out_col))
    return rows.join(ranks, [*keys, value_col])


def holm(rows: DataFrame, p_col: str = "p", out_col: str = "p_holm") -> DataFrame:
    """rows with Holm-adjusted p values: the greatest of (tests at or above p) * p over this and smaller p, at most 1. Equal p get equal
    values; null p are no tests and stay null. Ranks come from counted values, whatever the number of tests."""
    counts = rows.where(F.col(p_col).isNotNull()).groupBy(p_col).agg(F.count(F.lit(1)).alias("__n"))
    step = F.least(F.lit(1.0), (F.col("total___n") - F.col("before___n")) * F.col(p_col))
    steps = running(counts, [], p_col, "__n").select(p_col, step.alias("__step"))
    adjusted = best_below(steps, p_col, "__step", "__before").select(p_col, F.greatest("__step", "__before").alias(out_col))
    return rows.join(adjusted, p_col, "left").select(*rows.columns, out_col)


def pareto_front(points: DataFrame, x: str, y: str) -> DataFrame:
    """Points that no other beats in both x and y; of equals all stay, points with a null don't. The best y by x first, then the best of all
    greater x, handed from bucket to bucket."""
    by_x = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(F.max(y).alias("__best")).withColumn("__down", -F.col(x))
    above = best_below(by_x, "__down", "__best", "__above").drop("__down")
    return points.join(above, x).where((F.col(y) == F.col("__best")) & (F.col("__above").isNull() | (F.col(y) > F.col("__above")))).select(*points.columns)
