"""Split and Mondrian conformal calibration as aggregations: order statistics per group at several levels of grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.functions.calibration import Calibrator, finite, support_bin
from spliceflow.operators.ranks import bucket
from spliceflow.operators.tables import written

MIN_GROUP = 20


def score(estimate: Column, truth: Column, scale: Column) -> Column:
    """|truth - estimate| over the scale, the scale at least 1e-9; null where something isn't finite."""
    return F.abs(finite(truth) - finite(estimate)) / F.greatest(finite(scale), F.lit(1e-9))


def rank_of(n: Column, alpha: float) -> Column:
    """ceil((n + 1)(1 - alpha)), in decimal arithmetic."""
    return F.ceil((n + 1).cast("decimal(18,0)") * F.lit(f"{1 - alpha:.6f}").cast("decimal(8,6)")).cast("long")


def quantiles(scores: DataFrame, keys: list[str], alpha: float = 0.05, score_col: str = "score") -> DataFrame:
    """keys, n, q: the rank-th smallest score of each group; q is null (unbounded) if the rank is beyond n. Null keys are a group.

    Scores are counted by bucket in a first pass, which tells each group's bucket of that rank; only the scores in these few buckets are then
    compared with each other. No group is gathered, and nothing but bucket counts is exchanged of the others.
    """
    dealt = scores.where(F.col(score_col).isNotNull()).select(*keys, F.col(score_col).alias("__score"), bucket(F.col(score_col)).alias("__bucket"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    per = dealt.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("here"))
    per = per.withColumns({"n": F.sum("here").over(whole), "upto": F.sum("here").over(whole.orderBy("__bucket"))}).withColumn("rank", rank_of(F.col("n"), alpha))
    groups = per.groupBy(*keys).agg(F.max("n").alias("n"), F.min(F.when(F.col("upto") >= F.col("rank"), F.struct("__bucket", (F.col("rank") - F.col("upto") + F.col("here")).alias("left")))).alias("in"))
    groups = written(groups.select(*(F.col(k).alias(f"__{k}") for k in keys), "n", F.col("in.__bucket").alias("__at"), "in.left"))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.col("__bucket") == F.col("__at"))
    near = dealt.join(groups, same).groupBy(*keys, "left", "__score").agg(F.count(F.lit(1)).alias("here"))
    upto = F.sum("here").over(whole.orderBy("__score"))
    found = near.withColumn("upto", upto).where("upto >= left").groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min("__score").alias("q"))
    again = reduce(Column.__and__, (F.col(f"__{k}").eqNullSafe(F.col(f"_{k}")) for k in keys), F.lit(True))
    return groups.join(found, again, "left").select(*(F.col(f"__{k}").alias(k) for k in keys), "n", "q")


def levels(rows: DataFrame, alpha: float = 0.05, min_group: int = MIN_GROUP) -> DataFrame:
    """(level, key, n, q) for level global, bin, type and group of rows(estimate, truth, scale, support, event_type).

    Bins and types need one score, composite groups min_group.
    """
    base = rows.select(score(F.col("estimate"), F.col("truth"), F.col("scale")).alias("score"), support_bin(F.col("support")).alias("bin"), "event_type")
    wide = base.select("score", F.explode(F.array(
        *(F.struct(F.lit(level).alias("level"), key.alias("key")) for level, key in (("global", F.lit("")), ("bin", F.col("bin")), ("type", F.col("event_type")), ("group", F.concat("event_type", F.lit("|"), "bin"))))
    )).alias("g")).select("score", "g.level", "g.key").where("key is not null")
    return quantiles(wide, ["level", "key"], alpha).where((F.col("level") != "group") | (F.col("n") >= min_group))


def fit(rows: DataFrame, alpha: float = 0.05, min_group: int = MIN_GROUP) -> Calibrator:
    """The calibrator, one row for each bin, type and group, so a small table whatever the input."""
    found = {"global": {}, "bin": {}, "type": {}, "group": {}}
    for r in levels(rows, alpha, min_group).collect():
        found[r["level"]][r["key"]] = float("inf") if r["q"] is None else r["q"]
    return Calibrator(found["global"].get("", float("inf")), found["bin"], found["type"], found["group"])


def crossfit(rows: DataFrame, alpha: float = 0.05, min_bin: int = 1, folds: int = 3) -> DataFrame:
    """rows with q from the other folds: of the same support bin if that has min_bin scores there, else of all.

    Each score goes to the folds that it isn't in (folds - 1 copies); the quantile table is tiny and joined back.
    """
    base = rows.withColumns({"score": score(F.col("estimate"), F.col("truth"), F.col("scale")), "bin": support_bin(F.col("support"))})
    each = F.explode(F.array(F.struct(F.lit(True).alias("all"), F.lit("").alias("of")), F.struct(F.lit(False).alias("all"), F.col("bin").alias("of"))))
    copies = base.select("score", "bin", "fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("held")).where("fold <> held").select("score", "held", each.alias("x")).select("score", "held", "x.all", "x.of")
    found = quantiles(copies, ["held", "all", "of"], alpha)
    by_bin = found.where(~F.col("all") & (F.col("n") >= min_bin)).select("held", F.col("of").alias("bin"), F.col("q").alias("q_bin"))
    overall = found.where("all").select("held", F.col("q").alias("q_all"))
    return base.withColumn("held", F.col("fold")).join(by_bin, ["held", "bin"], "left").join(overall, "held", "left").withColumn("q", F.coalesce("q_bin", "q_all")).drop("held", "q_bin", "q_all")
