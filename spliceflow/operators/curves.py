"""Learning curves of a calibrator: coverage and width of intervals by the number of calibrating rows, over many draws."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.operators.tables import written

SIZES = (20, 30, 40, 50, 70, 90)
#: Effects that count as real.
REAL = 0.05


def nested_samples(rows: DataFrame, trials: int, most: int) -> DataFrame:
    """trial, place, id, estimate, truth: for each trial the `most` rows of least MD5 of id and trial, in that order.

    The first n are the trial's sample of n, so all sizes come from one pass. Only keys below a bound that some hundreds of a trial's rows are expected under
    are sorted; should a trial have fewer than `most` there, all keys are. Buckets are cut to `most` rows each before a trial's rows meet.
    """
    dealt = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("key", F.md5(F.concat_ws("-", "id", "trial")))
    total = rows.count()
    share = (4 * most + 200) / max(total, 1)
    if share < 1:
        low = written(dealt.where(F.col("key") < f"{int(share * (1 << 60)):015x}").select("trial", "key", "id", "estimate", "truth"))
        counts = [r["count"] for r in low.groupBy("trial").count().collect()]
        if len(counts) == trials and min(counts) >= most:
            dealt = low
    first = lambda *by: F.row_number().over(Window.partitionBy("trial", *by).orderBy("key", "id"))
    few = dealt.withColumn("bucket", F.substring("key", 32, 1)).withColumn("place", first("bucket")).where(F.col("place") <= most)
    return few.withColumn("place", first()).where(F.col("place") <= most).select("trial", "place", "id", "estimate", "truth")


def learning_curve(rows: DataFrame, trials: int = 20, sizes: tuple[int, ...] = SIZES, alpha: float = 0.05) -> DataFrame:
    """trial, size, q, n, coverage, width, reliable, precision of rows(id, estimate, truth), all within -1 and 1.

    q is the conformal quantile of the absolute residuals of the trial's first `size` rows (1 if there are too few for one); the others are held out. Sizes beyond
    the number of rows are left out.
    coverage: share of them within q of the estimate; width: mean length of the intervals, cut at -1 and 1; reliable: share of intervals without
    0; precision: share of these with the truth's sign and a real effect, null without any. Every held-out sum is a step function of q that
    each row changes at four places; rows are dealt to the places between the (few) quantiles by one search, and one aggregate serves all
    trials and sizes. What the calibrating rows themselves add is taken off again. Ids are unique.
    """
    sample = nested_samples(rows, trials, max(sizes)).withColumn("residual", F.abs(F.col("truth") - F.col("estimate")))
    wanted = F.explode(F.array(*(F.struct(F.lit(n).alias("size"), F.lit(math.ceil((n + 1) * (1 - alpha))).alias("rank")) for n in sizes)))
    held = sample.withColumn("w", wanted).select("*", "w.size", "w.rank").where(F.col("place") <= F.col("size"))
    by_rank = F.array_sort(F.collect_list("residual"))
    qs = held.groupBy("trial", "size").agg(F.count(F.lit(1)).alias("there"), F.when(F.first("rank") <= F.first("size"), F.get(by_rank, F.first("rank") - 1)).otherwise(F.lit(1.0)).alias("q")).where("there = size").drop("there")
    # At most trials x sizes numbers.
    levels = sorted({r["q"] for r in qs.select("q").collect()})
    if not levels:
        return qs.select("trial", "size", "q", *(F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("coverage", "double"), ("width", "double"), ("reliable", "double"), ("precision", "double"))))
    ordered = F.array(*map(F.lit, levels))
    size, p = F.abs("estimate"), F.col("estimate")
    right = ((F.signum(p) == F.signum("truth")) & (F.abs("truth") > REAL)).cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def step(at, n, cut, cut_sum, far, far_right):
        """The number of levels below (or, for what ends at a level, up to) a row's own place, and what changes there."""
        return F.struct(at.alias("at"), n.alias("n"), cut.alias("cut"), cut_sum.alias("cut_sum"), far.alias("far"), far_right.alias("far_right"))

    below = lambda x: F.size(F.filter(ordered, lambda level: level < x))
    nought = F.lit(0.0)
    steps = F.array(
        step(below(F.abs(F.col("truth") - p)), one, zero, nought, zero, zero),
        # Above 1 - p the upper end stays at 1, and above 1 + p the lower one at -1: those are q longer than they should be.
        step(below(1 - p), zero, one, 1 - p, zero, zero), step(below(1 + p), zero, one, 1 + p, zero, zero),
        step(below(size), zero, zero, nought, one, right),
    )
    sums = [F.sum(f"x.{c}").alias(c) for c in ("n", "cut", "cut_sum", "far", "far_right")]
    places = rows.select(F.explode(steps).alias("x")).groupBy("x.at").agg(*sums)
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum((size >= 0).cast("long") * right).alias("all_right"))
    order = Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    all_places = places.sparkSession.range(len(levels)).select(F.col("id").cast("int").alias("at")).join(places, "at", "left")
    told = all_places.select("at", F.get(ordered, F.col("at")).alias("q"), *(F.coalesce(F.sum(c).over(order), F.lit(0)).alias(c) for c in ("n", "cut", "cut_sum", "far", "far_right")))
    whole = qs.join(F.broadcast(told), "q").crossJoin(F.broadcast(total))
    # The calibrating rows' own part, row by row: there are at most trials x the sum of sizes.
    own = held.join(F.broadcast(qs), ["trial", "size"])
    q = F.col("q")
    reliable = (size > q).cast("long")
    width = F.least(p + q, F.lit(1.0)) - F.greatest(p - q, F.lit(-1.0))
    own = own.groupBy("trial", "size").agg(F.count(F.lit(1)).alias("own"), F.sum((F.col("residual") <= q).cast("long")).alias("own_n"), F.sum(width).alias("own_width"), F.sum(reliable).alias("own_far"), F.sum(reliable * right).alias("own_right"))
    out = whole.join(own, ["trial", "size"])
    n = F.col("rows") - F.col("own")
    lengths = 2 * F.col("q") * F.col("rows") - (F.col("cut") * F.col("q") - F.col("cut_sum")) - F.col("own_width")
    far, far_right = F.col("rows") - F.col("far") - F.col("own_far"), F.col("all_right") - F.col("far_right") - F.col("own_right")
    return out.select("trial", "size", "q", n.alias("n"), F.try_divide(F.col("n") - F.col("own_n"), n).alias("coverage"), F.try_divide(lengths, n).alias("width"), F.try_divide(far, n).alias("reliable"), F.try_divide(far_right, far).alias("precision"))


def curve_summary(curve: DataFrame) -> DataFrame:
    """size, coverage, coverage_lo, coverage_hi, width, reliable, precision over the trials: means, and the 2.5 and 97.5 percentiles of coverage."""
    return curve.groupBy("size").agg(F.avg("coverage").alias("coverage"), F.percentile("coverage", 0.025).alias("coverage_lo"), F.percentile("coverage", 0.975).alias("coverage_hi"), F.avg("width").alias("width"), F.avg("reliable").alias("reliable"), F.avg("precision").alias("precision"))
