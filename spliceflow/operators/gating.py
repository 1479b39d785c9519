"""Searches over grids of gates and filters, and reports of calibrated intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.functions.calibration import interval_score
from spliceflow.operators.metrics import share, wilson
from spliceflow.operators.ranks import running

NOMINAL = 0.95
#: Bits of a number that stand for configurations of a grid.
BITS = 60


def gate_grid(rows: DataFrame, keys: list[str], gates: dict[str, bool], success: str) -> DataFrame:
    """keys, the gates' thresholds, n, k: how many rows pass all gates at these thresholds and how many of them succeed.

    gates maps a column to whether rows pass at or above (True) or at or below it. Thresholds are the column's different values within the
    keys. Counts of cells are summed along one gate after the other, so the work is the grid's size, not rows times thresholds; the grid
    itself is built by joins on the keys. Null values pass no gate.
    """
    names = list(gates)
    rows = rows.where(reduce(Column.__and__, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in names)))
    cells = rows.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(success).cast("long")).alias("k"))
    grid = reduce(lambda a, b: a.join(b, keys), (cells.select(*keys, c).distinct() for c in names))
    grid = grid.join(cells, [*keys, *names], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "k": F.coalesce("k", F.lit(0))})
    for c, above in gates.items():
        along = Window.partitionBy(*keys, *(x for x in names if x != c)).orderBy(F.desc(c) if above else F.asc(c)).rowsBetween(Window.unboundedPreceding, 0)
        grid = grid.withColumns({"n": F.sum("n").over(along), "k": F.sum("k").over(along)})
    return grid


def confidence_gate(rows: DataFrame, keys: list[str], width: str, cv: str, success: str, accuracy: float, least: int, default_width: float, default_cv: float) -> DataFrame:
    """keys, width, cv: the gates that let most rows pass at the accuracy (then the more accurate, narrower, smaller ones), never tighter
    than default_width nor looser than default_cv. Keys without such gates stay out."""
    grid = gate_grid(rows, keys, {width: False, cv: False}, success).where((F.col("n") >= least) & (F.col("k") >= accuracy * F.col("n")))
    best = F.max(F.struct("n", (F.col("k") / F.col("n")).alias("a"), (-F.col(width)).alias("w"), (-F.col(cv)).alias("c"))).alias("b")
    return grid.groupBy(*keys).agg(best).select(*keys, F.greatest(F.lit(default_width), -F.col("b.w")).alias("width"), F.least(F.lit(default_cv), -F.col("b.c")).alias("cv"))


def effect_gate(rows: DataFrame, keys: list[str], effect: str, snr: str, cv: str, success: str, accuracy: float, least: int) -> DataFrame:
    """keys, selected, accuracy, effect, snr, cv: the override that lets most rows pass by effect and signal, with or without (null) a
    ceiling on cv; of equals the more accurate, then the one with a ceiling, larger effect, larger signal, lower ceiling."""
    with_cv = gate_grid(rows, keys, {effect: True, snr: True, cv: False}, success).select(*keys, "n", "k", F.col(effect).alias("e"), F.col(snr).alias("s"), F.lit(1).alias("uses"), (-F.col(cv)).alias("c"))
    without = gate_grid(rows, keys, {effect: True, snr: True}, success).select(*keys, "n", "k", F.col(effect).alias("e"), F.col(snr).alias("s"), F.lit(0).alias("uses"), F.lit(-1.0).alias("c"))
    good = with_cv.union(without).where((F.col("n") >= least) & (F.col("k") >= accuracy * F.col("n")))
    best = good.groupBy(*keys).agg(F.max(F.struct("n", (F.col("k") / F.col("n")).alias("a"), "uses", "e", "s", "c")).alias("b"))
    return best.select(*keys, F.col("b.n").alias("selected"), F.col("b.a").alias("accuracy"), F.col("b.e").alias("effect"), F.col("b.s").alias("snr"), F.when(F.col("b.uses") == 1, -F.col("b.c")).alias("cv"))


def filter_grid(transcripts: DataFrame, reference: DataFrame, keys: list[str], scores: list[float], coverages: list[float], supports: list[int]) -> DataFrame:
    """min_score, min_coverage, min_support, found, hits, f1 of each configuration: different chains of transcripts(keys, chain, score,
    cov, support, n_exons, length) that pass, against the reference's(keys, chain).

    The configurations that a transcript passes are bits of a few numbers, so it is exchanged once, whatever their number; different chains are then counted by
    their bits.
    """
    choices = [(float(s), float(c), n) for s in scores for c in coverages for n in supports]
    grid = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"), F.lit(c).alias("c"), F.lit(n).alias("n")) for i, (s, c, n) in enumerate(choices)))
    score, cov = F.col("score"), F.col("cov")
    passes = lambda s, c, n: ((score >= s) | ((cov >= max(20.0, 10 * c)) & (score >= s / 2))) & (cov >= c) & ((F.col("n_exons") < 2) | (F.col("support") >= n)) & (F.col("length") >= 50)
    words = [f"__w{k}" for k in range(-(-len(choices) // BITS))]
    bits = {w: reduce(Column.__add__, (F.when(passes(*g), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, g in enumerate(choices[k * BITS : (k + 1) * BITS]))) for k, w in enumerate(words)}
    truth = reference.select(*keys, "chain").distinct().withColumn("__true", F.lit(1))
    chains = transcripts.select(*keys, "chain", *(b.alias(w) for w, b in bits.items())).where(reduce(Column.__or__, (F.col(w) != 0 for w in words))).groupBy(*keys, "chain").agg(*(F.bit_or(w).alias(w) for w in words))
    alike = chains.join(truth, [*keys, "chain"], "left").groupBy(*words).agg(F.count(F.lit(1)).alias("n"), F.count("__true").alias("h"))
    held = F.filter(grid, lambda g: F.call_function("getbit", F.get(F.array(*words), F.floor(g["i"] / BITS).cast("int")), g["i"] % BITS) == 1)
    counts = alike.select("n", "h", F.explode(held).alias("g")).groupBy("g").agg(F.sum("n").alias("found"), F.sum("h").alias("hits"))
    wanted = truth.agg(F.count(F.lit(1)).alias("__n"))
    f1 = 2 * F.col("hits") / F.greatest(F.col("found") + F.col("__n"), F.lit(1))
    every = transcripts.sparkSession.range(1).select(F.explode(grid).alias("g"))
    return every.join(counts, "g", "left").crossJoin(F.broadcast(wanted)).select(F.col("g.s").alias("min_score"), F.col("g.c").alias("min_coverage"), F.col("g.n").alias("min_support"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce(f1, F.lit(0.0)).alias("f1"))


def best_filter(grid: DataFrame) -> DataFrame:
    """The row of filter_grid() with the greatest f1, the first of equals."""
    order = F.struct("f1", (-F.col("min_score")).alias("a"), (-F.col("min_coverage")).alias("b"), (-F.col("min_support")).alias("c"))
    return grid.groupBy().agg(F.max_by(F.struct("*"), order).alias("x")).select("x.*")


def uniform(id_: Column, seed: int = 42) -> Column:
    """A number from 0 to 1 that depends on id and seed only, by MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), id_.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def sharpness(rows: DataFrame, keys: list[str], id_col: str, clip: tuple[float, float], alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Coverage, width and score of rows(low, high, estimate, truth), and the coverage of intervals of the same width about the estimate
    and about random centres."""
    low, high, truth = F.col("low"), F.col("high"), F.col("truth")
    half = (high - low) / 2
    inside = lambda c: (truth >= F.greatest(c - half, F.lit(clip[0]))) & (truth <= F.least(c + half, F.lit(clip[1])))
    centre = F.lit(clip[0]) + uniform(F.col(id_col), seed) * (clip[1] - clip[0])
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), share((truth >= low) & (truth <= high)).alias("coverage"), F.avg(high - low).alias("mean_width"), F.avg(interval_score(low, high, truth, alpha)).alias("interval_score"),
        share(inside(F.col("estimate"))).alias("estimate_centred"), share(inside(centre)).alias("random_centred"),
    )


def coverage_table(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, n, k, coverage, low, high (Wilson), mean_width, mean_score and descriptive (too few rows) of rows(low, high, truth)."""
    hit = (F.col("truth") >= F.col("low")) & (F.col("truth") <= F.col("high"))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("long")).alias("k"), F.avg(F.col("high") - F.col("low")).alias("mean_width"), F.avg(interval_score(F.col("low"), F.col("high"), F.col("truth"))).alias("mean_score"))
    w = wilson(F.col("k").cast("double"), F.col("n"))
    return out.select(*keys, "n", "k", (F.col("k") / F.col("n")).alias("coverage"), w["low"].alias("low"), w["high"].alias("high"), "mean_width", "mean_score", (F.col("n") < least).alias("descriptive"))


def partition_gate(table: DataFrame) -> DataFrame:
    """One row: eligible bins of coverage_table(), those whose interval excludes the nominal coverage, whether two intervals are apart
    (the greatest low end above the least high end), the largest gap, and whether both findings hold."""
    e = table.where("not descriptive")
    out = e.agg(
        F.count(F.lit(1)).alias("eligible"), F.count(F.when((F.col("low") > NOMINAL) | (F.col("high") < NOMINAL), 1)).alias("excluding"), F.coalesce(F.max("low") > F.min("high"), F.lit(False)).alias("disjoint"),
        F.max(F.abs(F.col("coverage") - NOMINAL)).alias("max_gap"), F.min("coverage").alias("worst"), F.max("coverage").alias("best"),
    )
    return out.withColumn("go", F.col("disjoint") & (F.col("excluding") > 0))


def inflated_summary(rows: DataFrame, keys: list[str], factor: float, width_threshold: Column) -> DataFrame:
    """keys, n, coverage, median_width, confident, confident_accuracy of rows(psi, low, high, truth, raw_confident, correct) after the arms
    of the intervals are stretched by a factor."""
    low, high = F.col("psi") - factor * (F.col("psi") - F.col("low")), F.col("psi") + factor * (F.col("high") - F.col("psi"))
    width = (F.col("high") - F.col("low")) * factor
    sure = F.col("raw_confident") & (width < width_threshold)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), share((F.col("truth") >= low) & (F.col("truth") <= high)).alias("coverage"), F.percentile(width, F.lit(0.5)).alias("median_width"),
        F.count(F.when(sure, 1)).alias("confident"), F.avg(F.when(sure, F.col("correct").cast("double"))).alias("confident_accuracy"),
    )


def detection_metrics(rows: DataFrame, keys: list[str], call: Column, label: Column) -> DataFrame:
    """keys, tp, fp, fn, tn, precision, recall, fpr; null where a denominator is zero."""
    n = lambda c: F.sum(c.cast("long"))
    out = rows.groupBy(*keys).agg(n(call & label).alias("tp"), n(call & ~label).alias("fp"), n(~call & label).alias("fn"), n(~call & ~label).alias("tn"))
    return out.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "fpr": F.try_divide("fp", F.col("fp") + F.col("tn"))})


def cluster_interval(rows: DataFrame, value: str, cluster: str, draws: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean when whole clusters are drawn again: Poisson weights by cluster and draw, from hashes; each cluster
    is one row before it is copied."""
    sums = rows.groupBy(cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    u = (F.pmod(F.xxhash64(F.col(cluster), F.col("b"), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    edges, total, term = [], 0.0, 0.36787944117144233
    for k in range(1, 9):  # Poisson(1) below 1, 2, ... 8
        total += term
        edges.append(total)
        term /= k
    copies = sums.select(cluster, "s", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b")).withColumn("u", u)
    weight = reduce(Column.__add__, ((F.col("u") > e).cast("int") for e in edges))
    means = copies.withColumn("w", weight).groupBy("b").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("m"))
    q = lambda p: F.percentile("m", F.lit(p))
    return means.agg(q((1 - level) / 2).alias("low"), q((1 + level) / 2).alias("high"))


def null_thresholds(rows: DataFrame, key: str, value: str, rate: float, least: int, floor: float) -> DataFrame:
    """key, n, pooled, threshold: the value that a share `rate` of null rows exceeds (the higher of its two neighbours, at least `floor`);
    keys with fewer than `least` rows take that of all rows."""

    def higher(keys: list[str]) -> DataFrame:
        ranked = running(rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("here")), keys, value, "here")
        place = F.ceil((F.col("total_here") - 1).cast("decimal(18,0)") * F.lit(f"{1 - rate:.6f}").cast("decimal(8,6)")).cast("long") + 1
        return ranked.where(F.col("before_here") + F.col("here") >= place).groupBy(*keys, F.col("total_here").alias("n")).agg(F.min(value).alias("t"))

    pooled = higher([]).select(F.col("t").alias("__pooled"))
    out = higher([key]).crossJoin(F.broadcast(pooled)).withColumn("pooled", F.col("n") < least)
    return out.select(key, "n", "pooled", F.greatest(F.lit(floor), F.when(F.col("pooled"), F.col("__pooled")).otherwise(F.col("t"))).alias("threshold"))
