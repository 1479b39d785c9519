"""Ends of terminal exons by the fall of coverage outward from a splice site."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceflow.operators.tables import spread, written

BINS_NEAR = 5
#: Bases of a chromosome whose anchors are looked up in one table of running counts, which also holds the reach on both sides.
STRETCH = 100_000
#: Anchors and bins that are looked at in one go.
ASKS, BINS = 20_000, 50


def terminal_boundaries(anchors: DataFrame, blocks: DataFrame, share: float = 0.10, reach: int = 10_000, least_span: int = 100) -> DataFrame:
    """anchor, boundary of anchors(anchor, chrom, pos, side): where coverage first falls below `share` of its peak near the anchor.

    side is left or right. blocks: chrom, s, e of the aligned blocks of reads, s < e. Looked at are `reach` bases outward, within the chromosome's
    blocks, in bins of 10 bases (fewer for short stretches); a block counts for each bin it touches, its end included. The peak is that of the
    BINS_NEAR bins next to the anchor's and its own. Where there is no coverage the boundary is `least_span` from the anchor, not below 0;
    where coverage never falls it is the end of the stretch. A bin's coverage is the number of blocks that begin before its end less that of those
    that end before its start, so anchors and blocks form no pairs: both are counted by place, and a stretch of a chromosome is a table of running counts.
    """
    extent = blocks.groupBy("chrom").agg(F.min("s").alias("first"), F.max("e").alias("last"))
    left = F.col("side") == "left"
    looked = anchors.select("chrom", "pos", "side").distinct().join(F.broadcast(extent), "chrom").withColumns({"rs": F.when(left, F.greatest("first", F.col("pos") - reach)).otherwise(F.col("pos")), "re": F.when(left, F.col("pos")).otherwise(F.least("last", F.col("pos") + reach))})
    looked = looked.withColumn("width", F.greatest(F.least(F.floor((F.col("re") - F.col("rs")) / 10), F.lit(10)), F.lit(1)))
    looked = looked.withColumn("bins", F.greatest(F.floor((F.col("re") - F.col("rs")) / F.col("width")), F.lit(1))).where("rs < re")
    asks = looked.select("chrom", F.floor(F.col("pos") / STRETCH).alias("at"), "pos", "side", "rs", "re", "width", "bins")
    # What a stretch's anchors can see of a block; ends that lie beyond come to its edges.
    sight = reach + 1
    placed = blocks.select("chrom", "s", "e", F.explode(F.sequence(F.floor((F.col("s") - sight) / STRETCH), F.floor((F.col("e") + sight) / STRETCH))).alias("at"))
    begin, end = F.greatest("s", F.col("at") * STRETCH - sight), F.least("e", (F.col("at") + 1) * STRETCH + sight)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    step = lambda place, a, b: F.struct((place - F.col("at") * STRETCH + sight).alias("place"), a.alias("n_s"), b.alias("n_e"))
    steps = placed.select("chrom", "at", F.explode(F.array(step(begin, one, none), step(end, none, one))).alias("x"))
    steps = written(steps.groupBy("chrom", "at", "x.place").agg(F.sum("x.n_s").alias("n_s"), F.sum("x.n_e").alias("n_e")))
    near = BINS_NEAR

    def table(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty:
            return asked[["chrom", "pos", "side"]].assign(found=0)
        # How many lie before each place.
        before = {c: np.concatenate(([0], np.cumsum(np.bincount(held["place"], held[c], STRETCH + 2 * sight + 1).astype(np.int64)))) for c in ("n_s", "n_e")}
        low = key[1] * STRETCH - sight
        found = []
        for k in range(0, len(asked), ASKS):
            rs, re, width, bins = (asked[c].to_numpy()[k : k + ASKS, None] for c in ("rs", "re", "width", "bins"))
            leftward = (asked["side"] == "left").to_numpy()[k : k + ASKS, None]
            at = rs - low

            def depth(bin_: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
                """Blocks that touch the bin; in the first, those that end where it begins don't overlap."""
                ends = before["n_e"][at[rows] + bin_ * width[rows] + (bin_ == 0)]
                return before["n_s"][at[rows] + (bin_ + 1) * width[rows]] - ends

            some = before["n_s"][at + bins * width] > before["n_e"][at + 1]
            # The n-th bin outward.
            place = lambda n, rows: np.where(leftward[rows], bins[rows] - 1 - n, n)
            n = np.minimum(np.arange(near + 1)[None, :], bins - 1)
            peak = depth(place(n, slice(None))).max(axis=1, keepdims=True)
            least = np.maximum(np.floor(peak * share), 1)
            fall = bins[:, 0].copy()
            open_ = np.flatnonzero(some[:, 0])
            first = 0
            while len(open_):
                n = np.minimum(first + np.arange(BINS)[None, :], bins[open_] - 1)
                under = depth(place(n, open_), open_) < least[open_]
                hit = under.any(axis=1)
                fall[open_[hit]] = n[hit, under[hit].argmax(axis=1)]
                first += BINS
                open_ = open_[~hit & (bins[open_, 0] > first)]
            never = fall == bins[:, 0]
            to = np.where(leftward[:, 0], np.where(never, rs[:, 0], rs[:, 0] + (bins[:, 0] - fall) * width[:, 0]), np.where(never, re[:, 0], rs[:, 0] + fall * width[:, 0]))
            out = asked.iloc[k : k + ASKS][["chrom", "pos", "side"]].assign(found=to)
            found.append(out[some[:, 0]])
        return pd.concat(found)

    kinds = {f.name: f.dataType.simpleString() for f in anchors.schema.fields}
    told = spread(asks, "chrom", "at").groupBy("chrom", "at").cogroup(spread(steps, "chrom", "at").groupBy("chrom", "at")).applyInPandas(table, f"chrom {kinds['chrom']}, pos {kinds['pos']}, side {kinds['side']}, found long")
    span = max(1, min(least_span, reach))
    otherwise = F.when(left, F.greatest(F.col("pos") - span, F.lit(0))).otherwise(F.col("pos") + span)
    return anchors.join(told, ["chrom", "pos", "side"], "left").select("anchor", "side", F.coalesce("found", otherwise).alias("boundary"))
