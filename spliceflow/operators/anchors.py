"""Grouping by fixed anchors: each item joins the first anchor in order that it matches, or becomes one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.operators.intervals import islands, overlap_join
from spliceflow.operators.tables import dropped, mark, written


def first_anchors(holds: DataFrame) -> DataFrame:
    """item of those of holds(item, feature) that share no feature with an earlier anchor; items go in their numbers' order.

    The sequential rule in rounds: an undecided item that is the least undecided one of all its features has no earlier rival and is an
    anchor; who shares a feature with it isn't. A feature's rivals are never paired: it only tells its least item, by a partial minimum.
    """
    left, found = written(holds.distinct()), None
    while left.limit(1).count():
        least = left.groupBy("feature").agg(F.min("item").alias("least"))
        told = left.join(least, "feature")
        new = written(told.groupBy("item").agg(F.bool_and(F.col("item") == F.col("least")).alias("first")).where("first").select("item"))
        beaten = left.join(left.join(new, "item", "left_semi").select("feature").distinct(), "feature", "left_semi").select("item").distinct()
        rest = written(left.join(beaten, "item", "left_anti"))
        dropped(left)
        left, found = rest, new if found is None else found.union(new)
    return found if found is not None else left.select("item")


def span_anchors(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, s, e of the spans, in order of start and end, that overlap no anchor before them.

    From an anchor the next one is the first span that begins at or behind its end. Each span points there, within its island of
    overlapping spans; who can be reached from an island's first span is found by doubling the pointers.
    """
    each = spans.select(*keys, "s", "e").distinct()
    whole = islands(each, keys, gap=-1).select(*keys, F.col("island"), F.col("s").alias("rs"), F.col("e").alias("re"))
    placed = overlap_join(each, whole, keys).select(*keys, "island", "s", "e")
    place = [*keys, "island"]
    # What is asked (the end of a span) and what answers (its start) in one order, the answers behind the questions of their place.
    asked = placed.select(*place, F.col("e").alias("at"), F.lit(1).alias("kind"), F.struct("s", "e").alias("own")).union(placed.select(*place, F.col("s").alias("at"), F.lit(0).alias("kind"), F.struct("s", "e").alias("own")))
    onward = Window.partitionBy(*place).orderBy(F.desc("at"), "kind", F.desc("own")).rowsBetween(Window.unboundedPreceding, -1)
    answer = F.last(F.when(F.col("kind") == 0, F.col("own")), ignorenulls=True).over(onward)
    nxt = asked.withColumn("next", answer).where("kind = 1").select(*place, F.col("own").alias("here"), "next")
    first = placed.groupBy(*place).agg(F.min(F.struct("s", "e")).alias("here"))
    reached, pointers = written(first), written(nxt.where("next is not null"))
    while pointers.limit(1).count():
        more = written(reached.union(reached.join(pointers, [*place, "here"]).select(*place, F.col("next").alias("here"))).distinct())
        far = pointers.select(*place, F.col("here").alias("next"), F.col("next").alias("further"))
        jumped = written(pointers.join(far, [*place, "next"]).select(*place, "here", F.col("further").alias("next")))
        dropped(reached)
        dropped(pointers)
        reached, pointers = more, jumped
    return reached.select(*keys, "here.s", "here.e")


def anchor_groups(transcripts: DataFrame, keys: list[str]) -> DataFrame:
    """item, anchor of transcripts(keys, item, tx_start, tx_end, introns): spliced ones match if they share an intron, others if their spans
    overlap; item numbers the transcripts in order of start and end. A spliced and an unspliced transcript never match. Groups are loci
    that a read-through transcript can't chain together."""
    spliced = transcripts.where(F.size("introns") > 0).select("item", F.explode("introns").alias("i"), *keys).select("item", F.struct(*keys, "i").alias("feature"))
    anchors = first_anchors(spliced)
    owners = spliced.join(anchors, "item", "left_semi").groupBy("feature").agg(F.min("item").alias("anchor"))
    groups = spliced.join(owners, "feature").groupBy("item").agg(F.min("anchor").alias("anchor"))
    single = transcripts.where(F.size("introns") == 0).select(*keys, "item", F.col("tx_start").alias("s"), F.col("tx_end").alias("e"))
    chosen = span_anchors(single, keys).join(single, [*keys, "s", "e"]).groupBy(*keys, "s", "e").agg(F.min("item").alias("anchor")).withColumnsRenamed({"s": "rs", "e": "re"})
    return groups.union(overlap_join(single, chosen, keys).groupBy("item").agg(F.min("anchor").alias("anchor")))
