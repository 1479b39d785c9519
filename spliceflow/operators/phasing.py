"""Paths of graph nodes that reads support."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceflow.operators.crowded import covering
from spliceflow.operators.intervals import overlap_join
from spliceflow.operators.tables import written


def block_nodes(blocks: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """blocks(qname, s, e) with the node(node, rs, re) that each overlaps most, if that is half of the block or 80 % of the node; of equals the smaller node.

    Equal blocks, and equal nodes, are looked up once. No node shares more than one that holds the whole block: the least of those comes from
    covering(), and only blocks that no node holds are paired with the nodes they overlap.
    """
    least = nodes.groupBy(*keys, "rs", "re").agg(F.min("node").alias("node"))
    asked = written(blocks.select(*keys, "s", "e").distinct())
    whole = written(covering(asked.where("s < e"), least.withColumn("__v", -F.col("node").cast("long")), keys, "__v").select(*keys, "s", "e", (-F.col("most")).cast(nodes.schema["node"].dataType).alias("node")))
    shared = F.least("e", "re") - F.greatest("s", "rs")
    met = overlap_join(asked.join(whole, [*keys, "s", "e"], "left_anti"), least, keys).withColumn("shared", shared).where("shared >= 0.5 * (e - s) or shared >= 0.8 * (re - rs)")
    rest = met.groupBy(*keys, "s", "e").agg(F.min_by("node", F.struct(-F.col("shared"), F.col("node"))).alias("node"))
    return blocks.join(whole.unionByName(rest), [*keys, "s", "e"]).select(*keys, "qname", "s", "e", "node").distinct()


def phasing_paths(blocks: DataFrame, nodes: DataFrame, keys: list[str], min_length: int = 2) -> DataFrame:
    """keys, path, support: node paths of at least min_length that reads run through, with the number of reads."""
    found = block_nodes(blocks, nodes, keys).groupBy(*keys, "qname").agg(F.array_sort(F.collect_list(F.struct("s", "e", "node"))).alias("b"))
    nodes_ = F.transform("b", lambda x: x["node"])
    path = F.filter(nodes_, lambda x, i: (i == 0) | (x != F.get(nodes_, i - 1)))
    return found.withColumn("path", path).where(F.size("path") >= min_length).groupBy(*keys, "path").agg(F.count(F.lit(1)).alias("support"))
