"""Long reads as paths of the splice graph: co-linear chains of nodes that their exons match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.operators.intervals import overlap_join
from spliceflow.operators.tables import swept


def matched_nodes(exons: DataFrame, nodes: DataFrame, tolerance: int = 5) -> DataFrame:
    """exons(locus, read, exon, s, e, ...) with each node(locus, node, s, e, ...) that matches: one that lies within the exon give or take the tolerance, or has
    over half of it inside."""
    wide = exons.withColumns({"s": F.col("s") - tolerance, "e": F.col("e") + tolerance})
    met = overlap_join(wide, nodes.withColumnsRenamed({"s": "rs", "e": "re"}), ["locus"])
    inside = (F.col("rs") >= F.col("s")) & (F.col("re") <= F.col("e"))
    shared = F.least(F.col("re"), F.col("e") - tolerance) - F.greatest(F.col("rs"), F.col("s") + tolerance)
    return met.where(inside | (2 * shared > F.col("re") - F.col("rs"))).drop("s", "e", "rs", "re")


def _follow(state: dict, exon: int, node: int, last: int, into: list[int] | None, open_: bool | None, closed: bool | None) -> None:
    """The best chain to a node of an exon, from those to the nodes before it, which came before."""
    chains = state.setdefault("chains", {})
    state["last"] = last
    state.setdefault("opens", {})[node], state.setdefault("closes", {})[node] = bool(open_), bool(closed)
    told = [chains[x, a] for a in into or () for x in (exon - 1, exon) if (x, a) in chains]
    best = min(((-len(way), way) for way in told), default=None)
    if best:
        chains[exon, node] = (*best[1], node)
    elif exon == 1:
        chains[exon, node] = (node,)


def _followed(state: dict) -> list[tuple]:
    reached = [(-len(way), way) for (exon, _), way in state["chains"].items() if exon == state["last"]]
    if not reached:
        return []
    path = min(reached)[1]
    return [(list(path), state["opens"][path[0]] and state["closes"][path[-1]])]


def longread_paths(exons: DataFrame, nodes: DataFrame, edges: DataFrame, tolerance: int = 5) -> DataFrame:
    """locus, read, path, complete: of each read's chains the one of the most nodes, of these the smallest.

    A chain follows edges from node to node; each node matches the read's exon of the one before or the next exon, and every exon has a node.
    exons number from 1 without gaps. complete: the chain runs from a node without edges in to one without edges out, so that it can
    guide a decomposition. A read without a chain has no row. A node brings the nodes before it along, so reads meet their locus's graph once, and
    a read's matches stream through one task in their order.
    """
    ends = edges.select("locus", F.col("b").alias("node"), F.col("a").alias("into")).distinct().union(edges.select("locus", F.col("a").alias("node"), F.lit(None).cast(edges.schema["a"].dataType)).distinct())
    ways = ends.groupBy("locus", "node").agg(F.collect_list("into").alias("into"), F.bool_or(F.col("into").isNull()).alias("leaves"))
    known = nodes.select("locus", "node", "s", "e").join(ways, ["locus", "node"], "left")
    known = known.withColumns({"opens": F.col("leaves") & (F.size("into") == 0), "closes": ~F.col("leaves")}).drop("leaves")
    numbered = exons.withColumn("last", F.max("exon").over(Window.partitionBy("locus", "read")))
    pairs = matched_nodes(numbered.select("locus", "read", "exon", "last", "s", "e"), known, tolerance)
    kind = nodes.schema["node"].dataType.simpleString()
    return swept(pairs.select("locus", "read", "exon", "node", "last", "into", "opens", "closes"), ["locus", "read"], ["exon", "node"], _follow, _followed, f"path array<{kind}>, complete boolean")


def guide_paths(paths: DataFrame) -> DataFrame:
    """locus, path, reads: the complete paths of longread_paths(), each once."""
    return paths.where("complete").groupBy("locus", "path").agg(F.count(F.lit(1)).alias("reads"))


__all__ = ["guide_paths", "longread_paths", "matched_nodes"]
