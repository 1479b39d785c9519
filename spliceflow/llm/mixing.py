"""Mixing sources to target weights by weighted fair queueing.

The documents of a source stand in a shuffled queue that starts anew when it ends, `repeats` times at most. A document's virtual finish time is
what its source has given with it, in words, divided by the source's target. All documents are put in the order of these times by a range
sort, and the mix ends where its words reach the budget: at time 1, when each source has given its target. A document that is in service then
is cut there, so that no source is further from its target than by a word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceflow.llm.common import carried, cut, drop_cut, laid_out, numbered

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: How often a document may be taken.
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
_SOURCE = ["no_source", "source"]


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, budget: int | None = None) -> DataFrame:
    """sources(no_source, source, source_size) with weight and target: the budget (all sizes by default) shared by weight, no target above `repeats` times its source's size.

    Sources weigh by their rank in the order of code points, the null source last. What a source can't give is shared among the others by
    weight: with sources in the order of size over weight, one stops at its most exactly if that is less than its share of what the
    sources before it leave. A budget beyond all that can be given stops everywhere.
    """
    ranked = numbered(laid_out(sources, *_SOURCE), "rank")
    share = F.get(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))).cast("int"))
    weighed = ranked.select(*_SOURCE, "source_size", "rank", share.alias("weight"), (F.lit(repeats) * F.col("source_size")).alias("most"))
    levels = carried(laid_out(weighed, F.col("most") / F.col("weight"), "rank"), [], "most", "weight")
    whole = F.lit(budget).cast("long") if budget is not None else (F.col("total_most") / repeats).cast("long")
    level = F.try_divide(whole - F.col("before_most"), F.col("total_weight") - F.col("before_weight"))
    levels = cut(levels.withColumn("full", F.col("most") / F.col("weight") < level).withColumn("whole", whole))
    # One row: the words and weights that are left to the sources that don't stop.
    left = levels.agg(F.max("whole") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))), F.lit(0)), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
    level = F.lit(left[0] / left[1] if left[1] else 0.0)
    return levels.select(*_SOURCE, "source_size", "weight", F.when(F.col("full"), F.col("most").cast("double")).otherwise(level * F.col("weight")).alias("target"))


def queues(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, budget: int | None = None) -> DataFrame:
    """Every row of docs in its place: doc_id, no_source, source, size, part, at, before_size (words of the source's rows ahead of it), source_size, weight, target.

    Rows stand by the MD5 of their id, then by size; at tells the rows apart. Ids keep their type. A null text has no words; rows with a
    null id or source are rows like others (null is a source of its own); repeated rows each have a place. An empty table gives an empty
    one; other columns aren't read.
    """
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), size.alias("size"))
    placed = laid_out(rows, *_SOURCE, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "size")
    sources = placed.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    return cut(carried(placed, _SOURCE, "size", also=targets(sources, weights, repeats, budget)).drop("total_size"))


def mix(placed: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """The mix in its order, of queues(): at (the row taken), doc_id, no_source, source, turn (from 0), taken, finish, part, nth.

    part and nth grow along the mix. Documents without words aren't in it. turn counts how often the queue has started anew.
    """
    quota = F.floor("target")
    ahead = F.col("turn") * F.col("source_size") + F.col("before_size")
    served = placed.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long")))).where(ahead < quota)
    taken = F.least(F.col("size"), quota - ahead)
    timed = served.withColumn("taken", taken).withColumn("finish", (ahead + F.col("taken")) / F.col("target")).select("at", "doc_id", *_SOURCE, "turn", "taken", "finish")
    ordered = laid_out(timed.withColumnRenamed("at", "row"), "finish", *_SOURCE, "turn", "row")
    out = ordered.withColumnsRenamed({"at": "nth", "row": "at"})
    out._cut_path = ordered._cut_path
    return out


def truncated(mixed: DataFrame, budget: int) -> DataFrame:
    """mixed with begins, the words ahead of each row, up to the row that reaches the budget, which is cut there."""
    placed = carried(mixed.withColumnsRenamed({"at": "row", "nth": "at"}), [], "taken").withColumnRenamed("before_taken", "begins").where(F.col("begins") < budget)
    return placed.withColumn("taken", F.least(F.col("taken"), F.lit(budget) - F.col("begins"))).drop("total_taken").withColumnsRenamed({"at": "nth", "row": "at"})


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs: how many of its words, repeats counted, a mix as large as all docs takes."""
    placed = queues(docs, id_col, text_col, source_col, weights, repeats)
    mixed = mix(placed, repeats)
    given = truncated(mixed, placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]).groupBy("at").agg(F.sum("taken").alias("taken"))
    out = cut(placed.join(given, "at", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))
    drop_cut(mixed)
    drop_cut(placed)
    return out
