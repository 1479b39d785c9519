"""A stored index of intervals: written once, asked again and again without moving it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceflow.operators.intervals import BIN, CLASS, LEVELS, bins, level

BUCKETS = 64


def write_index(intervals: DataFrame, table: str, keys: list[str], path: str | None = None, buckets: int = BUCKETS, width: int = BIN) -> None:
    """Writes intervals(keys, s, e, ...) as a table: each row in the bins of its length's class, bucketed and sorted by key, class and bin.

    The bins' width is kept with the rows. path: where the table lies (the warehouse by default). A row touches about CLASS bins at most unless it is
    longer than the widest class.
    """
    own = bins(intervals.withColumn("__own", level("s", "e", width)), "s", "e", width, F.array("__own")).drop("__own").withColumn("__width", F.lit(width))
    by = [*keys, "__level", "__bin"]
    writer = own.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def query_index(spark: SparkSession, table: str, regions: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """regions(keys, rs, re, ...) with the columns of each indexed interval that overlaps them, each pair once.

    Regions go to the bins of all classes and meet the index bucket by bucket: only the regions are exchanged, or broadcast if they are few.
    width is that of write_index().
    """
    index = spark.table(table).where(F.col("__width") == width).drop("__width")
    asked = bins(regions, "rs", "re", width, F.array(*map(F.lit, range(LEVELS))))
    met = asked.join(index, [*keys, "__level", "__bin"]).where((F.col("s") < F.col("re")) & (F.col("rs") < F.col("e")))
    widths = F.element_at(F.array(*(F.lit(width * CLASS**n) for n in range(LEVELS))), F.col("__level") + 1)
    return met.where(F.col("__bin") == F.floor(F.greatest("s", "rs") / widths)).drop("__level", "__bin")
