"""What the operators share: tables written to cut lineage, and connected components over link tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def frame(rows: list[tuple], columns: str) -> pd.DataFrame:
    """Rows for Spark, columns given as "name type, ...": whole numbers may be null, strings are plain objects."""
    names, kinds = zip(*(c.split() for c in columns.split(", ")), strict=True)
    made = pd.DataFrame(rows, columns=list(names), dtype=object)
    return made.astype({n: {"long": "Int64", "int": "Int32", "double": "float64"}[k] for n, k in zip(names, kinds, strict=True) if k in ("long", "int", "double")})


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores in front as keep it apart from the columns of df."""
    held = {c.lower() for c in df.columns}
    return [next(made for k in range(len(held) + 1) if (made := "_" * k + name).lower() not in held) for name in names]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share. Only a one-machine session may go without the setting; it gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spliceflow-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame | None) -> None:
    """Deletes a table of cut() that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def laid_out(rows: DataFrame, *order: str | Column, keep: list[str] | None = None) -> DataFrame:
    """rows in their global order, written, with the columns part and at added: both grow along the order and at is unique.

    Rows are dealt out by ranges and equal ones by where they were read, so a key with very many rows lies in several parts. keep: the
    columns to write (all).
    """
    spread = rows.withColumn("__read", F.monotonically_increasing_id())
    by_range = spread.repartitionByRange(*order, "__read").sortWithinPartitions(*order, "__read")
    return cut(by_range.select(*(keep or rows.columns), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))


def numbered(table: DataFrame, name: str) -> DataFrame:
    """A table of laid_out() with a column that counts its rows from 0 along the order. There are as many sums as parts."""
    per = table.groupBy("part").agg(F.count(F.lit(1)).alias("__n"), F.min("at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    handed = per.select("part", (before - F.col("__first")).alias("__shift"))
    return table.join(F.broadcast(handed), "part").withColumn(name, F.col("at") + F.col("__shift")).drop("__shift")


def carried(table: DataFrame, keys: list[str], *columns: str, also: DataFrame | None = None) -> DataFrame:
    """A table of laid_out(keys, ...) with before_c and total_c for each of columns: the sums of c over a key's rows before and over all.

    A key isn't gathered: each of its parts is summed by itself, and a small table (a row for each key and part) hands on what lies before.
    also: a table by keys whose columns are added. Keys aren't null.
    """
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ahead = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = table.groupBy(*keys, "part").agg(*(F.sum(c).alias(c) for c in columns))
    handed = per.select(*keys, "part", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"before_{c}") for c in columns), *(F.sum(c).over(whole).alias(f"total_{c}") for c in columns))
    handed = handed if also is None else handed.join(also, keys)
    inside = Window.partitionBy(*keys, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return table.join(handed, [*keys, "part"]).withColumns({f"before_{c}": F.col(f"before_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum((F.col("u") != F.col("v")).cast("long"))).first())


def _toward_min(rows: DataFrame, keep_larger: bool) -> DataFrame:
    """For each u, links its partners (those above u, or all) and u itself to the smallest of them.

    The minima are a table of their own, so both sides of the join are exchanged by u and Spark can split a u with very many partners. They
    are never broadcast: small files can hold many rows, all of which would pass through the driver in every round.
    """
    least = cut(rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    met = rows.join(least.hint("merge"), "u")
    if keep_larger:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    new = cut(out.where("u != v").distinct())
    drop_cut(least)
    return new


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(u, v): root is the smallest node that links reach.

    Alternates the large-star and small-star steps until the links no longer change; each step is one written table, and the
    number of links never grows. Only counts and a checksum come to the driver. Null ends and loops are ignored; a node without
    links isn't returned. No links: no rows.
    """
    edges = cut(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_min(both, keep_larger=True)
        small = _toward_min(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), keep_larger=False)
        drop_cut(large)
        drop_cut(edges)
        edges, after = small, _mark(small)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
