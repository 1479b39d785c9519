"""Tables written to the folder that all machines share, to cut the lineage of jobs that go in rounds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a one-machine session may go without the setting; it gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spliceflow-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame) -> DataFrame:
    """The same rows, written and read again: computed once, and safe from lost executors.

    Spark sizes such a table by its files, which sorted columns make many times smaller than its rows: joins with it are merged, never broadcast
    from the driver unless they ask for it.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
    out._written_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(df._written_at)
    where.getFileSystem(conf).delete(where, True)


def mark(df: DataFrame, *columns: str) -> tuple:
    """Number and checksum of the rows; equal marks of two tables are equal rows, but for one chance in 2**64."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first())


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by their keys over all shuffle partitions, however few bytes they are: for rows that cost far more time than their size says."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
#: Rows of one batch that swept() gives.
SWEPT = 10_000


def _arrow(kind: str) -> pa.DataType:
    return pa.list_(_arrow(kind[6:-1])) if kind.startswith("array<") else _ARROW[kind]


def swept(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[..., None], close: Callable[[dict], Iterable[tuple]], schema: str) -> DataFrame:
    """keys and the columns of schema ("name type, ...", Spark's short names): what close(state) gives for each key.

    rows are dealt out by their keys and come in order; fold(state, ...) takes their other columns row by row, state is a dict that is empty at a key's first row.
    A key's rows stream through the task, so only what fold keeps of them is held. Keys aren't null.
    """
    others = [c for c in rows.columns if c not in keys]
    n, out = len(keys), [*((c, rows.schema[c].dataType.simpleString()) for c in keys), *(x.split(" ", 1) for x in schema.split(", "))]
    names, types = [x for x, _ in out], [_arrow(kind) for _, kind in out]

    def made(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, found = None, {}, []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).tolist() if c.null_count == 0 and pa.types.is_primitive(c.type) else c.to_pylist() for c in batch.columns]
            for key, row in zip(zip(*columns[:n], strict=True), zip(*columns[n:], strict=True), strict=True):
                if key != last:
                    if last is not None:
                        found += [(*last, *x) for x in close(state)]
                        if len(found) >= SWEPT:
                            yield made(found)
                            found = []
                    last, state = key, {}
                fold(state, *row)
        if last is not None:
            found += [(*last, *x) for x in close(state)]
        if found:
            yield made(found)

    dealt = spread(rows.select(*keys, *others), *keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(sweep, ", ".join(f"`{c}` {kind}" for c, kind in out))
