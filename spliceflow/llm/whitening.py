"""Whitening of embeddings with distributed block matrices.

Rows are numbered without gaps and centred; as an indexed row matrix they become blocks. The transposed blocks times the blocks are the
scatter matrix, summed over many parts of the rows at once (the product's inner dimension is split). Its eigenvectors are found on the
driver, where only width x width numbers arrive, and the blocks times the whitening matrix are the whitened rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceflow.llm.common import cut, drop_cut, laid_out, numbered

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Rows of a block.
BLOCK_ROWS = 1024
#: Blocks of rows that one part of a product sums up.
BLOCKS_A_PART = 16
#: Entries times SCALE are held within this on both sides, so that every finite entry has a long.
_MOST = 9e18
#: Eigenvalues below this share of the greatest are those of a direction without variance.
_FLAT = 1e-12


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x: the usable rows with their entries as longs; the commonest vector length (of equals the greatest) only. Written."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & (F.size("v") > 0))
    whole = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(_MOST)), F.lit(-_MOST))) + SHIFT
    made = cut(rows.select("vec_id", F.transform("v", whole).alias("x")))
    widths = made.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    return made.where(F.size("x") == (widths[0]["width"] if widths else 0))


def column_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each entry of x, whatever its size: halves of the longs are summed by batch, then by entry."""

    def halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                yield pd.DataFrame({"k": np.arange(x.shape[1]), "n": len(x), "high": (x >> 32).sum(axis=0), "low": (x & 0xFFFFFFFF).sum(axis=0)})

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = rows.select("x").mapInPandas(halves, "k long, n long, high long, low long").groupBy("k").agg(F.sum("n").alias("n"), exact("high").alias("high"), exact("low").alias("low")).orderBy("k").collect()
    return (sums[0]["n"] if sums else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in sums]


def _blocks(rows: DataFrame, n: int, total: list[int], rows_n: int, index: str) -> BlockMatrix:
    """The rows minus total / n as blocks; index numbers them from 0 without gaps."""
    floors = F.array(*(F.lit(s // n).cast("double") for s in total))
    parts = F.array(*(F.lit((s % n) / n) for s in total))
    # Whole numbers are subtracted first: near the mean that is exact.
    centred = F.zip_with(F.zip_with(F.transform("x", lambda c: c.cast("double")), floors, lambda a, b: a - b), parts, lambda a, b: a - b)
    frame = MLUtils.convertVectorColumnsFromML(rows.select(F.col(index).alias("index"), array_to_vector(centred).alias("vector")), "vector")
    blocks = IndexedRowMatrix(frame, rows_n, len(total)).toBlockMatrix(BLOCK_ROWS, len(total))
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)


def _product(a: BlockMatrix, b: BlockMatrix, inner: int) -> np.ndarray:
    """a times b on the driver, both sides' inner dimension of `inner` blocks split so that no task sums all of it."""
    made = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, max(1, -(-inner // BLOCKS_A_PART)))
    return BlockMatrix(made, a.rowsPerBlock, b.colsPerBlock).toLocalMatrix().toArray()


def _local(spark: SparkSession, matrix: np.ndarray) -> BlockMatrix:
    block = DenseMatrix(*matrix.shape, matrix.flatten(order="F"))
    return BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), matrix.shape[0], matrix.shape[1])


def _projected(blocks: BlockMatrix, matrix: np.ndarray, spark: SparkSession) -> BlockMatrix:
    return blocks.multiply(_local(spark, matrix)).persist(StorageLevel.MEMORY_AND_DISK)


def _rows(blocks: BlockMatrix) -> DataFrame:
    """index, vector of a block matrix, without leaving the JVM."""
    frame = callMLlibFunc("getIndexedRows", blocks.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    frame = MLUtils.convertVectorColumnsToML(frame, "vector")
    return frame.select("index", vector_to_array("vector").alias("vector"))


def _deviations(rows: DataFrame, n: int, total: list[int]) -> DataFrame:
    """rows with deviation: the sum of (n x - S) ** 2 over the entries, exact; null where it is beyond a long."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_numpy())
            most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in total)
            if most < 1 << 63:
                off = n * x - np.array(total)
                most = max(abs(int(off.max())), abs(int(off.min())))
                off = off if most * most * len(total) < 1 << 63 else off.astype(object)
            else:
                off = n * x.astype(object) - np.array(total, dtype=object)
            sums = [int(s) if s < 1 << 63 else None for s in (off * off).sum(axis=1)]
            yield pd.DataFrame({"index": batch["index"], "deviation": pd.array(sums, dtype="Int64")})

    return rows.select("index", "x").mapInPandas(measure, "index long, deviation long")


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and each of the first components.

    An entry c is x = floor(64 c) + 1000000. Rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are
    those of another length than most. Repeated rows are rows of their own; mean and covariance count each distinct x once. Components
    are numbered by falling eigenvalue (ties: as the solver orders them), their greatest entry positive. Directions without variance
    have no row, so a table of equal vectors, like an empty one, gives none. Ids keep their type and may be null; other columns aren't
    read. Entries beyond about 1.4e17 count as that; a deviation beyond a long is null.
    """
    spark = vectors.sparkSession
    rows = cut(numbered(laid_out(integers(vectors, id_col, vector_col), F.xxhash64("x")), "index").select("index", "vec_id", "x"))
    fit = cut(numbered(laid_out(rows.select("x").distinct(), F.xxhash64("x")), "index").select("index", "x"))
    n, total = column_sums(fit)
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    none = rows.select("vec_id").limit(0).selectExpr("vec_id", *(f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in schema.split(", ")))
    if not n:
        return none
    blocks, inner = _blocks(fit, n, total, n, "index"), -(-n // BLOCK_ROWS)
    values, axes = np.linalg.eigh(_product(blocks.transpose(), blocks, inner) / n)
    values, axes = values[::-1], axes[:, ::-1]
    kept = int((values[:components] > max(values[0], 0) * _FLAT).sum())
    if not kept:
        return none
    axes = axes[:, :kept] * np.sign(axes[np.abs(axes[:, :kept]).argmax(axis=0), np.arange(kept)])
    matrix = axes / np.sqrt(values[:kept])
    own = _projected(blocks, matrix, spark)
    error = float(np.abs(_product(own.transpose(), own, inner) / n - np.eye(kept)).max())
    every = _blocks(rows, n, total, rows.count(), "index")
    turned = _rows(_projected(every, matrix, spark))
    share = F.array(*(F.lit(float(v)) for v in values[:kept] / values.sum()))
    met = rows.select("index", "vec_id").join(_deviations(rows, n, total), "index").join(turned, "index")
    out = cut(
        met.select("vec_id", "deviation", F.posexplode("vector").alias("at", "whitened"))
        .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
    )
    for matrix_ in (blocks, own, every):
        matrix_.blocks.unpersist()
    for table in (rows, fit):
        drop_cut(table)
    return out
