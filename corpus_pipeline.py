"""A corpus pipeline: toxic documents go, near-duplicates go, repeated passages go, contaminated documents go, the rest is packed.

All stages take null ids and texts, repeated rows, empty tables and further columns of any name: rows without an id are documents of their
own, and all but the last stage return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spliceflow.llm import decontaminate, packing, simhash_dedup, substring_dedup, toxicity
from spliceflow.llm.common import cut, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows whose text is scored as toxic; null and empty texts score as a text without toxic passages. Labels are read
    for training only."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id (null last), then text hash. Null and empty texts are a group."""
    return simhash_dedup.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated sentence spans taken out of their texts but for the first occurrence; n_chars is set anew. Null texts stay null."""
    return substring_dedup.remove_repeats(docs, length_col="n_chars")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the documents that hold a window of a benchmark item; an empty benchmark drops none."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets; a null text is one piece that holds the end token."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL: the first stage is a fitted model, the second follows links without end, the last solves a packing. See tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of documents; each stage's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
