"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows are sets of positioned shingles of SHINGLE words. A document holds a window exactly if it holds all of its shingles in
place, so a single shingle, the window's rarest, is a sufficient prefix: shingles are ordered by how often the documents have them,
documents meet the windows on that one shingle, the window must lie inside the document (length and position), and the words there are
compared with the window's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceflow.llm.common import LOWER, UPPER, cut, unused

WINDOW_WORDS = 10
SHINGLE = 2
#: Windows sent to every task at once; a larger benchmark is handled in blocks of so many.
BLOCK_WINDOWS = 50_000
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of digits, letters a to z and characters beyond ASCII, A-Z lower-cased; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _GAPS), lambda w: w != "")


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window_words: int = WINDOW_WORDS) -> DataFrame:
    """(words, n, items): the different windows with the ids of their items. Items without words or id have none."""
    texts = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("item is not null and size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window_words + 1, F.lit(1)))
    each = texts.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window_words))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("n", F.size("words"))


def _shingle(words: Column, i: Column, size: int) -> Column:
    """Of `size` words from the 0-based place i; null where the words end before."""
    return reduce(lambda a, b: F.concat(a, F.lit(" "), b), [F.get(words, i + k) for k in range(size)])


def _at_each_word(docs: DataFrame, size: int) -> DataFrame:
    """docs with place and shingle for each word; the words themselves aren't copied."""
    return docs.select("*", F.posexplode("w").alias("place", "word")).withColumn("shingle", _shingle(F.col("w"), F.col("place"), size))


def _matches(docs: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, start, n, items): every place of a document at which a window of at least `size` words stands."""
    inside = windows.select("window", "words", "n", "items", F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("shift")).withColumn("shingle", _shingle(F.col("words"), F.col("shift"), size))
    # Rarity over all documents; shingles that no document has stay out, and so do their windows.
    asked = cut(inside.select("shingle").distinct())
    often = cut(_at_each_word(docs.select("w"), size).select("shingle").join(F.broadcast(asked), "shingle").groupBy("shingle").agg(F.count(F.lit(1)).alias("often")))
    ordered = inside.join(often, "shingle", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    prefix = cut(ordered.groupBy("window").agg(F.min(F.struct("often", "shift", "shingle")).alias("p"), F.first("words").alias("words"), F.first("n").alias("n"), F.first("items").alias("items")).where("p.often > 0").select("p.shift", "p.shingle", "words", "n", "items"))
    begin = F.col("place") - F.col("shift")
    met = _at_each_word(docs, size).join(F.broadcast(prefix), "shingle")
    found = met.where((begin >= 0) & (begin + F.col("n") <= F.size("w"))).where(F.slice("w", begin + 1, F.col("n")) == F.col("words"))
    return found.select("doc_id", "text_hash", begin.alias("start"), "n", "items")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_words: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids) for each row of docs.

    A word of a document is hit if it lies in an occurrence of a window: window_words consecutive words of an item, or all words of
    a shorter one. Null and empty texts have no words and no hits; null ids stay; rows that repeat an id are judged each by its own
    text; an empty table of docs gives an empty one, an empty benchmark no hits. Other columns aren't read.
    """
    return _judged(docs, items, id_col, text_col, window_words).drop("text_hash")


def _judged(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, window_words: int) -> DataFrame:
    """decontaminate() with the hash of each text."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    parsed = read.select("doc_id", F.xxhash64("t").alias("text_hash"), words_of(F.col("t")).alias("w"))
    windows = cut(windows_of(items, window_words=window_words).withColumn("window", F.xxhash64("words")).withColumn("block_key", F.monotonically_increasing_id()))
    found = []
    for size, n in sorted(windows.groupBy(F.least("n", F.lit(SHINGLE)).alias("size")).count().collect()):  # a row for each size up to SHINGLE
        blocks = -(-n // BLOCK_WINDOWS)
        of_size = windows.where(F.least("n", F.lit(SHINGLE)) == size).drop("window").withColumnRenamed("block_key", "window")
        found += [_matches(parsed, of_size.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b) if blocks > 1 else of_size, size) for b in range(blocks)]
    counted = parsed.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"))
    if not found:
        return _told(counted.withColumns({"spans": F.expr("cast(array() as array<struct<start:int,n:int>>)"), "item_ids": F.expr("cast(array() as array<string>)")}))
    places = reduce(DataFrame.union, found)
    # Repeated rows of one text give the same places; the sets hold each once.
    hits = places.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    hits = cut(hits.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "spans", "item_ids"))
    return _told(counted.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left"))


def _told(rows: DataFrame) -> DataFrame:
    covered = F.aggregate(
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,n:int>>)")),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["hit"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))).cast("long").alias("hit"), F.greatest(a["end"], s["start"] + s["n"]).alias("end")),
        lambda a: a["hit"],
    )
    ids = F.coalesce("item_ids", F.expr("cast(array() as array<string>)"))
    return rows.select("doc_id", "text_hash", "n_words", covered.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), ids.alias("item_ids")).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a window of an item, with all columns otherwise kept.

    Rows with a contaminated id go together; rows without an id are documents of their own, each judged by its text. Null and empty texts
    stay; an empty table gives an empty one; other columns may have any names.
    """
    judged = _judged(docs, items, id_col, text_col, WINDOW_WORDS)
    own = F.when(F.col("doc_id").isNull(), F.col("text_hash"))
    doc, hash_ = unused(docs, "doc", "hash")
    hit = cut(judged.where("contaminated").select(F.col("doc_id").alias(doc), own.alias(hash_)).distinct())
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col(doc)) & F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).eqNullSafe(F.col(hash_)), "left_anti")


__all__ = ["BLOCK_WINDOWS", "SHINGLE", "WINDOW_WORDS", "decontaminate", "drop_contaminated", "windows_of", "words_of"]
