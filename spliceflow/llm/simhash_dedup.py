"""SimHash near-duplicates: candidates by chains of segments on a ring, then the full Hamming check.

The 64 bits are cut into m segments on a ring. If two fingerprints differ in at most t bits, some chain of consecutive segments keeps
every prefix of length j within j*t/m differences. With m = 5 and t = 2 the first two segments of such a chain are equal (0.8 < 1), the
first three and four differ in at most one bit. The 38 or 39 bits that the two leave hold at most t differences as well, so they are a
ring of m segments in turn: some two neighbours there are equal too. Fingerprints are joined on such four equal segments (about 41 bits),
the longer prefixes of the outer chain are tested, and what is left gets the full check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceflow.llm.common import components, cut, drop_cut, unused

SHINGLE_WORDS = 3
MAX_BITS = 2
#: Segments of the ring, from the lowest bit.
WIDTHS = (13, 13, 13, 13, 12)
#: A bucket of four equal segments with more fingerprints than this isn't paired: they are linked through their one-bit neighbours, which
#: is exact too and linear.
LARGE_BUCKET = 256


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 without words."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    shingles = zip(*(words[i:] for i in range(shingle_words)), strict=False) if len(words) >= shingle_words else [words]
    counts, n, held = np.zeros(64, dtype=np.int64), 0, []

    def add() -> int:
        counts[:] += np.unpackbits(np.array(held, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return len(held)

    for shingle in shingles:
        held.append(hashed(b" ".join(shingle), seed))
        if len(held) == 65_536:
            n += add()
            held.clear()
    if held:
        n += add()
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint of each text, its 64 bits as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(x, shingle_words) for x in batch], dtype=np.uint64).view(np.int64))

    return of(text)


def _ring() -> list[tuple[int, int]]:
    """(shift, mask) of each segment; masks apply to the shifted value."""
    starts = [sum(WIDTHS[:i]) for i in range(len(WIDTHS))]
    return [(s, (1 << w) - 1) for s, w in zip(starts, WIDTHS, strict=True)]


def _segment(fp: Column, i: int) -> Column:
    shift, mask = _ring()[i % len(WIDTHS)]
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit(mask))


def _bits(value: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1))


def _chain_keys(fp: Column) -> list[Column]:
    """struct(chain, key) for each chain of the outer ring with each of the inner one: the bits of its four segments."""
    m, out = len(WIDTHS), []
    for i in range(m):
        start, width = sum(WIDTHS[:i]), WIDTHS[i] + WIDTHS[(i + 1) % m]
        turned = F.shiftrightunsigned(fp, start).bitwiseOR(F.shiftleft(fp, 64 - start)) if start else fp
        rest, n = F.shiftrightunsigned(turned, width), 64 - width
        inner = [n // m + (k < n % m) for k in range(m)]
        for j in range(m):
            k = (j + 1) % m
            pair = F.shiftleft(_bits(rest, sum(inner[:j]), inner[j]), inner[k]).bitwiseOR(_bits(rest, sum(inner[:k]), inner[k]))
            key = F.shiftleft(_bits(turned, 0, width), inner[j] + inner[k]).bitwiseOR(pair)
            out.append(F.struct(F.lit(m * i + j).alias("chain"), key.alias("key")))
    return out


def _near(prints: DataFrame) -> DataFrame:
    """(u, v) links between different fingerprints of prints(fp)."""
    m = len(WIDTHS)
    dealt = prints.select("fp", F.explode(F.array(*_chain_keys(F.col("fp")))).alias("at")).select("fp", "at.chain", "at.key")
    large = cut(dealt.groupBy("chain", "key").count().where(F.col("count") > LARGE_BUCKET).select("chain", "key")).hint("merge")
    crowded = not large.isEmpty()
    usual = dealt.join(large, ["chain", "key"], "left_anti") if crowded else dealt
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    budget = F.lit(True)
    for i in range(m):
        third = F.bit_count(_segment(x, i + 2))
        fourth = F.bit_count(_segment(x, i + 3))
        budget = F.when(F.floor(F.col("a.chain") / m) == i, (third * m <= 3 * MAX_BITS) & ((third + fourth) * m <= 4 * MAX_BITS)).otherwise(budget)
    # Spark sizes dealt by the fingerprints' file, without the 25 keys of each: below some size it would broadcast all of them.
    links = (
        usual.alias("a")
        .join(usual.alias("b").hint("merge"), (F.col("a.chain") == F.col("b.chain")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & budget & (F.bit_count(x) <= MAX_BITS))
        .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    )
    if not crowded:
        return links.distinct()
    # Two fingerprints are within two bits if and only if they have a neighbour within one bit in common; at most 65 share one.
    members = dealt.join(large, ["chain", "key"], "left_semi").select("fp").distinct()
    balls = members.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))).alias("near"))
    met = balls.groupBy("near").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u != v")
    return links.union(stars).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    Rows link if their fingerprints differ in at most two bits; component_id is the smallest id that links reach, the row's own
    included (ids that are null are passed over; it is null where a component has no other). Null and empty texts have fingerprint
    zero and link like any other. Rows that repeat an id are each kept. An empty table gives an empty one; other columns aren't read.
    """
    return _grouped(docs, id_col, text_col, []).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, more: list[Column]) -> DataFrame:
    """(doc_id, fp, more, root, component_id) for each row of docs; root tells components apart that have no id."""
    prints = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(F.col(text_col)).alias("fp"), *more))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(components(_near(distinct.select("fp"))))
    # Tables of a row for each fingerprint grow with the input: they are exchanged, never broadcast from the driver.
    joined = distinct.join(roots.hint("merge"), distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = cut(joined.select("fp", "root").join(least.hint("merge"), "root").select("fp", "root", "component_id"))
    drop_cut(roots)
    return prints.join(by_print.hint("merge"), "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near-duplicates: of each group exactly one row stays, with all its columns.

    It is the row with the smallest id (null ids come last), of equal ids that with the smallest hash of its text; of rows that repeat
    id and text any one. Other rows that have its id stay or go by their own groups. Null and empty texts are a group like any other; an
    empty table gives an empty one; other columns may have any names.
    """
    keys = cut(_grouped(docs, id_col, text_col, [F.xxhash64(text_col).alias("hash")]).groupBy("root", "doc_id", "hash").agg(F.count(F.lit(1)).alias("times")))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")
    first = cut(keys.groupBy("root").agg(F.min(place).alias("at")).select(F.col("root").alias("r"), F.col("at.doc_id").alias("d"), F.col("at.hash").alias("h")))
    stays = (F.col("root") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))
    doc, hash_ = unused(docs, "doc", "hash")
    named = [F.col("doc_id").alias(doc), F.col("hash").alias(hash_)]
    dropped = cut(keys.join(first.hint("merge"), stays, "left_anti").select(*named)).hint("merge")
    repeated = cut(keys.where("times > 1").join(first.hint("merge"), stays, "left_semi").select(*named)).hint("merge")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text_col) == F.col(hash_))
    kept = docs.join(dropped, same, "left_anti")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, same).dropDuplicates([doc, hash_]).select(*docs.columns)
    return kept.join(repeated, same, "left_anti").union(once)
