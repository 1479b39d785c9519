"""Best-fit packing of token pieces into sequences by linear grouping.

The histogram of piece lengths has at most `capacity` entries whatever the size of the corpus, so the plan is made on the driver from
the histogram alone: large lengths are rounded up to the largest of their group, groups being of equal number; a few-size
configuration program is solved by column generation; actual lengths take the places of the rounded ones; small pieces go where they
fit best. The plan maps (length, rank within length) to a sequence and an offset; ranks are dealt out without gathering a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spliceflow.llm.common import cut, frame
from spliceflow.llm.tokens import encoder

CAPACITY = 2048
#: Pieces up to this share of a sequence are small: they aren't grouped but fill what the others leave. Each share is tried.
SMALL_SHARES = (1 / 3, 1 / 2)
#: Groups of large lengths. More groups waste less by rounding and make the program larger.
GROUPS = 120
#: Ranks of equal rows that one task deals out.
RANKS = 10_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each row's ids and then end_id, cut if longer than capacity.

    A null text counts as empty (one piece holding end_id). The first piece of a long document is the one that may be shorter.
    A null id stays null; repeated rows each give their pieces. Other columns aren't read.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, last = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"].array, strict=True):
                ids = (enc.ids(text) if isinstance(text, str) else b"") + last
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                out += [(None if pd.isna(doc_id) else int(doc_id), k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield frame(out, PIECES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(encode, PIECES)


def _simplex_duals(basis: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.linalg.solve(basis, demand), np.linalg.solve(basis.T, np.ones(len(demand)))


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of greatest worth: a knapsack over whole lengths, one layer for each further piece."""
    layers, took = [np.zeros(capacity + 1)], []
    for _ in range(capacity // int(sizes.min())):
        best, choice = layers[-1].copy(), np.full(capacity + 1, -1)
        for k, size in enumerate(sizes):
            gains = layers[-1][: capacity + 1 - size] + worth[k]
            better = gains > best[size:] + 1e-12
            best[size:][better], choice[size:][better] = gains[better], k
        layers.append(best)
        took.append(choice)
    config, room = np.zeros(len(sizes), dtype=np.int64), capacity
    for choice in reversed(took):
        if choice[room] >= 0:
            config[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return config, float(layers[-1][capacity])


def _solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each: the linear program by column generation, rounded down."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        x, duals = _simplex_duals(basis, demand.astype(float))
        config, worth = _best_configuration(sizes, np.maximum(duals, 0), capacity)
        if worth <= 1 + 1e-5:
            break
        direction = np.linalg.solve(basis, config.astype(float))
        ratio = np.full(k, np.inf)
        up = direction > 1e-9
        ratio[up] = np.maximum(x[up], 0) / direction[up]
        basis[:, int(np.argmin(ratio))] = config
    x, _ = _simplex_duals(basis, demand.astype(float))
    return [(basis[:, j].astype(np.int64), int(np.floor(x[j] + 1e-6))) for j in range(k) if x[j] >= 1 - 1e-6]


class _Queue:
    """The pieces of a group, longest first, as runs of one length; ranks within a length are given out in order."""

    def __init__(self, counts: list[tuple[int, int]], given: dict[int, int]):
        self.runs, self.given = [[length, n] for length, n in counts], given

    def left(self) -> int:
        return sum(n for _, n in self.runs)

    def take(self, n: int) -> list[tuple[int, int, int]]:
        """n pieces as (length, first rank, number)."""
        out = []
        while n:
            length, there = self.runs[0]
            m = min(n, there)
            out.append((length, self.given.get(length, 0), m))
            self.given[length] = self.given.get(length, 0) + m
            n -= m
            self.runs[0][1] -= m
            if not self.runs[0][1]:
                self.runs.pop(0)
        return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_shares: tuple[float, ...] = SMALL_SHARES) -> np.ndarray:
    """The plan with the fewest sequences over the given shares. Rows (length, first rank, number, first sequence, offset): piece `rank` of a length goes to sequence `first sequence + rank - first rank`.

    Sequences are numbered from 0 without gaps and each is filled from offset 0 without gaps. The number of rows depends on the
    number of different lengths, not on that of pieces.
    """
    return _rows(min((_grouped(histogram, capacity, groups, int(capacity * share)) for share in small_shares), key=lambda runs: sum(n for n, _ in runs)))


def _grouped(histogram: dict[int, int], capacity: int, groups: int, small: int) -> list:
    """Runs of like sequences as (number, slots)."""
    given: dict[int, int] = {}
    # Runs of like sequences: room left, number, slots as (length, first rank).
    bins: list[tuple[int, int, list[tuple[int, int]]]] = []
    large = sorted(((length, n) for length, n in histogram.items() if small < length < capacity), reverse=True)
    if n := histogram.get(capacity, 0):
        bins.append((0, n, [(capacity, 0)]))
    queues, sizes, demand = [], [], []
    total, per, at = sum(n for _, n in large), 0, 0
    per = -(-total // groups) if total else 0
    while at < len(large):
        own, held = [], 0
        while at < len(large) and (not own or held + large[at][1] <= per):
            own.append(large[at])
            held += large[at][1]
            at += 1
        queues.append(_Queue(own, given))
        sizes.append(own[0][0])
        demand.append(held)
    if queues:
        for config, times in _solve(np.array(sizes), np.array(demand), capacity):
            slots = [g for g in np.nonzero(config)[0] for _ in range(int(config[g]))]
            # Places that the group can no longer fill stay open for later pieces.
            takes, spans = [], []
            for g in slots:
                takes.append(queues[g].take(min(times, queues[g].left())))
                spans.append(np.cumsum([0, *(n for _, _, n in takes[-1])]))
            edges = sorted({0, times, *(int(e) for s in spans for e in s)})
            for a, b in zip(edges, edges[1:], strict=False):
                here, room = [], capacity
                for took, span in zip(takes, spans, strict=True):
                    i = int(np.searchsorted(span, a, side="right")) - 1
                    if i < len(took):
                        here.append((took[i][0], took[i][1] + a - int(span[i])))
                        room -= took[i][0]
                if here:
                    bins.append((room, b - a, here))
    rest = sorted([(length, n) for q in queues for length, n in q.runs] + [(length, n) for length, n in histogram.items() if length <= small and length < capacity], reverse=True)
    return _best_fit(bins, rest, given, capacity)


def _best_fit(bins: list, rest: list[tuple[int, int]], given: dict[int, int], capacity: int) -> list:
    """Pieces by falling length, each into the sequence with the least room that holds it, whole runs of sequences at a time."""
    by_room: list[list] = [[] for _ in range(capacity + 1)]
    for room, n, slots in bins:
        by_room[room].append((n, slots))
    for length, n in rest:
        room = length
        while n:
            while room <= capacity and not by_room[room]:
                room += 1
            if room > capacity:
                by_room[capacity].append((-(-n // (capacity // length)), []))
                room = capacity
            there, slots = by_room[room].pop()
            each = min(room // length, n)
            m = min(there, n // each)
            if m < there:
                # The sequences that stay behind hold the later ranks.
                by_room[room].append((there - m, [(held, first + m) for held, first in slots]))
            first = given.get(length, 0)
            by_room[room - each * length].append((m, slots + [(length, first + i * m) for i in range(each)]))
            given[length] = first + each * m
            n -= each * m
    return [run for runs in by_room for run in runs]


def _rows(runs: list) -> np.ndarray:
    out, sequence = [], 0
    for n, slots in runs:
        offset = 0
        for length, first in slots:
            out.append((length, first, n, sequence, offset))
            offset += length
        sequence += n
    rows = np.array(out, dtype=np.int64).reshape(-1, 5)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def pack(parts: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """parts (of pieces(), or any table with its columns) with sequence_id and offset added.

    No piece may be longer than capacity. An empty table gives an empty one; equal rows each get a place of their own; columns
    beyond those of pieces() are dropped. parts should be a written table: it is read three times.
    """
    spark: SparkSession = parts.sparkSession
    counts = parts.groupBy("length").count().collect()  # at most `capacity` rows
    n = sum(r["count"] for r in counts)
    table = spark.sparkContext.broadcast(plan({r["length"]: r["count"] for r in counts}, capacity, groups))
    # Ranks within a length: rows are dealt to buckets by a hash, so that a length that very many pieces have is nobody's burden. Equal rows
    # are counted first and take a run of ranks, which is dealt out again in chunks.
    buckets = max(256, n // 100_000)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    each = parts.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = each.groupBy("length", "bucket").agg(F.sum("copies").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(ahead), F.lit(0))).drop("held")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    first = each.withColumn("nth", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(before, ["length", "bucket"]).withColumn("first", F.col("before") + F.col("nth"))
    chunks = first.select(*columns, "first", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RANKS).cast("long"))).alias("chunk")).repartition("doc_id", "piece", "chunk")
    ranked = chunks.select(*columns, F.explode(F.sequence(F.col("first") + F.col("chunk"), F.col("first") + F.least(F.col("chunk") + RANKS, F.col("copies")) - 1)).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = table.value
        keys = rows[:, 0] * (1 << 44) + rows[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
            yield batch[["doc_id", "piece", "start", "length", "ids_crc32"]].astype({"doc_id": "Int64"}).assign(sequence_id=rows[at, 3] + rank - rows[at, 1], offset=rows[at, 4])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, **how) -> DataFrame:
    """Tokenizes docs and packs the pieces: one row for each piece, with its sequence and its offset there."""
    return pack(cut(pieces(docs, capacity=capacity, **how)), capacity, groups)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, members): the sequences that pack() made, members in their order."""
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length"))).alias("members"))


__all__ = ["CAPACITY", "GROUPS", "pack", "pack_documents", "pieces", "plan", "sequences"]
