"""Prefix trie of conversations that are rebuilt from another one's head and their own rest, by composable fingerprints.

A turn is four numbers below a prime P, hashes of its role and text. A run of n turns v1 ... vn has in each lane the pair (n, v1 B + v2 B^2 + ...
+ vn B^n mod P); two runs compose to (n + m, H + B^n H'). Stretches of a long conversation compose so, and so do the head of one conversation
and the rest of another: the fingerprint of every prefix of a rebuilt conversation is worked out from stored prefix products, and no rebuilt
text is ever made. Equal prefixes have equal fingerprints. That equal fingerprints mean equal prefixes is checked: within a group the
fingerprints one turn shorter and the last turns' hashes must agree, and turns with different references in one group are read again, role
and text. If anything differs, all is done again with other hashes and multipliers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.llm.common import cut, drop_cut, laid_out

#: Conversations c and c - c % BLOCK share a head of crc32(c) % HEADS turns.
BLOCK, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
LANES, P = 4, (1 << 31) - 1
#: Bits of an exponent that one table of powers covers, and how many tables there are: conversations of up to 2**40 turns.
POWER_BITS, POWER_TABLES = 8, 5
#: Ids of a chunk that is joined to one string before it is digested.
CHUNK = 500
#: A prefix with more members than this, and than one in so many of all memberships, is joined by broadcast: there are at most so many.
CROWDED = 1_000
_LANES = range(LANES)


class _Lane:
    """Arithmetic of one lane: B and the seed of its hash, from the draw's and the lane's number."""

    def __init__(self, draw: int, lane: int, modulus: int):
        digest = hashlib.sha256(f"{draw} {lane}".encode()).digest()
        self.modulus, self.seed = modulus, int.from_bytes(digest[:4], "big")
        self.base = 2 + int.from_bytes(digest[8:16], "big") % (modulus - 2)
        self.inverse = pow(self.base, -1, modulus)

    def hash(self) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), "role", "text"), F.lit(self.modulus))

    def times_power(self, value: Column, exponent: Column) -> Column:
        """value * B ** exponent, the exponent taken by digits of POWER_BITS bits."""
        for k in range(POWER_TABLES):
            powers = ",".join(str(pow(self.base, digit << POWER_BITS * k, self.modulus)) for digit in range(1 << POWER_BITS))
            digit = F.shiftright(exponent, POWER_BITS * k).bitwiseAND((1 << POWER_BITS) - 1).cast("int")
            value = value * F.get(F.split(F.lit(powers), ",").cast("array<long>"), digit) % self.modulus
        return value

    def times_inverse(self, value: Column, exponent: Column) -> Column:
        """value / B ** exponent for an exponent below HEADS."""
        return value * F.get(F.array(*(F.lit(pow(self.inverse, k, self.modulus)).cast("long") for k in range(HEADS))), exponent.cast("int")) % self.modulus


def _columns(kind: str) -> list[str]:
    return [f"{kind}{lane}" for lane in _LANES]


def _packed(name: str, lanes: list[Column]) -> list[Column]:
    """Four lanes as two longs."""
    return [(lanes[0] * (1 << 31) + lanes[1]).alias(f"{name}a"), (lanes[2] * (1 << 31) + lanes[3]).alias(f"{name}b")]


def stored_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text of the rows with a conv_id, null role and text empty."""
    c = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return c.where("conv_id is not null")


def _products(stored: DataFrame, lanes: list[_Lane]) -> tuple[DataFrame, DataFrame]:
    """(turns, parts). turns: conv_id, part, at, k (from 1 within the part), words, v, t (term) and r (product up to the turn) by lane.
    parts: conv_id, part, before (turns ahead), turns (of the conversation), h by lane: the product of all that lies ahead."""
    hashed = stored.select("conv_id", "turn", F.md5(F.concat("role", F.lit("\n"), "text")).alias("tie"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), *(lane.hash().alias(f"v{i}") for i, lane in enumerate(lanes)))
    placed = laid_out(hashed, "conv_id", F.asc_nulls_first("turn"), "tie", keep=["conv_id", "words", *_columns("v")])
    along = Window.partitionBy("conv_id", "part").orderBy("at")
    terms = placed.withColumn("k", F.row_number().over(along).cast("long")).withColumns({f"t{i}": lane.times_power(F.col(f"v{i}"), F.col("k")) for i, lane in enumerate(lanes)})
    turns = cut(terms.withColumns({f"r{i}": F.sum(f"t{i}").over(along.rowsBetween(Window.unboundedPreceding, 0)) % lane.modulus for i, lane in enumerate(lanes)}))
    drop_cut(placed)
    whole = Window.partitionBy("conv_id")
    ahead = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = turns.groupBy("conv_id", "part").agg(F.max("k").alias("n"), *(F.sum(f"t{i}").alias(f"t{i}") for i in _LANES))
    per = per.withColumns({"before": F.coalesce(F.sum("n").over(ahead), F.lit(0)), "turns": F.sum("n").over(whole)})
    shifted = per.withColumns({f"s{i}": lane.times_power(F.col(f"t{i}") % lane.modulus, F.col("before")) for i, lane in enumerate(lanes)})
    return turns, cut(shifted.select("conv_id", "part", "before", "turns", *((F.coalesce(F.sum(f"s{i}").over(ahead), F.lit(0)) % lane.modulus).alias(f"h{i}") for i, lane in enumerate(lanes))))


def _members(turns: DataFrame, parts: DataFrame, lanes: list[_Lane]) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: conv_id, part (-1 for the head), depth, length (of the rebuilt conversation), fa, fb
    (its fingerprint), pa, pb (that of a turn less), va, vb (the last turn's hash), at (the last turn), words."""
    number = F.crc32(F.col("conv_id").cast("string")) % HEADS
    whole = lambda i, lane, product: (F.col(f"h{i}") + lane.times_power(product, F.col("before"))) % lane.modulus
    # The first turns of all conversations, with the products up to each.
    first = turns.where(F.col("k") < HEADS).join(parts.where(F.col("before") < HEADS - 1), ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("k")).where(F.col("pos") < HEADS)
    first = cut(first.select("conv_id", "pos", "at", "words", *_columns("v"), *(whole(i, lane, F.col(f"r{i}")).alias(f"f{i}") for i, lane in enumerate(lanes)), *(whole(i, lane, (F.col(f"r{i}") - F.col(f"t{i}")) % lane.modulus).alias(f"e{i}") for i, lane in enumerate(lanes))))
    known = parts.where("before = 0").select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"), number.alias("head"))
    bases = known.select(F.col("conv_id").alias("base"), F.col("turns").alias("there"))
    known = known.join(bases, "base", "left").withColumn("lent", F.least("head", F.coalesce("there", F.lit(0)))).drop("there")
    of_base = first.select(F.col("conv_id").alias("base"), F.col("pos").alias("lent"), *(F.col(f"f{i}").alias(f"b{i}") for i in _LANES))
    of_own = first.select("conv_id", F.col("pos").alias("head"), *(F.col(f"f{i}").alias(f"o{i}") for i in _LANES))
    none = lambda kind: {c: F.coalesce(c, F.lit(0)) for c in _columns(kind)}
    known = known.join(of_base, ["base", "lent"], "left").join(of_own, ["conv_id", "head"], "left").withColumns(none("b") | none("o"))
    known = cut(known.withColumn("length", F.col("lent") + F.greatest(F.col("turns") - F.col("head"), F.lit(0))))
    # Own turns behind the head: what lies before them is taken off the product, the rest is moved to its depth and put behind the head's.
    own = turns.join(parts.drop("turns").join(known.drop("turns", "base"), "conv_id"), ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("k")).where("pos > head")

    def behind(i: int, lane: _Lane, product: Column) -> Column:
        rest = (whole(i, lane, product) - F.col(f"o{i}") + lane.modulus) % lane.modulus
        return (F.col(f"b{i}") + lane.times_inverse(rest, F.col("head") - F.col("lent"))) % lane.modulus

    shorter = lambda i, lane: behind(i, lane, (F.col(f"r{i}") - F.col(f"t{i}") + lane.modulus) % lane.modulus)
    own = own.select("conv_id", "part", (F.col("pos") - F.col("head") + F.col("lent")).alias("depth"), "length", *_packed("f", [behind(i, lane, F.col(f"r{i}")) for i, lane in enumerate(lanes)]), *_packed("p", [shorter(i, lane) for i, lane in enumerate(lanes)]), *_packed("v", [F.col(f"v{i}") for i in _LANES]), "at", "words")
    lent = first.withColumnsRenamed({"conv_id": "base", "pos": "depth"})
    heads = known.where("lent > 0").select("conv_id", "base", "length", F.explode(F.sequence(F.lit(1).cast("long"), "lent")).alias("depth")).join(lent, ["base", "depth"])
    heads = heads.select("conv_id", F.lit(-1).alias("part"), "depth", "length", *_packed("f", [F.col(f"f{i}") for i in _LANES]), *_packed("p", [(F.col(f"e{i}") + lane.modulus) % lane.modulus for i, lane in enumerate(lanes)]), *_packed("v", [F.col(f"v{i}") for i in _LANES]), "at", "words")
    zero = F.lit(0).cast("long")
    roots = known.select("conv_id", F.lit(-1).alias("part"), zero.alias("depth"), "length", *(zero.alias(c) for c in ("fa", "fb", "pa", "pb", "va", "vb", "at", "words")))
    return cut(own.unionByName(heads).unionByName(roots))


def _differ(nodes: DataFrame, stored: DataFrame, lanes: list[_Lane]) -> bool:
    """Whether a group of nodes holds different prefixes: other fingerprints before, other hashes of the last turn, or other last turns."""
    if nodes.where("low_pa != high_pa or low_pb != high_pb or low_va != high_va or low_vb != high_vb").limit(1).count():
        return True
    told = nodes.where("low_at != high_at").groupBy(F.col("low_va").alias("va"), F.col("low_vb").alias("vb")).agg(F.sum("n_convs").alias("n_convs"))
    again = _crowd_join(stored.select("role", "text", *_packed("v", [lane.hash() for lane in lanes])), told, ["va", "vb"], nodes.agg(F.coalesce(F.sum("n_convs"), F.lit(0))).first()[0])
    ends = again.groupBy("va", "vb").agg(F.min("role").alias("role"), F.max("role").alias("last_role"), F.min("text").alias("text"), F.max("text").alias("last_text"))
    return ends.where("role != last_role or text != last_text").limit(1).count() > 0


def _crowd_join(rows: DataFrame, nodes: DataFrame, keys: list[str], members: int) -> DataFrame:
    """rows that have a partner among nodes, with its columns; partners with so many members that they would weigh on one task are broadcast (at most CROWDED)."""
    crowded = F.col("n_convs") > F.lit(max(CROWDED, members // CROWDED))
    few = F.broadcast(nodes.where(crowded))
    return rows.join(few, keys).unionByName(rows.join(few, keys, "left_anti").join(nodes.where(~crowded), keys))


def memberships(conversations: DataFrame, modulus: int = P, **columns: str) -> DataFrame:
    """conv_id, part, depth, length, words, node (smallest conv_id of the prefix's members), childless: a row for each prefix of each rebuilt conversation.

    Depth and node name a trie node. Written; no texts.
    """
    stored = stored_turns(conversations, **columns)
    for draw in count():
        lanes = [_Lane(draw, lane, modulus) for lane in _LANES]
        turns, parts = _products(stored, lanes)
        members = _members(turns, parts, lanes)
        ends = [f(c).alias(f"{how}_{c}") for c in ("pa", "pb", "va", "vb", "at") for how, f in (("low", F.min), ("high", F.max))]
        nodes = cut(members.groupBy("depth", "fa", "fb").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("node"), F.max("length").alias("deepest"), *ends))
        differ = _differ(nodes, stored, lanes)
        if not differ:
            placed = _crowd_join(members.select("conv_id", "part", "depth", "length", "words", "fa", "fb"), nodes.select("depth", "fa", "fb", "n_convs", "node", "deepest"), ["depth", "fa", "fb"], members.count())
            out = cut(placed.select("conv_id", "part", "depth", "length", "words", "node", (F.col("deepest") == F.col("depth")).alias("childless")))
        for table in (turns, parts, members, nodes):
            drop_cut(table)
        if not differ:
            return out


def _digests(ends: DataFrame) -> DataFrame:
    """node, depth, ends_sha256 of ends(node, depth, conv_id): ids in order, comma-joined, digested.

    Ids are put in order by ranges, so the ends of one node may lie in many partitions; each joins its own to chunks of CHUNK ids. A
    digest is sequential by nature: one task reads a node's chunks, one batch in memory at a time.
    """

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            group = batch.groupby(["node", "depth"], sort=False)
            at = group.cumcount() // CHUNK
            made = batch.assign(id=batch["conv_id"].astype(str)).groupby([batch["node"], batch["depth"], at], sort=False).agg(first=("conv_id", "min"), ids=("id", ",".join))
            yield made.reset_index(level=[0, 1])[["node", "depth", "first", "ids"]]

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, hashlib.sha256()
        for batch in batches:
            out = []
            for node, depth, ids in zip(batch["node"].tolist(), batch["depth"].tolist(), batch["ids"], strict=True):
                if (node, depth) == key:
                    held.update(b",")
                else:
                    out += [(*key, held.hexdigest())] if key else []
                    key, held = (node, depth), hashlib.sha256()
                held.update(ids.encode())
            yield pd.DataFrame(out, columns=["node", "depth", "ends_sha256"]).astype({"node": "int64", "depth": "int64"})
        if key:
            yield pd.DataFrame([(*key, held.hexdigest())], columns=["node", "depth", "ends_sha256"])

    joined = ends.repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id").mapInPandas(chunks, "node long, depth long, first long, ids string")
    return joined.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInPandas(digest, "node long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, modulus: int = P, **columns: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each distinct prefix of the rebuilt conversations.

    Conversation c is rebuilt from the first h turns of conversation c - c % 20 (the remainder has c's sign) and its own turns after its
    first h, h being crc32 of the decimal c, mod 4. Turns stand by their number, null first; of equal numbers by the MD5 of role and
    text, so repeated rows are turns that follow each other. Null roles and texts are empty. Rows without a conv_id are left out. An empty
    table gives no rows; other columns aren't read. A conversation isn't gathered: it may lie in many parts.
    """
    members = memberships(conversations, modulus, **columns)
    named = members.withColumn("new", F.col("conv_id") == F.col("node"))
    # What lies below a prefix: the words of its members' turns but those that the turn's first member brings, each counted with its conversation.
    saved = F.when(~F.col("new"), F.col("words")).otherwise(0)
    later = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    per = named.groupBy("conv_id", "part").agg(F.sum(saved).alias("saved"), F.max(((F.col("depth") == F.col("length")) & F.col("new") & F.col("childless")).cast("long")).alias("leaf"))
    per = per.select("conv_id", "part", F.coalesce(F.sum("saved").over(later), F.lit(0)).alias("later"), F.max("leaf").over(Window.partitionBy("conv_id")).alias("leaf"))
    upward = Window.partitionBy("conv_id", "part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    counted = named.join(per, ["conv_id", "part"]).withColumn("saved", F.col("later") + F.sum(saved).over(upward))
    nodes = counted.groupBy("node", "depth").agg(F.count(F.lit(1)).alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    # The node above is that of the same conversation one turn earlier; conv_id and depth are a key.
    above = named.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    linked = cut(nodes.join(above, ["node", "depth"], "left"))
    below = linked.where("depth > 0").groupBy(F.col("parent_conv_id").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    digests = _digests(named.where("depth = length").select("node", "depth", "conv_id"))
    out = linked.join(below, ["node", "depth"], "left").join(digests, ["node", "depth"], "left").select(
        F.col("node").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    out = cut(out)
    drop_cut(members)
    drop_cut(linked)
    return out
