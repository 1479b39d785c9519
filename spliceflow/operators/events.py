"""Alternative-splicing events of transcripts as equi joins on shared boundaries within a gene.

exons: transcript_id, gene_id, chrom, strand, tx (a number that orders transcripts), s, e; one row an exon, exons of a transcript apart.
Event tables have event_type, gene_id, chrom, strand, id, inclusion and exclusion junctions (arrays) and the numbers of transcripts.
Pairs are found by joins on gene and a shared coordinate, and different pairs of coordinates are reduced before they are paired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.operators.intervals import overlap_join

GENE = ["gene_id", "chrom", "strand"]


def with_neighbours(exons: DataFrame) -> DataFrame:
    """exons with the ends of their neighbours, their place from both ends and the number of exons: one window for all detectors."""
    order = Window.partitionBy("gene_id", "transcript_id").orderBy("s")
    back = Window.partitionBy("gene_id", "transcript_id").orderBy(F.desc("s"))
    return exons.withColumns({"up_s": F.lag("s").over(order), "up_e": F.lag("e").over(order), "down_s": F.lead("s").over(order), "down_e": F.lead("e").over(order), "nth": F.row_number().over(order), "nth_last": F.row_number().over(back)})


def introns(near: DataFrame) -> DataFrame:
    """transcript_id, gene, tx, js, je: the introns of with_neighbours()."""
    return near.where("down_s is not null").select(*GENE, "transcript_id", "tx", F.col("e").alias("js"), F.col("down_s").alias("je"))


def _pair(*ends: str) -> Column:
    return F.struct(F.col(ends[0]).alias("s"), F.col(ends[1]).alias("e"))


def _event(kind: Column | str, coordinates: list[str], inclusion: list[tuple[str, str]], exclusion: list[tuple[str, str]]) -> list[Column]:
    type_ = F.lit(kind) if isinstance(kind, str) else kind
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    arrays = [F.array(*(_pair(*j) for j in js)).cast("array<struct<s:bigint,e:bigint>>") if js else none for js in (inclusion, exclusion)]
    return [type_.alias("event_type"), *GENE, F.concat_ws(":", type_, "chrom", "strand", F.concat_ws("_", *coordinates)).alias("event_id"), arrays[0].alias("inclusion"), arrays[1].alias("exclusion")]


def _distinct(rows: DataFrame, *coordinates: str) -> DataFrame:
    """Each set of coordinates of a gene once, with the least and the greatest number of its transcripts: what is paired doesn't grow
    with the number of transcripts."""
    return rows.groupBy(*GENE, *coordinates).agg(F.min("tx").alias("lo"), F.max("tx").alias("hi"))


#: Two sets of coordinates have different transcripts unless both have one, the same.
_APART = "not (lo = hi and lo2 = hi2 and lo = lo2)"


def skipped_exons(near: DataFrame) -> DataFrame:
    """An internal exon of one transcript between the ends of an intron of another."""
    inner = _distinct(near.where("up_e is not null and down_s is not null").select(*GENE, "tx", F.col("up_e").alias("js"), F.col("down_s").alias("je"), "s", "e"), "js", "je", "s", "e")
    skip = _distinct(introns(near), "js", "je").withColumnsRenamed({"lo": "lo2", "hi": "hi2"})
    met = inner.join(skip, [*GENE, "js", "je"]).where(_APART)
    return met.select(*_event("SE", ["js", "s", "e", "je"], [("js", "s"), ("e", "je")], [("js", "je")]))


def _alternative(near: DataFrame, shared: str, other: str, plus: str, minus: str) -> DataFrame:
    """Introns of a gene's different transcripts with one end shared and the other not."""
    each = _distinct(introns(near), "js", "je")
    b = each.select(*GENE, shared, F.col(other).alias("o2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    met = each.join(b, [*GENE, shared]).where(f"{other} < o2").where(_APART).select(*GENE, shared, F.col(other).alias("near"), F.col("o2").alias("far"))
    kind = F.when(F.col("strand") == "-", minus).otherwise(plus)
    if shared == "je":
        # On the plus strand the nearer donor is the longer intron: the shorter exon end first.
        low, high = _pair("near", "je"), _pair("far", "je")
        first = F.col("strand") != "-"
        coordinates = ["near", "far", "je"]
    else:
        low, high = _pair("js", "far"), _pair("js", "near")
        first = F.col("strand") == "-"
        coordinates = ["js", "near", "far"]
    out = met.select(*_event(kind, coordinates, [], []))
    inc = F.array(F.when(first, low).otherwise(high))
    exc = F.array(F.when(first, high).otherwise(low))
    kept = met.select(kind.alias("event_type"), *GENE, F.concat_ws(":", kind, "chrom", "strand", F.concat_ws("_", *coordinates)).alias("event_id"), inc.alias("inclusion"), exc.alias("exclusion"))
    return kept.select(out.columns)


def alternative_donors(near: DataFrame) -> DataFrame:
    """Same intron end, different start: A5SS on the plus strand, A3SS on the minus strand."""
    return _alternative(near, "je", "js", "A5SS", "A3SS")


def alternative_acceptors(near: DataFrame) -> DataFrame:
    """Same intron start, different end: A3SS on the plus strand, A5SS on the minus strand."""
    return _alternative(near, "js", "je", "A3SS", "A5SS")


def mutually_exclusive(near: DataFrame) -> DataFrame:
    """Internal exons of different transcripts with the same flanks that neither overlap nor touch."""
    inner = _distinct(near.where("up_e is not null and down_s is not null").select(*GENE, "tx", F.col("up_e").alias("us"), F.col("down_s").alias("ds"), F.col("s").alias("s1"), F.col("e").alias("e1")), "us", "ds", "s1", "e1")
    other = inner.withColumnsRenamed({"lo": "lo2", "hi": "hi2", "s1": "s2", "e1": "e2"})
    met = inner.join(other, [*GENE, "us", "ds"]).where("s2 > e1").where(_APART)
    return met.select(*_event("MXE", ["us", "s1", "e1", "s2", "e2", "ds"], [("us", "s1"), ("e1", "ds")], [("us", "s2"), ("e2", "ds")]))


def retained_introns(near: DataFrame) -> DataFrame:
    """An exon of one transcript that holds an intron of another."""
    spans = _distinct(near.select(*GENE, "tx", "s", "e"), "s", "e")
    inner = _distinct(introns(near), "js", "je").withColumnsRenamed({"js": "rs", "je": "re", "lo": "lo2", "hi": "hi2"})
    met = overlap_join(spans, inner, GENE).where("s <= rs and e >= re").where(_APART)
    return met.select(*_event("RI", ["rs", "re"], [], [("rs", "re")])).distinct()


def _terminal(near: DataFrame, kind: str, place: str, joined: str) -> DataFrame:
    """First or last exons that differ while the neighbour's inner end is shared; a pair counts in transcript order, if starts don't fall."""
    ends = _distinct(near.where(f"{place} = 1 and {joined} is not null").select(*GENE, "tx", F.col(joined).alias("j"), F.col("s").alias("s1"), F.col("e").alias("e1")), "j", "s1", "e1")
    other = ends.withColumnsRenamed({"lo": "lo2", "hi": "hi2", "s1": "s2", "e1": "e2"})
    met = ends.join(other, [*GENE, "j"]).where("lo < hi2 and s1 <= s2 and not (s1 = s2 and e1 = e2)")
    if kind == "AFE":
        return met.select(*_event(kind, ["s1", "e1", "s2", "e2", "j"], [("e1", "j")], [("e2", "j")]))
    return met.select(*_event(kind, ["j", "s1", "e1", "s2", "e2"], [("j", "s1")], [("j", "s2")]))


def alternative_first(near: DataFrame) -> DataFrame:
    return _terminal(near, "AFE", "nth", "down_s")


def alternative_last(near: DataFrame) -> DataFrame:
    return _terminal(near, "ALE", "nth_last", "up_e")


DETECTORS = (skipped_exons, alternative_donors, alternative_acceptors, mutually_exclusive, retained_introns, alternative_first, alternative_last)


def detect(exons: DataFrame) -> DataFrame:
    """All seven classes of events."""
    near = with_neighbours(exons)
    return reduce(DataFrame.union, (d(near) for d in DETECTORS))


def junction_counts(events: DataFrame, junctions: DataFrame) -> DataFrame:
    """events with inc, exc, n_inc, n_exc, psi from junctions(chrom, js, je, count, strand); strand 0 is +, 1 is -, -1 fits both.

    psi = (inc / n_inc) / (inc / n_inc + exc / n_exc); null without reads, and for retained introns, whose inclusion has no junction.
    """
    code = F.when(F.col("strand") == "+", 0).when(F.col("strand") == "-", 1)
    keyed = events.select("event_id", "gene_id", "chrom", code.alias("code"), F.explode_outer(F.concat(F.transform("inclusion", lambda j: F.struct(j["s"].alias("js"), j["e"].alias("je"), F.lit(True).alias("inc"))), F.transform("exclusion", lambda j: F.struct(j["s"].alias("js"), j["e"].alias("je"), F.lit(False).alias("inc"))))).alias("j"))
    keyed = keyed.select("event_id", "gene_id", "chrom", "code", "j.js", "j.je", "j.inc")
    fits = F.col("code").isNull() | (F.col("strand") == F.col("code")) | (F.col("strand") == -1)
    met = keyed.join(junctions, ["chrom", "js", "je"], "left").withColumn("n", F.when(fits, F.col("count")).otherwise(0))
    sums = met.groupBy("event_id", "gene_id").agg(F.coalesce(F.sum(F.when(F.col("inc"), F.col("n"))), F.lit(0)).alias("inc"), F.coalesce(F.sum(F.when(~F.col("inc"), F.col("n"))), F.lit(0)).alias("exc"))
    out = events.join(sums, ["event_id", "gene_id"], "left")
    a = F.coalesce("inc", F.lit(0)) / F.greatest(F.size("inclusion"), F.lit(1))
    b = F.coalesce("exc", F.lit(0)) / F.greatest(F.size("exclusion"), F.lit(1))
    return out.withColumn("psi", F.when((a + b > 0) & (F.size("inclusion") > 0), a / (a + b)))


def body_reads(introns_: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """introns with the number of unspliced reads(rs, re, spliced) that speak for retention.

    A read counts if it spans the intron but for 10 bases at either end, or lies inside it and is longer than 50.
    """
    met = overlap_join(introns_, reads.where("not spliced"), keys)
    good = met.where("(rs <= s + 10 and re >= e - 10) or (rs >= s and re <= e and re - rs > 50)")
    ids = introns_.columns
    counts = good.groupBy(*ids).agg(F.count(F.lit(1)).alias("body"))
    return introns_.join(counts, ids, "left").withColumn("body", F.coalesce("body", F.lit(0)))


def de_novo_skips(junctions: DataFrame, reach: int = 50_000) -> DataFrame:
    """Exons between two junctions that a third one skips: equi joins on the outer ends."""
    j = junctions.select("chrom", "js", "je").distinct()
    first, last = j.select("chrom", "js", F.col("je").alias("s")), j.select("chrom", F.col("js").alias("e"), "je")
    return j.join(first, ["chrom", "js"]).join(last, ["chrom", "je"]).where(f"s < e and e <= s + {reach} and s < je and e > js").select("chrom", "js", "s", "e", "je")


def score(total: Column, width: Column, inc: Column, exc: Column) -> Column:
    """Confidence of an event from read support, interval width and balance."""
    balance = F.when(F.greatest(inc, exc) > 0, F.least(inc, exc) / F.greatest(inc, exc)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-(F.log1p(total) * 0.3 + (1 - width) * 0.4 + balance * 0.3)))
