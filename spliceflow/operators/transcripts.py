"""Transcript operators: intron chains, filters, expression, structure and comparison with a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.operators.intervals import overlap_join


def chains(exons: DataFrame) -> DataFrame:
    """A row for each transcript: gene, strand, exons (sorted array of s, e), introns (array), chain (text of introns), length, span."""
    rows = exons.groupBy("gene_id", "chrom", "strand", "transcript_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("exons"))
    inner = F.zip_with(F.slice("exons", 1, F.size("exons") - 1), F.slice("exons", 2, F.size("exons")), lambda a, b: F.struct(a["e"].alias("s"), b["s"].alias("e")))
    rows = rows.withColumn("introns", F.when(F.size("exons") > 1, inner).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>")))
    text = F.array_join(F.transform("introns", lambda i: F.concat_ws("-", i["s"], i["e"])), ",")
    length = F.aggregate("exons", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return rows.withColumns({"chain": text, "length": length, "tx_start": F.col("exons")[0]["s"], "tx_end": F.element_at("exons", -1)["e"]})


def merge_chains(transcripts: DataFrame, weight: str) -> DataFrame:
    """Transcripts of a gene with one intron chain become one: least start, greatest end, summed weight, name of the heaviest."""
    multi = transcripts.where("chain <> ''")
    return multi.groupBy("gene_id", "strand", "chain").agg(
        F.min("tx_start").alias("tx_start"), F.max("tx_end").alias("tx_end"), F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("members"),
        F.max_by("transcript_id", F.struct(F.col(weight), F.col("transcript_id"))).alias("representative"),
    )


def passes(score: Column, coverage: Column, support: Column, n_exons: Column, length: Column, min_score: float = 0.3, min_coverage: float = 1.0, min_support: int = 2, min_length: int = 50) -> Column:
    """Score (half of it for very well covered transcripts), coverage, junction support of multi-exon ones, length."""
    relaxed = (coverage >= max(20.0, 10 * min_coverage)) & (score >= min_score / 2)
    return ((score >= min_score) | relaxed) & (coverage >= min_coverage) & ((n_exons < 2) | (support >= min_support)) & (length >= min_length)


def best_per_chain(transcripts: DataFrame, score: str) -> DataFrame:
    first = Window.partitionBy("gene_id", "chain").orderBy(F.desc(score), "transcript_id")
    return transcripts.withColumn("__r", F.row_number().over(first)).where("__r = 1 or chain = ''").drop("__r")


def locus_cap(transcripts: DataFrame, score: str, n: int = 30) -> DataFrame:
    order = Window.partitionBy("gene_id").orderBy(F.desc(score), "transcript_id")
    return transcripts.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def expression(transcripts: DataFrame, coverage: str, mapped_reads: int, read_length: int = 100) -> DataFrame:
    """fpkm and tpm from coverage; zeros where nothing is mapped or covered. The total is one row, joined to all."""
    if mapped_reads < 0 or read_length <= 0:
        raise ValueError("mapped_reads must be at least 0 and read_length above 0")
    total = transcripts.agg(F.sum(coverage).alias("__total"))
    c = F.col(coverage).cast("double")
    fpkm = c * 1e9 / (mapped_reads * read_length) if mapped_reads else F.lit(0.0)
    tpm = F.when(F.col("__total") > 0, c / F.col("__total") * 1e6).otherwise(F.lit(0.0)) if mapped_reads else F.lit(0.0)
    return transcripts.crossJoin(F.broadcast(total)).withColumns({"fpkm": fpkm, "tpm": tpm}).drop("__total")


def structure(transcripts: DataFrame) -> DataFrame:
    lens = F.transform("exons", lambda x: x["e"] - x["s"])
    gaps = F.transform("introns", lambda x: x["e"] - x["s"])
    return transcripts.select(
        "gene_id", "transcript_id", F.size("exons").cast("long").alias("n_exons"), F.col("length"), (F.col("tx_end") - F.col("tx_start")).alias("span"),
        F.array_min(lens).alias("min_exon"), F.array_max(lens).alias("max_exon"), F.coalesce(F.array_max(gaps), F.lit(0)).alias("max_intron"),
        (F.col("length") / (F.col("tx_end") - F.col("tx_start"))).alias("exon_fraction"),
    )


def shared_junctions(transcripts: DataFrame) -> DataFrame:
    """For each transcript how many of its junctions other transcripts of the gene have, and how many are its own."""
    each = transcripts.select("gene_id", "transcript_id", F.explode("introns").alias("i"))
    users = each.groupBy("gene_id", "i").agg(F.count(F.lit(1)).alias("users"))
    met = each.join(users, ["gene_id", "i"])
    return met.groupBy("gene_id", "transcript_id").agg(F.sum((F.col("users") > 1).cast("long")).alias("shared"), F.sum((F.col("users") == 1).cast("long")).alias("own"))


def cap_terminal(exons: Column, most: int) -> Column:
    """The first exon's start and the last one's end moved in so that both are at most `most` long; single exons stay."""
    n = F.size(exons)
    cut = F.transform(exons, lambda x, i: F.struct(F.when((i == 0) & (n > 1), F.greatest(x["s"], x["e"] - most)).otherwise(x["s"]).alias("s"), F.when((i == n - 1) & (n > 1), F.least(x["e"], x["s"] + most)).otherwise(x["e"]).alias("e")))
    return cut


def merge_close(exons: Column, gap: int) -> Column:
    """Sorted exons with those at most `gap` apart merged, by one fold over the array."""
    empty = F.slice(exons, 1, 0)
    return F.aggregate(exons, empty, lambda a, x: F.when((F.size(a) > 0) & (x["s"] - F.element_at(a, -1)["e"] <= gap), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["s"].alias("s"), F.greatest(F.element_at(a, -1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(a, F.array(x))))


def classify(transcripts: DataFrame, reference: DataFrame, tolerance: int = 5, spare: int = 2) -> DataFrame:
    """gene_id, transcript_id and category against a reference of chains().

    single_exon; exact_match (the reference's chain, one whose junctions are all within the tolerance, or one of at least two junctions
    that the transcript holds with at most `spare` others); novel_combination (all junctions known); novel_exon (an exon that overlaps none
    of the gene's reference exons); novel_junction. Every step is an equi or overlap join on the gene; no gene's exons are gathered.
    """
    ids = ["gene_id", "transcript_id"]
    multi = transcripts.where("chain <> ''")
    known = reference.where("chain <> ''").select("gene_id", "chain", "introns").dropDuplicates(["gene_id", "chain"])
    same = multi.join(known.select("gene_id", "chain"), ["gene_id", "chain"], "left_semi").select(*ids)
    # Chains of as many junctions whose first junctions are near.
    w = 2 * tolerance + 1
    at = lambda c: F.col(c)[0]["s"]
    a = multi.select(*ids, "introns", F.size("introns").alias("n"), F.floor(at("introns") / w).alias("bin"))
    b = known.select("gene_id", F.col("introns").alias("other"), F.size("introns").alias("n"), F.explode(F.array_distinct(F.array(F.floor((at("introns") - tolerance) / w), F.floor((at("introns") + tolerance) / w)))).alias("bin"))
    close = F.forall(F.zip_with("introns", "other", lambda x, y: (F.abs(x["s"] - y["s"]) <= tolerance) & (F.abs(x["e"] - y["e"]) <= tolerance)), lambda ok: ok)
    near = a.join(b, ["gene_id", "n", "bin"]).where(close).select(*ids)
    # A reference chain within the transcript's shows by its first junction.
    each = multi.select(*ids, "introns", F.explode("introns").alias("i"))
    held = known.where(F.size("introns") >= 2).select("gene_id", F.col("introns").alias("other"), F.col("introns")[0].alias("i"))
    inside = (F.size("other") >= F.size("introns") - spare) & (F.size(F.array_except("other", "introns")) == 0)
    superset = each.join(held, ["gene_id", "i"]).where(inside).select(*ids)
    exact = same.union(near).union(superset).distinct().withColumn("exact", F.lit(True))
    known_j = reference.select("gene_id", F.explode("introns").alias("i")).distinct().withColumn("hit", F.lit(1))
    hits = each.select(*ids, "i").join(known_j, ["gene_id", "i"], "left").groupBy(*ids).agg(F.count("hit").alias("known"))
    spans = lambda rows: rows.select("gene_id", F.explode("exons").alias("x")).select("gene_id", "x.s", "x.e").distinct()
    own = spans(multi)
    seen = overlap_join(own, spans(reference).withColumnsRenamed({"s": "rs", "e": "re"}), ["gene_id"]).select("gene_id", "s", "e").distinct()
    novel = multi.select(*ids, F.explode("exons").alias("x")).select(*ids, "x.s", "x.e").join(seen, ["gene_id", "s", "e"], "left_anti").select(*ids).distinct().withColumn("novel", F.lit(True))
    out = transcripts.select(*ids, F.size("introns").alias("n")).join(exact, ids, "left").join(hits, ids, "left").join(novel, ids, "left")
    category = F.when(F.col("n") == 0, "single_exon").when(F.col("exact"), "exact_match").when(F.col("known") == F.col("n"), "novel_combination").when(F.col("novel"), "novel_exon").otherwise("novel_junction")
    return out.select(*ids, category.alias("category"))


def merge_compatible(transcripts: DataFrame, weight: str, safe: str) -> DataFrame:
    """Transcripts of a gene with the same exons become one: summed weight, safe if all are."""
    return transcripts.groupBy("gene_id", "exons").agg(F.sum(weight).alias("weight"), F.bool_and(safe).alias("safe"), F.count(F.lit(1)).alias("members"), F.min("transcript_id").alias("transcript_id"))


def junction_support(transcripts: DataFrame, junctions: DataFrame) -> DataFrame:
    """gene_id, transcript_id and what junctions(gene_id, js, je, count, canonical) say for its introns: number, least, mean and greatest
    support, how many have none, share of canonical ones, and the balance (least over greatest)."""
    each = transcripts.select("gene_id", "transcript_id", F.explode("introns").alias("i")).select("gene_id", "transcript_id", F.col("i.s").alias("js"), F.col("i.e").alias("je"))
    met = each.join(junctions.select("gene_id", "js", "je", "count", "canonical"), ["gene_id", "js", "je"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    out = met.groupBy("gene_id", "transcript_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("count").alias("least"), F.avg("count").alias("mean"), F.max("count").alias("most"),
        F.count(F.when(F.col("count") == 0, 1)).alias("unsupported"), F.avg(F.coalesce(F.col("canonical").cast("int"), F.lit(0))).alias("canonical"),
    )
    return out.withColumn("balance", F.coalesce(F.try_divide("least", "most"), F.lit(0.0)))


def sensitivity_precision(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row: number of different keys in both, in truth, in found, and the two shares."""
    a = found.select(*keys).distinct().withColumn("f", F.lit(1))
    b = truth.select(*keys).distinct().withColumn("t", F.lit(1))
    n = a.join(b, keys, "full").agg(F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("hits"), F.count("t").alias("n_truth"), F.count("f").alias("n_found"))
    return n.withColumns({"sensitivity": F.try_divide("hits", "n_truth"), "precision": F.try_divide("hits", "n_found")})
