"""GTF, FASTA and FASTQ as DataFrames, and the writers of the results.

The readers split text with Spark's line readers, so a file is read by many tasks; FASTA records come from a record separator, FASTQ's
four lines from line numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spliceflow.functions.parsing import restored_cell, safe_cell
from spliceflow.functions.reads import mean_quality, trimmed_length, usable


def attribute(attributes: Column, name: str) -> Column:
    value = F.regexp_extract(attributes, rf'(?:^|;\s*){name}\s+"([^"]*)"', 1)
    return F.when(value != "", value)


def gtf_exons(spark: SparkSession, path: str) -> DataFrame:
    """transcript_id, gene_id, gene_name, chrom, strand, s, e of the exon lines; starts become 0-based."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.get(cells, 2) == "exon")
    info = F.get(cells, 8)
    return rows.select(attribute(info, "transcript_id").alias("transcript_id"), attribute(info, "gene_id").alias("gene_id"), attribute(info, "gene_name").alias("gene_name"), F.get(cells, 0).alias("chrom"), F.get(cells, 6).alias("strand"), (F.get(cells, 3).cast("long") - 1).alias("s"), F.get(cells, 4).cast("long").alias("e"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, description, seq (upper case). A record is one row, so a contig must fit a task."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(text, r"^([^\n]*)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"\s", ""))
    return rows.where(F.trim(text) != "").select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), head.alias("description"), body.alias("seq"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n (from 0), value of each line. Lines are counted by block; a block's first number is the sum of the blocks before it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("n"), "value")


def fastq(spark: SparkSession, path: str, min_length: int = 0, min_quality: float | None = None, trim: int | None = None) -> DataFrame:
    """name, sequence (upper case), quality of the records, four lines each, plain or compressed.

    With trim, bases of less quality go from the end first; then reads shorter than min_length or of less mean quality than min_quality
    go. A record whose lines don't fit (no @, no +, other lengths) raises.
    """
    line = lambda k: F.max(F.when(F.col("n") % 4 == k, F.rtrim("value", F.lit("\r")))).alias(f"l{k}")
    records = _numbered_lines(spark, path).groupBy("file", F.floor(F.col("n") / 4).alias("record")).agg(*map(line, range(4))).where("l0 <> '' or l1 is not null")
    good = F.coalesce(F.startswith("l0", F.lit("@")) & F.startswith("l2", F.lit("+")) & (F.length("l1") == F.length("l3")), F.lit(False))
    checked = F.when(good, F.upper("l1")).otherwise(F.raise_error(F.concat(F.lit("no FASTQ record: "), F.coalesce("l0", F.lit("")))).cast("string"))
    rows = records.select(F.regexp_extract("l0", r"^@(\S*)", 1).alias("name"), checked.alias("sequence"), F.col("l3").alias("quality"))
    if trim is not None:
        rows = rows.withColumn("keep", trimmed_length(F.col("quality"), trim)).select("name", F.substring("sequence", F.lit(1), F.col("keep")).alias("sequence"), F.substring("quality", F.lit(1), F.col("keep")).alias("quality"))
    rows = rows.where(F.length("sequence") >= min_length)
    return rows if min_quality is None else rows.where(mean_quality(F.col("quality")) >= min_quality)


def gtf_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """transcript_id, gene_id, gene_name, chrom, strand, s, e, exons of transcript and exon lines in any order: the least start and the
    greatest end of both, exons sorted."""
    rows = _gtf(spark, path).where("feature in ('transcript', 'exon') and transcript_id is not null")
    exon = F.when(F.col("feature") == "exon", F.struct("s", "e"))
    return rows.groupBy("transcript_id", "chrom", "strand").agg(F.min("gene_id").alias("gene_id"), F.min("gene_name").alias("gene_name"), F.min("s").alias("s"), F.max("e").alias("e"), F.array_sort(F.collect_set(exon)).alias("exons")).select("transcript_id", "gene_id", "gene_name", "chrom", "strand", "s", "e", "exons")


def gene_transcripts(spark: SparkSession, path: str, gene: str, chrom: str | None = None) -> DataFrame:
    """gtf_transcripts() of one gene, by name or id, in upper or lower case."""
    rows = gtf_transcripts(spark, path).where(_is_gene(gene))
    return rows if chrom is None else rows.where(F.col("chrom") == chrom)


def lookup_gene(spark: SparkSession, path: str, gene: str) -> DataFrame:
    """chrom, s, e, strand, gene_name, gene_id of the first gene line of that name or id; no row without one."""
    rows = _gtf(spark, path).where("feature = 'gene'").where(_is_gene(gene))
    strand = F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(".")
    return rows.orderBy("file", "at").limit(1).select("chrom", "s", "e", strand.alias("strand"), F.coalesce("gene_name", F.lit(gene)).alias("gene_name"), "gene_id")


def _is_gene(gene: str) -> Column:
    return F.coalesce(F.upper("gene_name") == gene.upper(), F.lit(False)) | F.coalesce(F.upper("gene_id") == gene.upper(), F.lit(False))


def _gtf(spark: SparkSession, path: str) -> DataFrame:
    cells, info = F.split("value", "\t"), F.get(F.split("value", "\t"), 8)
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).where(~F.col("value").startswith("#")).where(F.size(cells) >= 9)
    return rows.select("file", "at", F.get(cells, 2).alias("feature"), F.get(cells, 0).alias("chrom"), (F.get(cells, 3).cast("long") - 1).alias("s"), F.get(cells, 4).cast("long").alias("e"), F.get(cells, 6).alias("strand"), *(attribute(info, n).alias(n) for n in ("transcript_id", "gene_id", "gene_name")))


def region_reads(alignments: DataFrame, chrom: str, start: int, end: int, min_mapq: int = 1) -> DataFrame:
    """Usable alignments(chrom, start, flag, mapq) that begin in [start, end); the conditions reach a Parquet scan."""
    return alignments.where((F.col("chrom") == chrom) & (F.col("start") >= start) & (F.col("start") < end)).where(usable(F.col("flag"), F.col("mapq"), min_mapq))


def chunks(contigs: DataFrame, size: int = 100_000) -> DataFrame:
    """name, chunk, seq: long contigs cut to pieces, so that lookups of places join on (name, chunk)."""
    n = F.greatest(F.ceil(F.length("seq") / size), F.lit(1)).cast("int")
    return contigs.select("name", F.col("seq").alias("whole"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).select("name", "chunk", F.substring("whole", F.col("chunk") * size + 1, F.lit(size)).alias("seq"))


def write_tsv(rows: DataFrame, path: str) -> None:
    """A folder of tab-separated parts with headers; text that a spreadsheet would run is quoted, nulls are NA, NaN is nan."""
    cells = [(safe_cell(F.col(c)) if kind == "string" else F.col(c).cast("string")).alias(c) for c, kind in rows.dtypes]
    rows.select(*(F.coalesce(c, F.lit("NA")).alias(n) for c, n in zip(cells, rows.columns, strict=True))).write.csv(path, sep="\t", header=True, quote="", escape="")


def write_report(rows: DataFrame, path: str, digits: int = 6) -> None:
    """As write_tsv(), numbers with fixed digits and truth values as yes or no, for readers rather than programs."""
    shape = {"double": lambda c: F.format_string(f"%.{digits}f", F.col(c)), "float": lambda c: F.format_string(f"%.{digits}f", F.col(c).cast("double")), "boolean": lambda c: F.when(F.col(c), "yes").when(~F.col(c), "no"), "string": lambda c: safe_cell(F.col(c))}
    cells = [shape.get(kind, lambda c: F.col(c).cast("string"))(c) for c, kind in rows.dtypes]
    cells = [F.when(F.col(n).isNotNull(), c).alias(n) for c, n in zip(cells, rows.columns, strict=True)]
    rows.select(*(F.coalesce(c, F.lit("NA")).alias(n) for c, n in zip(cells, rows.columns, strict=True))).write.csv(path, sep="\t", header=True, quote="", escape="")


def read_events_tsv(spark: SparkSession, path: str, numbers: tuple[str, ...] = (), needed: tuple[str, ...] = ("event_id", "event_type")) -> DataFrame:
    """A table of write_tsv() or write_report(): guards taken off, NA is null, columns of numbers cast (null where they can't be); raises
    where a needed column lacks."""
    rows = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote="", escape="")
    if lacking := [c for c in needed if c not in rows.columns]:
        raise ValueError(f"{path} lacks the columns {lacking}")
    text = lambda c: F.when(F.col(c) != "NA", restored_cell(F.col(c)))
    return rows.select(*((text(c).try_cast("double") if c in numbers else text(c)).alias(c) for c in rows.columns))


def _line(feature: str, frame: Column) -> Column:
    return F.concat_ws("\t", "chrom", F.lit("spliceflow"), F.lit(feature), (F.col("s") + 1).cast("string"), F.col("e").cast("string"), F.lit("."), "strand", F.lit("."), frame)


def write_gtf(exons: DataFrame, path: str) -> None:
    """exons(transcript_id, gene_id, chrom, strand, s, e) with a transcript line before each transcript's exons, sorted by place."""
    info = F.concat(F.lit('gene_id "'), F.col("gene_id"), F.lit('"; transcript_id "'), F.col("transcript_id"), F.lit('";'))
    whole = exons.groupBy("transcript_id", "gene_id", "chrom", "strand").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    first = whole.select("chrom", F.col("s").alias("at"), "transcript_id", F.lit(0).alias("k"), "s", _line("transcript", info).alias("value"))
    starts = whole.select("transcript_id", "gene_id", F.col("s").alias("at"))
    rest = exons.join(starts, ["transcript_id", "gene_id"]).select("chrom", "at", "transcript_id", F.lit(1).alias("k"), "s", _line("exon", info).alias("value"))
    first.union(rest).orderBy("chrom", "at", "transcript_id", "k", "s").select("value").write.text(path)


def write_gff3(exons: DataFrame, path: str) -> None:
    enc = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("%"), F.lit("%25")), F.lit(";"), F.lit("%3B")), F.lit("="), F.lit("%3D")), F.lit("&"), F.lit("%26")), F.lit(","), F.lit("%2C"))
    exons.orderBy("chrom", "s").select(_line("exon", F.concat(F.lit("Parent="), enc("transcript_id"))).alias("value")).write.text(path)


def write_fasta(sequences: DataFrame, path: str, width: int = 80) -> None:
    """sequences(name, seq), lines of at most `width`."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    sequences.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), body).alias("value")).write.text(path)


def write_ioe(events: DataFrame, path: str) -> None:
    """seqname, gene_id, event_id, inclusion and all transcripts of each event as sorted comma lists."""
    rows = events.select(F.col("chrom").alias("seqname"), "gene_id", "event_id", F.array_join(F.array_sort(F.array_distinct("inclusion_transcripts")), ",").alias("inclusion_transcripts"), F.array_join(F.array_sort(F.array_union("inclusion_transcripts", "exclusion_transcripts")), ",").alias("total_transcripts"))
    rows.write.csv(path, sep="\t", header=True, quote="", escape="")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
