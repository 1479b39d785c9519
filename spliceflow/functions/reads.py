"""Column expressions over CIGAR operations, flags, splice motifs and sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CIGAR operation codes; those that advance on the reference; intron motifs of the plus strand.
MATCH, INSERTION, DELETION, SKIP, SOFT, HARD, PAD, EQUAL, DIFFERENT = range(9)
ON_REFERENCE = (MATCH, DELETION, SKIP, EQUAL, DIFFERENT)
MOTIFS = (("GT", "AG"), ("GC", "AG"), ("AT", "AC"))


def _advances(op: Column) -> Column:
    return op.isin(*ON_REFERENCE)


def reference_length(cigar: Column) -> Column:
    """Bases on the reference that array<struct<op, len>> covers."""
    return F.aggregate(F.filter(cigar, lambda c: _advances(c["op"])), F.lit(0).cast("long"), lambda a, c: a + c["len"])


def junctions(cigar: Column, start: Column) -> Column:
    """array<struct<s, e>> of the skipped stretches, in one pass over the operations."""
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")

    def step(a: Column, c: Column) -> Column:
        after = a["at"] + F.when(_advances(c["op"]), c["len"].cast("long")).otherwise(F.lit(0).cast("long"))
        skip = F.struct(a["at"].alias("s"), after.alias("e"))
        return F.struct(after.alias("at"), F.when(c["op"] == SKIP, F.array_append(a["js"], skip)).otherwise(a["js"]).alias("js"))

    return F.aggregate(cigar, F.struct(start.cast("long").alias("at"), none.alias("js")), step, lambda a: a["js"])


def blocks(cigar: Column, start: Column) -> Column:
    """array<struct<s, e>> of the aligned stretches between skips."""
    skips = junctions(cigar, start)
    whole = start + reference_length(cigar)
    starts = F.concat(F.array(start.cast("long")), F.transform(skips, lambda p: p["e"]))
    ends = F.concat(F.transform(skips, lambda p: p["s"]), F.array(whole))
    return F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("s"), b.alias("e"))), lambda p: p["e"] > p["s"])


def usable(flag: Column, mapq: Column, min_mapq: int = 1) -> Column:
    """Mapped, primary, neither failed nor duplicate, of enough quality."""
    return (flag.bitwiseAND(0x4 | 0x100 | 0x200 | 0x400 | 0x800) == 0) & (mapq >= min_mapq)


def strand_of_flag(flag: Column, protocol: str = "none") -> Column:
    """+ or - from orientation and library protocol (rf, fr, none)."""
    reverse, second = flag.bitwiseAND(0x10) != 0, flag.bitwiseAND(0x80) != 0
    minus = {"rf": reverse == second, "fr": reverse != second, "none": reverse}[protocol]
    return F.when(minus, "-").otherwise("+")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def strand_of_motif(donor: Column, acceptor: Column) -> Column:
    """+ or - where the intron's ends are a known motif on that strand, else '.'."""
    plus = reduce(lambda c, m: c | ((donor == m[0]) & (acceptor == m[1])), MOTIFS, F.lit(False))
    rc_donor, rc_acceptor = reverse_complement(acceptor), reverse_complement(donor)
    minus = reduce(lambda c, m: c | ((rc_donor == m[0]) & (rc_acceptor == m[1])), MOTIFS, F.lit(False))
    return F.when(plus, "+").when(minus, "-").otherwise(".")


def pieces(seq: Column, overlap: int, size: int = 4096) -> Column:
    """seq as binary strings of `size` bytes and `overlap` more that the next begins with: a long sequence never is one array of k-mers."""
    raw = seq.cast("binary")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(raw) - overlap, F.lit(1)), F.lit(size)), lambda i: F.substring(raw, i, F.lit(size + overlap)))


def kmers(seq: Column, k: int) -> Column:
    """The k-mers of ACGT only, in order of place, of a string or of its bytes."""
    raw = seq.cast("binary")
    all_ = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(raw) - k + 1, F.lit(1))), lambda i: F.substring(raw, i, F.lit(k)).cast("string"))
    return F.filter(all_, lambda x: (F.octet_length(x) == k) & ~x.rlike("[^ACGT]"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def mean_quality(quality: Column) -> Column:
    """Mean Phred+33 quality; null for an empty string."""
    total = F.aggregate(F.split(quality, ""), F.lit(0).cast("long"), lambda a, x: a + F.when(x != "", F.ascii(x) - 33).otherwise(0))
    return F.when(F.length(quality) > 0, total / F.length(quality))


def trimmed_length(quality: Column, threshold: int) -> Column:
    """Length left when bases below the threshold are taken off the end."""
    return F.length(F.rtrim(quality, F.lit("".join(map(chr, range(33, 33 + threshold))))))
