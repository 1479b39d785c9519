"""BAM files written here, in small blocks, read back by several tasks."""

import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spliceflow.functions import reads as R
from spliceflow.sources import bam

NAMES, LENGTHS = ["chr1", "chr2", "chrX"], [100_000, 50_000, 10_000]


def block(data):
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def alignment(name, flag, ref, pos, mapq, cigar, seq, qual):
    nibbles = [bam.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True))
    ops = b"".join(struct.pack("<I", n << 4 | op) for op, n in cigar)
    raw = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + (bytes(ord(q) - 33 for q in qual) if qual else b"\xff" * len(seq)) + b"NMC\1"
    return struct.pack("<i", len(raw)) + raw


def write(path, rows, size, order="coordinate"):
    text = f"@HD\tVN:1.6\tSO:{order}\n".encode()
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(NAMES)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in zip(NAMES, LENGTHS, strict=True))
    data = head + b"".join(alignment(*r) for r in rows)
    path.write_bytes(b"".join(block(data[k : k + size]) for k in range(0, len(data), size)) + block(b""))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = []
    for k in range(3000):
        ref = int(rng.integers(0, 3))
        n = int(rng.integers(1, 80))
        cigar = [(0, n)] if k % 3 else [(4, 1), (0, n), (3, 500), (7, 5)]
        seq = "".join(rng.choice(list("ACGTN"), n))
        out.append((f"read{k}", int(rng.choice([0, 16, 256, 1024])), ref, int(rng.integers(0, LENGTHS[ref] - 700)), int(rng.integers(0, 60)), cigar, seq, "".join(chr(33 + q) for q in rng.integers(0, 40, n)) if k % 5 else None))
    return sorted(out, key=lambda r: (r[2], r[3])) + [(f"lost{k}", 4, -1, -1, 0, [], "ACGT", None) for k in range(40)]


def told(frame):
    return sorted((r.name, r.flag, r.chrom, r.start, r.mapq, tuple((c.op, c.len) for c in r.cigar), r.seq, r.qual) for r in frame.collect())


def wanted(rows):
    return sorted((n, f, NAMES[r] if r >= 0 else None, p if p >= 0 else None, m, tuple(c), s or None, q) for n, f, r, p, m, c, s, q in rows)


@pytest.mark.parametrize(("size", "split"), [(700, 4_000), (60_000, 20_000), (60_000, 1 << 25), (150, 1_000)])
def test_file_is_read_by_several_tasks(spark, tmp_path, rows, size, split):
    write(tmp_path / "a.bam", rows, size)
    got = bam.read_bam(spark, str(tmp_path / "a.bam"), split_bytes=split)
    assert told(got) == wanted(rows)
    if split < 1 << 20:
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 2


def test_regions_read_few_splits(spark, tmp_path, rows):
    write(tmp_path / "a.bam", rows, 700)
    for chrom, start, end in (("chr2", 10_000, 20_000), ("chr1", 0, 500), ("chrX", 0, 10_000), ("chr2", 49_999, 50_000), ("chr9", 0, 10)):
        got = bam.read_bam(spark, str(tmp_path / "a.bam"), chrom, start, end, split_bytes=4_000)
        assert told(got) == wanted([r for r in rows if r[2] >= 0 and NAMES[r[2]] == chrom and start <= r[3] < end])
    reader = bam.BamReader({"path": str(tmp_path / "a.bam"), "splitBytes": "4000", "chrom": "chr2", "start": "10000", "end": "20000"})
    every = bam.BamReader({"path": str(tmp_path / "a.bam"), "splitBytes": "4000"}).partitions()
    assert 0 < len(reader.partitions()) < len(every) / 4


def test_unsorted_files_counts_and_junctions(spark, tmp_path, rows):
    write(tmp_path / "a.bam", rows[::-1], 700, order="unsorted")
    write(tmp_path / "b.bam", rows[:5], 700)
    got = bam.read_bam(spark, str(tmp_path / "*.bam"), split_bytes=9_000)
    every = rows + rows[:5]
    assert got.count() == len(every)
    counts = {r.chrom: r.n for r in bam.count_reads(got, min_mapq=10).collect()}
    assert counts == Counter(NAMES[r[2]] for r in every if r[2] >= 0 and r[1] in (0, 16) and r[4] >= 10)
    region = bam.read_bam(spark, str(tmp_path / "a.bam"), "chr1", 5, 9_000, split_bytes=9_000)
    assert told(region) == wanted([r for r in rows if r[2] == 0 and 5 <= r[3] < 9_000])
    skips = got.select(F.explode(R.junctions(F.col("cigar"), F.col("start"))).alias("j")).where("j.e - j.s = 500").count()
    assert skips == sum(len(r[5]) == 4 for r in every)


def test_faulty_files(spark, tmp_path, rows):
    (tmp_path / "x.bam").write_bytes(b"not a bam file at all, by far")
    with pytest.raises(Exception, match="no block"):
        bam.read_bam(spark, str(tmp_path / "x.bam")).count()
    write(tmp_path / "e.bam", [], 700)
    assert bam.read_bam(spark, str(tmp_path / "e.bam")).count() == 0
