"""BAM files as a Spark data source that splits a file by its compressed blocks.

A file is cut at byte offsets; each task looks for the first block behind its own, and in it for the first place from which alignments follow
each other, and reads every alignment that begins in its blocks. In a file sorted by coordinate a region is found by bisecting the splits,
and a task ends behind it.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: the bases of a nibble, the first bytes of a block and of a file, the flags of alignments that don't count.
BASES, BLOCK, MAGIC = "=ACMGRSVTWYHKDBN", b"\x1f\x8b\x08\x04", b"BAM\x01"
UNUSABLE = 4 + 256 + 512 + 1024 + 2048
SPLIT_BYTES = 32 << 20
SCHEMA = "name string, flag int, chrom string, start long, mapq int, cigar array<struct<op:int,len:long>>, next_chrom string, next_start long, template_length int, seq string, qual string"
#: Bytes in which a split's first alignment is looked for.
SEARCHED = 1 << 20
#: Alignments in a row that show that a place is the beginning of one.
CHAIN = 6
_ARROW = pa.schema([("name", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("start", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.list_(pa.struct([("op", pa.int32()), ("len", pa.int64())]))), ("next_chrom", pa.string()), ("next_start", pa.int64()), ("template_length", pa.int32()), ("seq", pa.string()), ("qual", pa.string())])
_FIXED = struct.Struct("<iiiBBHHHiiii")


@dataclass
class Split(InputPartition):
    path: str
    begin: int
    end: int


@dataclass
class _Header:
    names: list[str]
    lengths: list[int]
    ordered: bool
    block: int
    skip: int  # decompressed bytes of the header from that block on


def _block_size(head: bytes) -> int | None:
    """Size of the block whose first bytes these are."""
    if len(head) < 18 or head[:4] != BLOCK:
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(12 + extra, len(head)):
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def _blocks(file, at: int) -> Iterator[tuple[int, bytes]]:
    """Offset and contents of the blocks from `at` on."""
    while True:
        file.seek(at)
        head = file.read(18)
        if not head:
            return
        size = _block_size(head)
        if size is None:
            raise ValueError(f"{file.name}: no block at byte {at}")
        raw = head + file.read(size - 18)
        extra = struct.unpack_from("<H", raw, 10)[0]
        yield at, zlib.decompress(raw[12 + extra : -8], -15)
        at += size


def _next_block(file, at: int) -> int | None:
    """The first block that begins at or behind `at`: its size must lead to another one or to the end of the file."""
    whole = os.fstat(file.fileno()).st_size
    file.seek(at)
    window, k = file.read(1 << 17), -1
    while (k := window.find(BLOCK, k + 1)) >= 0:
        size = _block_size(window[k : k + 18])
        if size and at + k + size <= whole:
            file.seek(at + k + size)
            if at + k + size == whole or _block_size(file.read(18)):
                return at + k
    return None


def _header(path: str) -> _Header:
    with open(path, "rb") as file:
        data, starts = b"", []
        for at, block in _blocks(file, 0):
            starts.append((len(data), at))
            data += block
            try:
                if data[:4] != MAGIC:
                    raise ValueError(f"{path} is not a BAM file")
                text = struct.unpack_from("<i", data, 4)[0]
                pos = 8 + text
                names, lengths = [], []
                n = struct.unpack_from("<i", data, pos)[0]
                pos += 4
                for _ in range(n):
                    size = struct.unpack_from("<i", data, pos)[0]
                    names.append(data[pos + 4 : pos + 3 + size].decode())
                    lengths.append(struct.unpack_from("<i", data, pos + 4 + size)[0])
                    pos += 8 + size
            except struct.error:
                continue  # the header goes on in the next block
            first = max((s for s in starts if s[0] <= pos), key=lambda s: s[0])
            return _Header(names, lengths, b"SO:coordinate" in data[8 : 8 + text].split(b"\n")[0], first[1], pos - first[0])
    raise ValueError(f"{path} ends within its header")


def _plausible(data: bytes, at: int, header: _Header) -> int | None:
    """Where the next alignment would begin if one begins at `at`; None if none does. A place behind the data is the end of what is known."""
    if at + 36 > len(data):
        return len(data)
    size, ref, pos, name, _, _, ops, _, seq, next_ref, next_pos, _ = _FIXED.unpack_from(data, at)
    n = len(header.names)
    if not (32 <= size < 1 << 28 and -1 <= ref < n and -1 <= next_ref < n and pos >= -1 and next_pos >= -1 and name >= 1 and seq >= 0):
        return None
    if (ref >= 0 and pos >= header.lengths[ref]) or 32 + name + 4 * ops + (seq + 1) // 2 + seq > size:
        return None
    text = data[at + 36 : at + 36 + name]
    if len(text) == name and (text[-1] != 0 or any(not 33 <= c <= 126 for c in text[:-1])):
        return None
    return at + 4 + size


def _first(data: bytes, header: _Header) -> int | None:
    """The first place in data from which alignments follow each other, CHAIN of them or to the end of the data."""
    for at in range(len(data) - 36):
        k, place = 0, at
        while k < CHAIN and place is not None and place < len(data):
            place = _plausible(data, place, header)
            k += 1
        if place is not None:
            return at
    return None


def _alignments(split: Split, header: _Header) -> Iterator[bytes]:
    """The alignments that begin in the blocks of a split, without their sizes."""
    with open(split.path, "rb") as file:
        begins_here = split.begin <= header.block
        at = header.block if begins_here else _next_block(file, split.begin)
        if at is None or at >= split.end:
            return
        blocks, data, own, reached = _blocks(file, at), b"", 0, False

        def more() -> bool:
            """One block more; own grows while blocks are the split's."""
            nonlocal data, own, reached
            for offset, block in blocks:
                data += block
                reached = offset >= split.end
                own += 0 if reached else len(block)
                return True
            reached = True
            return False

        while len(data) < (header.skip if begins_here else SEARCHED) and more():
            pass
        place = header.skip if begins_here else _first(data, header)
        if place is None:
            return
        while True:
            while place >= own and not reached:
                more()
            if place >= own:
                return
            while len(data) < place + 4 or len(data) < place + 4 + struct.unpack_from("<i", data, place)[0]:
                if not more():
                    if len(data) == place:
                        return
                    raise ValueError(f"{split.path} ends within an alignment")
            size = struct.unpack_from("<i", data, place)[0]
            yield data[place + 4 : place + 4 + size]
            place += 4 + size
            if place > 1 << 20:
                data, own, place = data[place:], own - place, 0


def _row(raw: bytes, names: list[str]) -> tuple:
    ref, pos, name, mapq, _, ops, flag, seq, next_ref, next_pos, length = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32 + name
    cigar = [{"op": c & 15, "len": c >> 4} for c in struct.unpack_from(f"<{ops}I", raw, at)]
    at += 4 * ops
    packed = raw[at : at + (seq + 1) // 2]
    bases = "".join([BASES[b >> 4] + BASES[b & 15] for b in packed])[:seq]
    qual = raw[at + len(packed) : at + len(packed) + seq]
    text = None if not seq or qual[0] == 255 else bytes(q + 33 for q in qual).decode()
    of = lambda k: names[k] if k >= 0 else None
    place = lambda k: k if k >= 0 else None
    return raw[32 : at - 4 * ops - 1].decode(), flag, of(ref), place(pos), mapq, cigar, of(next_ref), place(next_pos), length, bases or None, text


class BamReader(DataSourceReader):
    """Options: path (a file or a glob), splitBytes, and chrom, start and end of a region."""

    def __init__(self, options: dict[str, str]):
        self.paths = sorted(p for part in options["path"].split(",") for p in glob.glob(part.removeprefix("file://")))
        if not self.paths:
            raise FileNotFoundError(options["path"])
        self.size = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.chrom = options.get("chrom")
        self.start, self.end = int(options.get("start", -1)), int(options.get("end", 1 << 40))

    def partitions(self) -> list[Split]:
        return [s for path in self.paths for s in self._splits(path)]

    def _splits(self, path: str) -> list[Split]:
        whole, header = os.path.getsize(path), _header(path)
        splits = [Split(path, at, min(at + self.size, whole)) for at in range(0, whole, self.size)]
        splits = [s for s in splits if s.end > header.block]
        if self.chrom is None or not header.ordered:
            return splits
        if self.chrom not in header.names:
            return splits[:1]
        ref = header.names.index(self.chrom)

        def reached(place: tuple[int, int]) -> int:
            """The number of splits that begin before a place: of one without an alignment the next one tells."""
            low, high = 0, len(splits)
            while low < high:
                mid = probe = (low + high) // 2
                first = None
                while first is None and probe < high:
                    first = next(_alignments(splits[probe], header), None)
                    probe += 1
                at = struct.unpack_from("<ii", first) if first else None
                if at is None or at[0] < 0 or at >= place:
                    high = mid
                else:
                    low = probe
            return low

        return splits[max(0, reached((ref, self.start)) - 1) : max(1, reached((ref, self.end)))]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        header = _header(partition.path)
        ref = None if self.chrom is None else header.names.index(self.chrom) if self.chrom in header.names else -2
        rows: list[tuple] = []
        for raw in _alignments(partition, header):
            if ref is not None:
                own, pos = struct.unpack_from("<ii", raw)
                if header.ordered and (own > ref or own < 0 or (own == ref and pos >= self.end)):
                    break
                if own != ref or not self.start <= pos < self.end:
                    continue
            rows.append(_row(raw, header.names))
            if len(rows) == 5_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))


def read_bam(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The alignments of BAM files in a folder that all machines see, SCHEMA; with a region those that begin in it (0-based, half open).

    Places are 0-based; null stands for unmapped, absent and unknown. Neither an index nor a sorted file is needed; a sorted file's region
    reads only the splits that hold it. A region on a chromosome that the file doesn't have is empty. The region is an argument and not taken
    from filters: a Python source that takes pushed filters keeps them for other uses of the same frame (Spark 4.1), which then lack rows.
    """
    spark.dataSource.register(BamSource)
    options = {"path": path, "splitBytes": split_bytes, "chrom": chrom, "start": start, "end": end}
    return spark.read.format("bam").options(**{k: str(v) for k, v in options.items() if v is not None}).load()


def count_reads(alignments: DataFrame, min_mapq: int = 0, required: int = 0, unwanted: int = UNUSABLE) -> DataFrame:
    """chrom, n: alignments with all required flags, none of the unwanted ones and the mapping quality."""
    good = (F.col("flag").bitwiseAND(required) == required) & (F.col("flag").bitwiseAND(unwanted) == 0) & (F.col("mapq") >= min_mapq)
    return alignments.where(good & F.col("chrom").isNotNull()).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))
