"""Substring dedup: runs of several consecutive sentences are hashed and joined over all documents; repeats are removed.

Words are what ASCII white space parts. A sentence ends with a word on . ! ? (and the ideographic stops), closing marks aside, or at a
line break. One of over WHOLE_WORDS words is cut further, at places that the words around them alone decide (see sentences()), so that a
passage is cut alike wherever it begins and what follows a changed word is too; no sentence has over MAX_WORDS words. From each sentence
a run goes on until it has RUN_SENTENCES sentences and MIN_WORDS words, or two sentences and MAX_WORDS words; a run that the text ends
before isn't one. The first of equal runs, by document id and place, stays; sentences that any other occurrence covers go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.llm.common import cut, frame, unused

RUN_SENTENCES = 3
MIN_WORDS = 16
MAX_WORDS = 20
#: Longer sentences are cut at words whose hash is the least of NEAR words on either side.
WHOLE_WORDS = 12
NEAR = 2
#: Bytes of text whose runs a task looks at together: of equal ones only the first goes on to be compared with those of other tasks.
CHUNK_BYTES = 16 << 20
#: Bytes of text that are cut into sentences at once.
BLOCK_BYTES = 1 << 19
RUNS = "high long, low long, doc_id long, text_hash long, first int, n int, repeated boolean"


def _bytes(*values: int) -> np.ndarray:
    made = np.zeros(256, dtype=bool)
    made[list(values)] = True
    return made


_GAP, _LINE, _STOP, _CLOSE = (_bytes(*x) for x in (b" \t\n\r\x0b\x0c", b"\n\r", b".!?", b"\"')]"))
_IDEOGRAPHIC = [(0xE3, 0x80, 0x82), (0xEF, 0xBC, 0x81), (0xEF, 0xBC, 0x9F)]


@dataclass(frozen=True)
class Sentences:
    """The sentences of some texts.

    words of all; begins and ends: first and last byte of each, in the texts joined by line breaks; at: first word of each sentence, and
    the number of words; docs: first sentence of each text, and the number of sentences; offsets: first byte of each text.
    """

    words: list[bytes]
    begins: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    docs: np.ndarray
    offsets: np.ndarray

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of text k, the byte at which each sentence begins (they tile the text from there on), and their numbers of words."""
        own = self.at[self.docs[k] : self.docs[k + 1] + 1]
        return self.begins[own[:-1]] - self.offsets[k], np.diff(own)


def sentences(texts: list[bytes]) -> Sentences:
    """The sentences of texts in UTF-8; a text's sentences depend on nothing but the text.

    One of over WHOLE_WORDS words is cut before each word whose hash is less than those of the NEAR words before it and no more than those
    of the NEAR words after it, all in the sentence, and after MAX_WORDS words without such a place.
    """
    raw = b"\n".join(texts)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    words = raw.split()
    n = len(words)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Sentences(words, none, none, np.zeros(1, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64), offsets)
    b = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=bool)
    np.logical_not(_GAP[b], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edge[::2], edge[1::2] - 1
    last = ends
    for _ in range(2):  # a stop may stand before two closing marks
        last = last - (_CLOSE[b[last]] & (last > begins))
    stop = _STOP[b[last]]
    wide = np.flatnonzero((b[last] >= 0x80) & (last - begins >= 2))
    if len(wide):
        x, y, z = (b[last[wide] - k] for k in (2, 1, 0))
        stop[wide] |= np.logical_or.reduce([(x == i) & (y == j) & (z == k) for i, j, k in _IDEOGRAPHIC])
    broken = np.searchsorted(begins, np.flatnonzero(_LINE[b])) - 1  # the word before each line break
    stop[broken[broken >= 0]] = True
    stop[-1] = True
    at = np.concatenate(([0], np.flatnonzero(stop) + 1))
    lengths = np.diff(at)
    if lengths.max() > WHOLE_WORDS:
        at = _cut_long(words, at, lengths)
    docs = np.searchsorted(begins[at[:-1]], np.append(offsets, len(b) + 1))
    return Sentences(words, begins, ends, at, docs, offsets)


def _cut_long(words: list[bytes], at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh32_intdigest, words), dtype=np.uint32, count=len(words))
    before = np.arange(len(words)) - np.repeat(at[:-1], lengths)
    whole = np.repeat(lengths, lengths)
    place = np.flatnonzero((whole > WHOLE_WORDS) & (before >= NEAR) & (before < whole - NEAR))
    least = np.ones(len(place), dtype=bool)
    for k in range(1, NEAR + 1):
        least &= (h[place] < h[place - k]) & (h[place] <= h[place + k])
    at = np.sort(np.concatenate((at, place[least])))
    lengths = np.diff(at)
    pieces = -(-lengths // MAX_WORDS)
    if pieces.max() > 1:
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = np.append(np.repeat(at[:-1], pieces) + nth * MAX_WORDS, at[-1])
    return at


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, digest (two 64-bit numbers), first sentence and number of sentences of each run; white space between words doesn't count."""
    cuts = sentences(texts)
    at = cuts.at
    first = np.arange(len(at) - 1)
    usual = np.maximum(first + RUN_SENTENCES, np.searchsorted(at, at[:-1] + MIN_WORDS))
    end = np.minimum(usual, np.maximum(first + 2, np.searchsorted(at, at[:-1] + MAX_WORDS)))
    doc = np.repeat(np.arange(len(texts)), np.diff(cuts.docs))
    whole = end <= cuts.docs[1:][doc]
    doc, first, end = doc[whole], first[whole], end[whole]
    plain = b" ".join(cuts.words)
    place = np.concatenate(([0], np.cumsum(cuts.ends - cuts.begins + 2)))
    spans = zip(place[at[first]].tolist(), (place[at[end]] - 1).tolist(), strict=True)
    digests = b"".join([xxhash.xxh3_128_digest(plain[a:b]) for a, b in spans])
    return doc, np.frombuffer(digests, dtype="<i8").reshape(-1, 2), first - cuts.docs[doc], end - first


def _blocks(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of neighbours of about `most` together; a larger one is alone."""
    begin, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            yield slice(begin, k)
            begin, held = k, 0
        held += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def _runs_of(ids: list[int | None], hashes: list[int], texts: list[bytes]) -> pa.RecordBatch:
    """RUNS of some documents, each once. Of equal runs all but the first are marked as repeated; they need no partner and get a key of
    their own."""
    order = sorted({(ids[k], hashes[k]): k for k in range(len(ids))}.values(), key=lambda k: (ids[k] is None, ids[k] or 0, hashes[k]))
    found = [(b.start, runs([texts[k] for k in order[b]])) for b in _blocks([len(texts[k]) for k in order], BLOCK_BYTES)]
    doc, first, n = (np.concatenate([np.zeros(0, dtype=np.int64), *(f[i] + (start if i == 0 else 0) for start, f in found)]) for i in (0, 2, 3))
    key = np.concatenate([np.zeros((0, 2), dtype=np.int64), *(f[1] for _, f in found)])
    # Documents are in order and so are their runs: a stable sort keeps the first of equal digests in front.
    by_key = np.argsort(key[:, 0], kind="stable")
    same = np.zeros(len(key), dtype=bool)
    same[by_key[1:]] = (key[by_key[1:]] == key[by_key[:-1]]).all(axis=1)
    key[same, 0], key[same, 1] = np.arange(same.sum()), first[same]
    row_id = np.array([ids[k] or 0 for k in order], dtype=np.int64)[doc]
    no_id = np.array([ids[k] is None for k in order], dtype=bool)[doc]
    row_hash = np.array([hashes[k] for k in order], dtype=np.int64)[doc]
    columns = [pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(row_id, mask=no_id), pa.array(row_hash), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(same)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RUNS.split(", ")])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, spans): for each document with non-first repeated runs, their first sentences and lengths."""

    def told(ids: list, hashes: list, texts: list) -> Iterator[pa.RecordBatch]:
        found = _runs_of(ids, hashes, texts)
        for at in range(0, found.num_rows, 50_000):
            yield found.slice(at, 50_000)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, texts, size = [], [], [], 0
        for batch in batches:
            for id_, hash_, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids.append(id_)
                hashes.append(hash_)
                texts.append(text)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield from told(ids, hashes, texts)
                    ids, hashes, texts, size = [], [], [], 0
        yield from told(ids, hashes, texts)

    read = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    # One exchange of the runs. A digest comes at most once from each chunk, however many documents of it hold the run. Rows that repeat
    # id and text share a rank: they are one document.
    places = Window.partitionBy("high", "low").orderBy(F.col("doc_id").asc_nulls_last(), "text_hash", "first")
    later = read.mapInArrow(cut_up, RUNS).withColumn("nth", F.rank().over(places)).where("repeated or nth > 1")
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "n")).alias("spans"))


def _cleaned(text: Column, spans: Column) -> Column:
    """text without the sentences in spans, its sentences and words, and how many of them went; null for a null text."""

    @F.pandas_udf("text string, sentences long, removed long, words long, removed_words long")
    def clean(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        raws = [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in text]
        for block in _blocks([len(raw) for raw in raws], BLOCK_BYTES):
            cuts = sentences(raws[block])
            for k, (raw, t, s) in enumerate(zip(raws[block], text[block], spans[block], strict=True)):
                starts, words = cuts.of(k)
                gone = np.zeros(len(words), dtype=bool)
                for span in s if s is not None else ():
                    gone[span["first"] : span["first"] + span["n"]] = True
                if gone.any():
                    edges = [*starts.tolist(), len(raw)]
                    t = (raw[: edges[0]] + b"".join([raw[edges[j] : edges[j + 1]] for j in np.flatnonzero(~gone).tolist()])).decode("utf-8", "replace")
                out.append((t if isinstance(t, str) else None, len(words), int(gone.sum()), int(words.sum()), int(words[gone].sum())))
        return frame(out, "text string, sentences long, removed long, words long, removed_words long")

    return clean(text, spans)


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs with the spans of each row, and the name of that column. Rows without text are spread over the join by a key of their own."""
    doc, own, hash_, spans = unused(docs, "doc", "own", "hash", "spans")
    found = cut(repeated_spans(docs, id_col, text_col).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(hash_), F.col("spans").alias(spans)))
    keyed = docs.withColumn(own, F.when(F.length(text_col) > 0, F.xxhash64(text_col)).otherwise(F.monotonically_increasing_id()))
    return keyed.join(found, F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(hash_)), "left"), spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the repeated sentences taken out of their texts; other columns and all rows stay (length_col, if given, is set anew).

    Null texts stay null; a text may become empty. Rows that repeat both id and text are one document and treated alike; those that
    repeat an id with another text, and those with null ids (which come after all others), are documents of their own. An empty
    table gives an empty one. Other columns may have any names.
    """
    marked, spans = _with_spans(docs, id_col, text_col)
    new = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(_cleaned(F.col(text_col), F.col(spans))["text"])
    out = marked.withColumn(text_col, new)
    if length_col:
        out = out.withColumn(length_col, F.length(text_col).cast("long"))
    return out.select(*docs.columns)


def repeats_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, n_removed, n_words, n_removed_words, clean_sha256) for each row of docs; see remove_repeats()."""
    marked, spans = _with_spans(docs.select(id_col, text_col), id_col, text_col)
    out = marked.select(F.col(id_col).alias("doc_id"), _cleaned(F.col(text_col), F.col(spans)).alias("c"))
    return out.select("doc_id", F.col("c.sentences").alias("n_sentences"), F.col("c.removed").alias("n_removed"), F.col("c.words").alias("n_words"), F.col("c.removed_words").alias("n_removed_words"), F.sha2(F.coalesce("c.text", F.lit("")), 256).alias("clean_sha256"))
