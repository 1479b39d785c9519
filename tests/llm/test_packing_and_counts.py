import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spliceflow.llm import packing, token_counts
from spliceflow.llm.tokens import encoder

DOCS = "doc_id long, text string, length int, rank int, bucket string"


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_the_tokenizer_file(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(encoder().ids(text), dtype="<u4").tolist() == tokenizer().encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40), st.integers(1, 12))
def test_plan_places_every_piece_once_without_gaps(histogram, groups):
    rows = packing.plan(histogram, 64, groups)
    filled = {}
    for length, first, n, sequence, offset in rows.tolist():
        for i in range(n):
            filled.setdefault(sequence + i, []).append((offset, length))
    for slots in filled.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(filled) == list(range(len(filled)))
    for length, n in histogram.items():
        own = sorted((f, k) for ln, f, k, _, _ in rows.tolist() if ln == length)
        assert [f for f, _ in own] == np.cumsum([0, *(k for _, k in own)])[:-1].tolist() and sum(k for _, k in own) == n
    total = sum(k * v for k, v in histogram.items())
    assert len(filled) >= -(-total // 64)


def test_plan_is_near_the_least_number_of_sequences():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6.5, 1, 50_000).astype(int) + 1, 2048)
    rows = packing.plan({int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)})
    assert (rows[:, 2] + rows[:, 3]).max() <= 1.005 * lengths.sum() / 2048 + 1


def test_packing_round_trip(spark):
    docs = [(1, "a b c", 1, 2, "x"), (2, None, 1, 2, "x"), (3, "", 1, 2, "x"), (4, "word " * 5000, 1, 2, "x"), (4, "word " * 5000, 1, 2, "x"), (None, "the end", None, None, None)]
    rows = packing.pack_documents(spark.createDataFrame(docs, DOCS)).collect()
    tok, want = tokenizer(), []
    for doc_id, text, *_ in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 2048 or 2048
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in places.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.sequences(packing.pack_documents(spark.createDataFrame(docs, DOCS))).count() == len(places)


def test_special_tokens_are_those_of_the_tokenizer_file():
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  \n y", "<|endoftext| >"):
        assert np.frombuffer(encoder().ids(text), dtype="<u4").tolist() == tokenizer().encode(text, add_special_tokens=False).ids


def test_every_place_of_the_registered_query(spark):
    """All pieces of all documents of sf0.01, and all sequences: no gap, no overlap, none over the capacity, near the lower bound."""
    import duckdb

    from spliceflow.llm import queries

    sf_dir = "/root/testdata/sf0.01"
    tok, want = tokenizer(), []
    texts = duckdb.connect().execute(f"SELECT doc_id, coalesce(text, '') FROM '{sf_dir}/documents.parquet'").fetchall()
    for (doc_id, _), made in zip(texts, tok.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True):
        ids = [*made.ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows = queries.op2(spark, sf_dir).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in rows) // 2048) + 3


def test_packing_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).collect() == []


def brute_counts(text, parts, rule):
    import public_tokenizers
    from tokenizers import Tokenizer

    counts = {k: 0 for k in range(len(parts))}
    for a, b in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).offsets:
        owner = [next((k for k, (s, e) in enumerate(parts) if s <= i < e), -1) for i in range(a, b)]
        if rule == "start":
            k = owner[0]
        elif rule == "end":
            k = owner[-1]
        else:
            k = max(dict.fromkeys(owner), key=lambda o: owner.count(o))
        counts[k] = counts.get(k, 0) + 1
    return {k: n for k, n in counts.items() if k >= 0 or n}


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_follow_the_offsets(spark, rule):
    texts = ["One line.\nTwo  lines\n\n\nthree", "été à Noël 😀😀\nñandú", "x" * 3000, "\n\n", "a b"]
    docs = spark.createDataFrame([(k, t, 0, 0, "") for k, t in enumerate(texts)] + [(9, None, 0, 0, ""), (8, "", 0, 0, "")], DOCS)
    got = {}
    for r in token_counts.token_counts(docs, rule=rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = r.n_tokens
    assert got == {k: brute_counts(t, token_counts.paragraphs(t), rule) for k, t in enumerate(texts)}


def test_token_counts_of_given_sections(spark):
    text, parts = "The quick brown fox jumped", [(2, 6), (6, 6), (10, 17)]
    docs = spark.createDataFrame([(1, text, parts), (2, text, None)], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    got = {(r.doc_id, r.section): r.n_tokens for r in token_counts.token_counts(docs, sections_col="parts").collect()}
    assert {k: n for (d, k), n in got.items() if d == 1} == brute_counts(text, parts, "most")
    assert got[2, -1] == len(tokenizer().encode(text).ids)
    with pytest.raises(ValueError):
        token_counts.token_counts(docs, rule="none")


def test_equal_rows_take_ranks_in_chunks(spark, monkeypatch):
    """Equal rows, without an id or with one, are counted and dealt out again in runs."""
    monkeypatch.setattr(packing, "RANKS", 7)
    rows = [(None, "")] * 60 + [(5, "a b c")] * 33 + [(k, "word " * (k % 40)) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed = packing.pack_documents(docs, capacity=16).collect()
    assert sum(r.length for r in packed if r.doc_id is None) == 60 and sum(r.doc_id == 5 and r.length == 4 for r in packed) >= 33
    filled = {}
    for r in packed:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in filled.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 16
