import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from spliceflow.llm import common, embedding_dedup, simhash_dedup, substring_dedup

DOCS = "doc_id long, text string, fp string, root string, component_id int"


def reach(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(4900, 5100)]
    nodes = {x for pair in links if pair[0] != pair[1] for x in pair}
    got = {r.node: r.root for r in common.components(spark.createDataFrame([*links, (7, None)], "u long, v long")).collect()}
    assert got == reach(nodes, [p for p in links if p[0] != p[1]])
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    h = [xxhash.xxh64_intdigest(b" ".join(s), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("large", [256, 0])
def test_simhash_groups(spark, monkeypatch, large):
    """large = 0 sends every bucket the way of very full ones."""
    monkeypatch.setattr(simhash_dedup, "LARGE_BUCKET", large)
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(200)) for _ in range(12)]
    texts = [None, "", "One two", " \t\n", *base]
    for text in base[:6]:
        for _ in range(12):
            words = text.split()
            words[rng.randrange(200)] = rng.choice(["XX", "yy"])
            texts.append(" ".join(words))
    rows = [(k + 10, t, "c", "c", 1) for k, t in enumerate(texts)] + [(10, "One two", "", "", 0), (None, base[0], "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    prints = [brute_print(r[1]) for r in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    roots = reach(range(len(rows)), links)
    least = {r: min((rows[i][0] for i in roots if roots[i] == r and rows[i][0] is not None), default=None) for r in set(roots.values())}
    want = sorted((str(rows[i][0]), prints[i], least[roots[i]]) for i in range(len(rows)))
    got = sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash_dedup.simhash_groups(docs).collect())
    assert got == want
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in want}
    assert simhash_dedup.simhash_groups(docs.limit(0)).count() == 0


def test_two_rings_hold_every_pair_within_two_bits(spark):
    """A fingerprint and all that differ from it in one or two bits have four equal segments in common."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for _ in range(3):
        base = rng.getrandbits(64)
        flips = [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i, j in itertools.combinations(range(64), 2)]
        rows += [(signed(base), signed(base ^ x)) for x in flips]
    keys = lambda c: F.array(*simhash_dedup._chain_keys(F.col(c)))
    pairs = spark.createDataFrame(rows, "a long, b long").select(F.arrays_overlap(keys("a"), keys("b")).alias("met"))
    assert pairs.count() == 3 * 2080 and pairs.where("not met").count() == 0


def test_embedding_groups(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16))
    vectors = np.concatenate([centers, *(centers[:10] + rng.normal(size=(10, 16)) * s for s in (0.05, 0.2, 0.27, 0.3, 0.4))]).astype(np.float32)
    rows = [(int(k), [float(x) for x in v], int(k) % 2, 5, "x") for k, v in enumerate(vectors)]
    rows += [(200, rows[3][1], 1, 5, "x"), (201, rows[3][1], 1, 5, "x"), (202, rows[3][1], 0, 5, "x"), (203, rows[3][1], None, 5, "x"), (3, rows[3][1], 1, 5, "x")]
    rows += [(300, None, 1, 5, "x"), (301, [], 1, 5, "x"), (302, [0.0] * 16, 1, 5, "x"), (303, [float("nan")] * 16, 1, 5, "x"), (304, [None] * 16, 1, 5, "x"), (305, [float("inf")] * 16, 1, 5, "x"), (306, [1.0, 2.0], 1, 5, "x"), (307, [2.0, 4.0], 1, 5, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key int, rep string")
    links = []
    for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2):
        if a[2] is None or a[2] != b[2] or not a[1] or not b[1] or len(a[1]) != len(b[1]) or None in a[1] + b[1] or not np.isfinite(a[1] + b[1]).all():
            continue
        x, y = np.array(a[1]), np.array(b[1])
        n = np.linalg.norm(x) * np.linalg.norm(y)
        if n and x @ y / n >= 0.93:
            links.append((i, j))
    roots = reach(range(len(rows)), links)
    least = {r: min(rows[i][0] for i in roots if roots[i] == r) for r in set(roots.values())}
    want = sorted((rows[i][0], sum(i in p for p in links), least[roots[i]], rows[i][0] == least[roots[i]]) for i in range(len(rows)))
    for block_bytes, tile in ((8 << 20, 1024), (1 << 10, 3)):
        monkeypatch.setattr(embedding_dedup, "TILE", tile)
        assert sorted(map(tuple, embedding_dedup.embedding_groups(table, block_bytes=block_bytes).collect())) == want
    assert len(links) > 40
    assert embedding_dedup.embedding_groups(table.limit(0)).count() == 0


def test_embedding_groups_of_any_size(spark):
    """Components from the smallest to the largest numbers; a cosine just below and just above the threshold; other lengths."""
    turn = lambda c: [c, math.sqrt(1 - c * c)]
    rows = [(1, [1e200, 0.0], 0), (2, [2e200, 0.0], 0), (3, [1e-200, 0.0], 0), (4, [5e-324, 0.0], 0), (5, [1.7e308, 1e300], 0), (6, [0.0, 1.0], 0), (7, [-1e200, 0.0], 0)]
    rows += [(10, [1.0, 0.0], 1), (11, turn(0.93 + 1e-9), 1), (12, turn(0.93 - 1e-9)[:1] + [-turn(0.93 - 1e-9)[1]], 1), (13, [3.0], 1), (14, [5.0], 1), (15, [-5.0], 1), (16, [1.0] * 40, 1), (17, [1.1] * 39 + [1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (4, 1), 6: (0, 6), 7: (0, 7), 10: (1, 10), 11: (1, 10), 12: (0, 12), 13: (1, 13), 14: (1, 13), 15: (0, 15), 16: (1, 16), 17: (1, 16)}


def test_early_stops_lose_no_link():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 48)) * np.linspace(3, 0.2, 48)
    x = np.concatenate([x, x[:300] + rng.normal(size=(300, 48)) * 0.4])
    _, axes = np.linalg.eigh(x.T @ x)
    for share in (0.0, 0.05, 1.1):
        embedding_dedup.SPARSE = share
        p, q = embedding_dedup._Turned(x[:700], axes[:, ::-1]), embedding_dedup._Turned(x[700:], axes[:, ::-1])
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        want = {tuple(r) for r in np.argwhere(unit[:700] @ unit[700:].T >= 0.9).tolist()}
        assert want and set(zip(*(k.tolist() for k in embedding_dedup._links(p, q, 0.9)), strict=True)) == want
        own = {(i, j) for i, j in np.argwhere(unit[:700] @ unit[:700].T >= 0.9).tolist() if i < j}
        assert {(min(i, j), max(i, j)) for i, j in zip(*(k.tolist() for k in embedding_dedup._links(p, p, 0.9)), strict=True)} == own
    embedding_dedup.SPARSE = 0.05


def plain_sentences(text):
    """(start, end, words) in bytes, by the docstring's rule and word by word."""
    raw = (text or "").encode()
    found = [(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", raw)]
    whole, now = [], []
    for k, (_, end, word) in enumerate(found):
        now.append(k)
        core = word
        for _ in range(2):
            if len(core) > 1 and core[-1:] in b"\"')]":
                core = core[:-1]
        after = raw[end : found[k + 1][0]] if k + 1 < len(found) else b"\n"
        if core[-1:] in b".!?" or core.decode("utf-8", "replace")[-1:] in "。！？" or b"\n" in after or b"\r" in after:
            whole.append(now)
            now = []
    out = []
    for own in whole:
        h = [xxhash.xxh32_intdigest(found[k][2]) for k in own]
        cuts = {0, len(own)}
        if len(own) > 12:
            cuts |= {i for i in range(2, len(own) - 2) if h[i] < min(h[i - 2 : i]) and h[i] <= min(h[i + 1 : i + 3])}
        at = sorted(cuts)
        at = sorted(cuts | {x for a, b in itertools.pairwise(at) for x in range(a, b, 20)})
        out += [[found[own[i]] for i in range(a, b)] for a, b in itertools.pairwise(at)]
    starts = [piece[0][0] for piece in out] + [len(raw)]
    return [(a, b, [w for *_, w in piece]) for a, b, piece in zip(starts, starts[1:], out, strict=False)]


def plain_runs(text):
    """(words of the run, first sentence, number of sentences)."""
    cuts, out = [w for *_, w in plain_sentences(text)], []
    for i in range(len(cuts)):
        for j in range(i + 2, len(cuts) + 1):
            n = sum(map(len, cuts[i:j]))
            if (j - i >= 3 and n >= 16) or n >= 20:
                out.append((b" ".join(itertools.chain(*cuts[i:j])), i, j - i))
                break
    return out


def plain_repeats(rows):
    """Row number -> sentences to remove; the first occurrence by id (null last) and place stays."""
    first, gone = {}, {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        for run, at, n in plain_runs(rows[k][1]):
            if first.setdefault(run, (k, at)) != (k, at):
                gone.setdefault(k, set()).update(range(at, at + n))
    return gone


def plain_removal(text, gone):
    cuts, raw = plain_sentences(text), text.encode()
    return (raw[: cuts[0][0]] + b"".join(raw[a:b] for k, (a, b, _) in enumerate(cuts) if k not in gone)).decode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb.", "Cc", "d!", "(ee.)", "\"f?\"", "é", "雨。", "\n", "\r\n", "  ", "\u00a0x", "gg", "hh", "ii", "jj", "kk", "ll", "mm", "nn", ".", "\t"]), max_size=120), st.integers(1, 5))
def test_sentences_and_runs_follow_the_rule(parts, copies):
    text = " ".join(parts)
    texts = ["lead " * copies, text, "", text + " tail"]
    cuts = substring_dedup.sentences([t.encode() for t in texts])
    for k, t in enumerate(texts):
        starts, words = cuts.of(k)
        assert [(a, n) for a, n in zip(starts.tolist(), words.tolist(), strict=True)] == [(a, len(w)) for a, _, w in plain_sentences(t)]
    doc, digest, first, n = substring_dedup.runs([t.encode() for t in texts])
    want = [(k, xxhash.xxh3_128_digest(r), i, m) for k, t in enumerate(texts) for r, i, m in plain_runs(t)]
    assert list(zip(doc.tolist(), (d.tobytes() for d in digest), first.tolist(), n.tolist(), strict=True)) == want


@pytest.mark.parametrize("chunk", [32 << 20, 500])
def test_substring_dedup(spark, monkeypatch, chunk):
    """A small chunk sends almost all runs to the global comparison."""
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(5000)]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randrange(3, 14))).capitalize() + ". "
    shared = ["".join(sentence() for _ in range(9)) for _ in range(3)] + [" ".join(rng.choices(words, k=60)) + "\n"]
    rows = []
    for k in range(40):
        text = "".join(sentence() for _ in range(6)) + (shared[k % 5] if k % 5 < 4 else "") + "".join(sentence() for _ in range(4))
        rows.append((k, text, "f", "r", 1))
    rows += [(50, rows[0][1], "", "", 1), (51, rows[0][1] + rows[0][1], "", "", 1), (52, None, "", "", 1), (53, "", "", "", 1), (54, "Short one.", "", "", 1), (55, "Short one.", "", "", 1), (56, " \n ", "", "", 1), (57, "x " * 30_000 + rows[0][1], "", "", 1)]
    rows = [(*r, "c", "c") for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string, root string, n int, __spans string, high string")
    gone = plain_repeats(rows)
    out = substring_dedup.remove_repeats(docs, length_col="n")
    assert out.columns == docs.columns
    cleaned = {r.doc_id: r.text for r in out.collect()}
    for k, (doc_id, text, *_) in enumerate(rows):
        assert cleaned[doc_id] == (plain_removal(text, gone[k]) if k in gone else text)
    assert cleaned[50] == "" and cleaned[54] == cleaned[55] == "Short one."
    for k in range(5, 40):
        if k % 5 < 4:
            assert len(set(shared[k % 5].split()) & set(cleaned[k].split())) < 16
    report = {r.doc_id: r for r in substring_dedup.repeats_report(docs).collect()}
    for k, (doc_id, text, *_) in enumerate(rows):
        cuts, r = plain_sentences(text), report[doc_id]
        assert (r.n_sentences, r.n_words, r.n_removed, r.n_removed_words) == (len(cuts), sum(len(w) for *_, w in cuts), len(gone.get(k, ())), sum(len(cuts[i][2]) for i in gone.get(k, ())))
        assert r.clean_sha256 == hashlib.sha256((cleaned[doc_id] or "").encode()).hexdigest()
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == substring_dedup.repeats_report(docs.limit(0)).count() == 0
    odd = [(None, rows[0][1], "", "", 1), (7, rows[0][1], "", "", 1), (7, rows[0][1], "", "", 1), (7, "Other text.", "", "", 1), (None, None, "", "", 1), (None, "Mine.", "", "", 1)]
    assert [r.text for r in substring_dedup.remove_repeats(spark.createDataFrame(odd, DOCS)).orderBy("doc_id", "text").collect()] == [None, "", "Mine.", "Other text.", rows[0][1], rows[0][1]]


def test_registered_repeats_against_plain_reading(spark):
    """All documents of sf0.001, each sentence of each text."""
    import duckdb

    from spliceflow.llm import queries

    rows = duckdb.connect().execute("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    gone = plain_repeats(rows)
    want = {doc_id: hashlib.sha256((plain_removal(text, gone[k]) if k in gone else text or "").encode()).hexdigest() for k, (doc_id, text) in enumerate(rows)}
    assert gone and {r.doc_id: r.clean_sha256 for r in queries.op9(spark, "/root/testdata/sf0.001").collect()} == want


@pytest.mark.parametrize("n_words", [51, 55, 59, 60, 80, 200])
def test_passages_without_stops_at_any_place(spark, n_words):
    """Over 50 words without a stop, begun in the middle of a sentence, at other places of the two documents."""
    rng = random.Random(n_words)
    some = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    rows, passages = [], []
    for k in range(40):
        passages.append(some(n_words))
        rows += [(2 * k + i, f"{some(rng.randrange(1, 60))} {passages[k]} {some(rng.randrange(1, 60))}", "", "", 1) for i in range(2)]
    cleaned = {r.doc_id: r.text for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    left = [len(set(passages[k].split()) & set(cleaned[2 * k + 1].split())) for k in range(40)]
    assert max(left) < n_words - 15 and sum(left) / 40 < 12
    for k in range(40):
        assert cleaned[2 * k] == rows[2 * k][1]
        assert set(rows[2 * k + 1][1].split()) - set(passages[k].split()) <= set(cleaned[2 * k + 1].split())


def test_a_changed_word_keeps_the_rest_aligned():
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    of = lambda w: {d.tobytes() for d in substring_dedup.runs([" ".join(w).encode()])[1]}
    for changed in (words[:40] + words[41:], [*words[:40], "new", *words[40:]]):
        assert len(of(words) & of(changed)) > 0.8 * len(of(words))


def test_keep_one_decides_by_row(spark):
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(5))
    rows = [(3, a), (7, a), (7, b), (None, a), (None, c), (None, d), (None, d), (9, e), (9, e), (None, None)]
    kept = simhash_dedup.keep_one(spark.createDataFrame([(i, t, "", "", 1) for i, t in rows], DOCS))
    want = [(3, a), (7, b), (None, c), (None, d), (9, e), (None, None)]
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, want))


def test_tables_of_fingerprints_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, f"some words of text number {i}", "", "", 1) for i in range(20)], DOCS)
    out = simhash_dedup.simhash_groups(docs)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 20


def test_keys_of_fingerprints_are_not_broadcast(spark):
    prints = simhash_dedup.cut(spark.createDataFrame([(i * 7919,) for i in range(50)], "fp long"))
    links = simhash_dedup._near(prints)
    assert "BroadcastHashJoin" not in links._jdf.queryExecution().executedPlan().toString()
    assert {(r.u, r.v) for r in links.collect()} == {(a * 7919, b * 7919) for a in range(50) for b in range(50) if a < b and (a * 7919 ^ b * 7919).bit_count() <= 2}
