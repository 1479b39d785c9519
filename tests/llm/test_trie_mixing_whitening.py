import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from conftest import DATA

from spliceflow.llm import conversation_trie, mixing, queries, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONV = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, size string, part int, at long"


@pytest.fixture
def many_parts(spark):
    """Small tables lie in several parts too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def table_rows(rows):
    return sorted(str(tuple(r)) for r in rows)


def same_as_sql(got, duck, sql):
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert table_rows(got.select(names).collect()) == table_rows(want.fetchall())


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_source_mixing"])
def test_query_equals_sql(spark, duck, name):
    same_as_sql(queries.QUERIES[name](spark, DATA), duck, queries.SQL[name])


def plain_trie(rows):
    """The trie by listing every prefix of every rebuilt conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{role or ''}\n{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + ts[h:])
    members = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    children = {p: sum(len(q) == len(p) + 1 for q in below[p]) for p in members}
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below[p] if q)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], sum(not children[q] for q in below[p]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


ODD_TURNS = [
    (1, 0, "user", "a b"), (1, None, "system", "c"), (1, 1, None, None), (2, 0, "user", "a b"), (2, 0, "user", "a b"), (2, 0, "user", "z"),
    (20, 0, "u", "x y z"), (20, 1, "u", "w"), (21, 0, "q", "own"), (21, 1, "u", "w"), (21, 2, "v", ""), (22, 0, "u", "x y z"), (39, 5, "u", "w"),
    (-7, 1, "u", "w"), (-7, 2, "", None), (47, 0, "u", "only"), (48, 0, "u", "only"), (49, 0, "u", "only"), (None, 0, "u", "lost"), (60, 3, "u", "x y あ"),
]


def test_trie_of_odd_rows_equals_listing(spark):
    rows = [(*r, "extra", 1) for r in ODD_TURNS]
    got = conversation_trie.trie(spark.createDataFrame(rows, CONV + ", node string, depth int"))
    assert table_rows(got.collect()) == table_rows(plain_trie(ODD_TURNS))


def test_trie_with_a_conversation_in_several_parts(spark, many_parts):
    rows = [(20, k // 3, "user", f"turn {k % 50} " * (k % 4)) for k in range(3000)] + [(c, k, "user", f"own {c} {k}") for c in range(21, 31) for k in range(5)]
    df = spark.createDataFrame(rows, CONV).repartition(5)
    lanes = [conversation_trie._Lane(0, k, conversation_trie.P) for k in range(4)]
    assert conversation_trie._products(conversation_trie.stored_turns(df), lanes)[1].where("conv_id = 20").count() > 1
    got = {(r.conv_id, r.depth): r for r in conversation_trie.trie(df).collect()}
    assert len([1 for c, _ in got if c == 20]) == 3001 and got[20, 0].n_convs == 11
    own = sorted((k // 3, hashlib.md5(f"user\n{text}".encode()).hexdigest(), text) for k in range(3000) for text in [f"turn {k % 50} " * (k % 4)])
    shared = {d: sum(zlib.crc32(str(c).encode()) % 4 >= d for c in range(21, 31)) for d in (1, 2, 3)}
    assert {d: got[20, d].n_convs - 1 for d in shared} == shared
    assert got[20, 0].saved_tokens == sum(n * len(own[d - 1][2].split()) for d, n in shared.items())


def test_trie_members_in_many_chunks(spark, many_parts):
    rows = [(c * 20, 0, "user", "same") for c in range(1300)]
    got = conversation_trie.trie(spark.createDataFrame(rows, CONV).repartition(7)).where("depth = 1").collect()
    assert [(r.conv_id, r.n_convs, r.saved_tokens) for r in got] == [(0, 1300, 1299)]
    assert got[0].ends_sha256 == hashlib.sha256(",".join(str(c * 20) for c in range(1300)).encode()).hexdigest()


def test_trie_draws_again_when_fingerprints_collide(spark, monkeypatch):
    """A modulus so small that different prefixes have equal fingerprints: those draws are refused."""
    rows = [(c, k, "user", f"{c} {k}") for c in range(12) for k in range(4)]
    stored = conversation_trie.stored_turns(spark.createDataFrame(rows, CONV))
    differ, draws = conversation_trie._differ, []
    lanes = [conversation_trie._Lane(0, k, 3) for k in range(4)]
    for lane in lanes[1:]:
        lane.hash = lanes[0].hash
        lane.base, lane.inverse = lanes[0].base, lanes[0].inverse
    turns, parts = conversation_trie._products(stored, lanes)
    ends = [f(c).alias(f"{how}_{c}") for c in ("pa", "pb", "va", "vb", "at") for how, f in (("low", conversation_trie.F.min), ("high", conversation_trie.F.max))]
    assert differ(conversation_trie._members(turns, parts, lanes).groupBy("depth", "fa", "fb").agg(conversation_trie.F.count("at").alias("n_convs"), *ends), stored, lanes)
    # And after a refused draw the next one gives the trie.
    monkeypatch.setattr(conversation_trie, "_differ", lambda *how: draws.append(differ(*how)) or len(draws) < 2 or draws[-1])
    got = conversation_trie.trie(spark.createDataFrame(rows, CONV))
    assert draws == [False, False]
    assert table_rows(got.collect()) == table_rows(plain_trie(rows))


def test_trie_compares_texts_of_equal_hashes(spark):
    """Hashes that agree though texts differ are found by the turns themselves."""
    lanes = [conversation_trie._Lane(0, k, conversation_trie.P) for k in range(4)]
    for lane in lanes:
        lane.hash = lambda: conversation_trie.F.length("text").cast("long")
    stored = conversation_trie.stored_turns(spark.createDataFrame([(20, 0, "u", "ab"), (40, 0, "u", "xy")], CONV))
    turns, parts = conversation_trie._products(stored, lanes)
    members = conversation_trie._members(turns, parts, lanes)
    ends = [f(c).alias(f"{how}_{c}") for c in ("pa", "pb", "va", "vb", "at") for how, f in (("low", conversation_trie.F.min), ("high", conversation_trie.F.max))]
    nodes = members.groupBy("depth", "fa", "fb").agg(conversation_trie.F.count("at").alias("n_convs"), *ends)
    assert nodes.where("depth = 1").count() == 1
    assert conversation_trie._differ(nodes, stored, lanes)


def test_empty_tables(spark):
    assert conversation_trie.trie(spark.createDataFrame([], CONV)).collect() == []
    assert mixing.mixed_documents(spark.createDataFrame([], DOCS)).collect() == []
    assert whitening.whitened(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def plain_targets(sizes, weights=(1, 2, 3), repeats=3):
    """Targets by handing excess on again and again, in exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed = {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        shares = {s: Fraction(left * w[s], sum(w[r] for r in rest)) for s in rest}
        over = [s for s in rest if shares[s] > repeats * sizes[s]]
        if not over:
            return {**fixed, **shares}
        fixed |= {s: Fraction(repeats * sizes[s]) for s in over}


def test_mix_of_odd_rows(spark, many_parts):
    rows = [(k, "w " * (k % 9), "en", ["b", "a", "é", "\U0001f600", None, "Z", "tiny"][k % 7], None, 0, 1) for k in range(400) if k % 7 != 6 or k < 10]
    rows += [(7, "w w", "en", "a", None, 0, 1)] * 3 + [(None, "w w w", None, "a", None, 0, 1), (None, None, None, None, None, 0, 1), (900, "x" * 200_000, "en", "b", None, 0, 1), (901, "y　z " * 60_000, "en", "Z", None, 0, 1), (902, None, None, "void", None, 0, 1)]
    placed = mixing.queues(spark.createDataFrame(rows, DOCS).repartition(6))
    got = mixing.mixed_documents(spark.createDataFrame(rows, DOCS)).collect()
    sizes = {}
    for _, text, _, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = plain_targets(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((r[0] is None, r[0] or 0, len(WORD.findall(r[1] or ""))) for r in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    taken = {r.source if not r.no_source else None: r for r in placed.select("source", "no_source", "target", "source_size").distinct().collect()}
    assert {s: r.source_size for s, r in taken.items()} == sizes
    assert all(abs(r.target - want[s]) <= 1e-9 * max(1, want[s]) for s, r in taken.items())
    mixed = mixing.mix(placed)
    given = {(None if r.no_source else r.source): r.n for r in mixed.groupBy("source", "no_source").agg(mixing.F.sum("taken").alias("n")).collect()}
    assert all(want[s] - 1 < given.get(s, 0) <= want[s] for s in sizes)
    assert table_rows(got) == table_rows(mixing.mixed_documents(spark.createDataFrame(rows, DOCS).repartition(3)).collect())


def test_mix_is_in_the_order_of_finish_times_and_ends_at_the_budget(spark):
    rows = [(k, "w " * (1 + k % 5), "en", "abc"[k % 3], None, 0, 0) for k in range(90)]
    mixed = mixing.mix(mixing.queues(spark.createDataFrame(rows, DOCS)))
    order = mixed.orderBy("nth").collect()
    assert [r.finish for r in order] == sorted(r.finish for r in order) and max(r.finish for r in order) <= 1
    short = mixing.truncated(mixed, 100).orderBy("nth").collect()
    assert sum(r.taken for r in short) == 100 and [r.begins for r in short] == [sum(r.taken for r in short[:k]) for k in range(len(short))]
    # Each prefix of the mix holds the sources by weight, to a document of each.
    for k in range(1, len(order) + 1):
        time = order[k - 1].finish
        for source, weight in zip("abc", (1, 2, 3), strict=True):
            held = sum(r.taken for r in order[:k] if r.source == source)
            assert abs(held - time * weight * sum(len(r[1].split()) for r in rows) / 6) <= 6


def plain_whitening(rows, components=16):
    usable = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in usable]
    fit = sorted({tuple(v) for _, v in x})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = lambda v: np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, total, strict=True)])
    a = np.array([centred(v) for v in fit])
    values, axes = np.linalg.eigh(a.T @ a / n)
    values, axes = values[::-1], axes[:, ::-1]
    return [(i, k + 1, n, sum((n * c - s) ** 2 for c, s in zip(v, total, strict=True)), float(centred(v) @ axes[:, k] / np.sqrt(values[k])), values[k] / values.sum()) for i, v in x for k in range(min(components, len(values)))]


def compare_whitening(got, want):
    got = sorted(got, key=lambda r: (r.component, r.deviation, str(r.vec_id)))
    want = sorted(want, key=lambda r: (r[1], r[3], str(r[0])))
    assert [(str(r.vec_id), r.component, r.n, r.deviation) for r in got] == [(str(r[0]), *r[1:4]) for r in want]
    for k in {r[1] for r in want}:
        a, b = (np.array([x for c, x in pairs if c == k]) for pairs in ([(r.component, r.whitened) for r in got], [(r[1], r[4]) for r in want]))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
    assert np.allclose([r.explained for r in got], [r[5] for r in want], rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_equals_plain_version(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    compare_whitening(queries.op13(spark, DATA).collect(), plain_whitening(rows))


def test_whitening_of_odd_rows(spark, many_parts):
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in rng.normal(size=3).astype(np.float32) * [1, 5, 30]], 0, "x") for k in range(50)]
    rows += [(100 + k, [0.5, 0.25, -0.125], None, "x") for k in range(70)] + [(None, [1.0, -1.0, 2.0], 1, "x"), (3, [9.0, 9.0, 9.0], 1, "x")]
    bad = [(200, None, 0, "x"), (201, [1.0, None, 2.0], 0, "x"), (202, [float("nan"), 0.0, 0.0], 0, "x"), (203, [float("inf"), 0.0, 0.0], 0, "x"), (204, [], 0, "x"), (205, [1.0, 2.0], 0, "x")]
    got = whitening.whitened(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, index int, x string").repartition(5)).collect()
    compare_whitening(got, plain_whitening([r[:2] for r in rows]))
    assert {r.component for r in got} == {1, 2, 3} and len(got) == 3 * len(rows)


def test_whitening_without_variance_and_with_huge_entries(spark):
    schema = "vec_id string, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])], schema)).collect() == []
    flat = whitening.whitened(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 3.0]), ("c", [1.0, 5.0])], schema)).collect()
    assert {(r.vec_id, r.component) for r in flat} == {("a", 1), ("b", 1), ("c", 1)}
    huge = whitening.whitened(spark.createDataFrame([("a", [1e300, 2.0]), ("b", [-1e300, 3.0]), ("c", [1.0, 5.0])], schema)).collect()
    assert len(huge) >= 3 and all(np.isfinite(r.whitened) for r in huge) and {r.deviation for r in huge if r.vec_id != "c"} == {None}


def test_sums_over_blocks_of_many_parts(spark):
    """More blocks than one part of a product sums: the split product is the whole scatter."""
    before = whitening.BLOCK_ROWS
    whitening.BLOCK_ROWS = 4
    try:
        rng = np.random.default_rng(5)
        rows = [(k, [float(c) for c in rng.normal(size=6).astype(np.float32)]) for k in range(300)]
        compare_whitening(whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect(), plain_whitening(rows))
    finally:
        whitening.BLOCK_ROWS = before
