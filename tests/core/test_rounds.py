"""Operators that go in rounds of joins, against their sequential rules and full listings."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from spliceflow.operators import anchors, boundaries, curves, flows, graph, kmers, longreads

EDGES = "locus long, a int, b int, weight double"


def random_loci(seed, loci=12, nodes=9):
    rng = np.random.default_rng(seed)
    return [(k, a, b, None if rng.random() < 0.1 else float(rng.integers(0, 7))) for k in range(loci) for a, b in itertools.combinations(range(1, nodes), 2) if rng.random() < 0.35]


def all_paths(edges):
    """Every path from a node without edges in to one without edges out."""
    out, heads = {}, {b for _, b, _ in edges}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    stack = [([n], []) for n in {a for a, _, _ in edges} - heads]
    while stack:
        path, ws = stack.pop()
        if path[-1] not in out:
            yield path, ws
        for b, w in out.get(path[-1], ()):
            stack.append((path + [b], ws + [w]))


def by_locus(rows, least=0.0, nulls=True):
    out = {}
    for k, a, b, w in rows:
        if (w is None and nulls) or (w is not None and w > least):
            out.setdefault(k, []).append((a, b, w))
    return out


def test_widest_paths_have_the_greatest_bottleneck(spark):
    rows = random_loci(1)
    got = {r.locus: r for r in flows.widest_paths(spark.createDataFrame(rows, EDGES)).collect()}
    want = by_locus(rows)
    assert set(got) == set(want)
    for k, edges in want.items():
        width = lambda ws: min((math.inf if w is None else w for w in ws), default=math.inf)
        paths = list(all_paths(edges))
        assert got[k].bottleneck == max(width(ws) for _, ws in paths)
        ws = next(ws for path, ws in paths if path == got[k].path)
        assert width(ws) == got[k].bottleneck and got[k].score == sum(w or 0 for w in ws)
        # The rule, node by node.
        best = {}
        for n in sorted({x for a, b, _ in edges for x in (a, b)}):
            ways = [(min(best[a][0], math.inf if w is None else w), best[a][1] + (w or 0), -a, best[a][3] + [n]) for a, b, w in edges if b == n]
            best[n] = max(ways) if ways else (math.inf, 0.0, 0, [n])
        tails = {a for a, _, _ in edges}
        assert got[k].path == max((best[n][0], best[n][1], -n, best[n][3]) for n in best if n not in tails)[3]


def test_longer_paths_than_rounds_of_a_job(spark):
    n = 3 * flows.ROUNDS + 1
    rows = [(1, k, k + 1, float(10 + k % 3)) for k in range(n)] + [(1, 0, n, 5.0), (2, 0, 1, 1.0)]
    got = {r.locus: r for r in flows.widest_paths(spark.createDataFrame(rows, EDGES)).collect()}
    assert got[1].path == list(range(n + 1)) and got[1].bottleneck == 10.0 and got[2].path == [0, 1]
    psi = {(r.locus, r.node): r.psi for r in flows.node_shares(spark.createDataFrame(rows, EDGES)).collect()}
    assert psi[1, 5] == pytest.approx(10 / 15) and psi[1, n] == pytest.approx(1) and psi[2, 0] == 1


def test_shares_are_sums_over_all_paths(spark):
    rows = random_loci(2)
    got = {(r.locus, r.node): r.psi for r in flows.node_shares(spark.createDataFrame(rows, EDGES)).collect()}
    want = Counter()
    for k, edges in by_locus(rows, nulls=False).items():
        out, heads = Counter(), {b for _, b, _ in edges}
        for a, _, w in edges:
            out[a] += w
        whole = sum(out[a] for a in set(out) - heads)
        for path, ws in all_paths(edges):
            p = out[path[0]] / whole * math.prod(w / out[a] for a, w in zip(path, ws, strict=False))
            for n in path:
                want[k, n] += p
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)


def test_partial_paths_are_completed_by_the_widest_ways(spark):
    rows, rng = random_loci(7), np.random.default_rng(7)
    graphs = by_locus(rows)
    asked = [(k, sorted(int(n) for n in rng.choice(range(1, 9), rng.integers(1, 4), replace=False))) for k in graphs for _ in range(6)]
    got = {(r.locus, tuple(r.path)): r for r in flows.completed(spark.createDataFrame(asked + asked[:3], "locus long, path array<int>"), spark.createDataFrame(rows, EDGES)).collect()}
    found = 0
    for k, path in {(k, tuple(p)) for k, p in asked}:
        edges = graphs[k]
        weight = {(a, b): math.inf if w is None else w for a, b, w in edges}
        heads, tails = {b for _, b, _ in edges}, {a for a, _, _ in edges}
        width = {(n, n): math.inf for n in heads | tails}
        for b in sorted(heads):
            for n in heads | tails:
                best = max((min(width[n, a], w) for (a, c), w in weight.items() if c == b and (n, a) in width), default=None)
                if best is not None and n != b:
                    width[n, b] = best
        into = max((width[s, path[0]] for s in tails - heads if (s, path[0]) in width), default=None)
        out = max((width[path[-1], t] for t in heads - tails if (path[-1], t) in width), default=None)
        between = [weight.get(p, width.get(p)) for p in itertools.pairwise(path)]
        if into is None or out is None or None in between:
            assert (k, path) not in got
            continue
        found += 1
        full = got[k, path].full
        assert got[k, path].bottleneck == min([into, out, *between]) == min((weight[p] for p in itertools.pairwise(full)), default=math.inf)
        assert full[0] not in heads and full[-1] not in tails and [n for n in full if n in path] == list(path)
    assert found > 10


def test_empty_graphs(spark):
    none = spark.createDataFrame([], EDGES)
    assert flows.widest_paths(none).collect() == flows.node_shares(none).collect() == graph.peeled(none).collect() == []


def test_fit_over_implicit_paths_is_as_near_as_over_all_paths():
    for seed in range(25):
        for edges in by_locus(random_loci(seed, loci=3), least=-1).values():
            es = [(a, b) for a, b, _ in edges]
            w = np.array([np.nan if x is None else x for *_, x in edges])
            if not np.isfinite(w).any():
                continue
            found, x = graph.fit_paths(es, w)
            known, at = np.isfinite(w), {e: k for k, e in enumerate(es)}
            full = np.array([[1.0 if e in zip(p, p[1:], strict=False) else 0.0 for p, _ in all_paths(edges)] for e in es])[known]
            best = graph.nnls(full, w[known])
            mine = np.zeros(len(es))
            for p, y in zip(found, x, strict=True):
                mine[p] += y
                assert [tuple(e) for e in zip(graph._nodes(es, p), graph._nodes(es, p)[1:], strict=False)] == [es[k] for k in p] and all(k in at.values() for k in p)
            assert (x > 0).all()
            assert np.linalg.norm(mine[known] - w[known]) <= np.linalg.norm(full @ best - w[known]) + 1e-6


def test_peeled_paths_take_their_width_off(spark):
    rows = [(1, 1, 2, 6.0), (1, 1, 3, 4.0), (1, 2, 4, 7.0), (1, 3, 4, 4.0), (1, 2, 3, None), (2, 1, 2, None)]
    got = graph.peeled(spark.createDataFrame(rows, EDGES)).orderBy("nth").collect()
    assert [(r.locus, r.path, r.weight) for r in got] == [(1, [1, 2, 4], 6.0), (1, [1, 3, 4], 4.0)]


def test_first_anchors_follow_the_sequential_rule(spark):
    rng = np.random.default_rng(4)
    holds = [(item, f"f{f}") for item in range(120) for f in rng.choice(40, rng.integers(1, 4), replace=False)]
    holds += [(200 + k, f"chain{k + d}") for k in range(25) for d in (0, 1)]
    features, want, held = {}, [], set()
    for item, f in holds:
        features.setdefault(item, set()).add(f)
    for item in sorted(features):
        if not features[item] & held:
            want.append(item)
            held |= features[item]
    got = anchors.first_anchors(spark.createDataFrame(holds, "item long, feature string"))
    assert sorted(r.item for r in got.collect()) == want


def test_span_anchors_follow_the_sequential_rule(spark):
    rng = np.random.default_rng(5)
    spans = [(g, int(s), int(s + rng.integers(1, 40))) for g in range(3) for s in rng.integers(0, 400, 60)] + [(9, 10 * k, 10 * k + 15) for k in range(50)] + [(8, 0, 5), (8, 5, 9), (8, 0, 5)]
    want = set()
    for g in {x[0] for x in spans}:
        end = None
        for s, e in sorted((s, e) for h, s, e in spans if h == g):
            if end is None or s >= end:
                want.add((g, s, e))
                end = e
    got = anchors.span_anchors(spark.createDataFrame(spans, "g int, s long, e long"), ["g"]).collect()
    assert {(r.g, r.s, r.e) for r in got} == want and len(got) == len(want)


def plain_boundary(blocks, pos, side, share=0.1, reach=10_000):
    """The rule on an array of bins."""
    otherwise = max(0, pos - 100) if side == "left" else pos + 100
    if not blocks:
        return otherwise
    first, last = min(s for s, _ in blocks), max(e for _, e in blocks)
    begin, end = (max(first, pos - reach), pos) if side == "left" else (pos, min(last, pos + reach))
    if end <= begin:
        return otherwise
    width = max(1, min(10, (end - begin) // 10))
    n = max(1, (end - begin) // width)
    depth = np.zeros(n, dtype=int)
    for s, e in blocks:
        s, e = max(s, begin), min(e, end)
        if s < e:
            depth[(s - begin) // width : min(n, (e - begin) // width + 1)] += 1
    if not depth.max():
        return otherwise
    if side == "left":
        least = max(1, int(depth[max(0, n - 1 - min(5, n)) :].max() * share))
        return next((begin + (b + 1) * width for b in range(n - 1, -1, -1) if depth[b] < least), begin)
    least = max(1, int(depth[: min(5, n) + 1].max() * share))
    return next((begin + b * width for b in range(n) if depth[b] < least), end)


def test_terminal_boundaries_equal_the_rule_on_bins(spark):
    rng = np.random.default_rng(6)
    blocks = [(c, int(s), int(s + rng.integers(1, 300))) for c in (0, 1) for s in np.concatenate([rng.integers(0, 3000, 80), rng.normal(9000, 200, 150).astype(int)])]
    ends = [(k, int(rng.integers(0, 3)), int(p), side) for k, p in enumerate([*rng.integers(0, 12000, 60), 0, 3, 25, 50_000]) for side in ("left", "right")]
    got = {(r.anchor, r.side): r.boundary for r in boundaries.terminal_boundaries(spark.createDataFrame(ends, "anchor int, chrom int, pos long, side string"), spark.createDataFrame(blocks, "chrom int, s long, e long")).collect()}
    assert got == {(k, side): plain_boundary([(s, e) for b, s, e in blocks if b == c], p, side) for k, c, p, side in ends}


def test_long_reads_take_the_longest_chain(spark):
    nodes = [(1, 1, 100, 200), (1, 2, 200, 260), (1, 3, 300, 400), (1, 4, 500, 520), (1, 5, 520, 600), (1, 6, 700, 800)]
    edges = [(1, 1, 2), (1, 2, 3), (1, 1, 3), (1, 3, 4), (1, 4, 5), (1, 3, 5), (1, 5, 6)]
    reads = {
        1: [(98, 263), (302, 401), (497, 604), (700, 799)],  # all nodes
        2: [(100, 200), (300, 400), (520, 600), (700, 800)],  # past the two optional ones
        3: [(300, 400), (520, 600)],  # neither end
        4: [(100, 200), (500, 520)],  # no such intron
        5: [(100, 200), (1000, 1100)],  # an exon without a node
        6: [(100, 190), (300, 340), (520, 600), (700, 800)],  # 40 of node 3's 100 bases
    }
    exons = [(1, r, k + 1, s, e) for r, xs in reads.items() for k, (s, e) in enumerate(xs)]
    frames = spark.createDataFrame(exons, "locus long, read long, exon int, s long, e long"), spark.createDataFrame(nodes, "locus long, node int, s long, e long"), spark.createDataFrame(edges, "locus long, a int, b int")
    for tolerance, more in ((5, {}), (0, {}), (60, {6: ([1, 3, 5, 6], True)})):
        got = {r.read: (r.path, r.complete) for r in longreads.longread_paths(*frames, tolerance).collect()}
        want = {r: brute_chain(xs, nodes, edges, tolerance) for r, xs in reads.items()}
        assert got == {r: w for r, w in want.items() if w}
        assert all(r in got for r in more)
    assert got[1][0] == [1, 2, 3, 4, 5, 6]
    guides = longreads.guide_paths(longreads.longread_paths(*frames, 5)).collect()
    assert {(tuple(g.path), g.reads) for g in guides} == {((1, 2, 3, 4, 5, 6), 1), ((1, 3, 5, 6), 1)}


def brute_chain(exons, nodes, edges, tolerance):
    def fits(x, n):
        (s, e), (_, _, ns, ne) = x, n
        return (ns >= s - tolerance and ne <= e + tolerance) or (ns < e + tolerance and ne > s - tolerance and 2 * (min(ne, e) - max(ns, s)) > ne - ns)

    out = {}
    for _, a, b in edges:
        out.setdefault(a, []).append(b)
    match = [{n[1] for n in nodes if fits(x, n)} for x in exons]
    done, stack = [], [([n], 0) for n in match[0]]
    while stack:
        path, x = stack.pop()
        if x == len(exons) - 1:
            done.append(path)
        for b in out.get(path[-1], ()):
            stack += [(path + [b], y) for y in (x, x + 1) if y < len(exons) and b in match[y]]
    if not done:
        return None
    best = min(done, key=lambda p: (-len(p), p))
    heads = {b for _, _, b in edges}
    return best, best[0] not in heads and best[-1] not in out


@pytest.mark.parametrize("k", [1, 5, 10, 11, 21, 31])
def test_kmers_of_any_length(spark, k, monkeypatch):
    monkeypatch.setattr(kmers, "CHUNK_BYTES", 500)
    rng = np.random.default_rng(k)
    seqs = ["".join(rng.choice(list("ACGTN"), n, p=[0.24, 0.24, 0.24, 0.24, 0.04])) for n in (0, 3, 40, 41, 200, 1700)] + ["A" * 900, "ACGT" * 60, None, "acgt", "é" + "ACGTTGCAAC" * 5]
    got = {r.kmer: r.n for r in kmers.counts(spark.createDataFrame([(s,) for s in seqs], "s string"), "s", k).collect()}
    assert got == Counter(s[i : i + k] for s in seqs if s for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT"))


def test_pieces_of_one_minimiser_hold_each_kmer_once():
    rng = np.random.default_rng(8)
    raw = "".join(rng.choice(list("ACGTN"), 3000, p=[0.245] * 4 + [0.02])).encode()
    pieces = kmers.stretches(raw, 21)
    assert Counter(p[i : i + 21] for _, p in pieces for i in range(len(p) - 20)) == Counter(raw[i : i + 21] for i in range(2980) if b"N" not in raw[i : i + 21])
    owner = {}
    for m, p in pieces:
        for i in range(len(p) - 20):
            assert owner.setdefault(p[i : i + 21], m) == m
    assert sum(len(p) for _, p in pieces) < 6 * len(raw)


def test_learning_curve_of_few_rows(spark):
    rows = [(k, k / 20 - 1, (k * 7 % 40) / 20 - 1) for k in range(40)]
    frame = spark.createDataFrame(rows, "id long, estimate double, truth double")
    got = curves.learning_curve(frame, trials=3, sizes=(5, 30, 60)).collect()
    assert len(got) == 6 and {(r["size"], r.n) for r in got} == {(5, 35), (30, 10)}
    assert all(r.q == 1.0 for r in got if r["size"] == 5) and all(0 <= r.coverage <= 1 for r in got)
    summary = {r["size"]: r for r in curves.curve_summary(frame.sparkSession.createDataFrame([(20, 0.5, 1.0, 0.1, None), (20, 0.7, 3.0, 0.3, 1.0)], "size int, coverage double, width double, reliable double, precision double")).collect()}
    assert summary[20].coverage == pytest.approx(0.6) and summary[20].width == 2.0 and summary[20].precision == 1.0
    assert curves.learning_curve(frame.limit(0), trials=2).collect() == []


def test_a_sweep_takes_a_key_row_by_row_across_batches(spark):
    from spliceflow.operators import tables

    rows = spark.range(30_000).selectExpr("id % 3 as locus", "id div 3 as a", "cast(if(id % 7 = 0, null, id) as double) as x")

    def fold(state, a, x):
        assert a == state.get("n", 0)
        state["n"], state["nulls"] = a + 1, state.get("nulls", 0) + (x is None)

    got = {r.locus: (r.n, r.nulls) for r in tables.swept(rows, ["locus"], ["a"], fold, lambda s: [(s["n"], s["nulls"])], "n bigint, nulls int").collect()}
    assert got == {k: (10_000, sum(i % 7 == 0 for i in range(k, 30_000, 3))) for k in range(3)}


def test_programmes_over_loci_exchange_edges_once_and_write_nothing(spark, monkeypatch):
    from spliceflow.operators import tables

    monkeypatch.setattr(tables, "written", lambda df: pytest.fail("written"))
    edges = spark.createDataFrame(random_loci(3), EDGES)
    paths = spark.createDataFrame([(k, [1, 5]) for k in range(12)], "locus long, path array<int>")
    for out, most in ((flows.widest_paths(edges), 1), (graph.peeled(edges), 1), (graph.locus_flow(edges), 1), (graph.decompose(edges), 1), (flows.completed(paths, edges), 4)):
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= most


def test_segments_and_supports_form_no_pairs(spark):
    rng = np.random.default_rng(5)
    junctions = sorted({(k, int(a), int(a + d)) for k in range(4) for a, d in zip(rng.integers(0, 400, 30), rng.integers(10, 200, 30), strict=True)})
    js = spark.createDataFrame([(*j, 2) for j in junctions], "locus long, js long, je long, count long")
    parts = graph.segments(spark.createDataFrame([(k, 0, 700) for k in range(4)], "locus long, s long, e long"), js)
    want = set()
    for k in range(4):
        own = [(a, b) for x, a, b in junctions if x == k]
        for s, e in itertools.pairwise(sorted({0, 700} | {p for j in own for p in j})):
            if s in {b for _, b in own} or e in {a for a, _ in own} or (e - s >= 20 and not any(a <= s and b >= e for a, b in own)):
                want.add((k, s, e))
    assert {tuple(r) for r in parts.collect()} == want
    exons = [(int(k), int(s), int(s + n), int(c)) for k, s, n, c in zip(rng.integers(0, 4, 300), rng.integers(0, 600, 300), rng.integers(0, 90, 300), rng.integers(1, 5, 300), strict=True)]
    found = graph.supported(graph.graph(parts, js)[1], parts, spark.createDataFrame(exons, "locus long, s long, e long, count long"))
    at = {(k, n): e for k in range(4) for n, (_, _, e) in enumerate(sorted(x for x in want if x[0] == k), 1)}
    met = found.where("kind = 'continuation'").collect()
    assert len(met) > 20 and all(r.weight == sum(c for k, s, e, c in exons if k == r.locus and s < at[k, r.a] < e) for r in met)
    assert "rs#" not in found._jdf.queryExecution().optimizedPlan().toString()
