"""Queries that once paired all that lies together: the same results as plain versions, and few rows on the way."""

from collections import Counter

import numpy as np
import pytest

from spliceflow.operators import boundaries, commands, crowded, evidence
from test_rounds import plain_boundary


def bases(rng, n):
    return "".join(rng.choice(list("ACGT"), n))


def plain_report(assembled, reference, k, least):
    other = str.maketrans("ACGT", "TGCA")
    cut = lambda s: {s[i : i + k] for i in range(len(s) - k + 1)}
    found = {n: cut(s) for n, s in assembled}
    wanted = {n: cut(s) | cut(s[::-1].translate(other)) for n, s in reference}
    f, w = set().union(*found.values()), set().union(*wanted.values())
    told = sum(any(len(x & y) >= max(1, least * len(x)) for y in found.values()) for x in wanted.values() if x)
    return len(f & w) / len(w), len(f & w) / len(f), 2 * len(f & w) / (len(f) + len(w)), told


@pytest.mark.parametrize("rare", [0, 16])
def test_assembly_report_pairs_only_what_can_reach_the_share(spark, monkeypatch, rare):
    rng = np.random.default_rng(rare)
    common, whole = bases(rng, 60), bases(rng, 600)
    # All have a stretch in common, which alone is too little for the long ones; some hold parts of one text around the share.
    assembled = [(k, bases(rng, 150) + common + whole[k * 5 : k * 5 + 20 + 8 * k]) for k in range(30)]
    reference = [(k, bases(rng, 300) + common + whole[: 40 + 12 * k]) for k in range(30)] + [(99, ""), (100, None)]
    kept, write = [], commands.written
    monkeypatch.setattr(commands, "RARE", rare)
    monkeypatch.setattr(commands, "written", lambda df: kept.append(write(df)) or kept[-1])
    got = commands.assembly_report(spark.createDataFrame(assembled, "name long, seq string"), spark.createDataFrame(reference, "name long, seq string"), 15, 0.1).first()
    want = plain_report(assembled, [(n, s or "") for n, s in reference], 15, 0.1)
    assert 0 < want[3] < 30
    assert (got.recall, got.precision, got.f1, got.recovered) == (*(pytest.approx(x) for x in want[:3]), want[3])
    pairs = next(t for t in kept if "contig" in t.columns)
    assert pairs.count() < 600


def test_terminal_boundaries_form_no_pairs(spark):
    rng = np.random.default_rng(3)
    places = np.concatenate([rng.integers(0, 2_000, 400), rng.integers(498_000, 503_000, 400), rng.integers(600_000, 1_700_000, 60)])
    blocks = [(int(c), int(s), int(s + rng.choice([3, 40, 300, 700_000], p=[0.3, 0.4, 0.295, 0.005]))) for c, s in zip(rng.integers(0, 2, len(places)), places, strict=True)]
    ends = [(k, int(rng.integers(0, 3)), int(p), side) for k, p in enumerate([*rng.integers(0, 13_000, 60), *rng.integers(488_000, 513_000, 60), *rng.integers(0, 1_800_000, 40), 500_000, 499_999, -5]) for side in ("left", "right")]
    out = boundaries.terminal_boundaries(spark.createDataFrame(ends, "anchor int, chrom int, pos long, side string"), spark.createDataFrame(blocks, "chrom int, s long, e long"))
    assert "__level" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.anchor, r.side): r.boundary for r in out.collect()}
    assert got == {(k, side): plain_boundary([(s, e) for b, s, e in blocks if b == c], p, side) for k, c, p, side in ends}


@pytest.mark.parametrize("crowd", [0, 200])
def test_intersections_are_counted_without_pairs(spark, monkeypatch, crowd):
    rng = np.random.default_rng(crowd)
    monkeypatch.setattr(crowded, "CROWD", crowd)

    def some(n):
        s = np.concatenate([rng.integers(0, 1_400, n), rng.integers(0, 60_000, n // 4)])
        return [(int(c), int(a), int(a + w)) for c, a, w in zip(rng.integers(0, 2, len(s)), s, rng.choice([1, 7, 90, 490, 510, 1_000, 1_500, 40_000], len(s)), strict=True)]

    left, right = some(150), some(200)
    out = crowded.intersection_counts(spark.createDataFrame(left, "chrom int, s long, e long"), spark.createDataFrame(right, "chrom int, rs long, re long"), ["chrom"])
    want = Counter((c, max(s, rs), min(e, re)) for c, s, e in left for rc, rs, re in right if c == rc and s < re and rs < e)
    assert {(r.chrom, r.s, r.e): r.n for r in out.collect()} == want
    assert out.count() == len(want)


@pytest.mark.parametrize("crowd", [0, 200])
def test_matches_by_overlap_without_pairs(spark, monkeypatch, crowd):
    rng = np.random.default_rng(crowd)
    monkeypatch.setattr(crowded, "CROWD", crowd)

    def some(n, widths):
        s = np.concatenate([rng.integers(-600, 900, n), rng.integers(0, 60_000, n // 4)])
        return [(k, int(c), int(a), int(a + w)) for k, (c, a, w) in enumerate(zip(rng.integers(0, 2, len(s)), s, rng.choice(widths, len(s)), strict=True))]

    left = [(*x, f"G{x[0] % 5}") for x in some(300, [1, 9, 60, 150, 499, 500, 501, 30_000])]
    right = [(*x, f"g{x[0] % 3}", None if x[0] % 7 == 0 else x[0] % 4) for x in some(300, [2, 9, 11, 40, 60, 70, 480, 600, 2_000])]
    joined, join = [], crowded.overlap_join
    monkeypatch.setattr(crowded, "overlap_join", lambda a, b, keys: joined.append((a, b)) or join(a, b, keys))
    out = evidence.matched(spark.createDataFrame(left, "id long, chrom int, s long, e long, gene string"), spark.createDataFrame(right, "rid long, chrom int, rs long, re long, rgene string, support int"), ["chrom"], "id", 20, 0.8)
    want = {}
    for i, c, s, e, g in left:
        near = [(abs(s - rs) + abs(e - re), g.lower() != h, u is None, -(u or 0), r) for r, d, rs, re, h, u in right if c == d and ((abs(s - rs) <= 20 and abs(e - re) <= 20) or (s < re and rs < e and min(e, re) - max(s, rs) >= 0.8 * min(e - s, re - rs)))]
        if near:
            want[i] = (min(near)[-1], min(near)[0])
    assert {r.id: (r.rid, r.distance) for r in out.collect()} == want
    assert len(joined) == 2  # only where one is long
