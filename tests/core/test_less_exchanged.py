"""Operators that used to exchange or sort a copy of each row for every trial or configuration."""

import hashlib
import itertools

from pyspark.sql import functions as F

from spliceflow.operators import curves, gating


def test_nested_samples_sort_only_the_least_keys(spark, monkeypatch):
    kept, write = [], curves.written
    monkeypatch.setattr(curves, "written", lambda df: kept.append(write(df)) or kept[-1])
    rows = spark.range(4000).select("id", F.lit(0.5).alias("estimate"), F.lit(0.4).alias("truth"))
    got = {(r.trial, r.place): r.id for r in curves.nested_samples(rows, 3, 10).collect()}
    want = {(t, k + 1): i for t in range(3) for k, (_, i) in enumerate(sorted((hashlib.md5(f"{i}-{t}".encode()).hexdigest(), i) for i in range(4000))[:10])}
    assert got == want
    assert len(kept) == 1 and kept[0].count() < 3 * 400


def test_filter_grid_exchanges_a_transcript_once(spark):
    rows = [(g, f"c{i % 7}", i % 5 / 4, float(i * 3 % 40), i % 4, 1 + i % 3, 40 + i % 30) for g in ("a", "b") for i in range(40)]
    transcripts = spark.createDataFrame(rows, "gene string, chain string, score double, cov double, support int, n_exons int, length int")
    truth = {("a", "c1"), ("b", "c2"), ("b", "c9")}
    reference = spark.createDataFrame(sorted(truth), "gene string, chain string")
    scores, coverages, supports = [0.0, 0.3, 0.5, 0.9], [0.0, 1.0, 5.0, 12.0, 30.0], [0, 1, 2, 9]
    out = gating.filter_grid(transcripts, reference, ["gene"], scores, coverages, supports)
    want = {}
    for s, c, n in itertools.product(scores, coverages, supports):
        found = {(r[0], r[1]) for r in rows if (r[2] >= s or (r[3] >= max(20, 10 * c) and r[2] >= s / 2)) and r[3] >= c and (r[5] < 2 or r[4] >= n) and r[6] >= 50}
        want[s, c, n] = len(found), len(found & truth)
    assert len(want) == 80 and {(r.min_score, r.min_coverage, r.min_support): (r.found, r.hits) for r in out.collect()} == want
    assert "bit_or" in out._jdf.queryExecution().optimizedPlan().toString()
