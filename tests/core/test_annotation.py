"""The stored index of intervals against all pairs, and its plan."""

import numpy as np

from spliceflow.sources import annotation


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_index_gives_all_overlaps_without_moving(spark, tmp_path):
    rng = np.random.default_rng(9)
    spans = [(k, int(rng.integers(0, 3)), int(s), int(s + rng.choice([5, 300, 2_000, 40_000, 700_000, 3_000_000]))) for k, s in enumerate(rng.integers(0, 5_000_000, 400))]
    asked = [(k, int(rng.integers(0, 4)), int(s), int(s + rng.choice([1, 50, 3_000, 900_000]))) for k, s in enumerate(rng.integers(0, 5_000_000, 80))]
    spans += [(900, 0, 1000, 2000), (901, 0, 2000, 3000)]
    asked += [(90, 0, 2000, 2001), (91, 0, 1999, 2000), (92, 0, 3000, 3001)]
    index = spark.createDataFrame(spans, "tx long, chrom int, s long, e long")
    annotation.write_index(index, "spans_index", ["chrom"], path=str(tmp_path / "index"), buckets=8)
    try:
        regions = spark.createDataFrame(asked, "region long, chrom int, rs long, re long")
        got = annotation.query_index(spark, "spans_index", regions, ["chrom"])
        want = sorted((r, t) for r, c, rs, re in asked for t, d, s, e in spans if c == d and s < re and rs < e)
        assert sorted((r.region, r.tx) for r in got.collect()) == want
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        moved = annotation.query_index(spark, "spans_index", regions, ["chrom"])
        assert plan(moved).count("Exchange") == 1  # that of the regions: the scan of the index has none
        assert plan(moved).index("Exchange") < plan(moved).index("FileScan parquet")
        assert sorted((r.region, r.tx) for r in moved.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE spans_index")
