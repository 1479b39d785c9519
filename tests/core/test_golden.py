"""Hand-computed cases of formulas, readers, draws and graph searches."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spliceflow.functions import calibration as C
from spliceflow.functions import parsing as P
from spliceflow.functions import reads as R
from spliceflow.functions import special
from spliceflow.operators import conformal, events, graph, intervals, metrics, posterior, transcripts
from spliceflow.sources import callers, genomics
from spliceflow.streaming.calibrate import calibrated, tiers_by_window


def test_two_group_examples(spark):
    cases = [("UP", 270, 30, 90, 210, 0.0008, 0.5980, 0.03159, 0.2484, 0.9477, "high-confidence"), ("DOWN", 40, 160, 180, 20, 0.0011, -0.6965, 0.03535, -1.0, -0.3455, "high-confidence"), ("SAME", 150, 150, 150, 150, 0.82, 0.0, 0.04069, -0.3532, 0.3532, "not-significant"), ("LOW", 14, 6, 7, 13, 0.04, 0.3333, 0.14195, -0.1065, 0.7732, "caller-significant-only")]
    made = spark.createDataFrame([c[:6] for c in cases], "id string, a long, b long, c long, d long, fdr double")
    ev = made.select("id", (C.beta_mean(F.col("a"), F.col("b")) - C.beta_mean(F.col("c"), F.col("d"))).alias("dpsi"), C.beta_dpsi_std(*map(F.col, "abcd")).alias("sampling_std"), F.expr("cast(a + b + c + d as double)").alias("total_support"), "fdr", F.lit(None).cast("double").alias("pvalue"))
    got = {r.id: r for r in calibrated(ev).collect()}
    for name, *_, dpsi, sd, low, high, tier in cases:
        r = got[name]
        assert [round(x, 4) for x in (r.dpsi, r.ci_low, r.ci_high)] == [dpsi, low, high] and round(r.sampling_std, 5) == sd and r.tier == tier


def test_tier_table(spark):
    table = {(True, True, None): "high-confidence", (False, True, None): "not-reliable", (False, False, None): "not-reliable", (True, False, None): "not-significant", (True, True, True): "high-confidence", (True, True, False): "supported", (False, True, True): "caller-significant-only", (True, False, True): "caller-significant-only", (False, False, True): "caller-significant-only", (True, False, False): "not-significant", (False, True, False): "not-significant", (False, False, False): "not-significant"}
    rows = spark.createDataFrame(list(table), "r boolean, e boolean, s boolean")
    assert {tuple(x)[:3]: x.t for x in rows.withColumn("t", C.tier(F.col("r"), F.col("e"), F.col("s"))).collect()} == table


def test_bins_and_non_finite_intervals(spark):
    rows = spark.createDataFrame([(19.5,), (20.0,), (249.9,), (250.0,), (None,), (float("nan"),), (-3.0,)], "s double")
    assert [r.b for r in rows.select(C.support_bin(F.col("s")).alias("b")).collect()] == ["<20", "20-49", "100-249", "250+", "<20", "<20", "<20"]
    odd = spark.createDataFrame([(None, 0.1), (0.5, float("nan")), (float("inf"), 0.1), (float("-inf"), 0.1), (0.5, None), (0.5, float("inf")), (float("nan"), 0.1)], "p double, s double")
    assert {tuple(r.i) for r in odd.select(C.plain_interval(F.col("p"), F.col("s"), F.lit(1.0)).alias("i")).collect()} == {(0.0, 1.0)}


def test_count_vectors(spark):
    cases = {"10,12": [10, 12], "10,12,": [10, 12], '"3", 4,NA': [3, 4], "": [], None: [], "NA": [], "1,,2": None, "1,NA,2": None, "-1": None, "x": None, "1.5": None}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", P.count_vector(F.col("v")).alias("c"))
    assert {r.v: r.c for r in rows.collect()} == cases


def test_conformal_quantile_is_the_order_statistic(spark):
    rng = np.random.default_rng(0)
    for n in (1, 18, 19, 20, 57):
        x = np.round(rng.random(n), 1)
        got = conformal.quantiles(spark.createDataFrame([(float(v),) for v in x], "score double"), []).first()
        rank = math.ceil(round((n + 1) * 0.95, 9))
        assert (got.n, got.q) == (n, None if rank > n else float(np.sort(x)[rank - 1]))


def test_special_functions():
    assert special.beta_ppf(0.975, 1 + 10, 1 + 10) == pytest.approx(0.7021939, abs=1e-6)
    assert special.beta_cdf(0.3, 2, 3) == pytest.approx(0.3483, abs=1e-9)
    assert special.t_ppf(0.975, 10) == pytest.approx(2.2281388520, abs=1e-8)
    assert special.normal_cdf(1.959963984540054) == pytest.approx(0.975, abs=1e-12)
    for k, n in ((0, 63), (1, 49), (5, 10), (3, 7)):
        tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n
        assert special.binomial_two_sided(k, n) == pytest.approx(min(1.0, 2 * tail), rel=1e-9)


def test_draws_have_the_posterior_moments(spark):
    rows = spark.createDataFrame([("a", [30, 40], [10, 20], [5, 9], [25, 31], 1.0), ("b", [30], [10], [0, 5], [0, 25], 2.0)], "event_id string, inc1 array<int>, exc1 array<int>, inc2 array<int>, exc2 array<int>, ratio double")
    got = {r.event_id: r for r in posterior.dpsi_posterior(rows, draws=20_000).collect()}
    again = {r.event_id: r for r in posterior.dpsi_posterior(rows.repartition(3), draws=20_000).collect()}
    assert got == again and got["a"].model == "rep" and got["b"].model == "sum"
    assert got["b"].psi1 == pytest.approx(30.5 / 51, abs=0.003) and got["b"].psi2 == pytest.approx(5.5 / 56, abs=0.003)
    assert got["a"].psi1 == pytest.approx((30.5 / 41 + 40.5 / 61) / 2, abs=0.003)
    with pytest.raises(Exception, match="fewer than two"):
        posterior.dpsi_posterior(rows, model="rep").collect()


def brute_paths(edges, sources, sinks):
    out = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    found, stack = [], [((s,), np.inf) for s in sources]
    while stack:
        p, w = stack.pop()
        if p[-1] in sinks:
            found.append((p, w))
        stack += [((*p, b), min(w, v)) for b, v in out.get(p[-1], ())]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def test_paths_are_the_best_ones():
    rng = np.random.default_rng(5)
    for _ in range(40):
        edges = [(a, b, float(rng.integers(1, 9))) for a, b in itertools.combinations(range(8), 2) if rng.random() < 0.4]
        if not edges:
            continue
        heads, tails = {b for _, b, _ in edges}, {a for a, _, _ in edges}
        want = brute_paths(edges, sorted(tails - heads), heads - tails)
        got = graph.best_paths(edges, sorted(tails - heads), heads - tails, 500)
        assert got == want
        assert [w for _, w in graph.best_paths(edges, sorted(tails - heads), heads - tails, 3)] == [w for _, w in want[:3]]


def test_nnls_and_flow():
    rng = np.random.default_rng(6)
    for _ in range(20):
        a, truth = rng.random((12, 5)), np.maximum(rng.normal(size=5), 0)
        assert np.allclose(graph.nnls(a, a @ truth), truth, atol=1e-8)
    assert graph.max_flow([(0, 1, 3.0), (0, 2, 2.0), (1, 2, 5.0), (1, 3, 2.0), (2, 3, 3.0)], 0, 3) == 5.0


def test_two_isoforms_are_found(spark):
    edges = spark.createDataFrame([(7, 1, 2, 6.0), (7, 1, 3, 4.0), (7, 2, 4, 6.0), (7, 3, 5, 4.0)], "locus long, a int, b int, weight double")
    got = {tuple(r.path): round(r.weight, 6) for r in graph.decompose(edges).collect()}
    assert got == {(1, 2, 4): 6.0, (1, 3, 5): 4.0}


def exon_rows(spark):
    genes = {"g1": [("tx1", [(100, 200), (300, 400), (500, 600)]), ("tx2", [(100, 200), (500, 600)]), ("tx3", [(100, 250), (300, 400), (500, 600)])], "g2": [("tx4", [(1000, 1500)]), ("tx5", [(1000, 1200), (1300, 1500)])]}
    rows = [(t, g, "chr1", "+", k, s, e) for g, ts in genes.items() for k, (t, xs) in enumerate(ts) for s, e in xs]
    return spark.createDataFrame(rows, "transcript_id string, gene_id string, chrom string, strand string, tx long, s long, e long")


def test_events_of_the_small_annotation(spark):
    found = events.detect(exon_rows(spark))
    ids = {r.event_id for r in found.collect()}
    assert {"SE:chr1:+:200_300_400_500", "A5SS:chr1:+:200_250_300", "RI:chr1:+:1200_1300"} <= ids
    jn = spark.createDataFrame([("chr1", 200, 300, 20, 0), ("chr1", 200, 500, 15, 0), ("chr1", 250, 300, 10, 0), ("chr1", 400, 500, 20, -1), ("chr1", 1200, 1300, 25, 1)], "chrom string, js long, je long, count long, strand int")
    psi = {r.event_id: (r.inc, r.exc, r.psi) for r in events.junction_counts(found, jn).collect()}
    assert psi["SE:chr1:+:200_300_400_500"] == (40, 15, pytest.approx(20 / 35))
    assert psi["A5SS:chr1:+:200_250_300"] == (20, 10, pytest.approx(2 / 3))
    assert psi["RI:chr1:+:1200_1300"] == (0, 0, None)


def test_expression_guards(spark):
    t = transcripts.chains(exon_rows(spark)).withColumn("cov", F.lit(0))
    assert {(r.fpkm, r.tpm) for r in transcripts.expression(t, "cov", 0).collect()} == {(0.0, 0.0)}
    with pytest.raises(ValueError):
        transcripts.expression(t, "cov", -1)


def test_islands_touch_and_nest(spark):
    rows = spark.createDataFrame([(1, 0, 10), (1, 10, 12), (1, 2, 3), (1, 13, 14), (2, 0, 1)], "c int, s long, e long")
    assert sorted((r.c, r.s, r.e, r.n) for r in intervals.islands(rows, ["c"]).collect()) == [(1, 0, 12, 3), (1, 13, 14, 1), (2, 0, 1, 1)]


def test_auc_with_ties_and_without_classes(spark):
    rows = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "score double, label int")
    assert metrics.auc(rows, []).first().auc == pytest.approx(0.875)
    assert metrics.auc(rows.where("label = 1"), []).first().auc is None


def test_cigar_and_motifs(spark):
    cigar = [(R.SOFT, 3), (R.MATCH, 10), (R.INSERTION, 2), (R.SKIP, 100), (R.EQUAL, 5), (R.DELETION, 1), (R.SKIP, 50), (R.MATCH, 7)]
    r = spark.createDataFrame([(cigar,)], "c array<struct<op:int,len:bigint>>").select(R.reference_length(F.col("c")).alias("n"), R.junctions(F.col("c"), F.lit(1000)).alias("j"), R.blocks(F.col("c"), F.lit(1000)).alias("b")).first()
    assert r.n == 173 and [tuple(x) for x in r.j] == [(1010, 1110), (1116, 1166)] and [tuple(x) for x in r.b] == [(1000, 1010), (1110, 1116), (1166, 1173)]
    rows = spark.createDataFrame([("GT", "AG"), ("CT", "AC"), ("AA", "AG"), ("AT", "AC"), ("GT", "AT")], "d string, a string")
    assert [x.s for x in rows.select(R.strand_of_motif(F.col("d"), F.col("a")).alias("s")).collect()] == ["+", "-", ".", "+", "-"]


def test_caller_tables(spark, tmp_path):
    head = "ID\tGeneID\tgeneSymbol\tchr\tstrand\texonStart_0base\texonEnd\tupstreamES\tupstreamEE\tdownstreamES\tdownstreamEE\tIJC_SAMPLE_1\tSJC_SAMPLE_1\tIJC_SAMPLE_2\tSJC_SAMPLE_2\tIncFormLen\tSkipFormLen\tPValue\tFDR\tIncLevel1\tIncLevel2\tIncLevelDifference\n"
    (tmp_path / "SE.MATS.JC.txt").write_text(head + '1\t"G1"\t"ABC"\tchr1\t+\t300\t400\t100\t200\t500\t600\t10,20\t5,5\t1,2\t9,9\t200\t100\t0.01\tNA\t0.5,NA,0.7\tNA\t0.4\n' + '2\t"G2"\tNA\tchr1\t-\t1\t2\t3\t4\t5\t6\t1,,2\t5,5\t1,2\t9,9\t200\t100\t0.01\t0.02\t0.5\t0.1\t0.4\n' + '3\t"G3"\tNA\tchr1\t-\t1\t2\t3\t4\t5\t6\t1,2\t5,5\t1,2\t9,9\t200\t100\t0.01\t0.02\t0.5\t0.1\tinf\n')
    got = callers.read_caller(spark, "rmats", str(tmp_path)).collect()
    assert [(r.gene, r.dpsi, r.fdr, r.total_support, r.group1_psi) for r in got] == [("ABC", 0.4, None, 61.0, 0.6)]
    assert got[0].event_id == "SE:chr1:200-300-400-500:+"
    with pytest.raises(Exception, match="unreadable"):
        callers.rmats(spark, str(tmp_path), strict=True).collect()
    (tmp_path / "m.tsv").write_text("gene_name\tlsv_id\tE(dPSI) per LSV junction\tP(|dPSI|>=0.20) per LSV junction\tnum_reads\nBIG\tx\t0.1;0.55\t0.2;0.98\t320\nMOD\ty\t0.18;-0.18\t0.97;0.1\t240\n")
    rows = {r.gene: r for r in calibrated(callers.majiq(spark, str(tmp_path / "m.tsv"))).collect()}
    assert (rows["BIG"].dpsi, round(rows["BIG"].pvalue, 6), rows["BIG"].tier) == (0.55, 0.02, "high-confidence")
    assert (round(rows["BIG"].ci_low, 4), round(rows["MOD"].ci_high, 4), rows["MOD"].tier) == (0.2059, 0.4618, "caller-significant-only")
    (tmp_path / "s.dpsi").write_text("A-B_dPSI\tA-B_p-val\nG1;A3:chr1:5\t0.3\t0.01\nG2;SE:chr1:7\tnan\t1\n")
    assert [(r.gene, r.event_type, r.dpsi, r.pvalue, r.total_support) for r in callers.suppa2(spark, str(tmp_path / "s.dpsi")).collect()] == [("G1", "A3SS", 0.3, 0.01, None)]
    (tmp_path / "b.tsv").write_text("gene\tevent_id\tdeltapsi\tlower\tupper\tfdr\nG\te\t0.2\t0.1\t0.3\t0.04\n")
    assert callers.betas(spark, str(tmp_path / "b.tsv")).first().sampling_std == pytest.approx(0.2 / 3.919927969080108)
    with pytest.raises(ValueError):
        callers.read_caller(spark, "none", "x")


def test_files_round_trip(spark, tmp_path):
    rows = exon_rows(spark)
    genomics.write_gtf(rows, str(tmp_path / "gtf"))
    back = genomics.gtf_exons(spark, str(tmp_path / "gtf"))
    pick = ["transcript_id", "gene_id", "chrom", "strand", "s", "e"]
    assert sorted(map(tuple, back.select(pick).collect())) == sorted(map(tuple, rows.select(pick).collect()))
    seqs = spark.createDataFrame([("a", "ACGT" * 50), ("b", "A")], "name string, seq string")
    genomics.write_fasta(seqs, str(tmp_path / "fa"), 60)
    assert sorted((r.name, r.seq) for r in genomics.fasta(spark, str(tmp_path / "fa")).collect()) == sorted(map(tuple, seqs.collect()))
    (tmp_path / "r.fq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nAC\n+\n#I\n")
    assert sorted(map(tuple, genomics.fastq(spark, str(tmp_path / "r.fq")).collect())) == [("r1", "ACGT", "IIII"), ("r2", "AC", "#I")]
    genomics.write_tsv(spark.createDataFrame([("=1+1", None, 0.5)], "a string, b string, c double").coalesce(1), str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a\tb\tc", "'=1+1\tNA\t0.5"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, 0.01 * (k % 90), 0.05, 30.0 * (k % 12), 0.01 * (k % 20), None, f"2024-01-01 0{k % 9}:00:00") for k in range(200)]
    made = spark.createDataFrame(rows, "id long, dpsi double, sampling_std double, total_support double, fdr double, pvalue double, t string").withColumn("t", F.to_timestamp("t"))
    made.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    run = calibrated(stream).select("id", "tier").writeStream.format("memory").queryName("tiers").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.sql("select * from tiers").collect())) == sorted(map(tuple, calibrated(made).select("id", "tier").collect()))
    run = tiers_by_window(stream, "t").writeStream.format("memory").queryName("windows").outputMode("update").start()
    run.processAllAvailable()
    run.stop()
    assert sum(r["count"] for r in spark.sql("select * from windows").collect()) == 200


def test_decompose_sees_every_path_of_a_locus(spark):
    """81 paths of equal bottleneck through four places of three variants: with only the first 50 the later variants get no weight."""
    from spliceflow.operators import graph

    edges = [(1, 10 * k + a, 10 * k + 10 * d + b, 10.0) for k in range(1, 5) for a, b, d in [(0, v, 0) for v in (1, 2, 3)] + [(v, 0, 1) for v in (1, 2, 3)]]
    table = spark.createDataFrame(edges, "locus long, a int, b int, weight double")
    psi = {r.node: r.psi for r in graph.exon_inclusion(graph.decompose(table, min_share=0.0)).collect()}
    assert all(abs(psi.get(10 * k + v, 0) - 1 / 3) < 1e-6 for k in range(1, 5) for v in (1, 2, 3))


def test_merge_nearby_reads_all_intervals(spark):
    """The last cluster of each chromosome's intervals is near the last end of all of them."""
    from conftest import DATA
    from pyspark.sql import functions as F

    from spliceflow.plans.domain import view
    from spliceflow.plans.registry import QUERIES

    kept = QUERIES["merge_nearby"](spark, DATA).groupBy("locus").agg(F.max("je").alias("je")).collect()
    ends = {r.chrom: r.e for r in view(spark, DATA, "iv").groupBy("chrom").agg(F.max("e").alias("e")).collect()}
    assert len(kept) == len(ends) and all(ends[r.locus] - r.je <= 20 for r in kept)


def test_fastq_by_line_numbers(spark, tmp_path):
    """Qualities that begin with @ or +, several files and blocks, compressed or not; nothing is lost."""
    import gzip

    want = []
    for f in range(3):
        text = ""
        for k in range(400):
            seq, quality = "acgt" * (1 + k % 5), "@+I#" * (1 + k % 5)
            want.append((f"r{f}_{k}", seq.upper(), quality))
            text += f"@r{f}_{k} more\n{seq}\n+\n{quality}\n"
        if f == 2:
            (tmp_path / "c.fq.gz").write_bytes(gzip.compress(text.encode()))
        else:
            (tmp_path / f"{f}.fq").write_text(text.replace("\n", "\r\n") if f else text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = genomics.fastq(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 0 and sorted(map(tuple, rows.collect())) == sorted(want)
        kept = genomics.fastq(spark, str(tmp_path), min_length=8, trim=10).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    # The last base of each group of four has quality 2.
    assert sorted(r.sequence for r in kept) == sorted(s[:-1] for _, s, _ in want if len(s) > 8)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.fq").write_text("@r\nAC\n+\nI\n")
    with pytest.raises(Exception, match="no FASTQ record"):
        genomics.fastq(spark, str(tmp_path / "bad")).collect()


def test_genes_of_a_gtf(spark, tmp_path):
    line = lambda feature, s, e, info: f"chr1\tx\t{feature}\t{s}\t{e}\t.\t+\t.\t{info}\n"
    t1, g1 = 'gene_id "G1"; gene_name "Abc"; transcript_id "T1";', 'gene_id "G1"; gene_name "Abc";'
    (tmp_path / "a.gtf").write_text("#head\n" + line("exon", 301, 400, t1) + line("gene", 101, 900, g1) + line("exon", 101, 200, t1) + line("transcript", 101, 450, t1) + line("gene", 1, 9, g1) + "short\tline\n" + line("exon", 5, 9, 'gene_id "G2"; transcript_id "T2";'))
    got = {r.transcript_id: r for r in genomics.gtf_transcripts(spark, str(tmp_path / "a.gtf")).collect()}
    assert (got["T1"].s, got["T1"].e, [tuple(x) for x in got["T1"].exons], got["T1"].gene_name) == (100, 450, [(100, 200), (300, 400)], "Abc")
    assert [tuple(r) for r in genomics.lookup_gene(spark, str(tmp_path / "a.gtf"), "aBC").collect()] == [("chr1", 100, 900, "+", "Abc", "G1")]
    assert genomics.lookup_gene(spark, str(tmp_path / "a.gtf"), "none").count() == 0
    assert [r.transcript_id for r in genomics.gene_transcripts(spark, str(tmp_path / "a.gtf"), "g2").collect()] == ["T2"]
    assert genomics.gene_transcripts(spark, str(tmp_path / "a.gtf"), "g1", "chr2").count() == 0


def test_region_strings(spark):
    from spliceflow.functions import parsing

    rows = spark.createDataFrame([("chr17:7,668,402-7,687,538",), ("HLA:A:1-2",), ("chr1",), ("chr1:5",), (None,)], "t string").select(parsing.region(F.col("t")).alias("r")).collect()
    assert [r.r and tuple(r.r) for r in rows] == [("chr17", 7668401, 7687538), ("HLA:A", 0, 2), None, None, None]


def test_event_tables_round_trip(spark, tmp_path):
    rows = [("=E1", "SE", 0.25, None, True), ("'q", "RI", None, "-x", False), ("\tT", "SE", 1.0, "NAB", None)]
    table = spark.createDataFrame(rows, "event_id string, event_type string, psi double, note string, kept boolean")
    genomics.write_report(table.where("event_type = 'SE'").coalesce(1).where("event_id = '=E1'"), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["event_id\tevent_type\tpsi\tnote\tkept", "'=E1\tSE\t0.250000\tNA\tyes"]
    genomics.write_tsv(table.where("event_id <> '\tT'"), str(tmp_path / "t"))
    back = genomics.read_events_tsv(spark, str(tmp_path / "t"), ("psi",)).select("event_id", "event_type", "psi", "note")
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(str(r[:4]) for r in rows[:2])
    with pytest.raises(ValueError):
        genomics.read_events_tsv(spark, str(tmp_path / "t"), needed=("gene",))


def test_calibrator_files():
    made = C.Calibrator(0.3, {"<20": float("inf"), "250+": 0.2}, {"SE": 0.4}, {"SE|250+": 0.1})
    assert C.Calibrator.from_json(made.to_json()) == made
    assert C.Calibrator.from_json('{"q_global": 0.5, "q_by_bin": {"20-49": 0.25}}') == C.Calibrator(0.5, {"20-49": 0.25})
    for bad in ('{"version": 3, "q_global": 1}', '{"q_global": -1}', '{"q_global": 1, "q_by_bin": {"x": 1}}'):
        with pytest.raises(ValueError):
            C.Calibrator.from_json(bad)


def test_region_reads_reach_the_scan(spark, tmp_path):
    rows = [("chr1", 10, 0, 30), ("chr1", 20, 4, 30), ("chr1", 99, 0, 30), ("chr2", 10, 0, 30), ("chr1", 15, 0, 0)]
    spark.createDataFrame(rows, "chrom string, start long, flag int, mapq int").write.parquet(str(tmp_path / "al"))
    found = genomics.region_reads(spark.read.parquet(str(tmp_path / "al")), "chr1", 10, 99)
    assert [r.start for r in found.collect()] == [10]
    assert "EqualTo(chrom,chr1)" in found._jdf.queryExecution().toString()


def test_differential_of_the_example(spark):
    """The published four-event example: sampled, so within 0.01 of the closed form; tiers are the same."""
    from spliceflow.operators import commands

    rows = [("STRONG_UP", 270, 30, 90, 210, 0.0008), ("STRONG_DOWN", 40, 160, 180, 20, 0.0011), ("NO_CHANGE", 150, 150, 150, 150, 0.82), ("LOW_COVERAGE", 14, 6, 7, 13, 0.04), ("FEW", 3, 2, 50, 50, 0.5)]
    table = spark.createDataFrame([(n, "SE", "g", "chr1", [a], [b], [c], [d], 1.0, 1.0, f, 0.5) for n, a, b, c, d, f in rows], "event_id string, event_type string, gene string, chrom string, inc1 array<int>, exc1 array<int>, inc2 array<int>, exc2 array<int>, inc_len double, skip_len double, fdr double, dpsi double")
    got = {r.event_id: r for r in commands.differential(table).collect()}
    want = {"STRONG_UP": (0.598, 0.2484, 0.9477, "high-confidence"), "STRONG_DOWN": (-0.6965, -1.0, -0.3455, "high-confidence"), "NO_CHANGE": (0.0, -0.3532, 0.3532, "not-significant"), "LOW_COVERAGE": (0.3333, -0.1065, 0.7732, "caller-significant-only")}
    assert set(got) == set(want)
    for name, (dpsi, low, high, tier) in want.items():
        r = got[name]
        assert abs(r.dpsi - dpsi) < 0.012 and abs(r.ci_low - low) < 0.015 and abs(r.ci_high - high) < 0.015 and r.tier == tier
        assert r.differential_model == "sum" and abs(r.dpsi - (r.ctrl_psi - r.treat_psi)) < 1e-9
    swapped = {r.event_id: r for r in commands.differential(table, swap_groups=True).collect()}
    assert abs(swapped["STRONG_UP"].dpsi + 0.598) < 0.012 and swapped["STRONG_UP"].rmats_dpsi == -0.5
    assert commands.differential(table.limit(0)).columns == list(commands.DIFFERENTIAL)
    with pytest.raises(ValueError):
        commands.differential(table, effect_cutoff=-1)
    one = {r.event_id: r for r in commands.psi(table, "s", replicate=0).collect()}
    assert one["FEW"].inc_count == 3 and one["FEW"].mode == "replicate" and {r.mode for r in commands.psi(table, "s", replicate=3).collect()} == {"sum"}


def test_probability_beyond(spark):
    from spliceflow.operators import commands

    cases = [(0.2, 0.1), (-0.3, 0.05), (0.0, 1.0), (0.1, 0.0), (float("nan"), 1.0)]
    got = spark.createDataFrame(cases, "m double, s double").select(commands.probability_beyond(F.col("m"), F.col("s"), 0.1).alias("p")).collect()
    cdf = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    for (m, s), r in zip(cases, got, strict=True):
        want = 1 - cdf((0.1 - m) / s) + cdf((-0.1 - m) / s) if s > 0 and m == m else None
        assert (r.p is None) == (want is None) and (want is None or abs(r.p - want) < 1e-6)


def test_running_sums_of_any_numbers(spark):
    from spliceflow.operators import ranks

    values = [-1e300, -3.5, -3.4999, -1e-300, 0.0, 5e-324, 1e-9, 0.5, 0.5000001, 7.0, 1e300, float("inf"), float("-inf")]
    rows = [(g, v, k + 1) for g in ("a", None) for k, v in enumerate(values)]
    got = {(r.g, r.v): (r.before_n, r.total_n) for r in ranks.running(spark.createDataFrame(rows, "g string, v double, n long"), ["g"], "v", "n").collect()}
    for g, v, _ in rows:
        assert got[g, v] == (sum(n for h, w, n in rows if h == g and w < v), sum(n for h, _, n in rows if h == g))


def test_simplified_graph(spark):
    """A tip, a weak arm of a bubble and a chain of low coverage go; the main chain stays."""
    from spliceflow.operators import debruijn

    def kmers(seq, n):
        return {seq[i : i + 5]: n for i in range(len(seq) - 4)}

    main = "ACGTTGCAAGGCTTACCGATAGTCCA"
    table = {**kmers("GGATC", 1), **kmers(main[:10] + "A" + main[11:16], 2), **kmers("TTTTTGGGGG", 1), **kmers(main, 40)}
    rows = spark.createDataFrame(list(table.items()), "kmer string, n long")
    left = {r.kmer for r in debruijn.simplified(rows, 5, least=2.0, ratio=0.2).collect()}
    assert left == set(kmers(main, 40))


def test_unsound_graphs_are_named(spark):
    from spliceflow.operators import paths

    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 2, 3), (2, 5, 4), (2, 6, 6), (3, 1, 2)], "locus long, a int, b int")
    assert sorted(map(tuple, paths.invalid(edges, ["locus"]).collect())) == [(1, "twice", 1), (2, "backward", 2)]
