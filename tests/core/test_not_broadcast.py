"""Tables that grow with the input and that Spark takes for small: joins with them are merged, nothing of them goes through the driver."""

from pyspark.sql import functions as F

from spliceflow.operators import flows, graph, intervals
from spliceflow.operators.tables import written


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_written_tables_are_merged(spark):
    rows = written(spark.range(300).select((F.col("id") % 7).alias("locus"), "id"))
    sums = rows.groupBy("locus").agg(F.sum("id").alias("n"))
    # What is made of a written table row by row or by group is sized by it too.
    for other in (rows.select("locus", F.col("id").alias("n")), sums, sums.where("n > 0")):
        met = rows.join(other, "locus")
        assert broadcasts(met) == 0
        assert met.where("id = 0").count() == other.where("locus = 0").count()
    assert broadcasts(rows.join(F.broadcast(sums), "locus")) == 1


def test_graphs_of_loci_are_not_broadcast(spark):
    junctions = written(spark.createDataFrame([(k, 20, 40, 3) for k in range(5)], "locus long, js long, je long, count long"))
    loci = spark.createDataFrame([(k, 0, 60) for k in range(5)], "locus long, s long, e long")
    exons = written(spark.createDataFrame([(k, s, e, 2) for k in range(5) for s, e in ((0, 20), (0, 60), (40, 60))], "locus long, s long, e long, count long"))
    parts = written(graph.segments(loci, junctions))
    nodes, edges = graph.graph(parts, junctions)
    edges = graph.supported(edges, parts, exons)
    out = flows.widest_paths(edges)
    assert broadcasts(edges) == broadcasts(nodes) == broadcasts(out) == 0
    assert {(r.locus, tuple(r.path), r.bottleneck) for r in out.collect()} == {(k, (1, 2), 3.0) for k in range(5)}


def test_overlap_joins_are_merged(spark):
    rows = spark.range(200).select((F.col("id") % 3).alias("chrom"), "id", (F.col("id") * 40).alias("s"), (F.col("id") * 40 + 70 + (F.col("id") % 50 == 0).cast("long") * 90_000).alias("e"))
    other = rows.select("chrom", F.col("id").alias("rid"), F.col("s").alias("rs"), F.col("e").alias("re"))
    plain = [r for r in rows.collect()]
    both = lambda x, y: min(x.e, y.e) - max(x.s, y.s)
    for out, good in ((intervals.overlap_join(rows, other, ["chrom"]), lambda x, y: both(x, y) > 0), (intervals.reciprocal(rows, other, ["chrom"]), lambda x, y: both(x, y) >= 0.5 * max(x.e - x.s, y.e - y.s))):
        assert broadcasts(out) == 0
        assert sorted((r.id, r.rid) for r in out.collect()) == sorted((x.id, y.id) for x in plain for y in plain if x.chrom == y.chrom and good(x, y))


def test_shares_exchange_the_edges_once_and_dont_hang_on_their_order(spark):
    rows = [(k, a, b, float(1 + (7 * a + 3 * b + k) % 11)) for k in range(6) for a in range(8) for b in range(a + 1, min(a + 4, 9))]
    told = []
    for turned in (rows, rows[::-1], sorted(rows, key=lambda r: r[3])):
        out = flows.node_shares(spark.createDataFrame(turned, "locus long, a int, b int, weight double").repartition(3))
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        told.append(sorted(map(tuple, out.collect())))
    assert told[0] == told[1] == told[2]
    assert all(psi == 1.0 for _, node, psi in told[0] if node == 0)
