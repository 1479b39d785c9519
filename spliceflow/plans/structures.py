"""Queries over ends of exons, groups of transcripts, long reads and learning curves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spliceflow.functions import reads as R
from spliceflow.operators import anchors, boundaries, curves, flows, graph, longreads
from spliceflow.operators import transcripts as T
from spliceflow.operators.tables import written
from spliceflow.plans.domain import sql, view
from spliceflow.plans.reads import _reads
from spliceflow.plans.registry import query
from spliceflow.plans.stochastic import _SUPPORTED, _parts, _supported

_TERMINAL = sql("reads", "iv") + """, bl AS (SELECT chrom, s, s + m1 AS e FROM reads UNION ALL SELECT chrom, s + m1 + n1, s + m1 + n1 + m2 + CASE WHEN n2 = 0 THEN m3 ELSE 0 END FROM reads UNION ALL SELECT chrom, s + m1 + n1 + m2 + n2, s + m1 + n1 + m2 + n2 + m3 FROM reads WHERE n2 > 0),
x AS (SELECT chrom, min(s) AS first, max(e) AS last FROM bl GROUP BY 1), an AS (SELECT id AS anchor, chrom, s AS pos, 'left' AS side FROM iv UNION ALL SELECT id, chrom, e, 'right' FROM iv),
lo AS (SELECT *, greatest(least((re - rs) // 10, 10), 1) AS width FROM (SELECT an.*, CASE side WHEN 'left' THEN greatest(first, pos - 10000) ELSE pos END AS rs, CASE side WHEN 'left' THEN pos ELSE least(last, pos + 10000) END AS re FROM an JOIN x USING (chrom)) WHERE rs < re),
lk AS (SELECT *, greatest((re - rs) // width, 1) AS bins FROM lo),
st AS (SELECT anchor, side, (greatest(bl.s, rs) - rs) // width AS b, least((least(bl.e, re) - rs) // width + 1, bins) AS t FROM lk JOIN bl ON bl.chrom = lk.chrom AND bl.s < re AND rs < bl.e),
pt AS (SELECT anchor, side, b AS bin, 1 AS d FROM st WHERE b < t UNION ALL SELECT anchor, side, t, -1 FROM st WHERE b < t UNION ALL SELECT anchor, side, 0, 0 FROM lk UNION ALL SELECT anchor, side, bins, 0 FROM lk),
ru AS (SELECT anchor, side, bin, sum(d) OVER w AS depth, lead(bin) OVER w AS until FROM (SELECT anchor, side, bin, sum(d) AS d FROM pt GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY anchor, side ORDER BY bin)),
rr AS (SELECT ru.*, rs, re, width, bins, CASE side WHEN 'left' THEN greatest(bins - 1 - least(5, bins), 0) ELSE 0 END AS nb, CASE side WHEN 'left' THEN bins ELSE least(bins, least(5, bins) + 1) END AS nt FROM ru JOIN lk USING (anchor, side) WHERE until IS NOT NULL),
th AS (SELECT anchor, side, max(depth) AS most, greatest(floor(max(CASE WHEN bin < nt AND until > nb THEN depth END) * 0.1e0), 1) AS least FROM rr GROUP BY 1, 2),
fo AS (SELECT anchor, side, CASE side WHEN 'left' THEN coalesce(max(rs + until * width) FILTER (WHERE depth < least), min(rs)) ELSE coalesce(min(rs + bin * width) FILTER (WHERE depth < least), min(re)) END AS found FROM rr JOIN th USING (anchor, side) WHERE most > 0 GROUP BY 1, 2)
SELECT anchor, side, CAST(coalesce(found, CASE side WHEN 'left' THEN greatest(pos - 100, 0) ELSE pos + 100 END) AS BIGINT) AS boundary FROM an LEFT JOIN fo USING (anchor, side)"""


@query("terminal_boundaries", _TERMINAL)
def terminal_boundaries(spark, sf_dir):
    """Ends outward from both ends of every interval, by all aligned blocks of all reads."""
    iv = view(spark, sf_dir, "iv")
    ends = iv.select(F.col("id").alias("anchor"), "chrom", F.col("s").alias("pos"), F.lit("left").alias("side")).union(iv.select("id", "chrom", "e", F.lit("right")))
    blocks = _reads(spark, sf_dir).select("chrom", F.explode(R.blocks(F.col("cigar"), F.col("s"))).alias("b")).select("chrom", "b.s", "b.e")
    return boundaries.terminal_boundaries(ends, blocks)


# The sequential rule: an item is an anchor unless an earlier anchor matches it, told transcript by transcript of a gene.
_GROUPS = sql("exons").replace("WITH ", "WITH RECURSIVE ", 1) + """, near AS (SELECT *, lead(s) OVER (PARTITION BY tx ORDER BY s) AS ds FROM exons),
t AS (SELECT gene, tx, min(s) AS ts, max(e) AS te, coalesce(list(e || '-' || ds) FILTER (WHERE ds IS NOT NULL), []) AS js FROM near GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY ts, te, tx) AS k FROM t),
seq AS (SELECT gene, k, [{'k': k, 'tx': tx, 'js': js, 'ts': ts, 'te': te}] AS found, tx, tx AS anchor FROM o WHERE k = 1
 UNION ALL SELECT gene, k, CASE WHEN m IS NULL THEN list_append(found, {'k': k, 'tx': tx, 'js': js, 'ts': ts, 'te': te}) ELSE found END, tx, coalesce(m, tx)
 FROM (SELECT o.gene, o.k, o.tx, o.js, o.ts, o.te, seq.found, list_filter(seq.found, lambda a: CASE WHEN len(a.js) > 0 OR len(o.js) > 0 THEN list_has_any(a.js, o.js) ELSE o.ts < a.te AND a.ts < o.te END)[1].tx AS m FROM seq JOIN o ON o.gene = seq.gene AND o.k = seq.k + 1))
SELECT tx, anchor FROM seq"""


@query("anchor_groups", _GROUPS)
def anchor_groups(spark, sf_dir):
    tx = F.expr("cast(substring(transcript_id, 2) as bigint)")
    rows = T.chains(view(spark, sf_dir, "exons")).withColumn("tx", tx)
    # The order of start, end and number as one number, and back.
    item = (F.col("tx_start") * (1 << 20) + F.col("tx_end")) * (1 << 24) + F.col("tx")
    groups = anchors.anchor_groups(rows.select("gene_id", item.alias("item"), "tx_start", "tx_end", "introns"), ["gene_id"])
    return groups.select(*(F.pmod(c, F.lit(1 << 24)).alias(n) for c, n in (("item", "tx"), ("anchor", "anchor"))))


# Reads are the transcripts with their exons' ends moved by up to three bases.
_LONGREADS = _SUPPORTED.replace("WITH ", "WITH RECURSIVE ", 1) + """, rx AS (SELECT gene AS locus, tx AS read, CAST(row_number() OVER (PARTITION BY tx ORDER BY s) AS INT) AS exon, s + tx % 7 - 3 AS s, e + tx % 5 - 2 AS e FROM exons),
pr AS (SELECT rx.locus, read, exon, CAST(sg.node AS INT) AS node FROM rx JOIN sg ON sg.locus = rx.locus AND ((sg.s >= rx.s - 5 AND sg.e <= rx.e + 5) OR 2 * (least(sg.e, rx.e) - greatest(sg.s, rx.s)) > sg.e - sg.s)),
li AS (SELECT DISTINCT l.locus, l.read, l.exon AS xa, l.node AS a, r.exon AS xb, r.node AS b FROM pr l JOIN oe ON oe.locus = l.locus AND oe.a = l.node JOIN pr r ON r.locus = l.locus AND r.read = l.read AND r.node = oe.b AND r.exon IN (l.exon, l.exon + 1)),
ch AS (SELECT locus, read, exon, node, 1 AS n, [node] AS path FROM pr WHERE exon = 1 UNION ALL SELECT ch.locus, ch.read, xb, b, n + 1, min(list_append(path, b)) FROM ch JOIN li ON li.locus = ch.locus AND li.read = ch.read AND li.xa = ch.exon AND li.a = ch.node GROUP BY ch.locus, ch.read, xb, b, n),
la AS (SELECT read, max(exon) AS exon FROM rx GROUP BY 1),
be AS (SELECT locus, read, path FROM (SELECT ch.*, row_number() OVER (PARTITION BY ch.read ORDER BY n DESC, path) AS r FROM ch JOIN la ON la.read = ch.read AND la.exon = ch.exon) WHERE r = 1),
lp AS (SELECT be.*, EXISTS (SELECT 1 FROM st WHERE st.locus = be.locus AND st.node = path[1]) AND EXISTS (SELECT 1 FROM en WHERE en.locus = be.locus AND en.node = path[-1]) AS complete FROM be)"""


def _longreads(spark, sf_dir):
    nodes = graph.graph(*_parts(spark, sf_dir))[0]
    edges = written(_supported(spark, sf_dir).where("weight > 0"))
    nth = F.row_number().over(Window.partitionBy("tx").orderBy("s"))
    exons = view(spark, sf_dir, "exons").select(F.col("gene").alias("locus"), F.col("tx").alias("read"), nth.alias("exon"), (F.col("s") + F.col("tx") % 7 - 3).alias("s"), (F.col("e") + F.col("tx") % 5 - 2).alias("e"))
    return longreads.longread_paths(exons, nodes, edges)


@query("longread_paths", _LONGREADS + " SELECT locus, read, array_to_string(path, '-') AS path, complete FROM lp")
def longread_paths(spark, sf_dir):
    return _longreads(spark, sf_dir).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "-"))


@query("guide_paths", _LONGREADS + " SELECT locus, array_to_string(path, '-') AS path, count(*) AS reads FROM lp WHERE complete GROUP BY locus, path")
def guide_paths(spark, sf_dir):
    return longreads.guide_paths(_longreads(spark, sf_dir)).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "-"))


_CURVE = sql("cal") + """, tr AS (SELECT id, estimate, truth, t AS trial, md5(id || '-' || t) AS key FROM cal, range(20) r(t)), sa AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY key, id) AS place FROM tr),
sz(size) AS (VALUES (20), (30), (40), (50), (70), (90)), h AS (SELECT trial, size, abs(truth - estimate) AS r, row_number() OVER (PARTITION BY trial, size ORDER BY abs(truth - estimate)) AS k FROM sa JOIN sz ON place <= size),
qs AS (SELECT trial, size, CASE WHEN ceil((size + 1) * 0.95e0) <= size THEN max(r) FILTER (WHERE k = ceil((size + 1) * 0.95e0)) ELSE 1e0 END AS q FROM h GROUP BY 1, 2),
te AS (SELECT qs.trial, size, q, greatest(estimate - q, -1) AS lo, least(estimate + q, 1) AS hi, estimate, truth, abs(truth - estimate) <= q AS hit, abs(estimate) > q AS far FROM qs JOIN sa ON sa.trial = qs.trial AND place > size)
SELECT CAST(trial AS INT) AS trial, size, round(q, 9) AS q, count(*) AS n, round(avg(hit::INT), 9) AS coverage, round(avg(hi - lo), 9) AS width, round(avg(far::INT), 9) AS reliable, round(sum((far AND sign(estimate) = sign(truth) AND abs(truth) > 0.05)::INT) / nullif(sum(far::INT), 0), 9) AS precision FROM te GROUP BY trial, size, q"""


@query("learning_curve", _CURVE)
def learning_curve(spark, sf_dir):
    out = curves.learning_curve(view(spark, sf_dir, "cal").select("id", "estimate", "truth"))
    return out.select("trial", "size", F.round("q", 9).alias("q"), "n", *(F.round(c, 9).alias(c) for c in ("coverage", "width", "reliable", "precision")))


@query("phasing_seeds")
def phasing_seeds(spark, sf_dir):
    """Paths of every second exon of the transcripts, completed through the graph of all of them."""
    nodes = graph.graph(*_parts(spark, sf_dir))[0].select("locus", "node", "s")
    exons = view(spark, sf_dir, "exons").select(F.col("gene").alias("locus"), "tx", "s", F.row_number().over(Window.partitionBy("tx").orderBy("s")).alias("nth"))
    partial = exons.where("nth % 2 = 1").join(nodes, ["locus", "s"]).groupBy("locus", "tx").agg(F.array_sort(F.collect_list("node")).alias("path"))
    out = flows.completed(partial, _supported(spark, sf_dir))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), "-").alias(c)
    return out.select("locus", text("path"), text("full"), "bottleneck")
