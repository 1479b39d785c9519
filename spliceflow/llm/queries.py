"""The registered query of each operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceflow.llm import conversation_trie, decontaminate, embedding_dedup, licenses, mixing, packing, sharding, simhash_dedup, substring_dedup, token_counts, toxicity, url_filter, whitening
from spliceflow.llm.common import read


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("item_ids")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), url_filter.rule_table(spark, url_filter.RULES))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(read(spark, sf_dir, "embeddings"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.simhash_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats_report(read(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(read(spark, sf_dir, "conversations"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(read(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_token_counts": op1,
    "op2_packing": op2,
    "op3_decontamination": op3,
    "op4_url_filter": op4,
    "op5_license_scan": op5,
    "op6_embedding_dedup": op6,
    "op7_toxicity": op7,
    "op8_simhash_dedup": op8,
    "op9_substring_dedup": op9,
    "op10_sharding": op10,
    "op11_conversation_trie": op11,
    "op12_source_mixing": op12,
    "op13_whitening": op13,
    "pipeline": pipeline,
}

OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.s = win.s AND g.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM met)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
OP4_SQL = rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES {_RULES_SQL}),
m AS (SELECT u.page_id, h || p AS rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(h || p) DESC, length(h) DESC, r.verdict DESC) AS k FROM u JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, '{url_filter.DEFAULT_VERDICT}') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id AND k = 1
"""


def _canonical_sql(text: str) -> str:
    kept = f"regexp_replace(lower(coalesce({text}, '')), '(?m){licenses.HOLDER_LINE}', ' ', 'g')"
    out = f"(' ' || trim(regexp_replace({kept}, '{licenses.GAP}', '  ', 'g')) || ' ')"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return rf"regexp_replace(trim(replace({out}, '  ', ' ')), '{licenses.TITLE}', '\2')"


_KNOWN_SQL = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.KNOWN)
_DIGESTS_SQL = ", ".join(f"('{name}', '{digest}')" for name, digest, *_ in licenses.DIGESTS)
OP5_SQL = f"""
WITH k AS (SELECT digest, min(license) AS found FROM (SELECT license, sha256({_canonical_sql("text")}) AS digest FROM (VALUES {_KNOWN_SQL}) v(license, text) UNION ALL SELECT * FROM (VALUES {_DIGESTS_SQL}) w(license, digest)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
parts AS (SELECT r, unnest(string_split_regex(text, '{licenses.PARAGRAPHS}')) AS part FROM d WHERE text IS NOT NULL),
pk AS (SELECT r, part, found FROM (SELECT r, part, sha256({_canonical_sql("part")}) AS digest FROM parts) LEFT JOIN k USING (digest)),
met AS (SELECT r, found FROM pk WHERE found IS NOT NULL UNION ALL SELECT r, k.found FROM (SELECT r, sha256({_canonical_sql("line")}) AS digest FROM (SELECT r, unnest(string_split(part, chr(10))) AS line FROM pk WHERE found IS NULL)) JOIN k USING (digest)),
n AS (SELECT r, count(*) AS n_notices, string_agg(DISTINCT found, ',' ORDER BY found) AS notices FROM met GROUP BY r)
SELECT d.doc_id, k.found AS license, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices, coalesce(notices, '') AS notices
FROM (SELECT r, doc_id, sha256({_canonical_sql("text")}) AS digest FROM d) d LEFT JOIN k USING (digest) LEFT JOIN n USING (r)
"""

OP6_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {embedding_dedup.THRESHOLD}),
reach AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id, v.vec_id <= coalesce(m, v.vec_id) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) d ON d.a = v.vec_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = v.vec_id
"""

# The crc32 of a text, bit by bit; 3988292384 is its polynomial.
_CRC_SQL = "xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split({}, ''), lambda ch: ascii(ch)::UBIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384::UBIGINT * (c & 1)))))"
OP11_SQL = rf"""
WITH t AS (SELECT conv_id, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(coalesce(role, ''), chr(10), coalesce(text, '')))) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(v ORDER BY k) AS vs, CAST({_CRC_SQL.format("CAST(conv_id AS VARCHAR)")} % 4 AS BIGINT) AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.vs[1:c.h], []), c.vs[c.h + 1:]) AS vs FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
m AS (SELECT conv_id, d AS depth, vs[1:d] AS path, len(vs) AS n FROM (SELECT *, unnest(range(0, len(vs) + 1)) AS d FROM r)),
g AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends, CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[depth].x, '[^\x20\x09-\x0D]+')) END AS saved FROM m GROUP BY path, depth),
p AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n FROM g WHERE depth > 0 GROUP BY 1, 2),
s AS (SELECT a.path, a.depth, sum(CASE WHEN p.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(b.saved) AS saved FROM g a JOIN g b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path LEFT JOIN p ON p.path = b.path AND p.depth = b.depth GROUP BY 1, 2)
SELECT g.conv_id, g.depth, up.conv_id AS parent_conv_id, g.n_convs, CAST(coalesce(p.n, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN s ON s.path = g.path AND s.depth = g.depth LEFT JOIN p ON p.path = g.path AND p.depth = g.depth LEFT JOIN g up ON up.depth = g.depth - 1 AND up.path = g.path[1:g.depth - 1]
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, source IS NULL AS no_source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT no_source, source, CAST(sum(size) AS BIGINT) AS source_size, CAST([1, 2, 3][(row_number() OVER (ORDER BY no_source, source) - 1) % 3 + 1] AS BIGINT) AS w FROM d GROUP BY 1, 2),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level FROM s WINDOW o AS (ORDER BY 3 * source_size / w, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 3 * source_size / w < level AS stops FROM l),
t AS (SELECT no_source, source, source_size, CAST(CASE WHEN stops THEN 3 * source_size ELSE (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (WHERE stops) OVER (), 0)) / (sum(w) FILTER (WHERE NOT stops) OVER ()) * w END AS DOUBLE) AS target FROM f),
q AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY no_source, source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d)
SELECT doc_id, size, source_size, target, CAST(list_sum([greatest(0, least(size, floor(target) - ahead - e * source_size)) FOR e IN [0, 1, 2]]) AS BIGINT) AS taken FROM q JOIN t USING (no_source, source)
"""

SQL = {"op6_embedding_dedup": OP6_SQL, "op3_decontamination": OP3_SQL, "op4_url_filter": OP4_SQL, "op5_license_scan": OP5_SQL, "op11_conversation_trie": OP11_SQL, "op12_source_mixing": OP12_SQL}
