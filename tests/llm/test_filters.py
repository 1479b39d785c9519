import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spliceflow.llm import decontaminate, licenses, queries, sharding, toxicity, url_filter

DOCS = "doc_id long, text string, words array<string>, start int, shingle string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(AZ))


def brute_decontamination(docs, items):
    found = {}
    for k, (doc_id, text, *_) in enumerate(docs):
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(10, len(v))
            for window in ({tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v and item_id is not None else ()):
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) == window:
                        hit |= set(range(i, i + n))
                        ids.add(str(item_id))
        found[k] = (doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return found


@pytest.mark.parametrize("block", [50_000, 3])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    passage = " ".join(f"Tok{k % 7}" for k in range(25))
    items = [(1, passage), (2, "solo"), (3, "Two words"), (4, None), (5, "..."), (None, "null item"), (10, passage), (6, "ÉTÉ à la plage de la grande ville du nord-ouest x")]
    rows = [(1, f"start {passage}, end"), (2, None), (3, ""), (4, "SOLO two-words, two  words solo"), (5, " ".join(passage.split()[:9])), (6, "a " * 30 + passage + " b" * 3000 + " " + passage), (7, "été À la plage de la grande ville du nord ouest X"), (7, "clean text here"), (None, "solo"), (8, "ÉTÉ à la plage de la grande ville du nord-ouest x"), (4, "SOLO two-words, two  words solo"), (9, "null item")]
    docs = spark.createDataFrame([(*r, ["z"], 1, "s") for r in rows], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench).drop("item_ids")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_decontamination(rows, items).values()))
    assert {r.n_hit for r in decontaminate.decontaminate(docs, bench.limit(0)).collect()} == {0}
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 9]


def test_drop_contaminated_judges_null_ids_by_row(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    rows = [(None, f"so {item} on"), (None, "clean"), (None, "clean too"), (None, None), (4, "clean as well"), (5, item)]
    kept = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert sorted(str(tuple(r)) for r in kept.collect()) == sorted(map(str, [rows[1], rows[2], rows[3], rows[4]]))


def brute_verdict(url):
    host, path = "", ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = m[1].translate(AZ), m[2]
    fit = [(len(h + p), len(h), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, url_filter.DEFAULT_VERDICT, None))
    return host, path, best[3], best[2]


@pytest.mark.parametrize("few", [5_000, 0])
def test_url_rules(spark, monkeypatch, few):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", few)
    urls = [None, "", "no scheme", "http://", "http://ORG/", "http://org", "https://a.Example.org/es/x?q#f", "https://example.org/en/1", "https://example.org/en/2", "https://notexample.org/es/", "http://x.com/de/1", "http://x.com/fr/1#z", "http://x.com/DE/", "https://u@x.com:80/de/", "http://com/de/", "http://y.com?x://z.com/de/", "//x.com/de/", "http://é.com/de/ü", "http://x..com/de/a\nb", "http://x.com/de/" + "a" * 9000, "http://x.com/de/1"]
    rows = [(k, u, "h", "rule") for k, u in enumerate(urls)] + [(None, urls[6], "h", "r"), (3, urls[6], "h", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    rules = url_filter.rule_table(spark, [*url_filter.RULES, ("allow", None, "/"), ("allow", "com", "/de/")])
    got = sorted(map(str, (tuple(r) for r in url_filter.judge(pages, rules).collect())))
    assert got == sorted(str((r[0], *brute_verdict(r[1]))) for r in rows)
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {(r.rule, r.verdict) for r in url_filter.judge(pages, rules.limit(0)).collect()} == {(None, "allow")}


ISC_AS_PUBLISHED = """ISC License

Copyright (c) 2004-2010 by Some Consortium, Inc. ("SC")
Copyright (c) 1995-2003 by Another Consortium

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""


def test_license_scan(spark):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and t.startswith("Permission"))
    bsd = next(t for n, t in licenses.KNOWN if n == "BSD-3-Clause")
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(". ", ".\n  ")),
        (2, "Some text.\nReleased under the M.I.T. License.\nreleased under the MIT licence!"),
        (3, "Intro\n  ** RELEASED under the MIT Licence **\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
        (4, None),
        (5, ""),
        (6, "Released under the MIT License. And more."),
        (7, "Licenced under CC-BY-NC 4.0"),
        (3, "Released under the MIT License."),
        (None, "Licensed under CC BY-NC 4.0."),
        (5, ""),
        (8, ISC_AS_PUBLISHED),
        (9, "The MIT License (MIT)\n\nCopyright © 2001 A. Holder\nAll rights reserved.\n\n" + mit.replace(" and ", "\nand ")),
        (10, "BSD 3-Clause License\n\n[Copyright 1999] x\nCopyright [yyyy] [name]\n" + bsd.replace("copyright holder nor", "copyright owner nor").replace(" (", "\n(")),
        (11, "A story.\nAnd on.\n\nReleased under\n the MIT License.\n\nThe end.\nLicence, licence, percent."),
        (12, "Copyright notice and this permission\nCopyright holders may\nReleased under the MIT License."),
        (13, "x " * 30_000 + "\nReleased under the MIT License."),
    ]
    docs = spark.createDataFrame([(a, b, "", "", 1) for a, b in rows], "doc_id long, text string, license string, digest string, row int")
    got = sorted(map(str, (tuple(r) for r in licenses.license_scan(docs, licenses.known_digests(spark)).collect())))
    want = [(1, "MIT", 1, "MIT"), (2, None, 1, "MIT"), (3, None, 3, "Apache-2.0,MIT"), (4, None, 0, ""), (5, None, 0, ""), (5, None, 0, ""), (6, None, 0, ""), (7, "CC-BY-NC-4.0", 1, "CC-BY-NC-4.0"), (3, "MIT", 1, "MIT"), (None, "CC-BY-NC-4.0", 1, "CC-BY-NC-4.0")]
    want += [(8, "ISC", 0, ""), (9, "MIT", 1, "MIT"), (10, "BSD-3-Clause", 1, "BSD-3-Clause"), (11, None, 1, "MIT"), (12, None, 1, "MIT"), (13, None, 1, "MIT")]
    assert got == sorted(map(str, want))
    assert licenses.license_scan(docs.limit(0), licenses.known_digests(spark)).count() == 0
    assert {r.license for r in licenses.license_scan(docs, licenses.known_digests(spark, digests=[]).limit(0)).collect()} == {None}


def test_equivalent_spellings_side_by_side(spark):
    rows = spark.createDataFrame([("Licence licence; LICENCE sub-licence",), ("The MIT License",), ("mit licence: grants",)], "t string").select(licenses.canonical(F.col("t")).alias("c"))
    assert [r.c for r in rows.collect()] == ["license license license sublicense", "the mit license", "grants"]


def test_sharding(spark):
    names = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(names[::-1], 997)
    # Turn by turn, with preferences written out.
    prefer = [[(sharding._number("start", n) % 997 + j * (sharding._number("step", n) % 996 + 1)) % 997 for j in range(997)] for n in names]
    want, at = [None] * 997, [0] * 7
    while None in want:
        for k in range(7):
            while at[k] < 997 and want[prefer[k][at[k]]] is not None:
                at[k] += 1
            if at[k] < 997:
                want[prefer[k][at[k]]] = k
    assert table == want
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 997)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 997 * 0.2
    for bad in ((names, 998), ([], 997), (names, 5)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)
    rows = [(k, k) for k in range(500)] + [(3, 1), (None, 1), (None, 2)]
    given = spark.createDataFrame(rows, "doc_id long, at long")
    placed = sharding.place(given, names, slots=997)
    assert placed.columns == ["doc_id", "at", "slot", "shard"]
    placed = placed.collect()
    assert len(placed) == len(rows) and sorted(r.at for r in placed) == sorted(r[1] for r in rows)
    clash = sharding.place(given.withColumnRenamed("at", "Shard"), names, slots=997)
    assert clash.columns == ["doc_id", "Shard", "slot", "_shard"] and sorted((str(r.doc_id), r.slot, r["_shard"]) for r in clash.collect()) == sorted((str(r.doc_id), r.slot, r.shard) for r in placed)
    assert sharding.place(given.withColumnRenamed("at", "shard"), names, slots=997, shard_col="to").columns == ["doc_id", "shard", "slot", "to"]
    assert sharding.place(given, names, "at", slots=997).count() == len(rows)
    for r in placed:
        slot = int(hashlib.sha256(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 997
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert sharding.place(spark.createDataFrame([], "doc_id long"), names, slots=997).count() == 0


def test_write_shards(spark, tmp_path):
    sharding.write_shards(spark.range(100).withColumnRenamed("id", "doc_id"), str(tmp_path / "out"), ["a", "b"])
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 2


def brute_segments(scores):
    """Maximal-scoring segments by their definition: the best segment, then what lies to its left and right."""

    def best(lo, hi):
        found = None
        for i in range(lo, hi):
            total = 0
            for j in range(i, hi):
                total += scores[j]
                if total > 0 and (found is None or total > found[2] + 1e-9):
                    found = (i, j + 1, total)
        if found is None:
            return []
        return best(lo, found[0]) + [found] + best(found[1], hi)

    return best(0, len(scores))


def test_segments_are_the_maximal_ones():
    import random

    rng = random.Random(4)
    for _ in range(200):
        table = {f"{c}{k}$": rng.choice([-3.1, -1.2, 0.7, 1.9, 4.3]) + rng.random() / 10 for c in "ab" for k in range(5)}
        text = [f"{rng.choice('abz')}{rng.randrange(5)}" for _ in range(rng.randrange(30))]
        model = toxicity.Model(table, -0.83, 1.0, 1.0, heads=frozenset(t[:2] for t in table))
        got = model.segments(text)
        want = brute_segments([table.get(f"{w}$", -0.83) for w in text])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(got, want, strict=True))


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    scored = queries.op7(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    seen = Counter((r.toxic, r.predicted) for r in scored.where("held_out").join(labels, "doc_id").collect())
    assert seen[1, 1] / (seen[1, 0] + seen[1, 1]) > 0.92 and seen[0, 1] / (seen[0, 0] + seen[0, 1]) < 0.03
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0


def test_tokens_cover_the_whole_word():
    assert toxicity.tokens("ab") == ["ab$"] and toxicity.tokens("abc") == ["abc$"] and toxicity.tokens("abcd") == ["abc", "abcd$"]
    long = "x" * 200
    assert toxicity.tokens(long)[-1] == long + "$" and sum(map(len, toxicity.tokens(long))) < 3 * len(long)
    assert toxicity.words_of("Ünser 悪い言葉 x_1, ของ") == ["ünser", *"悪い言葉", "x_1", *"ของ"]
    scores = {"bad": 2.0, "badg": 0.0, "badged$": 1.5, "worthles": 3.0, "unspeakably": 1.0}
    model = toxicity.Model(scores, -1.0, 1.0, 1.0, heads=frozenset({"bad", "wor"}))
    assert [model.word_score(w) for w in ("bad", "baddest", "badger", "badged", "worth", "worthless")] == [None, 2.0, None, 1.5, None, 3.0]


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(k, "you vile fool" if k % 2 else "a fine day", "x", "y") for k in range(60)] + [(None, None, "x", "y"), (5, "", "x", "y"), (5, "fool " * 20_000, "x", "y")], "doc_id long, text string, toxic string, score string")
    labels = spark.createDataFrame([(k, k % 2, "t") for k in range(50)] + [(None, 1, "t"), (3, None, "t"), (4, 7, "t"), (7, 1, "t")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 63 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got[:60])
    assert next(r for r in got if r.doc_id is None).held_out is False
    model = toxicity.fit(docs, labels)
    assert {r.doc_id for r in toxicity.passages(docs, model).collect()} <= {5, *range(1, 60, 2)}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert all(r.score < 1e-6 for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < 63


def test_pipeline(spark):
    """Each stage against a plain reading of what it kept; the last by its round trip."""
    from test_dedup import plain_removal, plain_repeats

    from spliceflow.llm import packing, simhash_dedup
    from spliceflow.llm.common import cut, read

    sf_dir = "/root/testdata/sf0.001"
    docs = read(spark, sf_dir, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        kept[name] = (before, docs)
    before, after = kept["toxicity"]
    told = {r.doc_id: r.predicted for r in toxicity.toxicity(before, read(spark, sf_dir, "labels")).collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == {d for d, p in told.items() if not p}
    before, after = kept["simhash_dedup"]
    groups = {r.component_id for r in simhash_dedup.simhash_groups(before).collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == groups
    before, after = kept["substring_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    gone = plain_repeats(rows)
    assert {r.doc_id: r.text for r in after.collect()} == {d: plain_removal(t, gone[k]) if k in gone else t for k, (d, t) in enumerate(rows)}
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in read(spark, sf_dir, "benchmark").collect()]
    judged = brute_decontamination([(r.doc_id, r.text) for r in before.collect()], items)
    assert {r.doc_id for r in after.collect()} == {v[0] for v in judged.values() if not v[5]}
    rows = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows.collect()) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.pieces(after).collect())


def test_pipeline_of_odd_rows(spark):
    """Nulls in all columns, repeated rows and ids, an empty text, a very long one and columns that the operators use inside."""
    from spliceflow.llm.common import cut

    sf_dir = "/root/testdata/sf0.001"
    long = " ".join(f"w{k % 9973}x" for k in range(60_000))
    rows = [(1, "A plain text of a few words.", "en", "s", 1), (1, "Another text under the same id, longer than the first.", None, "s", 2), (None, None, None, None, None), (None, "", "en", None, 0), (None, "No id but words that nobody else has.", "en", "s", 3), (4, long, "en", "s", 4), (4, long, "en", "s", 4), (5, None, "en", "s", None)]
    docs = spark.createDataFrame([(*r, "d", "h", 7, "w") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, doc string, hash string, __spans int, fp string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = cut(stage(spark, docs, sf_dir))
        assert kept.columns == docs.columns and stage(spark, docs.limit(0), sf_dir).count() == 0
        docs = kept
    assert sorted(str((r.doc_id, (r.text or "")[:20])) for r in docs.collect()) == sorted(str((i, (t or "")[:20])) for i, t in [(1, "A plain text of a few words."), (1, rows[1][1]), (4, long), (5, None), (None, rows[4][1])])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {1, 4, 5, None} and corpus_pipeline.pack(spark, docs.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    from conftest import DATA

    frame = queries.QUERIES[name](spark, DATA)
    want = duck.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(str, map(tuple, frame.select(names).collect()))) == sorted(map(str, want.fetchall()))


def test_host_of_very_many_labels(spark):
    import time

    urls = ["http://" + "a." * 20_000 + "org/x", "http://" + "org." * 20_000 + "net/x", "http://x.org./", "http://.org/", "http://" + "a." * 50 + "example.org/es/1"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    rules = url_filter.rule_table(spark, url_filter.RULES)
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got == {0: ("org/", "allow"), 1: (None, "allow"), 2: (None, "allow"), 3: ("org/", "allow"), 4: ("example.org/es/", "block")}
    assert time.time() - began < 30
