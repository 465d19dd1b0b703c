"""The corpus operators on small tables with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm import bpe, jaccard, language_id, licences, packing, quality, suffix_dedup, topk, url_rules, warc
from lodestar.llm.common import components, skew_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, gram int, weight string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = words(120, 1)
    near = base.split()
    near[60] = "changed"
    passage = words(80, 2)
    texts = [None, "", "   ", "short", base, base, " ".join(near), "Intro " + words(60, 3) + " " + passage, words(90, 4) + "\n" + passage + "\n" + words(30, 5), words(20000, 6), "x" * 50000, "é" * 300, passage, "日本 " * 200, None]
    out = [(i, t, "en" if i % 2 else None, "s", 0, "d", i, i, "w") for i, t in enumerate(texts)]
    return [*out, out[4], (None, words(70, 8), "en", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 200 + i) for i in range(40)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_skew_join(spark):
    left = spark.createDataFrame([(i % 7 if i % 2 else 0, i) for i in range(200)], "k long, x long")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("m")).where("k <> 5")
    for how in ("inner", "left"):
        got = skew_join(left, right, "k", "n", 200, how, share=4)
        assert sorted(map(str, got.select("k", "x", "n", "m").collect())) == sorted(map(str, left.join(right, "k", how).select("k", "x", "n", "m").collect()))


def test_skew_join_spreads_absent_and_null_keys(spark):
    left = spark.range(20000).select(F.when(F.col("id") % 10 < 6, -1).when(F.col("id") % 10 < 9, F.lit(None)).otherwise(F.col("id")).alias("k"), "id").repartition(8)
    right = left.where("k > 0").select("k", F.lit(1).alias("n"), F.col("id").alias("m"))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = skew_join(left, right, "k", "n", 20000, "left")
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20000 and max(sizes) < 20000 / 8 + 100
        assert got.where("k > 0 and m = id").count() == 2000 and got.where("m is null").count() == 18000
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value)


def test_topk(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(230, 6))
    v[7] = v[8] = v[9]
    data = [(i, v[i].tolist(), 1) for i in range(230)] + [(300, None, 1), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (500, [float("nan")] * 6, 1), (600, [1.0], 1), (700, [], 1), (None, v[0].tolist(), 1)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, score int").repartition(3)
    got = collections.defaultdict(list)
    for r in topk.top_k(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    q = np.floor(v * 1024).astype(int)
    valid = {i: q[i] for i in range(230)} | {600: np.array([1024, 0, 0, 0, 0, 0]), 700: np.zeros(6, int)}
    for i in (0, 100, 200, 600, 700):
        assert got[i] == [(b, -a) for a, b in sorted((-int(valid[i] @ x), j) for j, x in valid.items() if j != i)[:10]]
    assert set(got) == {0, 100, 200, 600, 700}
    assert topk.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_bpe(docs, nothing, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    want = []
    for r in rows:
        ids = theirs.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, bpe.round_trip(docs, path).collect()))) == sorted(map(str, want))
    assert bpe.round_trip(nothing, path).count() == 0
    texts = bpe.decode(bpe.encode(docs, path), path)
    assert texts.count() == len(rows)


def test_language_id(spark, nothing):
    rng = random.Random(1)
    langs = {"xx": "kara miro sano telu", "yy": "bigg dorf zwick plotz"}
    make = lambda t: " ".join(rng.choice(t.split()) for _ in range(20))
    data = [(i, make(t), lang) for i in range(120) for lang, t in [list(langs.items())[i % 2]]] + [(900, None, "xx"), (901, "12 34", None), (901, make(langs["xx"]), None)]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = language_id.language_id(table).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id < 900:
            assert r.lang_pred == ["xx", "yy"][r.doc_id % 2] and r.score > 0.9
    assert sorted((r.doc_id, r.lang_pred) for r in got if r.doc_id >= 900) == [(900, "und"), (901, "und"), (901, "xx")]
    assert language_id.language_id(nothing).count() == 0
    unlabelled = table.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.language_id(unlabelled).collect()} == {"und"}


def check_packing(got, texts, path, capacity):
    theirs = Tokenizer.from_file(path)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spots in by.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    want = collections.Counter()
    for key, text in texts:
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, 0]
        start, piece = 0, 0
        while start < len(ids):
            size = min(len(ids), len(ids) % capacity or capacity) if not piece else capacity
            want[(key, piece, start, size, zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes()))] += 1
            start, piece = start + size, piece + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    total = sum(r.length for r in got)
    assert len(by) <= 1.05 * total / capacity + 1


def test_packing(docs, nothing, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_packing(packing.pack(docs, path).collect(), [r[:2] for r in rows], path, 2048)
    assert packing.pack(nothing, path).count() == 0


def brute_join(rows):
    sets = [shingles(r[1]) for r in rows]
    near = lambda a, b: a and b and 5 * len(a & b) >= 4 * len(a | b)
    n, parent = len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if near(sets[i], sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return [(r[0], None if r[0] is None else least[find(i)], links[i]) for i, r in enumerate(rows)]


def test_jaccard_join(spark, docs, nothing, rows):
    got = sorted(map(str, map(tuple, jaccard.jaccard_join(docs).collect())))
    assert got == sorted(map(str, brute_join(rows)))
    assert jaccard.jaccard_join(nothing).count() == 0


@pytest.mark.parametrize("blob_bytes", [1 << 22, 1000])
def test_jaccard_join_splits_large_components(spark, monkeypatch, blob_bytes):
    monkeypatch.setattr(jaccard, "BLOB", 4)
    monkeypatch.setattr(jaccard, "BLOB_BYTES", blob_bytes)
    monkeypatch.setattr(jaccard, "CHUNK", 3)
    rng = random.Random(2)
    base = words(60, 9).split()
    data = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = f"new{rng.randrange(1000)}"
        data.append((i, " ".join(w)))
    got = jaccard.jaccard_join(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(brute_join(data))


def test_jaccard_join_of_very_long_texts_and_shared_ids(spark):
    long = words(1_000_000, 12)
    other = long.rsplit(" ", 1000)[0] + " " + words(1000, 13)
    data = [(1, long), (2, other), (3, long.replace(" ", "\n", 5)), (4, words(300, 14)), (4, words(300, 15)), (4, words(300, 14)), (None, words(300, 15)), (5, words(300, 14) + " end")]
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    assert sorted(map(str, map(tuple, jaccard.jaccard_join(table).collect()))) == sorted(map(str, brute_join(data)))
    kept = jaccard.without_near_duplicates(table.withColumn("node", F.lit("x")))
    assert sorted((str(r.doc_id), hashlib.md5(" ".join(r.text.split()).encode()).hexdigest()) for r in kept.collect()) == sorted((str(i), hashlib.md5(t.encode()).hexdigest()) for i, t in [data[0], data[3], data[4], data[6]])


def test_forest_joins_prefixes_across_ranges(spark):
    """However the sorted rows are dealt into ranges, rows that share a prefix are joined."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    rng = np.random.default_rng(4)
    paths = rng.integers(0, 2, (60, jaccard.TREES, jaccard.DEPTH), dtype=np.uint16)
    nodes = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(paths)], "node long, signature binary")
    try:
        for ranges in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            trie = jaccard.forest(nodes, 5)
            for length in (5, 7, 10):
                links = [(r.node, r.firsts[length - 5]) for r in trie.where(F.col("lcp") >= length).collect()] + [(a, b) for a, b, n in jaccard.across(trie) if n >= length]
                root = list(range(60))

                def find(x):
                    while root[x] != x:
                        x = root[x]
                    return x

                for a, b in links:
                    assert any((paths[a, t, :length] == paths[b, t, :length]).all() for t in range(jaccard.TREES))
                    root[find(a)] = find(b)
                want = list(range(60))
                for t in range(jaccard.TREES):
                    by = collections.defaultdict(list)
                    for i in range(60):
                        by[paths[i, t, :length].tobytes()].append(i)
                    for group in by.values():
                        for x in group:
                            old, new = want[x], want[group[0]]
                            want = [new if y == old else y for y in want]
                assert len({find(i) for i in range(60)}) == len(set(want))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def brute_dedup(rows):
    texts = [(r[1] or "").encode() for r in rows]
    n = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if n[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
        kept = np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()
        out.append((r[0], len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(docs, nothing, rows):
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_dedup(rows)))
    assert suffix_dedup.suffix_dedup(nothing).count() == 0
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows) and left.where("text is null").count() == 2


def test_suffix_dedup_splits_common_anchors(spark, monkeypatch):
    passage = words(60, 11)
    data = [(i, f"{i} " * (i % 5) + words(12, 100 + i) + passage + words(12, 200 + i)) for i in range(30)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 6)
    monkeypatch.setattr(suffix_dedup, "BATCH", 8)
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(brute_dedup(data))


def test_licences(spark):
    mit = "Released under the MIT License."
    data = [(1, "a/LICENSE", f"{mit}\n" + words(300, 1)), (2, "a/b/c.txt", "no notice"), (3, "a/b/d.txt", words(50, 2) + "\nLicensed under the Apache License, Version 2.0."), (4, "z/x.txt", None), (5, None, ""), (6, "ab/c.txt", "x"), (2, "a/b/c.txt", "no notice"), (7, "z/y/long.txt", ("license " + words(5000, 3)))]
    table = spark.createDataFrame([(*d, 1.0) for d in data], "doc_id long, path string, text string, score double")
    got = sorted((r.doc_id, r.licence, r.origin, r.from_dir) for r in licences.scan(table).collect())
    none = [(k, None, "none", None) for k in (4, 5, 6, 7)]
    assert got == sorted([(1, "MIT", "header", None), (2, "MIT", "inherited", "a"), (2, "MIT", "inherited", "a"), (3, "Apache-2.0", "header", None), *none], key=str) or sorted(got, key=str) == sorted([(1, "MIT", "header", None), (2, "MIT", "inherited", "a"), (2, "MIT", "inherited", "a"), (3, "Apache-2.0", "header", None), *none], key=str)
    assert licences.scan(table.limit(0)).count() == 0


def test_quality(spark, docs, nothing, rows):
    judged = quality.judge(docs, quality.fit(docs)).collect()
    assert len(judged) == len(rows)
    got = {r.doc_id: r for r in judged}
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept
    assert got[10].n_words == 1 and got[9].n_words == 20000
    clean = [(i, words(150, 50 + i), "en") for i in range(40)]
    junk = [(100 + i, " ".join(f"{w}###" for w in words(150, 50 + i).split()), "en") for i in range(3)]
    table = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.judge(table, quality.fit(table)).collect()}
    assert all(kept[i] for i, _, _ in clean) and not any(kept[i] for i, _, _ in junk)
    assert quality.judge(nothing, quality.fit(nothing)).count() == 0


def test_warc(spark):
    big, small = "é" * 600, "x" * 999
    data = [(1, "http://a", big), (5, "http://b", big), (3, None, big), (3, None, big), (7, "u", small), (8, "u", small), (9, "u", None), (10, "u", ""), (None, "u", big), (None, "u", "y" * 2000)]
    table = spark.createDataFrame([(*d, "z") for d in data], "page_id long, url string, html string, refers_to string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(table).collect()), key=str)
    want = []
    for k, _, h in data:
        raw = (h or "").encode()
        revisit = h == big and k != 5
        want.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(table.limit(0)).count() == 0


def test_url_rules(spark):
    cases = {
        "http://Example.COM/en/1": ("example.com", "/en/1", "com/en/", "block"), "https://a.example.com/en/77?x#y": ("a.example.com", "/en/77", "example.com/en/7", "allow"),
        "http://m.example.net/de/81": ("m.example.net", "/de/81", "example.net/de/8", "block"), "http://example.net/de/7": ("example.net", "/de/7", "net/de/", "allow"),
        "http://xexample.net/de/8": ("xexample.net", "/de/8", "net/de/", "allow"), "http://x.org/es/": ("x.org", "/es/", "org/es/", "block"), "http://x.org/es": ("x.org", "/es", None, "allow"),
        "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://": ("", "", None, "allow"), "http://com?q=/en/": ("com", "", None, "allow"), "http://com/en/" + "a" * 50000: ("com", "/en/" + "a" * 50000, "com/en/", "block"),
    }
    data = [(i, u, "c") for i, u in enumerate(cases)] + [(0, "http://Example.COM/en/1", "c")]
    got = url_rules.judge_urls(spark.createDataFrame(data, "page_id long, url string, rule string"))
    want = [(i, *cases[u]) for i, u, _ in data]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_pipeline_stages(spark, docs, nothing, sf):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, sf).columns == docs.columns, name
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
    first = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    want = {r[1] for r in brute_join([tuple(x) for x in docs.select("doc_id", "text").collect()]) if r[0] is not None}
    assert sorted(r.doc_id for r in first if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in first) == 1
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_packing(corpus_pipeline.pack(spark, docs, sf).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()], path, 2048)


def test_pipeline_stages_with_clashing_names(spark, docs, sf):
    """Columns that are named like the operators' own change nothing and come through."""
    names = "kept score n_words lang_pred _text _digest _kept _weight _id row raw digest node gram weight signature component blob grams held_out".split()
    plain = docs.drop(*names)
    clash = plain.withColumns({n: F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    for name, stage in corpus_pipeline.STAGES:
        got, want = stage(spark, clash, sf), stage(spark, plain, sf)
        if name != "best_fit_packing":
            assert got.columns == clash.columns, name
            assert got.where(" or ".join(f"`{n}` <> concat('{n} ', coalesce(cast(doc_id as string), '-'))" for n in names)).count() == 0
        of = [c for c in want.columns if c not in ("sequence_id", "offset")]
        assert sorted(map(str, map(tuple, got.select(*of).collect()))) == sorted(map(str, map(tuple, want.collect() if of == want.columns else want.select(*of).collect()))), name


def test_pipeline(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    ids = {r.doc_id for r in got}
    assert 0.3 * documents.count() < len(ids) < documents.count() and len({(r.doc_id, r.piece) for r in got}) == len(got)


def test_language_training_passes_counts_on(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"the rain of day {i % 7} falls", "en") for i in range(40)] + [(i, f"der regen am tag {i % 5}", "de") for i in range(40, 80)] + [(80, None, "de"), (81, "x", None), (82, "", "fr")], "doc_id long, text string, lang string")
    whole = language_id.train(rows, "doc_id", "text", "lang")
    monkeypatch.setattr(language_id, "HELD", 60)
    parts = language_id.train(rows, "doc_id", "text", "lang")
    assert whole.names == parts.names == ["de", "en"] and (whole.masks == parts.masks).all()
    assert parts.predict("the rain")[0] == "en"


def test_prefix_of_the_forest_does_not_depend_on_what_is_seen(spark, monkeypatch):
    """Neighbours that are nearly equal do not lengthen the prefix, which would risk links at the threshold."""
    rng, seen = np.random.default_rng(4), []
    texts = []
    for _ in range(6):
        words = [f"w{x}" for x in rng.integers(0, 10_000, 300)]
        texts += [" ".join(words), " ".join([*words, "end"])]
    monkeypatch.setattr(jaccard, "meetings", lambda wide, nodes, length, plain=jaccard.meetings: seen.append(length) or plain(wide, nodes, length))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = {r.doc_id: r.class_id for r in jaccard.jaccard_join(table).collect()}
    assert classes == {i: i - i % 2 for i in range(len(texts))}
    assert seen == [jaccard.floor_length(jaccard.TREES, jaccard.DEPTH, jaccard.SIMILARITY, jaccard.RECALL)]


def test_quality_references_count_every_document(spark, monkeypatch):
    """2100 short documents and one long one, whatever their ids; counts are passed on in parts."""
    rows = [(i, "so it goes", "en") for i in range(2100)] + [(5000, "rare " * 7000, "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (1 << 18, 4):
        monkeypatch.setattr(quality, "FIT_WORDS", most)
        references = quality.fit(table)
        assert dict(zip(references.common[0], references.words[0].tolist(), strict=False)) == {b"rare": 7000, b"so": 2100, b"it": 2100, b"goes": 2100}
        assert references.classes[0].sum() == sum(len(t) for _, t, _ in rows)
