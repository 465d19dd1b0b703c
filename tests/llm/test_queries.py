"""The registered queries over the smallest data: SQL where there is some, else brute force."""

import collections
import itertools
import math
import os
import re

import duckdb
import pytest

from lodestar.llm import licences, queries
from tests.llm.test_operators import brute_dedup, brute_join


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, cursor.fetchall()))


def test_joins_equal_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op5_jaccard(spark, sf).collect())) == sorted(brute_join(rows))
    assert sorted(map(tuple, queries.op6_suffix_dedup(spark, sf).collect())) == sorted(brute_dedup(rows))


def test_language_and_quality(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in documents.collect()}
    got = [r for r in queries.op3_language(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.95 * len(got)
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = {r.doc_id: r for r in queries.op8_quality(spark, sf).collect()}
    clean = [judged[k] for k, q in marks.items() if q == 1 and not judged[k].base_failed]
    assert sum(r.kept for r in clean) >= 0.95 * len(clean)


def brute_licences(files):
    """What the docstring of licences says, for rows (id, path, text), without DataFrames."""
    idf, rare, templates = licences.template_vectors(licences.TEMPLATES)
    cue, known = re.compile(licences.CUE), {k.lower(): k for k in licences.TEMPLATES}

    def score(words):
        v = {w: (1 + math.log(n)) * idf.get(w, rare) for w, n in collections.Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return min(((-sum(x * t.get(w, 0) for w, x in v.items()) / norm, k) for k, t in templates), key=lambda x: (round(x[0], 9), x[1]))

    def own(text):
        if not cue.search(text or ""):
            return None
        lines = [re.findall(licences.WORD, line.lower()) for line in text.split("\n")]
        words = [w for line in lines for w in line]
        spans, smaller, held = [], 0, 0.0
        for size in licences.SIZES:
            if len(words) > smaller:
                spans += [words[i : i + size] for i in range(0, max(1, len(words) - size + size // 4), size // 4)]
            smaller = size
        found, matched = [], 0
        for is_line, span in [*((True, x) for x in lines), *((False, x) for x in spans)]:
            if span and cue.search(" ".join(span)):
                s, name = score(span)
                if -s >= licences.THRESHOLD:
                    found.append((s, name))
                    matched += len(span) if is_line else 0
                    held = max(held, 0 if is_line else len(span) * s * s)
        tags = []
        for expression in re.findall(licences.TAG, text):
            for i in re.findall(licences._ID, re.sub(r"(?i)\bwith\s+\S+", "", expression)):
                name = known.get(re.sub(r"(-only|-or-later|[+])$", "", i.lower()), i if re.search("[A-Z0-9]", i) else None)
                if i.lower() not in ("and", "or", "none", "noassertion") and name:
                    tags.append((-1.0, name))
        if not found + tags:
            return None
        s, name = min(found + tags, key=lambda x: (round(x[0], 9), x[1]))
        return -s, name, max(matched, held, 4.0 * len(tags)) / max(1, len(words))

    files = [(i, p or "", own(t)) for i, p, t in files]
    speaks = {}
    for _, p, o in files:
        if o and (o[2] >= licences.FILE_SHARE or re.search(licences.NAME, p)):
            where = p.rpartition("/")[0]
            speaks[where] = min(speaks.get(where, (9, "")), (-o[0], p, o[1]))
    out = []
    for i, p, o in files:
        above = [a for a in itertools.accumulate(p.split("/")[:-1], lambda x, y: f"{x}/{y}")]
        near = next((a for a in ["", *above][::-1] if a in speaks), None)
        out.append((i, p, o[1], o[0], "header", None) if o else (i, p, speaks[near][2], -speaks[near][0], "inherited", near) if near is not None else (i, p, None, None, "none", None))
    return out


def test_licences(spark, sf, monkeypatch):
    asked, scan = [], licences.scan
    monkeypatch.setattr(licences, "scan", lambda files: asked.append(files) or scan(files))
    got = queries.op7_licences(spark, sf).collect()
    want = brute_licences([tuple(r) for r in asked[0].collect()])
    plain = lambda rows: sorted(map(str, ((i, p, x, s and round(s, 5), o, d) for i, p, x, s, o, d in rows)))
    assert plain(map(tuple, got)) == plain(want) and {"header", "none"} <= {r.origin for r in got}
