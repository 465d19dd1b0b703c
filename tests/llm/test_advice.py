"""Tests of what the review found missing."""

import collections
import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import language_id, licences, quality, topk


def test_topk_with_repeated_ids(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 6))
    nearest = int(np.argsort(-(v @ v[0]))[1])
    data = [(i, v[i].tolist()) for i in range(120)]
    # the query's own row and its best answer fill more than k places each; id 50 has different vectors
    data += [data[0]] * 15 + [data[nearest]] * 30 + [(50, v[j].tolist()) for j in range(50, 75)]
    best = collections.defaultdict(dict)
    for query in (0, 100):
        q = np.floor(v[query] * 1024).astype(int)
        for i, x in data:
            if i != query:
                best[query][i] = max(best[query].get(i, -(1 << 60)), int(np.floor(np.array(x) * 1024).astype(int) @ q))
    for few in (data, data[:1] * 20 + data[1:4] * 20):
        got = collections.defaultdict(list)
        for r in topk.top_k(spark.createDataFrame(few, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        have = {i for i, _ in few}
        want = {q: [(b, -a) for a, b in sorted((-s, i) for i, s in best[q].items() if i in have)[:10]] for q in (0, 100) if q in have}
        assert got == want


def wrapped(text, width=9):
    w = text.split()
    return "\n".join("# " + " ".join(w[i : i + width]) for i in range(0, len(w), width))


def test_licences_across_lines_and_in_full(spark):
    texts = {p.name: p.read_text() for p in (Path(licences.__file__).parent / "licence_texts").iterdir()}
    code = "\n".join(f"value{i} = compute(item{i}, other{i % 7})" for i in range(150))
    mit = texts["MIT"].split("\n\n", 1)[1] if texts["MIT"].startswith("MIT") else texts["MIT"]
    cases = {f"full/{name}/x.txt": (text, name) for name, text in texts.items()}
    cases |= {
        "tag/1": ("// SPDX-License-Identifier: MIT\n" + code, "MIT"), "tag/2": ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        "tag/3": ("/* SPDX-License-Identifier: MPL-2.0 */", "MPL-2.0"), "tag/4": (code + "\n# SPDX-License-Identifier: GPL-3.0-only\n" + code, "GPL-3.0"),
        "tag/5": ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND Zlib", "Apache-2.0"), "tag/6": ("SPDX-License-Identifier: Zlib", "Zlib"),
        "head/mit": (wrapped(mit) + "\n" + code, "MIT"), "head/after": (code + "\n" + wrapped(mit) + "\n" + code, "MIT"),
        "head/apache": (wrapped(licences.TEMPLATES["Apache-2.0"][0]) + "\n" + code, "Apache-2.0"),
        "head/gpl": (wrapped(licences.TEMPLATES["GPL-3.0"][0]) + "\n" + code, "GPL-3.0"), "head/lgpl": (wrapped(licences.TEMPLATES["LGPL-3.0"][0], 5) + "\n" + code, "LGPL-3.0"),
        "head/short": (code + "\nThis work is licensed under the GNU\nGeneral Public License,\nversion 3.\n" + code, "GPL-3.0"),
        "none/1": ("the driver had no license and " + code * 9, None), "none/2": ("copyright\n" + "the of and to in that it was for on as with his be at by this had not are " * 300, None),
    }
    cases |= {"full/MIT/below.c": ("int x;", "MIT"), "head/below.c": ("int x;", None)}
    data = [(i, path, text) for i, (path, (text, _)) in enumerate(cases.items())]
    got = {r.path: r.licence for r in licences.scan(spark.createDataFrame(data, "doc_id long, path string, text string")).collect()}
    assert got == {path: want for path, (_, want) in cases.items()}


def test_more_than_64_languages(spark):
    rng = random.Random(6)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 70 * 12)]
    data = []
    for k in range(70):
        own = ["".join(rng.choices(letters[12 * k : 12 * k + 12], k=4)) for _ in range(60)]
        data += [(100 * k + i, " ".join(rng.choices(own, k=150)), f"l{k:02}") for i in range(8)]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string").coalesce(2)
    assert {r.doc_id: r.lang_pred for r in language_id.language_id(table).collect()} == {i: lang for i, _, lang in data}
    assert all(r.kept for r in quality.judge(table, quality.fit(table)).collect())
