"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by path.

DataFrame functions only. A text is read as one run of words, across line ends. Its lines and, at every
size 16, 64, 256, 1024 and 4096, its windows at each quarter of the size (the last size that holds the
whole text gives one window) are scored if they speak of a licence: their TF-IDF vector (logarithmic
counts; inverse document frequencies over the templates; unknown words weigh as the rarest) is compared
with every template, be it a short notice, a usual header or a full licence text. The best template
counts if the cosine reaches the threshold. SPDX tags are read as such, with score 1: identifiers of
templates (also with -only, -or-later or +) name these, others are returned as written; of several in
an expression the smaller name counts. A file in which matching lines, a tag, or the best window times
its squared cosine hold a fifth of all words, or whose name says LICENSE, LICENCE or COPYING, is a
licence file and speaks for its directory. Files without a header of their own inherit from the licence
file in the nearest ancestor directory, found by joins of directory paths with their ancestors.

Null texts have no header; null paths lie in the root directory (""). Ties go to the template with the
smaller name and, among licence files of a directory, to the higher score and then the smaller path.
Rows are judged one by one, so repeated rows and ids are kept. Empty tables give empty results. Extra
columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut, skew_join

_FREE = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} General Public License for more details. You should have received a copy of the GNU {1} General Public License along with this {0}. If not, see <https://www.gnu.org/licenses/>."
#: Usual notices of licences; a licence may have several.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the above copyright notice is retained."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "GPL-2.0": [_FREE.format("program", "", "2")],
    "GPL-3.0": [_FREE.format("program", "", "3"), "This work is licensed under the GNU General Public License, version 3.", "You can redistribute it under the terms of the GNU General Public License."],
    "LGPL-2.1": [_FREE.format("library", "Lesser", "2.1")],
    "LGPL-3.0": [_FREE.format("library", "Lesser", "3"), "This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy, subject to the above copyright notice."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Full licence texts, by name.
for _path in sorted((Path(__file__).parent / "licence_texts").iterdir()):
    TEMPLATES.setdefault(_path.name, []).append(_path.read_text("utf-8"))
CUE, WORD, NAME = r"(?i)licen[cs]e|copyright|spdx|creative\s+commons|public\s+domain", r"([a-z0-9]+(?:[.][0-9]+)*)", r"(?i)(^|/)(licen[cs]e|copying)[^/]*$"
_ID = r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*[+]?"
TAG = rf"(?i)spdx-license-identifier:?[ \t]*([( \t]*{_ID}(?:[) \t]+(?:and|or|with)[ \t][( \t]*{_ID})*)"
SIZES, THRESHOLD, FILE_SHARE, BUCKETS = (16, 64, 256, 1024, 4096), 0.5, 0.2, 256


def template_vectors(templates: dict[str, list[str]]) -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """Inverse document frequencies, that of unknown words, and (licence, unit vector) of each template."""
    counts = [(k, Counter(re.findall(WORD, t.lower()))) for k, texts in sorted(templates.items()) for t in texts]
    n = len(counts)
    df = Counter(w for _, c in counts for w in c)
    idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
    raw = [(k, {w: (1 + math.log(c)) * idf[w] for w, c in words.items()}) for k, words in counts]
    return idf, math.log(1 + n) + 1, [(k, {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}) for k, v in raw]


def _const(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps({"x": value}, separators=(",", ":"))), f"x {kind}")["x"]


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _bucket(word: str) -> int:
    return (ord(word[0]) + 31 * len(word)) % BUCKETS


def best_template(words: Column, templates: dict[str, list[str]], model: Column) -> Column:
    """struct(score, licence) of the template nearest to an array of at least one word; model is model_of(templates)."""
    names = [name for name, _ in template_vectors(templates)[2]]
    rare = template_vectors(templates)[1]

    def weights(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == F.size(s) - 1) | (F.get(s, i) != F.get(s, i + 1)))

        def weight(e: Column, x: Column, i: Column) -> Column:
            place = F.coalesce(F.element_at(F.get(model.places, F.pmod(F.ascii(F.get(s, x)) + 31 * F.length(F.get(s, x)), F.lit(BUCKETS))), F.get(s, x)), F.lit(-1))
            return _let(place, lambda p: F.struct(p.alias("p"), ((1 + F.log((x - F.coalesce(F.get(e, i - 1), F.lit(-1))).cast("double"))) * F.coalesce(F.get(model.idf, p), F.lit(rare))).alias("x")))

        return _let(ends, lambda e: F.transform(e, lambda x, i: weight(e, x, i)))

    def nearest(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, p: a + p.x * p.x))
        known = F.filter(v, lambda p: p.p >= 0)
        dots = _let(known, lambda k: F.transform(model.vectors, lambda t: F.aggregate(k, F.lit(0.0), lambda a, p: a + p.x * F.get(t, p.p))))
        best = _let(dots, lambda d: F.struct(F.array_max(d).alias("dot"), F.array_position(d, F.array_max(d)).cast("int").alias("at")))
        return _let(best, lambda b: F.struct((b.dot / norm).alias("score"), F.get(F.array(*map(F.lit, names)), b.at - 1).alias("licence")))

    return _let(_let(F.array_sort(words), weights), nearest)


def model_of(templates: dict[str, list[str]]) -> Column:
    """struct(places, idf, vectors): buckets of words with their places, and by place the frequencies and each template's weights."""
    idf, _, vectors = template_vectors(templates)
    vocabulary, places = sorted(idf), [{} for _ in range(BUCKETS)]
    for i, w in enumerate(vocabulary):
        places[_bucket(w)][w] = i
    return F.struct(_const(places, "array<map<string,int>>").alias("places"), _const([idf[w] for w in vocabulary], "array<double>").alias("idf"), _const([[round(v.get(w, 0), 7) for w in vocabulary] for _, v in vectors], "array<array<double>>").alias("vectors"))


def tags(text: Column, templates: dict[str, list[str]]) -> Column:
    """array of struct(score, licence, n) of the identifiers in a text's SPDX tags."""
    known = F.create_map(*[F.lit(x) for k in sorted(templates) for x in (k.lower(), k)])
    found = F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), lambda x: F.regexp_replace(x, r"(?i)\bwith\s+\S+", ""))
    ids = F.flatten(F.transform(found, lambda x: F.regexp_extract_all(x, F.lit(f"({_ID})"), F.lit(1))))
    ids = F.filter(ids, lambda i: ~F.lower(i).isin("and", "or", "none", "noassertion"))
    named = F.transform(ids, lambda i: F.coalesce(F.element_at(known, F.regexp_replace(F.lower(i), r"(-only|-or-later|[+])$", "")), F.when(i.rlike("[A-Z0-9]"), i)))
    return F.transform(F.filter(named, lambda i: i.isNotNull()), lambda i: F.struct(F.lit(1.0).alias("score"), i.alias("licence"), F.lit(4).alias("n")))


def _span(size: int, n: Column):
    return lambda a: F.struct(a.alias("at"), F.least(F.lit(size), n - a).alias("n"))


def spans(words: Column) -> tuple[Column, Column]:
    """Of an array of struct(w, line): arrays of struct(at, n) of its lines, and of its windows; at counts from 0."""
    n = F.size(words)
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(every, lambda i: (i == 0) | (F.get(words, i)["line"] != F.get(words, i - 1)["line"]))
    lines = _let(starts, lambda s: F.transform(s, lambda a, i: F.struct(a.alias("at"), (F.coalesce(F.get(s, i + 1), n) - a).alias("n"))))
    windows, smaller = [], 0
    for size in SIZES:
        at = F.when(n > smaller, F.sequence(F.lit(0), F.greatest(F.lit(0), n - size + size // 4 - 1), F.lit(size // 4))).otherwise(F.array().cast("array<int>"))
        windows.append(F.transform(at, _span(size, n)))
        smaller = size
    return lines, F.concat(*windows)


def headers(words: Column, part: Column, templates: dict[str, list[str]], model: Column) -> Column:
    """array of struct(score, licence, n) of those spans of a text that speak of a licence."""
    runs = F.transform(part, lambda p: F.transform(F.slice(words, p["at"] + 1, p["n"]), lambda x: x.w))
    cued = F.filter(runs, lambda r: F.array_join(r, " ").rlike(CUE))
    return F.transform(cued, lambda r: _let(best_template(r, templates, model), lambda b: F.struct(b.score.alias("score"), b.licence.alias("licence"), F.size(r).alias("n"))))


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, licence (null if none), score, origin (header, inherited or none), from_dir of every file."""
    rows = files.select(F.col(id_col).alias("_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    # words are looked at only where the text has a cue at all
    split = F.transform(F.split(F.when(F.col("text").rlike(CUE), F.col("text")), "\n"), lambda x, i: F.transform(F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(1)), lambda w: F.struct(w.alias("w"), i.alias("line"))))
    found = F.when(F.col("text").rlike(CUE), _let(model_of(templates), lambda m: _let(F.flatten(split), lambda w: F.struct(
        *[F.filter(headers(w, part, templates, m), lambda h: h.score >= threshold).alias(name) for name, part in zip(("lines", "windows"), spans(w), strict=True)],
        tags(F.col("text"), templates).alias("tags"), F.size(w).alias("n")))))
    lines, windows, tagged = (F.col(f"found.{c}") for c in ("lines", "windows", "tags"))
    best = F.array_min(F.transform(F.concat(lines, windows, tagged), lambda h: F.struct((-h.score).alias("minus"), h.licence.alias("licence"))))
    held = F.greatest(F.aggregate(F.concat(lines), F.lit(0), lambda a, h: a + h.n).cast("double"), F.array_max(F.transform(windows, lambda h: h.n * h.score * h.score)), F.size(tagged) * F.lit(4.0))
    rows = rows.withColumn("found", found).select(
        "_id", "path", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"),
        F.when(best.isNotNull(), F.struct((-best.minus).alias("score"), best.licence.alias("licence"))).alias("own"),
        F.when(best.isNotNull(), held / F.greatest(F.lit(1), F.col("found.n"))).alias("share"),
    )
    table = cut(rows, "files")
    speaks = table.where(F.col("own").isNotNull() & ((F.col("share") >= FILE_SHARE) | F.col("path").rlike(NAME)))
    said = speaks.groupBy(F.col("dir").alias("anc")).agg(F.min(F.struct((-F.col("own.score")).alias("minus"), "path", "own.licence")).alias("best"))
    dirs = cut(table.groupBy("dir").agg(F.count("*").alias("n")), "dirs")
    parts = F.split("dir", "/")
    up = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    chain = dirs.select("dir", "n", F.posexplode(up).alias("depth", "anc"))
    below = chain.groupBy("anc").agg(F.count("*").alias("below"))
    told = cut(said.join(below, "anc"), "told")
    met = skew_join(chain, told, "anc", "below", max(1, dirs.count()), "left").where("best is not null")  # common directories may have no licence
    nearest = met.groupBy("dir").agg(F.max(F.struct("depth", "anc", "best")).alias("near"), F.first("n").alias("n"))
    out = skew_join(table, nearest, "dir", "n", table.count(), "left")
    own = F.col("own").isNotNull()
    return out.select(
        F.col("_id").alias(id_col), "path", F.coalesce("own.licence", "near.best.licence").alias("licence"),
        F.coalesce(F.col("own.score"), -F.col("near.best.minus")).alias("score"),
        F.when(own, "header").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("near.anc")).alias("from_dir"),
    )
