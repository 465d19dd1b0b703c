"""The parts of the corpus operators against brute force, without Spark."""

import collections
import gzip
import io
import json
import random
import zipfile

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm import jaccard, language_id, licences, packing, quality, suffix_dedup, topk, warc
from lodestar.llm.bpe import Vocabulary, merge
from lodestar.llm.suffix_array import common_prefixes, suffix_array

TEXTS = ["", " ", "a", "Hello, World's  end", "x" * 3000, "ÀΣς İ ﬁ é", "日本語 テスト", "1234 5.6", "a\u0085b c　d\x1ce", "<|endoftext|>a<|startoftext|>", "\n \n a \n", "a  b   c ", "don't we'll I'D", "😀😀 é"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_the_library(name):
    path = public_tokenizers.path(name)
    mine, theirs = Vocabulary(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    parts = ["the", " ", "\n", "Ing", "ß", "'s", "!", "12", "  ", "<|endoftext|>", "é", "\t", "漢"]
    for text in [*TEXTS, *("".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(500))]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        got, strings = mine.encode(text)
        assert np.frombuffer(got, np.uint32).tolist() == ids
        assert mine.text(ids) == theirs.decode(ids, skip_special_tokens=False)
        if mine.by_word:
            assert " ".join(strings) == mine.text(ids)
        else:
            assert packing.token_ids(text, path).tolist() == ids


@given(st.lists(st.integers(0, 3), max_size=40), st.randoms())
@settings(max_examples=150, deadline=None)
def test_merge_takes_the_leftmost_lowest_rank(ids, rng):
    pairs = [(a, b) for a in range(8) for b in range(8)]
    rng.shuffle(pairs)
    ranks = {a << 20 | b: r << 20 | (4 + r % 4) for r, (a, b) in enumerate(pairs[:20])}
    want = list(ids)
    while len(want) > 1:
        known = [(ranks[a << 20 | b] >> 20, i) for i, (a, b) in enumerate(zip(want, want[1:], strict=False)) if a << 20 | b in ranks]
        if not known or len(want) < 2:
            break
        _, i = min(known)
        want[i : i + 2] = [ranks[want[i] << 20 | want[i + 1]] & 0xFFFFF]
        if len(want) > 60:
            break
    assert merge(list(ids), ranks) == want


@given(st.lists(st.integers(0, 2), max_size=40))
@settings(max_examples=200, deadline=None)
def test_suffix_array(x):
    order = sorted(range(len(x)), key=lambda i: x[i:])
    assert suffix_array(x) == order
    shared = lambda a, b: next((k for k in range(len(x)) if a + k >= len(x) or b + k >= len(x) or x[a + k] != x[b + k]), len(x))
    assert common_prefixes(x, order) == [0] * (len(x) > 0) + [shared(a, b) for a, b in zip(order, order[1:], strict=False)]


def test_bit_sliced_search_is_exact(monkeypatch):
    rng = np.random.default_rng(2)
    for n, d, size, words in ((300, 8, 600, 512), (70, 3, 20, 1), (5, 4, 900, 3), (130, 1, 3, 8), (200, 5, 1 << 29, 64)):
        monkeypatch.setattr(topk, "WORDS", words)
        exact = rng.integers(-size, size, (n, d))
        exact[n // 2] = exact[n // 3]
        ids = rng.permutation(n).astype(np.int64)
        block = topk.Block(ids, exact.min(0), topk.sliced(exact, exact.min(0)))
        qids, queries = ids[:6], np.pad(exact[:6], ((0, 0), (0, 2)))
        queries[-1] = 0
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in qids]
        topk.search_block(block, qids, queries, 10, best)
        for qid, q, (s, r) in zip(qids, queries, best, strict=True):
            want = sorted((-int(sum(int(a) * int(b) for a, b in zip(exact[k], q, strict=False))), int(ids[k])) for k in range(n) if ids[k] != qid)[:10]
            assert [(-int(a), int(b)) for a, b in zip(s, r, strict=True)] == want


def test_few_rows_are_resolved(monkeypatch):
    """The slices decide: besides the answers only rows that tie with the last one are looked at."""
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    good, values = topk.quantised(table.column("embedding").combine_chunks(), 1024.0)
    ids = np.asarray(table.column("vec_id"))[good].astype(np.int64)
    looked, asked, resolve = [], ids % 100 == 0, topk.resolve
    monkeypatch.setattr(topk, "resolve", lambda s, places, o: looked.append(len(places)) or resolve(s, places, o))
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids[asked]]
    topk.search_block(topk.Block(ids, values.min(0), topk.sliced(values, values.min(0))), ids[asked], values[asked], 10, best)
    assert len(looked) == asked.sum() and sum(looked) < 0.02 * len(ids) * len(looked)


def test_bins_are_full_and_nothing_is_lost():
    rng = random.Random(4)
    for capacity, top, n in ((20, 20, 200), (2048, 2048, 3000), (10, 3, 50), (7, 7, 1)):
        lengths = [rng.randrange(1, top + 1) for _ in range(n)]
        counts = collections.Counter(lengths)
        fill, placed = collections.Counter(), collections.Counter()
        spots = set()
        for x, low, high, first, each, offset in packing.plan_bins(counts, capacity):
            for r in range(high - low):
                b, at = first + r // each, offset + r % each * x
                spots.add((b, at))
                fill[b] += x
                placed[x] += 1
        assert placed == counts and len(spots) == n and max(fill.values()) <= capacity
        assert len(fill) == max(fill) + 1 and len(fill) <= 1.02 * sum(lengths) / capacity + 2


def test_fullest_bin():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randrange(1, 12): rng.randrange(1, 3) for _ in range(4)}
        capacity = 15
        got = packing.fullest(sorted(counts), counts, capacity)
        sums = {max(counts)}
        pool = [x for x, c in counts.items() for _ in range(c - (x == max(counts)))]
        for x in pool:
            sums |= {s + x for s in sums if s + x <= capacity}
        assert sum(got) == max(sums) and not collections.Counter(got) - collections.Counter(counts)


def test_packages_and_zip64():
    pages = [(k, f"http://h/{k}", f"<p>{k}</p>é".encode(), "d" * 40, 1 if k == 2 else None) for k in range(5)] + [(None, None, b"", "e", None)]
    for zip64 in (False, True):
        raw = warc.package([(p[0], warc.record(*p)) for p in pages], zip64)
        with zipfile.ZipFile(io.BytesIO(raw)) as z:  # an independent reader
            assert z.testzip() is None and z.namelist() == ["archive/data.warc.gz", "indexes/index.jsonl"]
            assert gzip.decompress(z.read("archive/data.warc.gz")).count(b"WARC/1.1") == 6
        got = list(warc.read_package(io.BytesIO(raw)))
        assert [(g[0], g[1]["warc-type"], g[3]) for g in got] == [(p[0], "revisit" if p[4] is not None else "response", b"" if p[4] is not None else p[2]) for p in pages]
        assert int(got[2][2]["content-length"]) == len(pages[2][2])
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"nothing"))
    assert list(warc.read_package(io.BytesIO(warc.package([])))) == []
    assert {"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(got[0][1])  # those that WARC/1.1 requires


def test_a_package_of_several_archives_and_indexes():
    out = io.BytesIO()
    store = warc.ZipStore(out, True)
    for name in "ab":
        data = warc.record(name, None, name.encode() * 3, "d", None)
        store.add(f"archive/{name}.warc.gz", b"junk" + data)
        store.add(f"indexes/{name}.jsonl", json.dumps({"page_id": name, "filename": f"{name}.warc.gz", "offset": 4, "length": len(data)}).encode())
    store.close()
    assert [(g[0], g[3]) for g in warc.read_package(out)] == [("a", b"aaa"), ("b", b"bbb")]
    assert [g[0] for g in warc.read_package(out, ["indexes/b.jsonl"])] == ["b"]


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@given(st.text(alphabet="ab #é\n\t\r\x0b\x1c 日", max_size=80))
@settings(max_examples=300, deadline=None)
def test_quality_counts(text):
    assert quality.base_counts(text)[2] == brute_counts(text)


def test_distance():
    assert quality.distance(np.array([1.0, 1]), np.array([2.0, 2])) == 0
    assert quality.distance(np.array([1.0, 0]), np.array([0, 3.0])) == 1


def test_language_filter_corrects_and_guards():
    known = {"aa": np.unique(language_id.grams(language_id.letters_only("la la land lala"))), "bb": np.unique(language_id.grams(language_id.letters_only("zig zag zug")))}
    model = language_id.Filter(known)
    assert model.predict("Lala LAND")[0] == "aa" and model.predict("zug zig")[0] == "bb"
    assert model.predict(None) == ("und", 0.0) and model.predict("12 !?") == ("und", 0.0) and model.predict("") == ("und", 0.0)
    assert model.predict("x")[0] in ("aa", "bb")
    assert language_id.Filter({}).predict("abc") == ("und", 0.0)
    masks = model.languages(known["aa"])
    assert (masks & np.uint64(1)).all()  # no false negatives


def test_linked_sets():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 30)).astype(np.uint64)) for _ in range(60)]
    near = jaccard.linked(sets, sets, 0.6)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert near[i, j] == (both >= 0.6 * (len(a) + len(b) - both) - 1e-6)
    assert (jaccard.linked(sets[:20], sets[20:], 0.6) == near[:20, 20:]).all()


def test_prefix_length():
    """The prefix is shortened as far as the similarities seen need it, and never beyond what the threshold needs."""
    assert jaccard.floor_length(24, 10, 0.8, 0.9999) == 5 and jaccard.floor_length(1, 10, 0.8, 0.9999) == 1
    length = lambda *near: jaccard.prefix_length(np.array(near), 5, 24, 10, 0.8, 0.9999)
    assert length() == 5 and length(0.5, 0.6) == 5 and length(0.8) == 5 and length(0.76, 0.99) == 5
    assert length(1.0, 1.0) == 10 and 5 < length(0.93) < 10 and length(0.93) <= length(0.95) <= length(0.99)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for same in (1000, 1800, 2000):
        other = np.concatenate([base[:same], rng.integers(0, 1 << 63, 2000 - same, dtype=np.uint64)])
        a, b = jaccard.signatures_of([base, other])
        assert a.shape == (24, 10) and abs((a == b).mean() - same / (4000 - same)) < 0.12


def test_anchor_ranges_cover_every_string_once():
    rng = np.random.default_rng(3)
    for raw in (rng.integers(0, 3, 900).astype(np.uint8), np.zeros(700, np.uint8), np.frombuffer(b"abcdefg" * 100, np.uint8), rng.integers(0, 255, 200).astype(np.uint8)):
        at, _, first, last = suffix_dedup.anchors(raw)
        assert first[0] == 0 and last[-1] == len(raw) - 199 and (first[1:] == last[:-1]).all()
        assert (at >= last - 1).all() and (at + 40 <= first + 200).all()
    assert len(suffix_dedup.anchors(np.zeros(199, np.uint8))[0]) == 0


def test_repeated_in_equals_brute_force():
    rng = random.Random(9)
    passage = bytes(rng.randrange(97, 123) for _ in range(400))
    contexts, groups = [], []
    for k in range(40):
        a, b = rng.randrange(0, 150), rng.randrange(220, 400)
        edge = bytes(rng.randrange(97, 123) for _ in range(60))
        contexts.append(edge[: rng.randrange(60)] + passage[a:b] + edge[: rng.randrange(60)])
        groups.append(k % 3)
    contexts = [c if len(c) >= 200 else c + bytes(rng.randrange(97, 123) for _ in range(200)) for c in contexts]
    got = suffix_dedup.repeated_in(contexts, [1] * 40, groups)
    for k, c in enumerate(contexts):
        others = collections.Counter(x[i : i + 200] for x, g in zip(contexts, groups, strict=True) if g == groups[k] for i in range(len(x) - 199))
        assert got[k].tolist() == [i for i in range(len(c) - 199) if others[c[i : i + 200]] > 1]


def test_merged_ranges():
    assert suffix_dedup.merged(np.array([[5, 9], [0, 3], [3, 4], [6, 7]])).tolist() == [[0, 4], [5, 9]]
    assert suffix_dedup.ranges(np.array([0, 1, 200, 500])).tolist() == [0, 400, 500, 700]


def test_template_vectors_are_unit():
    _, _, vectors = licences.template_vectors(licences.TEMPLATES)
    assert all(abs(sum(x * x for x in v.values()) - 1) < 1e-9 for _, v in vectors)


@pytest.mark.parametrize("step", [1, 2, 3, 4, 7, 1000])
def test_language_steps_count_every_gram_once(monkeypatch, step):
    monkeypatch.setattr(language_id, "STEP", step)
    for text in TEXTS:
        points = language_id.letters_only(text)
        parts = list(language_id.steps(points))
        assert sorted(np.concatenate(parts).tolist()) == sorted(language_id.grams(points).tolist())
