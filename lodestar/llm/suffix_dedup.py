"""Removal of bytes that lie in long strings occurring more than once, with suffix arrays.

Every string of LENGTH bytes of a document is assigned to an anchor inside it: the k-gram with the
smallest hash, the rightmost of equals. Equal strings have equal anchors at equal places, so a string
can only be repeated if its anchor's k-gram is.

1. Texts that are copies are one text with a count; copies of LENGTH bytes or more go entirely.
2. k-grams that are anchors more than once are found by counting. Around each such anchor the context
   (all bytes of the strings assigned to it) is cut out; equal contexts are one, with a count.
3. Contexts meet by anchor. In a batch of anchors, contexts become sequences of content-defined phrases;
   the suffix array of all of them (linear grouping by Lyndon prefixes) and its common prefixes show
   which contexts share enough phrases to hold a repeated string. Only those go on: their strings are
   hashed (twice 64 bits), and strings with hashes that occur twice are repeated.
4. Repeated strings give byte ranges; ranges of a document are merged and removed.

An anchor with more than BLOCK different contexts, whatever the size of the input, is split into blocks, and
each two blocks meet in a group of their own. The anchors to split are broadcast if there are at most ANCHORS of
them; else they are joined, common ones apart.

Null texts count as empty. Rows sharing an id are different texts; equal rows are copies of each other.
Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut, skew_join
from lodestar.llm.shingles import mix, prefix_hashes, range_hashes
from lodestar.llm.suffix_array import common_prefixes, suffix_array

LENGTH, GRAM, BLOCK, ANCHORS = 200, 40, 1024, 100_000
#: Contexts whose suffixes are sorted together, and the window and gram that delimit phrases.
BATCH, PHRASE_GRAM, PHRASE_WINDOW = 2000, 8, 25
#: Bytes of a text that are read at once.
STEP = 1 << 23
_LOW = np.uint64(0xFFFFFF)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every width neighbours."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    table = padded.reshape(blocks, width)
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def _anchors(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, prefix = len(raw), prefix_hashes(raw)
    at = np.arange(n - gram + 1)
    hashes = range_hashes(prefix, at, at + gram)
    least = sliding_least((hashes & ~_LOW) | (_LOW - at.astype(np.uint64)), length - gram + 1)
    where = (_LOW - (least & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.diff(where, prepend=-1))
    return where[first], hashes[where[first]], first, np.append(first[1:], len(where))


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors, and the first and past-the-last start of the strings assigned to each.

    Texts beyond STEP bytes are read in steps; an anchor may then come twice, with different strings.
    """
    if len(raw) < length:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    found = []
    for low in range(0, len(raw) - length + 1, STEP):
        at, hashes, first, last = _anchors(raw[low : low + STEP + length - 1], length, gram)
        found.append((at + low, hashes, first + low, last + low))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def sharing(contexts: list[np.ndarray], least: int) -> np.ndarray:
    """Which contexts share a run of whole phrases of at least that many bytes with anything in the batch.

    Phrases start where anchors of a small gram lie, so equal bytes are cut alike except near the ends
    of a context: of equal strings of n bytes, all but 2 * (2 * PHRASE_WINDOW + PHRASE_GRAM) bytes are whole
    phrases that both have.
    """
    flat, ends = np.concatenate(contexts), np.cumsum([len(c) for c in contexts])
    cuts = np.unique(np.concatenate([anchors(flat, PHRASE_WINDOW + PHRASE_GRAM - 1, PHRASE_GRAM)[0], [0], ends[:-1]]))
    sizes = np.diff(np.append(cuts, len(flat)))
    codes = np.unique(range_hashes(prefix_hashes(flat), cuts, cuts + sizes), return_inverse=True)[1]
    owner = np.searchsorted(ends, cuts, side="right")
    # an end symbol after each context, different for all, so that no run crosses it
    after = np.searchsorted(cuts, ends)
    symbols = np.insert(codes, after, len(codes) + np.arange(len(contexts))).tolist()
    total = np.concatenate([[0], np.cumsum(np.insert(sizes, after, 0))])
    owner = np.insert(owner, after, np.arange(len(contexts)))
    order = suffix_array(symbols)
    same, order = np.array(common_prefixes(symbols, order), np.int64), np.array(order, np.int64)
    long = np.flatnonzero(total[order + same] - total[order] >= least)
    out = np.zeros(len(contexts), bool)
    out[owner[order[long]]] = True
    out[owner[order[long - 1]]] = True
    return out


def repeated_in(contexts: list[bytes], counts: list[int], groups: list[int]) -> list[np.ndarray]:
    """For each context the starts of its strings that another context of its group has too, or that count tells."""
    raws = [np.frombuffer(c, np.uint8) for c in contexts]
    out: list[np.ndarray] = [np.arange(len(r) - LENGTH + 1) if n > 1 else np.zeros(0, np.int64) for r, n in zip(raws, counts, strict=True)]
    _, at, sizes = np.unique(groups, return_inverse=True, return_counts=True)
    some = np.flatnonzero(sizes[at] > 1)
    if not len(some):
        return out
    near = some[sharing([raws[k] for k in some], LENGTH - 2 * (2 * PHRASE_WINDOW + PHRASE_GRAM))]
    if not len(near):
        return out
    flat, lengths = np.concatenate([raws[k] for k in near]), np.array([len(raws[k]) for k in near])
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    n = lengths - LENGTH + 1
    owner = np.repeat(np.arange(len(near)), n)
    inside = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    start = base[owner] + inside
    group = mix(np.asarray(groups, np.uint64)[near])[owner]  # a context may be in several groups
    keys, more = (range_hashes(prefix_hashes(flat, h), start, start + LENGTH, h) ^ group for h in (0, 1))
    _, first, code, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    if (more[first[code]] != more).any():  # one hash for different strings
        _, code, times = np.unique(np.stack([keys, more], axis=1), axis=0, return_inverse=True, return_counts=True)
    twice = times[code] > 1
    cuts = np.cumsum(n)[:-1]
    for k, mask in zip(near, np.split(twice, cuts), strict=True):
        if counts[k] < 2:
            out[k] = np.flatnonzero(mask)
    return out


def ranges(starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Merged [start, end) ranges of strings of that length, as a flat array."""
    if not len(starts):
        return starts
    gap = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])] + length], axis=1).ravel()


def merged(spans: np.ndarray) -> np.ndarray:
    """Rows (start, end), in any order and overlapping, as disjoint and not adjacent ones in order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])]], axis=1)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = _bytes(value.as_py())
            seen, n = np.unique(anchors(raw)[1].view(np.int64), return_counts=True)
            data = raw.tobytes()
            rows.append((key, hashlib.md5(data, usedforsecurity=False).digest(), len(raw), hashlib.sha256(data).hexdigest(), np.concatenate([seen, seen[n > 1]])))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], names=["doc_id", "digest", "n_bytes", "sha256", "grams"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["digest", "start", "gram", "context", "same"], [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        for text, digest, grams in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = _bytes(text.as_py())
            data = raw.tobytes()
            _, hashes, first, last = anchors(raw)
            hashes = hashes.view(np.int64)
            keep = np.isin(hashes, grams.values.to_numpy())
            parts = [data[a : b + LENGTH - 1] for a, b in zip(first[keep].tolist(), last[keep].tolist(), strict=True)]
            same = [hashlib.blake2b(p, digest_size=16).digest() for p in parts]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([digest] * len(parts), first[keep], hashes[keep], parts, same), kinds, strict=True)], names=names)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by (gram, i, j) to rows (same, ranges)."""

    def flush(rows: list) -> pa.RecordBatch:
        spans = [ranges(s) for s in repeated_in([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])]
        some = [k for k, s in enumerate(spans) if len(s)]
        return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in some], pa.binary()), pa.array([spans[k] for k in some], pa.list_(pa.int64()))], names=["same", "spans"])

    rows, last, group = [], None, 0
    for batch in batches:
        for same, context, n, gram, i, j in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (gram, i, j) != last:
                last = (gram, i, j)
                group += 1
                if len(rows) >= BATCH:
                    yield flush(rows)
                    rows = []
            rows.append((same, context, n, group))
    if rows:
        yield flush(rows)


def text_digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")))


def find_repeats(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(texts, copies, candidates, spans).

    texts: doc_id, digest, n_bytes, sha256 of each row; copies: digest, node, weight; candidates: digest,
    text of the texts with repeated anchors; spans: digest, spans (array of (start, end)) to remove.
    """
    texts = cut(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_first, "doc_id long, digest binary, n_bytes long, sha256 string, grams array<long>"), "texts")
    copies = cut(texts.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("weight"), F.first("n_bytes").alias("n_bytes")), "copies")
    single = texts.select("doc_id", "digest", "grams").join(copies.select(F.col("digest").alias("d"), "node"), F.col("digest").eqNullSafe(F.col("d")) & F.col("doc_id").eqNullSafe(F.col("node"))).dropDuplicates(["digest"]).select("doc_id", "digest", "grams")
    single = cut(single.where(F.size("grams") > 0), "single")
    every = single.select("doc_id", "digest", F.explode("grams").alias("gram"))
    often = cut(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "often")
    n_grams = often.agg(F.sum("n")).first()[0] or 0
    hits = skew_join(every, often, "gram", "n", n_grams).groupBy("doc_id", "digest").agg(F.collect_set("gram").alias("grams"))
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pick = (text_digest("text") == F.col("digest")) & F.col("id").eqNullSafe(F.col("doc_id"))  # ids may repeat or be null
    candidates = cut(whole.join(hits, pick).select("text", "digest", "grams"), "candidates")
    found = cut(candidates.mapInArrow(_contexts, "digest binary, start long, gram long, context binary, same binary"), "contexts")
    distinct = cut(found.groupBy("gram", "same").agg(F.first("context").alias("context"), F.count("*").alias("n")), "distinct")
    sizes = cut(distinct.groupBy("gram").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / (BLOCK // 2)).cast("int")), "sizes")
    if sizes.count() <= ANCHORS:
        met = distinct.join(F.broadcast(sizes.select("gram", "blocks")), "gram", "left")
    else:
        met = skew_join(distinct, sizes, "gram", "size", distinct.count(), "left")
    own = F.pmod(F.xxhash64("same", F.lit("block")), F.col("blocks")).cast("int")
    met = met.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("same", "context", "n", "gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")
    ranged = met.mapInArrow(_meet, "same binary, spans array<long>").groupBy("same").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    weights = found.groupBy("same").agg(F.count("*").alias("weight"))
    ranged = cut(ranged.join(weights, "same"), "ranged")
    n_found = found.count()
    met = skew_join(found.select("digest", "start", "same"), ranged, "same", "weight", max(1, n_found))
    spans = met.groupBy("digest").agg(F.collect_list(F.struct("start", "spans")).alias("found"))
    return texts, copies, candidates, cut(spans, "spans")


def _removed(raw: np.ndarray, found: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The merged ranges and the bytes left."""
    spans = merged(np.concatenate([np.array(x["spans"], np.int64).reshape(-1, 2) + x["start"] for x in found]))
    change = np.zeros(len(raw) + 1, np.int32)
    change[spans[:, 0]] += 1
    change[spans[:, 1]] -= 1
    return spans, raw[np.cumsum(change[:-1]) == 0]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, digest, found in zip(*batch.columns, strict=True):
            spans, rest = _removed(_bytes(text.as_py()), found.as_py())
            rows.append((digest.as_py(), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(rest.tobytes()).hexdigest(), rest.tobytes().decode("utf-8", "ignore")))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], names=["digest", "n_removed", "n_spans", "kept_sha256", "kept"])


_EMPTY = hashlib.sha256(b"").hexdigest()


def results(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(texts, done, rows): done has digest, weight, n_removed, n_spans, kept_sha256, kept of the texts that lose bytes."""
    texts, copies, candidates, spans = find_repeats(docs, id_col, text_col)
    gone = copies.where((F.col("weight") > 1) & (F.col("n_bytes") >= LENGTH))
    part = candidates.select("text", F.col("digest").alias("d")).join(spans.join(gone, "digest", "left_anti"), F.col("d") == F.col("digest")).select("text", "digest", "found").mapInArrow(_finish, "digest binary, n_removed long, n_spans long, kept_sha256 string, kept string")
    part = part.dropDuplicates(["digest"]).withColumn("weight", F.lit(1).cast("long"))
    whole = gone.select("digest", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(_EMPTY).alias("kept_sha256"), F.lit("").alias("kept"), "weight")
    return texts, cut(part.unionByName(whole), "done"), texts.count()


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    texts, done, rows = results(docs, id_col, text_col)
    zero = F.lit(0).cast("long")
    out = skew_join(texts.select("doc_id", "digest", "n_bytes", "sha256"), done.drop("kept"), "digest", "weight", max(1, rows), "left")
    return out.select(F.col("doc_id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes cut out of its texts; a character that loses a byte goes entirely. Null texts stay null; columns may have any names."""
    _, done, rows = results(docs, id_col, text_col)
    table = docs.select(F.struct("*").alias("row"), text_digest(text_col).alias("digest"))
    out = skew_join(table, done.select("digest", "kept", "weight"), "digest", "weight", max(1, rows), "left")
    text = F.col("row").getField(text_col)
    return out.select(F.col("row").withField(f"`{text_col}`", F.when(F.col("kept").isNotNull() & text.isNotNull(), F.col("kept")).otherwise(text)).alias("row")).select("row.*")
