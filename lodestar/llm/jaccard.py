"""N-gram Jaccard join with a MinHash LSH forest.

1. Copies: documents with the same words in the same order are one node.
2. Signatures: a node has TREES paths of DEPTH MinHash values (16 bits each), computed from its shingles.
3. Forest: (tree, path, node) is sorted as a whole, by ranges, so that no path needs one task. Neighbours in
   that order that share a prefix are neighbours in the tree's trie; a pass over the sorted rows tells how
   many values each row shares with the one before it, and for every prefix length the first row that
   shares it. Prefixes that go on in the next range are joined by the first and last row of each range.
4. Prefix length: the longest that reaches the expected recall of the links even if all of them were just at
   the threshold (floor_length). It depends on no data, so no link is risked on what a part of the rows looks like.
5. Verification: nodes that share a prefix of that length in some tree are linked to the first of them.
   Each component of those links is cut, in the order of its trie, into blobs of at most BLOB nodes and
   BLOB_BYTES bytes of shingles (or one longer text). Two blobs meet if they share a matched prefix; then
   all their texts are compared exactly by shingle sets, as products of incidence matrices. The answer
   is each node's number of links and its root, never pairs.
6. Components of the verified links are the classes.

Returned for each row: its class (the smallest id in it) and its number of links, which are the other
rows, copies included, with similarity of at least the threshold.

Words are [^\\x20\\x09-\\x0D]+; a text with fewer words than a shingle has one shingle of all its
words. Texts that are null or have no words are alone and have no links; their class is their own id. Rows that
share an id are compared like any others. Rows without an id have a null class, but count as links. Empty tables
give an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import components, cut, skew_join
from lodestar.llm.shingles import mix, shingle_hashes, word_hashes

SIZE, SIMILARITY, TREES, DEPTH, RECALL = 5, 0.8, 24, 10, 0.9999
#: How much less than its estimate a similarity counts in prefix_length().
MARGIN = 0.05
#: Nodes and bytes of a blob, columns of an incidence matrix, shingles hashed at once, blobs of a prefix that meet in one group.
BLOB, BLOB_BYTES, COLUMNS, AT_ONCE, CHUNK = 256, 4 << 20, 8192, 1 << 15, 256


def floor_length(trees: int, depth: int, similarity: float, recall: float) -> int:
    """The longest prefix, up to depth, that reaches the expected recall even at the threshold."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def prefix_length(near: np.ndarray, floor: int, trees: int, depth: int, similarity: float, recall: float) -> int:
    """The prefix shortened from depth until the links expected from these similarities of trie neighbours reach the recall.

    For callers that know the similarities of all neighbours; classes() takes the floor, which needs none. A neighbour at similarity s comes up in proportion to s**floor, so it counts with the inverse.
    """
    s = np.clip(near[near >= similarity - MARGIN] - MARGIN, similarity, 1.0)
    if not len(s):
        return floor
    weight = s**-floor
    while depth > floor and 1 - (weight * (1 - s**depth) ** trees).sum() / weight.sum() < recall:
        depth -= 1
    return depth


def signatures_of(shingles: list[np.ndarray], trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """16 bits of each MinHash value [set, tree, place] of sets of shingle hashes."""
    flat, starts = (np.concatenate(shingles) >> np.uint64(32)).astype(np.uint32), np.cumsum([0, *map(len, shingles[:-1])])
    seeds = np.random.default_rng(5).integers(0, 1 << 32, (trees, depth, 2), dtype=np.uint32)
    least, space = np.zeros((len(shingles), trees, depth), np.uint64), np.empty_like(flat)
    for t in range(trees):
        for d, (a, b) in enumerate(seeds[t]):
            np.multiply(np.bitwise_xor(flat, a, out=space), b | np.uint32(1), out=space)
            least[:, t, d] = np.minimum.reduceat(space, starts)
    return (mix(least + np.uint64(1)) & np.uint64(0xFFFF)).astype(np.uint16)


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """doc_id and the MD5 of each whole text (raw), with more columns."""
    raw = F.unhex(F.md5(F.encode(F.col(text_col).cast("string"), "UTF-8")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw"), *more)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """The written doc_id, raw, digest of the words, signature of every row; the last two are null without words."""
    names, kinds = ["doc_id", "raw", "digest", "signature"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list) -> pa.RecordBatch:
            some = [s for *_, s in rows if len(s)]
            signed = iter(signatures_of(some) if some else [])
            columns = [*([r[k] for r in rows] for k in range(3)), [next(signed).tobytes() if len(s) else None for *_, s in rows]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        rows, n = [], 0
        for batch in batches:
            for key, raw, value in zip(*batch.columns, strict=True):
                text = value.as_py() or ""
                words = b" ".join(text.encode("utf-8", "surrogatepass").split())  # bytes.split() cuts at exactly \x20 and \x09-\x0D
                s = shingle_hashes(word_hashes(text), size)
                rows.append((key.as_py(), raw.as_py(), hashlib.md5(words, usedforsecurity=False).digest() if words else None, s))
                n += len(s)
                if n >= AT_ONCE or len(rows) >= 4096:
                    yield flush(rows)
                    rows, n = [], 0
        if rows:
            yield flush(rows)

    rows = keyed(docs, id_col, text_col, F.col(text_col).cast("string").alias("text"))
    return cut(rows.mapInArrow(run, "doc_id long, raw binary, digest binary, signature binary"), "signatures")


def nodes_of(signed: DataFrame) -> DataFrame:
    """The written digest, node, first (none, doc_id, raw: the row that stands for it), weight, signature of every distinct text with words."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("first")
    nodes = signed.where("digest is not null").groupBy("digest").agg(first, F.count("*").alias("weight"), F.first("signature").alias("signature"))
    return cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading values rows of a and b have in common."""
    return np.logical_and.accumulate(a == b, axis=1).sum(1)


def _trie(floor: int):
    """Sorted rows (tree, path, node) to their links (node, lcp, firsts), and to the first and last row of the range."""
    names = ["part", "tree", "path", "node", "lcp", "firsts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None

        def ends(tree: int, path: np.ndarray, node: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([tree], pa.int32()), pa.array([path.tobytes()], pa.binary()), pa.array([node], pa.int64()), pa.array([None], pa.int32()), pa.array([None], pa.list_(pa.int64()))], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            trees, nodes = np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(2)).astype(np.int64)
            paths = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(nodes), DEPTH)
            if before is None:
                before = (trees[0], paths[0], nodes[0], np.full(DEPTH - floor + 1, nodes[0]))
                yield ends(int(trees[0]), paths[0], int(nodes[0]))
                lcp = np.append(0, shared(paths[1:], paths[:-1]) * (trees[1:] == trees[:-1]))
            else:
                lcp = shared(paths, np.concatenate([before[1][None], paths[:-1]])) * (trees == np.append(before[0], trees[:-1]))
            firsts = np.empty((len(nodes), DEPTH - floor + 1), np.int64)
            for j in range(firsts.shape[1]):
                start = np.maximum.accumulate(np.where(lcp < floor + j, np.arange(len(nodes)), -1))
                firsts[:, j] = np.where(start < 0, before[3][j], nodes[start])
            before = (trees[-1], paths[-1].copy(), nodes[-1], firsts[-1].copy())
            some = np.flatnonzero(lcp >= floor)
            if len(some):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * firsts.shape[1]), pa.array(firsts[some].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), part, np.int32)), pa.array(trees[some].astype(np.int32)), pa.nulls(len(some), pa.binary()), pa.array(nodes[some]), pa.array(lcp[some].astype(np.int32)), lists], names=names)
        if before is not None:
            yield ends(int(before[0]), before[1], int(before[2]))

    return run


def forest(nodes: DataFrame, floor: int) -> DataFrame:
    """The written trie neighbours: part, tree, path, node, lcp, firsts. Links have an lcp and no path, ends of ranges a path and no lcp."""
    paths = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring(F.col("signature"), t * 2 * DEPTH + 1, F.lit(2 * DEPTH)))
    rows = nodes.select("node", F.posexplode(paths).alias("tree", "path")).select("tree", "path", "node")
    ordered = rows.repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    return cut(ordered.mapInArrow(_trie(floor), "part int, tree int, path binary, node long, lcp int, firsts array<long>"), "forest")


def across(trie: DataFrame) -> list[tuple[int, int, int]]:
    """(node, node, lcp) of the last row of each range and the first of the next: two rows a range come to the driver."""
    rows = trie.where("lcp is null").select("part", "tree", "path", "node").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.part, []).append((r.tree, np.frombuffer(bytes(r.path), np.uint16).tolist(), r.node))
    spans = [(min(x), max(x)) for _, x in sorted(by.items())]
    out = []
    for (_, a), (b, _) in zip(spans, spans[1:], strict=False):
        same = next((i for i, (x, y) in enumerate(zip(a[1], b[1], strict=True)) if x != y), DEPTH) if a[0] == b[0] else 0
        out.append((a[2], b[2], same))
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets (sorted, without repeats) of left and right are at least that similar."""
    sides = left if right is left else [*left, *right]
    codes, at, n = np.unique(np.concatenate(sides), return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    owner = np.repeat(np.arange(len(sides)), [len(s) for s in sides])
    keep = n[at] > 1
    at, owner = column[at[keep]], owner[keep]
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        i, j = np.searchsorted(at, [low, low + COLUMNS])
        x = np.zeros((len(sides), min(COLUMNS, int(at[j - 1]) - low + 1)), np.float32)
        x[owner[i:j], at[i:j] - low] = 1
        both += x[: len(left)] @ (x if right is left else x[len(left) :]).T
    a, b = np.array([len(s) for s in left], float), np.array([len(s) for s in right], float)
    return both >= similarity * (a[:, None] + b[None, :] - both) - 1e-6


class Blob:
    """Nodes with their weights and shingle sets."""

    def __init__(self, nodes: list[int], weights: list[int], sets: list[np.ndarray]):
        self.nodes, self.weights, self.sets = np.array(nodes, np.int64), np.array(weights, np.int64), sets

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.nodes.tobytes(), self.weights.tobytes(), np.array([len(s) for s in self.sets], np.int64).tobytes(), b"".join(s.tobytes() for s in self.sets)

    @classmethod
    def of(cls, row: dict) -> Blob:
        ends = np.cumsum(np.frombuffer(row["sizes"], np.int64))
        return cls(np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["weights"], np.int64), np.split(np.frombuffer(row["sets"], np.uint64), ends[:-1]))


def compare(a: Blob, b: Blob, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, links, root of the nodes of two blobs, compared with each other, or of one with itself."""
    near = linked(a.sets, b.sets if b is not a else a.sets, similarity)
    if a is b:
        np.fill_diagonal(near, False)
        links, ids, full = near @ a.weights, a.nodes, near
    else:
        links, ids = np.concatenate([near @ b.weights, a.weights @ near]), np.concatenate([a.nodes, b.nodes])
        full = np.block([[np.zeros((len(a.nodes),) * 2, bool), near], [near.T, np.zeros((len(b.nodes),) * 2, bool)]])
    root = ids.copy()
    while True:
        least = np.minimum(root, np.where(full, root[None, :], np.iinfo(np.int64).max).min(1))
        if (least == root).all():
            return ids, links, root
        root = least


_BLOB = "component long, blob long, nodes binary, weights binary, sizes binary, sets binary, links binary, roots binary"


def _blobs(similarity: float, size: int):
    """Texts sorted by component and path to blobs.

    Components that lie within one blob, neither first nor last in the range, are compared at once: their blobs have links and
    roots instead of sets.
    """
    names = [f.split(" ")[0] for f in _BLOB.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob = TaskContext.get().partitionId() << 32
        done: list[tuple] = []
        component, last, parts, now, held, is_first = None, None, [], [], 0, True

        def close(whole: bool) -> None:
            nonlocal blob
            for p in parts:
                made = Blob([x[0] for x in p], [x[1] for x in p], [x[2] for x in p])
                nodes, weights, sizes, sets = made.packed()
                if whole and len(parts) == 1:
                    _, links, root = compare(made, made, similarity)
                    done.append((component, blob, nodes, weights, None, None, links.astype(np.int64).tobytes(), root.tobytes()))
                else:
                    done.append((component, blob, nodes, weights, sizes, sets, None, None))
                blob += 1

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 6
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done.clear()
            return out

        def full() -> bool:
            return len(done) >= 1000 or sum(len(x[5] or b"") for x in done) >= BLOB_BYTES

        for batch in batches:
            for of, node, weight, text in zip(*batch.columns, strict=True):
                of, node = of.as_py(), node.as_py()
                if node == last:
                    continue  # a row that is there several times
                last = node
                if of != component:
                    if now:
                        parts.append(now)
                        close(not is_first)
                        is_first = False
                        if full():
                            yield flush()
                    component, parts, now, held = of, [], [], 0
                s = np.unique(shingle_hashes(word_hashes(text.as_py() or ""), size))
                if now and (len(now) >= BLOB or held + s.nbytes > BLOB_BYTES):
                    parts.append(now)
                    now, held = [], 0
                    close(False)
                    # what was closed is known not to be whole
                    parts, is_first = [], True
                    if full():
                        yield flush()
                now.append((node, weight.as_py(), s))
                held += s.nbytes
        if now:
            parts.append(now)
            close(False)
        if done:
            yield flush()

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs that were compared at once, to node, links, root."""
    for batch in batches:
        parts = [[np.frombuffer(x, np.int64) for x in c.to_pylist()] for c in batch.columns]
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in parts], names=["node", "links", "root"])


def _compare(similarity: float):
    """Rows (blobs: one blob, or two that meet) to node, links, root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                blobs = [Blob.of(x) for x in row.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in compare(blobs[0], blobs[-1], similarity)], names=["node", "links", "root"])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.repeat(np.asarray(batch.column(0)).astype(np.int64), [len(x) for x in nodes]))], names=["node", "blob"])


def meetings(wide: DataFrame, nodes: DataFrame, length: int) -> DataFrame:
    """i, j of different blobs that share a matched prefix. A prefix of many blobs is dealt into groups of at most CHUNK by CHUNK."""
    placed = wide.select("blob", "nodes").mapInArrow(_unpack, "node long, blob long").join(nodes.select("node", "signature"), "node")
    label = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring(F.col("signature"), t * 2 * DEPTH + 1, F.lit(2 * length))))
    touched = cut(placed.select("blob", F.explode(label).alias("label")).distinct(), "touched")
    sizes = touched.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    met = skew_join(touched, sizes, "label", "n", max(1, touched.count())).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    met = cut(met.withColumn("chunk", F.pmod(F.xxhash64("blob"), F.col("chunks")).cast("int")), "met")
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    left, right = met.select("label", F.col("blob").alias("i"), F.col("chunk").alias("c"), every.alias("d")), met.select("label", F.col("blob").alias("j"), every.alias("c"), F.col("chunk").alias("d"))
    return left.join(right, ["label", "c", "d"]).where("i < j").select("i", "j").distinct()


def classes(signed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """digest, weight, class_id, n_links, first, stays (whether it stands for its class) of every distinct text of signatures(docs)."""
    length = floor_length(TREES, DEPTH, similarity, recall)
    nodes = nodes_of(signed)
    trie = forest(nodes, length)
    spark = docs.sparkSession
    ends = spark.createDataFrame([(a, b) for a, b, n in across(trie) if n >= length], "a long, b long")
    links = trie.where(F.col("lcp") >= length).select(F.col("node").alias("a"), F.element_at("firsts", 1).alias("b")).unionByName(ends)
    parts = components(links.where("a <> b").distinct())
    members = parts.join(nodes, F.col("id") == F.col("node")).select("component", "node", "weight", F.col("first.doc_id").alias("i"), F.col("first.raw").alias("r"), F.substring("signature", 1, 2 * DEPTH).alias("path"))
    texts = keyed(docs, id_col, text_col, F.col(text_col).cast("string").alias("text"))
    found = texts.join(members, (F.col("raw") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("i"))).select("component", "path", "node", "weight", "text")
    ordered = found.repartitionByRange("component", "path", "node").sortWithinPartitions("component", "path", "node").select("component", "node", "weight", "text")
    blobs = cut(ordered.mapInArrow(_blobs(similarity, size), _BLOB), "blobs")
    wide, payload = blobs.where("sets is not null"), F.struct("nodes", "weights", "sizes", "sets")
    alone = wide.select(F.array(payload).alias("blobs"))
    pairs = meetings(wide, nodes, length).select("i", "j", F.explode(F.array("i", "j")).alias("blob"))
    both = pairs.join(wide.select("blob", payload.alias("x")), "blob").groupBy("i", "j").agg(F.collect_list("x").alias("blobs")).select("blobs")
    here = blobs.where("links is not null").select("nodes", "links", "roots").mapInArrow(_answers, "node long, links long, root long")
    there = alone.unionByName(both).mapInArrow(_compare(similarity), "node long, links long, root long")
    done = cut(here.withColumn("whole", F.lit(True)).unionByName(there.withColumn("whole", F.lit(False))), "links")
    joined = components(done.where("not whole").select(F.col("node").alias("a"), F.col("root").alias("b")))
    result = done.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root")).join(joined, F.col("node") == F.col("id"), "left").select("node", "links", F.coalesce("component", "root").alias("root"))
    rooted = cut(nodes.drop("signature").join(result, "node", "left").select("digest", "weight", "first", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "rooted")
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("n"))
    named = skew_join(rooted, heads, "root", "n", max(1, rooted.count()))
    return cut(named.select("digest", "weight", F.col("head.doc_id").alias("class_id"), "n_links", "first", (F.col("first.raw") == F.col("head.raw")).alias("stays")), "classes")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links of every row of docs."""
    signed = signatures(docs, id_col, text_col, size)
    known = classes(signed, docs, id_col, text_col, size, similarity, recall).select("digest", "weight", "class_id", "n_links")
    rows = signed.select("doc_id", "digest")
    met = skew_join(rows.where("digest is not null"), known, "digest", "weight", max(1, rows.count()))
    alone = rows.where("digest is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("class_id"))
    return met.select("doc_id", own.alias("class_id"), "n_links").unionByName(alone).withColumnRenamed("doc_id", id_col)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: that with the smallest id, of equal ids the text with the smaller MD5, of equal texts the least row.

    Rows without an id and rows without words stay as they are, all of them; columns may have any names.
    """
    signed = signatures(docs, id_col, text_col, SIZE)
    stay = classes(signed, docs, id_col, text_col).where("stays and not first.none").select(F.col("first.doc_id").alias("i"), F.col("first.raw").alias("r"))
    rows = keyed(docs, id_col, text_col, F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("has_words"))
    rows = rows.withColumn("apart", F.col("doc_id").isNull() | ~F.col("has_words"))
    kept = rows.where("not apart").join(stay, (F.col("raw") == F.col("r")) & (F.col("doc_id") == F.col("i"))).groupBy("doc_id", "raw").agg(F.min("row").alias("row"))
    return kept.select("row.*").unionByName(rows.where("apart").select("row.*"))
