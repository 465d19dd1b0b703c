"""Hybrid proximity graph: edges per big label, and shared edges between rows with several common labels.

The build is set-based. Candidates of a row are its nearest rows in the nearest clusters of each of its
big labels; lists longer than the degree, which depends on the label's size, go through a greedy
occlusion prune in the order (distance, overlap, id), where shared edges within the label occlude too;
reverse edges are added and pruned once more. Search runs a beam in one group for each label and block
of queries; labels with more rows than a worker should hold are left to clustered search by the router.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.blocks import _matrix
from lodestar.operators.labels import label_rows, label_sizes, overlap
from lodestar.plans.cells import column, pieces, search_cells
from lodestar.plans.ivf import rank_centroids
from lodestar.schema import SearchConfig
from lodestar.storage import cut

#: Queries of a label for which its graph is copied once more, up to the given number of blocks.
QUERIES = 256
#: A neighbour farther than this times the squared distance at place k of a full enough queue is skipped.
PRUNE_RATIO = 1.35


def candidates(points: DataFrame, centroids: DataFrame, members: DataFrame, cfg: SearchConfig, dim: int, labels: DataFrame) -> DataFrame:
    """label, src, dst, dist, overlap (common labels, at most 255): the build_candidates nearest rows in the nprobe nearest clusters of the label."""
    points = points.join(label_rows(labels), "id", "left")
    asked = points.select("label", F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("labels").alias("tags"))
    cells = rank_centroids(asked, centroids, dim, "double", cfg.nprobe).select("label", "qid", "cid")
    scored = search_cells(asked, cells, members, points, cfg.build_candidates, dim, exclude_self=True).select("label", F.col("qid").alias("src"), F.col("id").alias("dst"), "dist", F.least("overlap", F.lit(255)).alias("overlap"))
    place = F.row_number().over(Window.partitionBy("label", "src").orderBy("dist", "dst"))
    return scored.withColumn("place", place).where(F.col("place") <= cfg.build_candidates).drop("place")


def occlusion_prune(dist: np.ndarray, vectors: np.ndarray, degree: int, alpha: float, blockers: np.ndarray | None = None) -> list[int]:
    """Which candidates, in order of distance, are kept: at most degree, none that a kept one (or a blocker) occludes."""
    kept: list[int] = []
    nearest = np.full(len(dist), np.inf)  # squared distance to the nearest blocker or kept candidate
    for b in blockers if blockers is not None else ():
        np.minimum(nearest, ((vectors - b) ** 2).sum(1), out=nearest)
    for a in (1.0, alpha):
        i = 0
        while i < len(dist):
            free = a * nearest[i:] > dist[i:]
            free[[j - i for j in kept if j >= i]] = False
            if not free.any():
                break
            if len(kept) >= degree:
                return sorted(kept)
            i += int(free.argmax())
            kept.append(i)
            np.minimum(nearest, ((vectors - vectors[i]) ** 2).sum(1), out=nearest)
            i += 1
    return sorted(kept)


def degrees(labels: DataFrame, cfg: SearchConfig) -> DataFrame:
    """label, n, degree of the big labels: the degree of the first step of cfg.degrees that holds the label's size."""
    big = label_sizes(labels).where(F.col("n") > cfg.big_cutoff)
    degree = F.lit(cfg.degrees[-1][1])
    for upper, d in reversed(cfg.degrees[:-1]):
        degree = F.when(F.col("n") <= upper, d).otherwise(degree)
    return big.select("label", "n", degree.alias("degree"))


_EDGE = "label long, src long, dst long, dist double, overlap int"

#: Most edges of a group in prune(), whose vectors it holds.
GROUP_EDGES = 1 << 16


def _pruned(alpha: float):
    """Groups (label, block) of vectors and then edges, sorted by (src, dist, overlap, dst), to the edges that stay."""
    names = ["label", "src", "dst", "dist", "overlap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        edges: list[pa.RecordBatch] = []

        def answer() -> Iterator[pa.RecordBatch]:
            ids, vectors = np.asarray(column(held, 5)), _matrix(column(held, 8))
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], vectors[order]
            src, dst, dist, overlap, degree = (np.asarray(column(edges, i)) for i in (4, 5, 6, 7, 9))
            blocks = column(edges, 3).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(src, prepend=src[0] - 1))
            stay = []
            for low, high in zip(starts, np.append(starts[1:], len(src)), strict=True):
                own = low + np.flatnonzero(~blocks[low:high])
                own = own[np.sort(np.unique(dst[own], return_index=True)[1])]  # of repeated targets the first
                if len(own) and len(own) > degree[own[0]]:
                    block = vectors[np.searchsorted(ids, dst[low:high][blocks[low:high]])]
                    own = own[occlusion_prune(dist[own], vectors[np.searchsorted(ids, dst[own])], int(degree[own[0]]), alpha, block)]
                stay.append(own)
            some = np.concatenate(stay)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), held[0].column(0)[0].as_py())), *(pa.array(x[some]) for x in (src, dst, dist)), pa.array(overlap[some].astype(np.int32))], names=names)

        for new, asks, piece in pieces(batches, 2):
            if new:
                if edges:
                    yield from answer()
                held, edges = [], []
            (edges if asks else held).append(piece)
        if edges:
            yield from answer()

    return run


def prune(edges: DataFrame, vectors: DataFrame, degree: DataFrame, alpha: float, blockers: DataFrame | None = None) -> DataFrame:
    """Edges (label, src, dst, dist, overlap) that survive, by (dist, overlap, dst); lists that are no longer than the degree (label, degree) stay whole.

    blockers (label, src, dst), if given, occlude as kept edges do. A source's list is bounded by the candidates and
    reverse edges of one row; sources are dealt to groups, to which each vector that a group needs travels once.
    """
    rows = edges.select("label", "src", "dst", "dist", F.col("overlap").cast("int").alias("overlap"), F.lit(False).alias("blocks"))
    if blockers is not None:
        rows = rows.unionByName(blockers.select("label", "src", "dst", F.lit(0.0).alias("dist"), F.lit(0).alias("overlap"), F.lit(True).alias("blocks")))
    groups = rows.groupBy("label").agg(F.ceil(F.count("*") / GROUP_EDGES).cast("int").alias("groups"))
    limits = F.broadcast(degree.select("label", "degree").join(groups, "label"))  # one row a label
    rows = rows.join(limits, "label").withColumn("block", F.pmod(F.xxhash64("src"), F.col("groups")).cast("int"))
    null = lambda kind: F.lit(None).cast(kind)
    kinds = {"label": "long", "block": "int", "asks": "boolean", "blocks": "boolean", "src": "long", "dst": "long", "dist": "double", "overlap": "int", "v": "array<double>", "degree": "int"}
    put = lambda df, **own: df.select(*[own.get(c, F.col(c) if c in df.columns else null(k)).cast(k).alias(c) for c, k in kinds.items()])
    needed = rows.select("label", "block", "dst").distinct().join(vectors.select(F.col("id").alias("dst"), "v"), "dst")
    met = put(needed, asks=F.lit(False)).unionByName(put(rows, asks=F.lit(True)))
    return met.repartition("label", "block").sortWithinPartitions("label", "block", "asks", "src", "dist", "overlap", "dst").mapInArrow(_pruned(alpha), _EDGE)


def with_reverse(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select("label", F.col("dst").alias("src"), F.col("src").alias("dst"), "dist", "overlap")).dropDuplicates(["label", "src", "dst"])


def shared_candidates(found: DataFrame, labels: DataFrame, min_shared: int) -> DataFrame:
    """src, dst, dist, overlap of candidates with at least min_shared common labels, which are counted here if found does not tell."""
    if "overlap" in found.columns:
        return found.where(F.col("overlap") >= min_shared).groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("overlap").alias("overlap"))
    pairs = found.groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    return pairs.join(overlap(labels, pairs.select("src", "dst")), ["src", "dst"]).where(F.col("overlap") >= min_shared)


def build(points: DataFrame, centroids: DataFrame, members: DataFrame, labels: DataFrame, vectors: DataFrame, cfg: SearchConfig, dim: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(single: label, src, dst, dist; shared: src, dst, dist, overlap; entries: label, id)."""
    found = cut(candidates(points, centroids, members, cfg, dim, labels), "candidates")
    common = cut(shared_candidates(found, labels, cfg.min_shared), "common").withColumn("label", F.lit(-1).cast("long"))
    one = labels.sparkSession.createDataFrame([(-1, cfg.shared_degree)], "label long, degree int")
    shared = cut(prune(common, vectors, one, cfg.alpha), "first")
    shared = cut(prune(with_reverse(shared), vectors, one, cfg.alpha).drop("label"), "shared")
    # a shared edge blocks in every big label that both its ends have
    limits = cut(degrees(labels, cfg), "degrees")
    big = labels.join(F.broadcast(limits.select("label")), "label")
    blockers = shared.join(big.select(F.col("id").alias("src"), "label"), "src").join(big.select(F.col("id").alias("dst"), "label"), ["dst", "label"]).select("label", "src", "dst")
    blockers = cut(blockers, "blockers")
    single = cut(prune(found.withColumn("overlap", F.lit(0)), vectors, limits, cfg.alpha, blockers), "first")
    single = cut(prune(with_reverse(single), vectors, limits, cfg.alpha, blockers).drop("overlap"), "single")
    entries = points.groupBy("label").agg(F.min_by("id", F.xxhash64("id")).alias("id"))
    return single, shared, entries


def beam(query: np.ndarray, start: list[int], near: dict[int, list[int]], at: dict[int, int], vectors: np.ndarray, k: int, width: int) -> tuple[list[tuple[float, int]], tuple[int, int, int]]:
    """The k best of a queue of width after expanding all of it, and (distances computed, rows expanded, rows put into the queue)."""
    seen, queue, fresh, n, hops, pushed = set(start), [], [], 0, 0, 0
    for s in start:
        d = float(((vectors[at[s]] - query) ** 2).sum())
        n += 1
        pushed += 1
        queue.append((d, s))
        heapq.heappush(fresh, (d, s))
    queue.sort()
    queue = queue[:width]
    while fresh:
        d, s = heapq.heappop(fresh)
        if len(queue) >= width and (d, s) > queue[-1]:
            break
        hops += 1
        new = [x for x in near.get(s, ()) if x not in seen and x in at]
        seen.update(new)
        if not new:
            continue
        dist = ((vectors[[at[x] for x in new]] - query) ** 2).sum(1)
        n += len(new)
        for e, x in zip(dist.tolist(), new, strict=True):
            if len(queue) > k and e > PRUNE_RATIO * queue[k][0]:
                continue
            if len(queue) < width or (e, x) < queue[-1]:
                queue.append((e, x))
                heapq.heappush(fresh, (e, x))
                pushed += 1
        queue.sort()
        queue = queue[:width]
    return queue[:k], (n, hops, pushed)


def search(queries: DataFrame, single: DataFrame, shared: DataFrame, entries: DataFrame, labels: DataFrame, vectors: DataFrame, cfg: SearchConfig, blocks: int = 8) -> DataFrame:
    """qid, rank, id, dist, dist_comps, hops, pushed of queries (qid, qv, label) by beam search over single edges and the shared edges within the label.

    A task holds the graph of one label; labels with more than cfg.graph_rows rows are refused: they belong to clustered search.
    """
    wanted = queries.select("label").distinct()
    within = labels.join(wanted, "label")
    large = within.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > cfg.graph_rows).first()
    if large:
        raise ValueError(f"label {large.label} has {large.n} rows: search its clusters")
    inside = shared.join(within.select(F.col("id").alias("dst"), "label"), "dst").select("label", "src", "dst")
    edges = single.join(wanted, "label").select("label", "src", "dst").unionByName(inside).distinct()
    out = edges.groupBy("label", "src").agg(F.collect_list("dst").alias("out"))  # bounded by the degrees
    first = entries.select("label", F.col("id"), F.lit(True).alias("entry"))
    graph = within.join(vectors, "id").join(out.withColumnRenamed("src", "id"), ["label", "id"], "left").join(first, ["label", "id"], "left").select("label", "id", "v", "out", F.coalesce("entry", F.lit(False)).alias("entry"))
    spread = F.broadcast(queries.groupBy("label").agg(F.least(F.lit(blocks), F.ceil(F.count("*") / QUERIES)).cast("int").alias("blocks")))  # one row a label
    graph = graph.join(spread, "label").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = queries.select("label", "qid", "qv").join(spread, "label").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
    row = lambda df, asks, name, v, out, entry: df.select(F.col("label").cast("long").alias("label"), "block", F.lit(asks).alias("asks"), F.col(name).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v"), out.cast("array<long>").alias("out"), entry.alias("entry"))
    met = row(graph, False, "id", "v", F.col("out"), F.col("entry")).unionByName(row(asked, True, "qid", "qv", F.lit(None), F.lit(False)))
    k, width = cfg.k, cfg.beam

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for new, asks, piece in pieces(batches, 2):
            if new:
                held, at = [], None
            if not asks:
                held.append(piece)
                continue
            if not held:
                continue
            if at is None:
                ids, vectors = np.asarray(column(held, 3)).tolist(), _matrix(column(held, 4))
                at = {x: i for i, x in enumerate(ids)}
                near = {x: list(o) for x, o in zip(ids, column(held, 5).to_pylist(), strict=True) if o is not None}
                # several entries, so that islands of the batch build are reached
                start = sorted({*(x for x, e in zip(ids, column(held, 6).to_pylist(), strict=True) if e), *ids[:: max(1, len(ids) // 8)]})
                held = held[:1]
            rows = []
            for qid, qv in zip(piece.column(3).to_pylist(), _matrix(pa.concat_arrays([piece.column(4)])), strict=True):
                best, counts = beam(qv, start, near, at, vectors, k, width)
                rows += [(qid, r + 1, x, d, *counts) for r, (d, x) in enumerate(best)]
            kinds = [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 3
            names = ["qid", "rank", "id", "dist", "dist_comps", "hops", "pushed"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    met = met.repartition("label", "block").sortWithinPartitions("label", "block", "asks", "id")
    return met.mapInArrow(run, "qid long, rank long, id long, dist double, dist_comps long, hops long, pushed long")
