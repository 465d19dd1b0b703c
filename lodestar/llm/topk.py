"""Exact top-k inner-product search on a bit-sliced index.

Every block of rows is stored as slices: one bitmap over the block's rows for each dimension and bit of
the quantised component, at full width, above the block's least component of that dimension. A query
is written in signed digits (-1, 0, 1 at powers of two); its inner product is a sum of shifted slices,
complemented where the digit is negative, plus a constant. The slices of that sum come from carry-save
adders: three bitmaps of one weight become one of that weight and one of the next, until a single
bitmap of every weight is left. The k-th best sum is found from the most significant slice downward.
Rows above it and the boundary rows that tie with it are resolved exactly: their scores are read off the slices
of the sum, and ties go to the smaller id. Nothing else of the rows is stored or read.

The index is a written table. Blocks are dealt to groups of bounded size; a task holds one group's
blocks and streams the queries, which are a table too, past them. It answers with k rows for each query,
which a window merges. Queries travel once to each group: some hundred bytes a query and group, against
milliseconds of arithmetic.

Null vectors and vectors that hold null or non-finite components take no part, as rows or queries;
nor do rows without an id. Shorter vectors count as padded with zeros. Ties go to the smaller id.
Rows that share an id count once (with their best score; the smallest vector asks) and never answer
their own id, however many they are. Empty tables give empty results; other columns are ignored.
Scores must fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import cut

#: Rows of an index block (the last of a partition may have twice as many), bytes of the slices that a
#: task holds, and words of a bitmap over the rows and queries that are added at once.
BLOCK_ROWS, GROUP_BYTES, WORDS = 8192, 64 << 20, 512
#: Bitmaps to add in, kept by a Python worker.
_SPACE: list[np.ndarray] = []


def quantised(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and their floor(scale * x) as int64, padded with zeros."""
    offsets, flat = np.asarray(vectors.offsets), vectors.values
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), dtype=np.float64)
    n, sizes = len(vectors), np.diff(offsets)
    bad = np.zeros(len(values) + 1, np.int64)
    np.cumsum(~np.isfinite(values), out=bad[1:])
    good = np.asarray(vectors.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]])
    out = np.zeros((n, int(sizes.max(initial=0))), np.int64)
    take = np.arange(out.shape[1])[None, :] < (sizes * good)[:, None]
    at = (offsets[:-1, None] + np.arange(out.shape[1])[None, :])[take]
    out[take] = np.floor(scale * values[at]).astype(np.int64)
    return good, out[good]


def sliced(values: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Bitmaps [dimension, bit, word] of values - low over the rows; at least one bit."""
    n, d = values.shape
    shifted = (values - low).astype(np.uint64)
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    words = -(-n // 64)
    out = np.zeros((d, bits, words), np.uint64)
    padded = np.zeros((d, words * 64), np.uint8)
    for b in range(bits):
        padded[:, :n] = ((shifted >> np.uint64(b)) & np.uint64(1)).T
        out[:, b] = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    return out


def digits(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, shift, dimension, whether negative), in that order, of signed digits: no two neighbours of a number differ from 0."""
    x = np.abs(queries)
    half = x >> 1
    both = x + half
    change = half ^ both
    used, minus = change, np.where(queries < 0, both & change, half & change)
    places = np.arange(int(used.max(initial=0)).bit_length())[None, :, None]
    query, shift, dim = np.nonzero((used[:, None, :] >> places) & 1)
    return query, shift, dim, (minus[query, dim] >> shift) & 1


class Block:
    """Slices of some rows, and their complements for negative digits."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, slices: np.ndarray):
        self.ids, self.low = ids, low
        self.dims, self.bits, self.words = slices.shape
        flat = slices.reshape(self.dims * self.bits, self.words)
        self.slices = np.concatenate([flat, ~flat, np.zeros((1, self.words), np.uint64)])
        every = np.zeros(self.words * 64, np.uint8)
        every[: len(ids)] = 1
        self.rows = np.packbits(every, bitorder="little").view(np.uint64)
        self.unique = len(np.unique(ids)) == len(ids)

    def scores(self, queries: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Slices [query, weight, word], the least weight first, of all rows' inner products above an offset; the offsets."""
        queries = queries[:, : self.dims]
        many = len(queries)
        query, shift, dim, negative = digits(queries)
        full = (1 << self.bits) - 1
        offsets = [sum(a * b for a, b in zip(q, self.low.tolist(), strict=False)) for q in queries.tolist()]
        for q, s in zip(query[negative == 1].tolist(), shift[negative == 1].tolist(), strict=True):
            offsets[q] -= full << s
        # the digits of a query are in the order of their shifts: those that a weight needs are a range
        top = int(shift.max(initial=-1)) + self.bits
        count = np.zeros((many, top + self.bits + 1), np.int64)
        np.add.at(count, (query, shift + self.bits), 1)
        upto = np.cumsum(count, axis=1) + np.concatenate([[0], np.cumsum(count.sum(1))[:-1]])[:, None]
        first = np.append((negative * self.dims + dim) * self.bits - shift, 0)
        zero = len(self.slices) - 1
        most = 2 * int(count.sum(1).max(initial=0)) + 4  # of one weight: its slices and at most as many carried ones
        size = most * many * self.words
        if not _SPACE or len(_SPACE[0]) < size:
            _SPACE[:] = [np.empty(size, np.uint64) for _ in range(3)]
        now, later, odd = (x[:size].reshape(most, many, self.words) for x in _SPACE)
        out, n, weight = [], 0, 0
        while weight < top or n:
            start, end = (upto[:, weight], upto[:, weight + self.bits]) if weight < top else (upto[:, 0],) * 2
            place = np.arange(int((end - start).max(initial=0)))[:, None] + start
            take = np.where(place < end, first[np.minimum(place, len(first) - 1)] + weight, zero)
            np.take(self.slices, take, axis=0, out=now[n : n + len(take)], mode="clip")
            x, n = now[: n + len(take)], 0
            while len(x) > 2:
                third = len(x) // 3
                a, b, c, h = x[:third], x[third : 2 * third], x[2 * third : 3 * third], odd[:third]
                np.bitwise_xor(a, b, out=h)
                np.bitwise_and(a, b, out=a)
                np.bitwise_and(h, c, out=b)
                np.bitwise_or(a, b, out=later[n : n + third])
                np.bitwise_xor(h, c, out=c)
                x, n = x[2 * third :], n + third
            if len(x) == 2:
                np.bitwise_and(x[0], x[1], out=later[n])
                n += 1
                x = x[:1] ^ x[1:]
            out.append(x[0].copy() if len(x) else np.zeros((many, self.words), np.uint64))
            now, later, weight = later, now, weight + 1
        return np.stack(out or [np.zeros((many, self.words), np.uint64)], axis=1), offsets


def select_top(scores: np.ndarray, rows: np.ndarray, k: int) -> int | None:
    """The k-th largest value among the rows of a bitmap, from the most significant slice down; None if fewer rows."""
    count = lambda m: int(np.bitwise_count(m).sum())
    if count(rows) < k:
        return None
    among, value, sure = rows, 0, 0
    for b in range(len(scores) - 1, -1, -1):
        ones = among & scores[b]
        n = count(ones)
        if sure + n >= k:
            among = ones
            value += 1 << b
        else:
            sure += n
            among = among & ~ones
    return value


def at_least(scores: np.ndarray, bound: int, rows: np.ndarray) -> np.ndarray:
    """The bitmap of rows whose value is at least bound."""
    if bound <= 0:
        return rows
    if bound >= 1 << len(scores):
        return np.zeros_like(rows)
    more, same = np.zeros_like(rows), rows
    for b in range(len(scores) - 1, -1, -1):
        if (bound >> b) & 1:
            same = same & scores[b]
        else:
            more |= same & scores[b]
            same = same & ~scores[b]
    return more | same


def others(rows: np.ndarray, ids: np.ndarray, qid: int) -> np.ndarray:
    """The bitmap without the rows of an id."""
    own = np.flatnonzero(ids == qid)
    if len(own):
        rows = rows.copy()
        np.bitwise_and.at(rows, own >> 6, ~(np.uint64(1) << (own & 63).astype(np.uint64)))
    return rows


def members(rows: np.ndarray, n: int) -> np.ndarray:
    """The places of the rows of a bitmap over n rows."""
    return np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little")[:n])


def kth_id(scores: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, unique: bool) -> int | None:
    """A value that rows of at least k distinct ids reach, the k-th largest if ids are unique; None if fewer than k ids are sure to."""
    want = k
    while (value := select_top(scores, rows, want)) is not None and not unique:
        reached = ids[members(at_least(scores, value, rows), len(ids))]
        if len(np.unique(reached)) >= k:
            break
        want = 2 * len(reached)
    return value


def resolve(scores: np.ndarray, places: np.ndarray, offset: int) -> np.ndarray:
    """The exact scores of the rows at some places, read off the slices."""
    bits = (scores[:, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
    weights = np.array([1 << b if b < 64 else 0 for b in range(len(scores))], np.uint64)[:, None]
    return ((bits * weights).sum(0) + np.uint64(offset % (1 << 64))).view(np.int64)  # modulo 2^64, as scores fit


def search_block(block: Block, qids: np.ndarray, queries: np.ndarray, k: int, best: list) -> None:
    """Merges a block into best, which has (scores, ids) of each query, best first."""
    step = max(1, WORDS // max(1, block.words))
    for low in range(0, len(qids), step):
        slices, offsets = block.scores(queries[low : low + step])
        for i, (scores, offset) in enumerate(zip(slices, offsets, strict=True), low):
            rows, have = others(block.rows, block.ids, qids[i]), best[i]
            floor = kth_id(scores, rows, block.ids, k, block.unique) or 0
            if len(have[0]) == k:
                floor = max(floor, int(have[0][-1]) - offset)
            places = members(at_least(scores, floor, rows), len(block.ids))
            if not len(places):
                continue
            s, r = np.concatenate([have[0], resolve(scores, places, offset)]), np.concatenate([have[1], block.ids[places]])
            order = np.lexsort((r, -s))
            s, r = s[order], r[order]
            _, first = np.unique(r, return_index=True)
            first.sort()
            best[i] = (s[first[:k]], r[first[:k]])


def index(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """The written index: a row a block, with ids, least components and slices."""
    schema, names = "ids binary, low binary, bits int, slices binary", ["ids", "low", "bits", "slices"]

    def block(ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        low = values.min(0)
        slices = sliced(values, low)
        columns = [pa.array([x], t) for x, t in ((ids.tobytes(), pa.binary()), (low.tobytes(), pa.binary()), (slices.shape[1], pa.int32()), (slices.tobytes(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values = np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
        for batch in batches:
            part = batch.filter(batch.column(0).is_valid())
            good, new = quantised(pa.concat_arrays([part.column(1)]), scale)
            width = max(values.shape[1], new.shape[1])
            values = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (values, new)])
            ids = np.concatenate([ids, np.asarray(part.column(0))[good].astype(np.int64)])
            while len(ids) >= 2 * BLOCK_ROWS:
                yield block(ids[:BLOCK_ROWS], values[:BLOCK_ROWS])
                ids, values = ids[BLOCK_ROWS:], values[BLOCK_ROWS:]
        if len(ids):
            yield block(ids, values)

    blocks = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(build, schema)
    return cut(blocks.withColumn("block", F.monotonically_increasing_id()), "slices")


def _search(k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one group, blocks before queries."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            is_query = np.asarray(batch.column(1)).astype(bool)
            for row in batch.filter(pa.array(~is_query)).select([2, 3, 4, 5]).to_pylist():
                ids, low = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["low"], np.int64)
                held.append((ids, low, np.frombuffer(row["slices"], np.uint64).reshape(len(low), row["bits"], -(-len(ids) // 64))))
            asked = batch.filter(pa.array(is_query))
            if not asked.num_rows:
                continue
            good, queries = quantised(pa.concat_arrays([asked.column(7)]), scale)
            qids = np.asarray(asked.column(6))[good].astype(np.int64)
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in qids]
            for part in held:
                search_block(Block(*part), qids, queries, k, best)
            sizes = [len(s) for s, _ in best]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, sizes)), pa.array(np.concatenate([r for _, r in best])), pa.array(np.concatenate([s for s, _ in best]))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query (a Column), the k best other rows."""
    spark = vectors.sparkSession
    blocks = index(vectors, id_col, vector_col, scale)
    n_blocks, size = blocks.agg(F.count("*"), F.sum(F.length("slices"))).first()
    groups = max(1, -(-(size or 0) // GROUP_BYTES), min(n_blocks, spark.sparkContext.defaultParallelism))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    asked = vectors.where(is_query).select(F.col(id_col).cast("long").alias("qid"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = asked.where(F.col("qid").isNotNull() & F.col("v").isNotNull() & finite).groupBy("qid").agg(F.min("v").alias("v"))
    nulls = lambda **kinds: [F.lit(None).cast(t).alias(n) for n, t in kinds.items()]
    dealt = F.pmod(F.shiftright("block", 33) + F.col("block").bitwiseAND((1 << 33) - 1), F.lit(groups)).cast("int")
    left = blocks.select(dealt.alias("part"), F.lit(False).alias("asks"), "ids", "low", "bits", "slices", *nulls(qid="long", v="array<double>"))
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(True).alias("asks"), *nulls(ids="binary", low="binary", bits="int", slices="binary"), "qid", "v")
    met = left.unionByName(right).repartitionById(groups, "part").sortWithinPartitions("part", "asks")
    found = met.mapInArrow(_search(k, scale), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
