"""Best-fit packing by minimum bin slack.

Documents become token ids, an end id is appended, and only documents longer than a sequence are cut
(the first piece takes the remainder, so that the others are full). Placement sees no documents, only
the number of pieces of each length, which is bounded by the sequence length: for one bin at a time,
a bitset subset-sum over the available lengths finds the fullest feasible combination that holds the
longest piece left; the combination is then removed as often as the counts allow. The plan is a table
of (length, first and last rank among the pieces of that length, bin), and pieces find their bins by
their rank. Ranks come from counts of (length, bucket of the id), so that no length needs one task.

Null texts count as empty: one piece with only the end id. Empty tables give an empty result. Rows
that repeat an id are packed row by row; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.bpe import vocabulary
from lodestar.llm.common import cut

#: Runs without white space that are longer go through the segment tree, whose time is nearly linear.
LONG_RUN = 2000
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    """Rank BPE over the same vocabulary, which is several times as fast as merging in Python."""
    if path not in _ENCODERS:
        import tiktoken

        vocab = vocabulary(path)
        ranks = {bytes(vocab.bytes_of[c] for c in t): i for i, t in vocab.strings.items() if t not in vocab.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=vocab.special), regex.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))
    return _ENCODERS[path]


def token_ids(text: str, path: str) -> np.ndarray:
    encoder, long_run = _encoder(path)
    if long_run.search(text):
        return np.frombuffer(vocabulary(path).encode(text)[0], np.uint32)
    return encoder.encode_to_numpy(text, allowed_special="all", disallowed_special=())


def fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> list[int]:
    """The lengths, longest first, of the fullest combination that holds the longest length.

    Bit s of reach[j] tells whether the first j packs can be added up to s; a length that is there c times
    enters as packs of 1, 2, 4, ... pieces. Long lengths enter first and so are preferred: short ones
    are easier to place later.
    """
    first = lengths[-1]
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    packs, reach = [], [1]
    for x in reversed(lengths):
        left = min(counts[x] - (x == first), room // x)
        size = 1
        while left > 0:
            take = min(size, left)
            packs.append((x, take))
            reach.append((reach[-1] | reach[-1] << (x * take)) & mask)
            left -= take
            size *= 2
        if reach[-1] >> room & 1:
            break
    total = reach[-1].bit_length() - 1
    chosen = [first]
    for j in range(len(packs) - 1, -1, -1):
        x, take = packs[j]
        if not reach[j] >> total & 1:
            chosen += [x] * take
            total -= x * take
    return sorted(chosen, reverse=True)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, bin_from, each, offset): ranks rank_from + r fill bin_from + r // each.

    Work and rows depend on the number of lengths, not of pieces: each combination is used until a length runs out.
    """
    counts = {x: c for x, c in counts.items() if c}
    used = dict.fromkeys(counts, 0)
    out, bins = [], 0
    while counts:
        lengths = sorted(counts)
        combo = fullest(lengths, counts, capacity)
        need = {x: combo.count(x) for x in combo}
        times = min(counts[x] // n for x, n in need.items())
        offset = 0
        for x, n in need.items():
            out.append((x, used[x], used[x] + n * times, bins, n, offset))
            used[x] += n * times
            counts[x] -= n * times
            offset += x * n
            if not counts[x]:
                del counts[x]
        bins += times
    return out


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, extra: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if extra) of the pieces of every whole text."""
    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if extra else [])]
    schema = docs.select(id_col).withColumns({"piece": F.lit(0), "start": F.lit(0).cast("long"), "length": F.lit(0).cast("long"), "ids_crc32": F.lit(0).cast("long"), **({"ids": F.lit(b"")} if extra else {})}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            for k, value in enumerate(batch.column(1)):
                raw = np.append(token_ids(value.as_py() or "", path), np.uint32(end_id)).astype("<u4").tobytes()
                n, start, piece = len(raw) // 4, 0, 0
                while start < n:
                    size = min(n, n % capacity or capacity) if piece == 0 else capacity
                    part = raw[4 * start : 4 * (start + size)]
                    rows.append((piece, start, size, zlib.crc32(part), part) if extra else (piece, start, size, zlib.crc32(part)))
                    at.append(k)
                    start += size
                    piece += 1
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]], names=names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece (with ids as binary, if asked)."""
    spark = docs.sparkSession
    table = cut(pieces(docs, path, capacity, end_id, id_col, text_col, with_ids).withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(1 << 16))), "pieces")
    counts = {r.length: r.n for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = spark.createDataFrame(plan_bins(counts, capacity) or [(0, 0, 0, 0, 1, 0)], "length long, rank_from long, rank_to long, bin_from long, each long, place long")
    # ranks: about 1000 rows share a (length, bucket), whatever the input; the counts before a bucket are summed by length
    fold = max(1, sum(counts.values()) // 1000)
    table = table.withColumn("bucket", F.pmod(F.hash("bucket", "length"), F.lit(min(fold, 1 << 16))))
    sizes = table.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    # each length's counts are summed in two steps, so that a length may have many buckets
    wide = sizes.withColumn("hundred", F.floor(F.col("bucket") / 256))
    hundreds = wide.groupBy("length", "hundred").agg(F.sum("n").alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("hundred").rowsBetween(Window.unboundedPreceding, -1))).select("length", "hundred", F.coalesce("base", F.lit(0)).alias("base"))
    before = wide.withColumn("sum", F.sum("n").over(Window.partitionBy("length", "hundred").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).join(hundreds, ["length", "hundred"]).select("length", "bucket", (F.coalesce("sum", F.lit(0)) + F.col("base")).alias("skip"))
    order = Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = table.withColumn("nth", F.row_number().over(order) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("nth") + F.col("skip"))
    # the plan has rows for each combination and length, a number bounded by capacity: broadcast
    spans = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("rank_from", "rank_to", "bin_from", "each", "place"))).alias("spans"))
    span = F.filter("spans", lambda s: (s.rank_from <= F.col("rank")) & (F.col("rank") < s.rank_to))[0]
    placed = ranked.join(F.broadcast(spans), "length").withColumn("span", span).withColumn("r", F.col("rank") - F.col("span.rank_from"))
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []),
        (F.col("span.bin_from") + F.floor(F.col("r") / F.col("span.each"))).cast("long").alias("sequence_id"),
        (F.col("span.place") + F.pmod(F.col("r"), F.col("span.each")) * F.col("length")).cast("long").alias("offset"),
    )
