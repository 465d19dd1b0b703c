"""Operators on sequences: tables (i, x) with positions i from 0.

Order-dependent operators work in two levels: within blocks of consecutive positions, each in one task,
and over one row a block, so that no task sees the whole sequence.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.storage import cut

BLOCK = 1 << 16
_MONOIDS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.greatest(a, b) if kind == "max" else F.least(a, b)


def tabulate(spark: SparkSession, n: int, f: Callable[[Column], Column]) -> DataFrame:
    """i, x = f(i) for i < n."""
    return spark.range(n).select(F.col("id").alias("i"), f(F.col("id")).alias("x"))


def scan(s: DataFrame, kind: str = "sum", inclusive: bool = False, block: int = BLOCK) -> DataFrame:
    """i, x, scan: the monoid (sum, max, min) of all values before i, or up to it; null (0 for sum) where there are none."""
    fold = _MONOIDS[kind]
    parts = s.withColumn("block", F.expr(f"i div {block}"))
    totals = parts.groupBy("block").agg(fold("x").alias("t"))
    before = totals.select("block", fold("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    own = Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return parts.withColumn("own", fold("x").over(own)).join(before, "block").select("i", "x", _combine(kind, F.col("before"), F.col("own")).alias("scan"))


def fold(s: DataFrame, zero: Column, lift: Callable[[Column], Column], op: Callable[[Column, Column], Column], block: int = 1 << 12) -> DataFrame:
    """x: all values combined in order by a user's monoid: lift(value) gives its elements, op(a, b) combines them, zero is neutral.

    op need not commute. Blocks of consecutive positions are folded in one row each, then blocks of blocks.
    """
    now = s.select("i", lift(F.col("x")).alias("x"))
    n = s.agg(F.max("i")).first()[0]
    while True:
        lists = now.groupBy(F.expr(f"i div {block}").alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("l"))
        now = cut(lists.select("i", F.aggregate("l", zero, lambda a, e: op(a, e["x"])).alias("x")), "folded")
        n = (n or 0) // block
        if not n:
            return now.select("x")


def neighbour(s: DataFrame, offset: int, name: str, block: int = BLOCK) -> DataFrame:
    """s with the value at i + offset (null beyond the ends): an equi-join on positions, so no global window."""
    other = s.select((F.col("i") - offset).alias("i"), F.col("x").alias(name))
    return s.join(other, "i", "left")


def pack_index(s: DataFrame, flag: Column) -> DataFrame:
    """Positions where flag holds, renumbered: k, i."""
    marked = s.select("i", F.when(flag, 1).otherwise(0).alias("x"))
    return scan(marked).where("x = 1").select(F.col("scan").alias("k"), "i")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, x of both sequences merged in order; on ties a comes first."""
    both = a.select("i", "x", F.lit(0).alias("side")).unionByName(b.select("i", "x", F.lit(1).alias("side")))
    return order_index(both, ["x", "side", "i"]).select("i", "x")


def order_index(s: DataFrame, by: list[str], rows: int = 1 << 20) -> DataFrame:
    """Rows renumbered i = 0, 1, ... by the columns: range-partitioned sort, then counts of the parts before.

    There are as many parts as the session shuffles into, or more, so that a part has about rows at most. The parts
    are written out, since bounds are sampled anew whenever they are computed. by must order rows totally.
    """
    parts = max(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-s.count() // rows))
    named = [F.col(c).alias(f"_k{j}") for j, c in enumerate(by)]
    keys = [f"_k{j}" for j in range(len(by))]
    ranged = s.select("*", *named).repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part").orderBy(*keys)
    ranged = cut(ranged.withColumn("_n", F.row_number().over(own)), "ranged")
    counts = ranged.groupBy("_part").agg(F.max("_n").alias("_c"))
    before = counts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = ranged.join(F.broadcast(before), "_part")  # one row a part
    return out.withColumn("i", F.col("_before") + F.col("_n") - 1).drop("_part", "_n", "_before", *keys)


def find_first(s: DataFrame, condition: Column) -> DataFrame:
    """i of the first match, or the length."""
    return s.agg(F.coalesce(F.min(F.when(condition, F.col("i"))), F.count("*")).cast("long").alias("i"))


def quantifiers(s: DataFrame, condition: Column) -> DataFrame:
    return s.agg(F.coalesce(F.bool_and(condition), F.lit(True)).alias("all_of"), F.coalesce(F.bool_or(condition), F.lit(False)).alias("any_of"), (~F.coalesce(F.bool_or(condition), F.lit(False))).alias("none_of"))


def adjacent_find(s: DataFrame) -> DataFrame:
    """The first i whose value equals the next one, or the length."""
    pairs = neighbour(s, 1, "y")
    return pairs.agg(F.coalesce(F.min(F.when(F.col("x") == F.col("y"), F.col("i"))), F.count("*")).cast("long").alias("i"))


def mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """The first i where the sequences differ or one ends."""
    both = a.join(b.select("i", F.col("x").alias("y")), "i", "full")
    return both.agg(F.coalesce(F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("i"))), F.count("*")).cast("long").alias("i"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """equal, less: element-wise equality and lexicographical order."""
    both = a.join(b.select("i", F.col("x").alias("y")), "i", "full")
    first = F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.struct("i", "x", "y")))
    return both.agg(first.alias("d")).select(F.col("d").isNull().alias("equal"), F.coalesce(F.col("d").isNotNull() & F.col("d.y").isNotNull() & (F.col("d.x").isNull() | (F.col("d.x") < F.col("d.y"))), F.lit(False)).alias("less"))


def search(s: DataFrame, pattern: list, last: bool = False) -> DataFrame:
    """The first (or last) i where the pattern starts, or the length."""
    sought = s.sparkSession.createDataFrame([(j, x) for j, x in enumerate(pattern)], "j long, x long")
    hits = s.join(F.broadcast(sought), "x").groupBy((F.col("i") - F.col("j")).alias("at")).agg(F.count("*").alias("n")).where(F.col("n") == len(pattern))
    found = hits.agg((F.max if last else F.min)("at").alias("at"))
    return s.agg(F.count("*").alias("n")).crossJoin(found).select(F.coalesce("at", "n").cast("long").alias("i"))


def unique(s: DataFrame) -> DataFrame:
    """i, x without values equal to the one before."""
    return neighbour(s, -1, "y").where(~F.col("x").eqNullSafe(F.col("y")) | (F.col("i") == 0)).select("i", "x")


def extremes(s: DataFrame) -> DataFrame:
    """Positions of the smallest and the largest value, the first of equals."""
    return s.agg(F.min(F.struct("x", "i"))["i"].alias("min_i"), F.min(F.struct((-F.col("x")).alias("x"), "i"))["i"].alias("max_i"))


def reverse(s: DataFrame) -> DataFrame:
    n = s.agg(F.count("*").alias("n"))
    return s.join(F.broadcast(n)).select((F.col("n") - 1 - F.col("i")).alias("i"), "x")


def rotate(s: DataFrame, k: int) -> DataFrame:
    """The element at k comes first."""
    n = s.agg(F.count("*").alias("n"))
    return s.join(F.broadcast(n)).select(F.pmod(F.col("i") - k, F.col("n")).alias("i"), "x")


def sorted_until(s: DataFrame) -> DataFrame:
    """is_sorted, until: the first position whose value is below the one before, or the length."""
    pairs = neighbour(s, -1, "y")
    return pairs.agg(F.min(F.when(F.col("x") < F.col("y"), F.col("i"))).alias("at"), F.count("*").alias("n")).select(F.col("at").isNull().alias("is_sorted"), F.coalesce("at", "n").cast("long").alias("until"))


def is_partitioned(s: DataFrame, condition: Column) -> DataFrame:
    """Whether all elements that satisfy the condition come first."""
    return s.agg((F.coalesce(F.max(F.when(condition, F.col("i"))), F.lit(-1)) < F.coalesce(F.min(F.when(~condition, F.col("i"))), F.count("*"))).alias("partitioned"))


def split_at(s: DataFrame, flag: Column) -> DataFrame:
    """part, n, total: runs that end after each flagged position."""
    ends = scan(s.select("i", F.when(flag, 1).otherwise(0).alias("x"))).select("i", F.col("scan").alias("part"))
    return s.join(ends, "i").groupBy("part").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


def tokens(texts: DataFrame, text_col: str = "text") -> DataFrame:
    return texts.select("doc_id", F.explode(F.filter(F.split(text_col, r"\s+"), lambda w: w != "")).alias("token"))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to id, cols, vals: the distinct tokens of each text, as tokens() cuts them, and how often they occur."""
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            some = batch.slice(low, 256)
            counts = [Counter(x.as_py().encode("utf-8").split()) for x in some.column(1)]
            ends = pa.array([0, *accumulate(map(len, counts))], pa.int32())
            words = pa.array([w for c in counts for w in c], pa.binary()).cast(pa.string())
            values = pa.array([n for c in counts for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, values)], names=["doc_id", "cols", "vals"])


def reduce_by_index(s: DataFrame, n: int) -> DataFrame:
    """k, total, n for every index k < n of rows (k, x); 0 where there are none."""
    got = s.groupBy("k").agg(F.sum("x").alias("t"), F.count("*").alias("c"))
    return s.sparkSession.range(n).select(F.col("id").alias("k")).join(got, "k", "left").select("k", F.coalesce("t", F.lit(0)).cast("long").alias("total"), F.coalesce("c", F.lit(0)).alias("n"))


def kth_smallest(s: DataFrame, k: int) -> DataFrame:
    """The element with k smaller ones (from 0): ordered take, no full sort."""
    return s.orderBy("x", "i").limit(k + 1).agg(F.max(F.struct("x", "i"))["x"].alias("x"))


def shuffled(s: DataFrame, seed: int) -> DataFrame:
    """A permutation that depends only on seed and positions."""
    return order_index(s.select("x", F.col("i").alias("was"), F.xxhash64(F.lit(seed), "i").alias("key")), ["key", "was"]).select("i", "x")
