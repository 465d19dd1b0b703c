"""What the corpus operators share: joins on skewed keys, components, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.storage import cut

__all__ = ["components", "cut", "sampled", "skew_join"]


def skew_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner", share: int = 1000) -> DataFrame:
    """left joined with right on key, where right is unique by key and weight tells how many rows of left have it.

    Keys with more than total / share rows are fewer than share by counting, so they are broadcast;
    all others are joined by a shuffle in which no key holds more than 1 / share of the rows.
    how: inner or left. For left, the keys of left are counted, as right need not have them; rows with a null key
    take no part in any join. left is read twice or more: give it a table that is cheap to read.
    """
    if how == "left":
        some, none = left.where(F.col(key).isNotNull()), left.where(F.col(key).isNull())
        often = cut(some.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") * share > F.lit(total)).select(key), "often")
        met = some.join(F.broadcast(often.join(right, key, "left")), key)
        return met.unionByName(some.join(F.broadcast(often), key, "left_anti").join(right, key, "left")).unionByName(none, allowMissingColumns=True)
    hot = F.broadcast(right.where(F.col(weight) * share > F.lit(total)))
    cold = right.where(F.col(weight) * share <= F.lit(total))
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, component), component being the smallest id.

    Alternating large-star and small-star steps; every step is an aggregation with partial sums and
    a join that survives hubs, and is written out. Self loops add vertices. Null ends are ignored.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    vertices = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(pairs: DataFrame, total: int, large: bool) -> DataFrame:
        """pairs (u, v): every u moves the neighbours v that this step concerns to the smallest of them and u."""
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        met = skew_join(pairs, least, "u", "n", total)
        if large:
            out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return cut(out.where("a <> b").distinct(), "edges")

    before = state(now)
    for _ in range(rounds):
        if before[0] == 0:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        now = star(both, 2 * before[0], True)
        now = star(now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), before[0], False)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return cut(vertices.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "components")


def sampled(rows: DataFrame, group: str, each: int, key: str) -> DataFrame:
    """About each rows of every group (all, if fewer), picked by a hash of key: the bounded sample for fitting.

    Two passes; the first reads only the group column. Every group has its share; a row a group is broadcast.
    """
    counts = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.least(F.lit(1.0), F.lit(float(each)) / F.count("*")).alias("_share"))
    return rows.join(F.broadcast(counts), group).where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 20)) < F.col("_share") * (1 << 20)).select(*rows.columns)
