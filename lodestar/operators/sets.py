"""Algebra of sorted id sets, as Columns on arrays and as joins on (key, value) relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded(a: Column, upper: Column) -> Column:
    """The elements below upper."""
    return F.filter(a, lambda x: x < upper)


def intersect(a: Column, b: Column, upper: Column | None = None) -> Column:
    both = F.sort_array(F.array_intersect(a, b))
    return both if upper is None else bounded(both, upper)


def intersect_count(a: Column, b: Column, upper: Column | None = None, without: tuple[Column, ...] = ()) -> Column:
    both = intersect(a, b, upper)
    for x in without:
        both = F.array_remove(both, x)
    return F.size(both).cast("long")


def difference(a: Column, b: Column, own: Column | None = None, upper: Column | None = None) -> Column:
    """a without b and, if given, without the id of b's owner."""
    rest = F.sort_array(F.array_except(a, b))
    if own is not None:
        rest = F.array_remove(rest, own)
    return rest if upper is None else bounded(rest, upper)


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def union(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def points_in_intervals(points: DataFrame, intervals: DataFrame, width: int, upper: int | None = None) -> DataFrame:
    """start, n: points (p) in each half-open interval (start, stop). Both sides meet in buckets of the given width, so no side is replicated beyond the buckets that an interval spans."""
    p = points.withColumn("bucket", F.floor(F.col("p") / width))
    if upper is not None:
        p = p.where(F.col("p") < upper)
    i = intervals.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    counts = p.groupBy("bucket", "p").agg(F.count("*").alias("c"))  # equal points meet once
    return i.join(counts, "bucket").where("p >= start and p < stop").groupBy("start").agg(F.sum("c").alias("n"))


def interval_overlap(a: DataFrame, b: DataFrame, width: int, upper: int | None = None) -> DataFrame:
    """total: the summed length of the overlaps of two lists of half-open intervals (start, stop), below upper if given."""
    cut = (lambda d: d) if upper is None else (lambda d: d.withColumn("stop", F.least("stop", F.lit(upper))).where("start < stop"))
    spans = lambda d: F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width)))
    x = cut(a).select("start", "stop", spans(a).alias("bucket"))
    y = cut(b).select(F.col("start").alias("s"), F.col("stop").alias("e"), spans(b).alias("bucket"))
    low, high = F.greatest("start", "s", F.col("bucket") * width), F.least("stop", "e", (F.col("bucket") + 1) * width)
    return x.join(y, "bucket").select((high - low).alias("length")).where("length > 0").agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total"))
