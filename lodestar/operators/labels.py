"""Operators on the label relation (id, label): statistics, predicates, intersections, bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_sizes(labels: DataFrame) -> DataFrame:
    """label, n."""
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def big_labels(labels: DataFrame, cutoff: int) -> DataFrame:
    """label, n, ordinal (from 0, by label) of labels with more than cutoff members. Labels are few: one small window."""
    sizes = label_sizes(labels).where(F.col("n") > cutoff)
    return sizes.withColumn("ordinal", (F.row_number().over(Window.orderBy("label")) - 1).cast("long"))


def posting_lists(labels: DataFrame) -> DataFrame:
    """label, ids in ascending order."""
    return labels.groupBy("label").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def label_rows(labels: DataFrame) -> DataFrame:
    """id, labels in ascending order."""
    return labels.groupBy("id").agg(F.sort_array(F.collect_list("label")).alias("labels"))


def label_bitmaps(labels: DataFrame) -> DataFrame:
    """label, bucket, bits: a bitmap of 32768 ids for each label and bucket."""
    return labels.groupBy("label", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def matching(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """qid, id: rows that carry all of a query's labels (relational division).

    Each query starts from its rarest label and the others are semi-joined one by one, so that what is
    shuffled is bounded by the smallest posting list. Repeated labels count once; queries without labels match nothing here.
    """
    sizes = label_sizes(labels).select(F.col("label").alias("need"), "n")
    wanted = queries.select("qid", F.explode(F.array_distinct("qlabels")).alias("need")).join(sizes, "need", "left")
    plan = wanted.groupBy("qid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "need")).alias("seed"), F.collect_set("need").alias("all"))
    seeds = plan.select("qid", F.col("seed.need").alias("label"), F.array_remove("all", F.col("seed.need")).alias("rest"), F.size("all").alias("arity"))
    first = seeds.join(labels, "label").select("qid", "id", "rest", "arity")
    done = first.where("arity = 1").select("qid", "id")
    more = first.where("arity > 1").select("qid", "id", F.size("rest").alias("k"), F.explode("rest").alias("label"))
    met = more.join(labels, ["id", "label"]).groupBy("qid", "id").agg(F.count("*").alias("got"), F.first("k").alias("k")).where("got = k")
    return done.unionByName(met.select("qid", "id"))


def specificity(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """qid, n: how many rows match each query, 0 included."""
    n = matching(queries, labels).groupBy("qid").agg(F.count("*").alias("n"))
    return queries.select("qid").join(n, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"))


def percentile_slices(sizes: DataFrame, percents: tuple[int, ...]) -> DataFrame:
    """percent, qid, n: queries whose place by (n, qid) lies within one percent of the percentile."""
    ranked = sizes.select("qid", "n", (F.row_number().over(Window.orderBy("n", "qid")) - 1).alias("place"), F.count("*").over(Window.partitionBy()).alias("total"))
    return ranked.withColumn("percent", F.explode(F.array(*[F.lit(p).cast("long") for p in percents]))).where(F.abs(100 * F.col("place") / F.col("total") - F.col("percent")) <= 1).select("percent", "qid", "n")


def pair_sizes(labels: DataFrame) -> DataFrame:
    """a, b, n for labels a < b that occur together; touches only pairs that do."""
    left = labels.select("id", F.col("label").alias("a"))
    return left.join(labels.select("id", F.col("label").alias("b")), "id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def pair_cache(labels: DataFrame, big_cutoff: int, precomp_cutoff: int) -> tuple[DataFrame, DataFrame]:
    """(pair_stats: a, b, n, too_large; pair_postings: a, b, id of the pairs that fit) among big labels."""
    big = F.broadcast(big_labels(labels, big_cutoff).select("label"))  # one row a label
    among = labels.join(big, "label")
    stats = pair_sizes(among).withColumn("too_large", F.col("n") > precomp_cutoff)
    both = among.select("id", F.col("label").alias("a")).join(among.select("id", F.col("label").alias("b")), "id").where("a < b")
    return stats, both.join(stats.where("not too_large").select("a", "b"), ["a", "b"]).select("a", "b", "id")


def triangular_index(i, j, n):
    """The place of the pair (i, j), i < j < n, among all pairs in row order."""
    return i * n - (i * (i + 1) / 2).cast("long") + (j - i - 1)


def overlap(labels: DataFrame, pairs: DataFrame, cap: int = 255) -> DataFrame:
    """src, dst, overlap: common labels of each pair of rows, at most cap."""
    a = pairs.join(labels.select(F.col("id").alias("src"), "label"), "src", "left")
    b = labels.select(F.col("id").alias("dst"), "label", F.lit(1).alias("hit"))
    return a.join(b, ["dst", "label"], "left").groupBy("src", "dst").agg(F.least(F.count("hit"), F.lit(cap)).alias("overlap"))
