"""Preparation of whole data sets: attributes and categories to labels, subsets of queries, synthetic sets, their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.labels import label_rows, percentile_slices, specificity
from lodestar.operators.prep import bernoulli_labels, composite_label, distinct_labels, first_seen_codes, label_text, random_vectors, sorted_codes
from lodestar.operators.sequence import order_index
from lodestar.sources import native
from lodestar.sources.text import write_lines


def attribute_labels(base: DataFrame, queries: DataFrame, n_attributes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, label) of base rows and of queries (id, attributes), and one row with the number of classes.

    Codes go by first occurrence in base, position by position; the label has them in mixed radix, the first leading.
    Rows with a null value, and queries with one that base lacks, get no label. Dictionaries are joined by shuffle or broadcast as Spark finds them.
    """
    codes = [first_seen_codes(base.select("id", F.col("attributes")[i].alias(f"a{i}")).dropna(), "id", f"a{i}").withColumnRenamed("code", f"c{i}") for i in range(n_attributes)]
    sizes = codes[0].agg(F.count("*").alias("n0"))
    for i in range(1, n_attributes):
        sizes = sizes.join(codes[i].agg(F.count("*").alias(f"n{i}")))  # one row each
    label = composite_label([F.col(f"c{i}") for i in range(n_attributes)], [F.col(f"n{i}") for i in range(n_attributes)])

    def labelled(rows: DataFrame) -> DataFrame:
        out = rows.select("id", *[F.col("attributes")[i].alias(f"a{i}") for i in range(n_attributes)])
        for i in range(n_attributes):
            out = out.join(codes[i], f"a{i}")
        return out.join(F.broadcast(sizes)).select("id", label.alias("label"))

    classes = F.lit(1).cast("long")
    for i in range(n_attributes):
        classes = classes * F.col(f"n{i}")
    return labelled(base), labelled(queries), sizes.select(classes.alias("classes"))


def category_labels(base: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, label) of base rows and of queries (id, category), and the dictionary (category, code), which has base's categories in order."""
    codes = sorted_codes(base.where("category is not null"), "category")
    labels = [rows.join(codes, "category").select("id", F.col("code").alias("label")).distinct() for rows in (base, queries)]
    return labels[0], labels[1], codes


def query_subsets(queries: DataFrame, labels: DataFrame, percents: tuple[int, ...] = (1, 25, 50, 75)) -> DataFrame:
    """subset, qid, n: single_query, double_query and mixed_query by the number of labels, and pc1_query and so on by specificity n.

    Queries of more than two labels are mixed only.
    """
    sizes = specificity(queries, labels).join(queries.select("qid", F.size(F.array_distinct("qlabels")).alias("arity")), "qid")
    named = sizes.select(F.explode(F.array_compact(F.array(F.lit("mixed_query"), F.when(F.col("arity") == 1, "single_query").when(F.col("arity") == 2, "double_query")))).alias("subset"), "qid", "n")
    slices = percentile_slices(sizes.select("qid", "n"), percents).select(F.concat(F.lit("pc"), F.col("percent"), F.lit("_query")).alias("subset"), "qid", "n")
    return named.unionByName(slices)


def write_labels(labels: DataFrame, folder: str, rows: int, classes: int, prefix: str = "") -> None:
    """(id, label) as prefix.metadata.spmat and as the two text forms, comma-separated and shifted by one.

    Rows without labels are -1 and classes + 1 in the texts, whose lines are in the order of ids, which go from 0 to rows.
    """
    native.write_matrix(labels.selectExpr("id as row", "label as col"), f"{folder}/{prefix or 'base'}.metadata.spmat", rows, classes)
    lists = labels.sparkSession.range(rows).join(label_rows(labels), "id", "left").select("id", F.coalesce("labels", F.array().cast("array<long>")).alias("labels"))
    for name, shift, empty in (("labels_comma", 0, "-1"), ("labels_shifted", 1, str(classes + 1))):
        write_lines(lists.select("id", label_text(F.col("labels"), shift, empty).alias("line")), f"{folder}/{prefix + '_' if prefix else ''}{name}.txt")


def synthetic_sets(ids: DataFrame, qids: DataFrame, n_labels: int, per_row: int, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, label) of base rows, each label with probability per_row / n_labels, and of queries with one and with two labels."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "id", "label"), F.lit(n_labels)) < per_row
    return bernoulli_labels(ids.select("id"), n_labels, draw), distinct_labels(qids.select("id"), n_labels, F.lit(1), seed + 1), distinct_labels(qids.select("id"), n_labels, F.lit(2), seed + 2)


def synthetic_points(spark: SparkSession, n: int, queries: int, dim: int, easy: bool = False, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(id, v) of n base rows and of the queries: one draw around as many centres as queries (one, if easy), split by a hash."""
    points = random_vectors(spark, n + queries, dim, 1 if easy else queries, seed=seed)
    mixed = order_index(points.select(F.xxhash64(F.lit(seed + 3), "id").alias("key"), F.col("id").alias("was"), "v"), ["key", "was"])
    return mixed.where(F.col("i") < n).select(F.col("i").alias("id"), "v"), mixed.where(F.col("i") >= n).select((F.col("i") - n).alias("id"), "v")


def dense_queries(queries: DataFrame, subset: DataFrame) -> DataFrame:
    """Queries of a subset with dense ids from 0 in the order of the old ones (kept as old_id)."""
    kept = queries.join(subset.select("qid"), "qid", "left_semi").withColumnRenamed("qid", "old_id")
    return order_index(kept, ["old_id"]).withColumnRenamed("i", "qid")


def write_subset(queries: DataFrame, truth: DataFrame, subset: DataFrame, folder: str, name: str, classes: int, k: int, kind: str = "u8bin") -> None:
    """One subset's query vectors, labels in all forms, and true neighbours as ids and as pairs with distance 0."""
    kept = dense_queries(queries, subset)
    n = kept.count()
    native.write_vectors(kept.select(F.col("qid").alias("id"), F.col("qv").alias("v")), f"{folder}/{name}.{kind}", kind)
    write_labels(kept.select(F.col("qid").alias("id"), F.explode("qlabels").alias("label")), folder, n, classes, name)
    found = truth.where(F.col("rank") <= k).withColumnRenamed("qid", "old_id").join(kept.select("old_id", "qid"), "old_id")
    native.write_vectors(_padded(found, n, k), f"{folder}/{name}_GT.ibin", "ibin")
    native.write_pairs(found.withColumn("dist", F.lit(0.0)), f"{folder}/{name}_GT.pairs", n, k)


def _padded(found: DataFrame, queries: int, k: int) -> DataFrame:
    """(id, v): k neighbours a query by rank, -1 where there are fewer."""
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("l"))  # k a query
    every = found.sparkSession.range(queries).join(lists.withColumnRenamed("qid", "id"), "id", "left")
    at: Column = F.sequence(F.lit(1), F.lit(k))
    return every.select("id", F.transform(at, lambda i: F.coalesce(F.get(F.col("l")["id"], i - 1), F.lit(-1)).cast("int")).alias("v"))
