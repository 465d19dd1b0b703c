"""Exact nearest-neighbour operators. Ties always go by (distance, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.blocks import search_blocks, sparse_blocks
from lodestar.operators.labels import label_rows


def top_k(scored: DataFrame, k: int, descending: bool = False) -> DataFrame:
    """qid, rank, id, dist of the k best rows (qid, id, dist) of each query; the filter on the rank is pushed below the shuffle."""
    best = F.desc("dist") if descending else F.asc("dist")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(best, "id")).cast("long"))
    return ranked.where(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def score(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, distance: Column) -> DataFrame:
    """qid, id, dist of candidate pairs (qid, id); distance speaks of qv and v."""
    return pairs.join(queries.select("qid", "qv"), "qid").join(vectors.select("id", "v"), "id").select("qid", "id", distance.alias("dist"))


def filtered_knn(queries: DataFrame, labels: DataFrame, vectors: DataFrame, k: int, dim: int | None = None, kind: str = "double") -> DataFrame:
    """The k nearest rows that carry all labels of the query; fewer, if there are fewer."""
    rows = vectors.select("id", "v").join(label_rows(labels), "id")
    return top_k(search_blocks(queries.select("qid", "qv", "qlabels"), rows, k, kind=kind), k)


def all_pairs(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every query with every row: a stated query set against all rows, in as many blocks of rows as there are shuffle partitions."""
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = queries.select("qid", "qv", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    rows = vectors.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"))
    return blocks.join(rows, "block")


def unfiltered_knn(queries: DataFrame, vectors: DataFrame, k: int, dim: int | None = None, kind: str = "double", exclude_self: bool = False) -> DataFrame:
    return top_k(search_blocks(queries.select("qid", "qv"), vectors, k, exclude_self=exclude_self, kind=kind), k)


def max_inner_product(queries: DataFrame, vectors: DataFrame, k: int, dim: int | None = None, kind: str = "double") -> DataFrame:
    return top_k(search_blocks(queries.select("qid", "qv"), vectors, k, product=True, kind=kind), k, descending=True)


def range_search(queries: DataFrame, vectors: DataFrame, radius_squared: float, dim: int | None = None, kind: str = "double") -> DataFrame:
    """qid, id, dist of all rows nearer than the radius."""
    return search_blocks(queries.select("qid", "qv"), vectors, radius=radius_squared, kind=kind)


def partitioned_knn(queries: DataFrame, vectors: DataFrame, k: int, dim: int | None = None, kind: str = "double") -> DataFrame:
    """Queries search only the rows of their population (column population on both sides)."""
    asked = queries.select("qid", "qv", F.array(F.col("population").cast("long")).alias("qlabels"))
    return top_k(search_blocks(asked, vectors.select("id", "v", F.array(F.col("population").cast("long")).alias("labels")), k, kind=kind), k)


def sparse_mips(queries: DataFrame, rows: DataFrame, k: int, entries: int | None = None) -> DataFrame:
    """The k largest inner products of sparse vectors (qid, cols, vals) and (id, cols, vals); only common columns meet.

    A product is summed within one group of rows (sparse_blocks), so that pairs of queries and rows are never shuffled.
    """
    return top_k(sparse_blocks(queries, rows, k, entries), k, descending=True)
