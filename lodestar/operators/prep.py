"""Preparation of attributes, labels and queries, and synthesis of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_seen_codes(rows: DataFrame, order: str, value: str) -> DataFrame:
    """value, code: codes from 0 in the order in which the values first occur. Dictionaries are small: one window."""
    first = rows.groupBy(value).agg(F.min(order).alias("_first"))
    return first.select(value, (F.row_number().over(Window.orderBy("_first", value)) - 1).cast("long").alias("code"))


def sorted_codes(rows: DataFrame, value: str) -> DataFrame:
    """value, code: codes from 0 in the order of the values."""
    return rows.select(value).distinct().select(value, (F.row_number().over(Window.orderBy(value)) - 1).cast("long").alias("code"))


def composite_label(codes: list[Column], sizes: list[Column]) -> Column:
    """One number for several codes, in mixed radix, the first code leading."""
    out = codes[0]
    for code, size in zip(codes[1:], sizes[1:], strict=True):
        out = out * size + code
    return out


def label_text(labels: Column, shift: int, empty: str) -> Column:
    """Labels as a comma-separated line, each shifted; empty for none."""
    line = F.array_join(F.transform(F.sort_array(labels), lambda x: (x + shift).cast("string")), ",")
    return F.when(F.size(labels) > 0, line).otherwise(F.lit(empty))


def parse_label_text(lines: DataFrame, shift: int = 0) -> DataFrame:
    """id, label from (id, line): the inverse of label_text; lines that stand for no label give no row."""
    parts = lines.select("id", F.explode(F.split("line", ",")).alias("t")).where(F.trim("t").rlike("^[0-9]+$"))
    return parts.select("id", (F.col("t").cast("long") - shift).alias("label"))


def indptr(rows: DataFrame, n: int) -> DataFrame:
    """row, start: offsets of a sparse matrix with n rows from its entries (row, col); row n has the total."""
    from lodestar.operators.sequence import scan

    counts = rows.groupBy("row").agg(F.count("*").alias("x"))
    every = rows.sparkSession.range(n + 1).select(F.col("id").alias("i")).join(counts.select(F.col("row").alias("i"), "x"), "i", "left").fillna(0, ["x"])
    return scan(every).select(F.col("i").alias("row"), F.col("scan").alias("start"))


def bernoulli_labels(ids: DataFrame, n_labels: int, keep: Column) -> DataFrame:
    """id, label for each label below n_labels where keep, an expression of id and label, holds."""
    return ids.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_labels - 1).cast("long"))).alias("label")).where(keep)


def distinct_labels(ids: DataFrame, n_labels: int, per_row: Column, seed: int = 0, weights: list[float] | None = None) -> DataFrame:
    """id, label: per_row distinct labels of each id, uniform or by weights (exponential keys), from hashes."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "id", "label"), F.lit(1 << 52)).cast("double") + 1) / float(1 << 52)
    w = F.lit(1.0) if weights is None else F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("label") + 1).cast("int"))
    keyed = ids.select("id", per_row.alias("want"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_labels - 1).cast("long"))).alias("label")).withColumn("key", -F.log(u) / w)
    return keyed.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("key", "label"))).where("r <= want").select("id", "label")


def zipf_weights(n: int) -> list[float]:
    return [1 / (i + 1) for i in range(n)]


def random_vectors(spark: SparkSession, n: int, dim: int, centres: int, spread: float = 0.2, seed: int = 0) -> DataFrame:
    """id, v: points around centres on the unit sphere's scale; the same for the same arguments."""
    normal = lambda *key: F.sqrt(-2 * F.log((F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)) + 1) / float(1 << 40))) * F.cos(6.283185307179586 * F.pmod(F.xxhash64(F.lit(seed + 1), *key), F.lit(1 << 40)) / float(1 << 40))
    centre = F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(centres))
    v = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: normal(F.lit("c"), centre, d) + spread * normal(F.lit("p"), F.col("id"), d))
    return spark.range(n).select("id", v.alias("v"))


def random_queries(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows picked by a hash of their ids."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)


def subset(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """Rows of the picked ids with a new dense id from 0 in the order of the old (kept as old_id)."""
    from lodestar.operators.sequence import order_index

    kept = rows.join(picked.select("id").distinct(), "id").withColumnRenamed("id", "old_id")
    return order_index(kept, ["old_id"]).withColumnRenamed("i", "id")
