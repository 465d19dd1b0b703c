"""Text sources of attributes and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.storage import cut


def numbered_lines(spark: SparkSession, path: str, parts: int = 32) -> DataFrame:
    """id (from 0, in file order), line. Lines get increasing ids by split, then dense ones by counting the splits before."""
    raw = cut(spark.read.text(path).select(F.monotonically_increasing_id().alias("_n"), F.col("value").alias("line")), "lines")
    raw = raw.withColumn("_part", F.shiftright("_n", 33))
    counts = raw.groupBy("_part").agg(F.count("*").alias("c"))
    before = counts.select("_part", F.coalesce(F.sum("c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return raw.join(F.broadcast(before), "_part").select((F.col("before") + F.col("_n").bitwiseAND((1 << 33) - 1)).alias("id"), "line")


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """id, attributes (array of strings) from a file whose first line has the numbers of rows and attributes."""
    lines = numbered_lines(spark, path)
    return lines.where("id > 0").select((F.col("id") - 1).alias("id"), F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "").alias("attributes"))


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """id, label from comma-separated lines; empty lines are skipped and not counted."""
    kept = numbered_lines(spark, path).where(F.trim("line") != "")
    from lodestar.operators.sequence import order_index

    dense = order_index(kept.withColumnRenamed("id", "was"), ["was"]).select(F.col("i").alias("id"), "line")
    return dense.select("id", F.explode(F.split("line", ",")).alias("t")).where(F.trim("t").rlike("^[0-9]+$")).select("id", F.trim("t").cast("long").alias("label"))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """id, category from JSON lines with main_categories (base rows) or label (queries)."""
    lines = numbered_lines(spark, path)
    parsed = lines.select("id", F.from_json("line", "main_categories array<string>, label string").alias("j"))
    return parsed.select("id", F.explode(F.coalesce(F.col("j.main_categories"), F.array("j.label"))).alias("category")).where("category is not null")


def write_lines(rows: DataFrame, path: str) -> None:
    """(id, line) as text files in the order of ids."""
    rows.repartitionByRange("id").sortWithinPartitions("id").select("line").write.text(path)
