"""The search tables derived from the driver's embeddings: vectors, labels, queries, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.distance import quantise_u8

DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str, u8: bool = False) -> DataFrame:
    """id, v: doubles, or integers from 0 to 255."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (quantise_u8(F.col("embedding")) if u8 else F.col("embedding").cast("array<double>")).alias("v"))


def vec_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label by integer arithmetic: 0..19 frequent, 20..22 rare, 23 empty."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    many = ids.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("label")).where("((id + 1) * (label + 3) * 7919 + id * id * 31 + label * label * 17) % 1009 < 404")
    rare = [ids.where(c).select("id", F.lit(j).cast("long").alias("label")) for c, j in (("id % 50 = 0", 20), ("id % 25 = 1", 21), ("id % 100 = 7", 22))]
    out = many
    for r in rare:
        out = out.unionByName(r)
    return out


def queries(spark: SparkSession, sf_dir: str, arity: int, u8: bool = False) -> DataFrame:
    """qid, qv, qlabels of the rows with id % 10 = 3."""
    k = "id div 10"
    a = f"({k} * 7 + 3) % 20"
    b = f"({a} + 1 + {k} % 19) % 20"
    c = f"({b} + 1 + {k} % 17) % 20"
    base = vectors(spark, sf_dir, u8).where("id % 10 = 3").select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.expr(a).alias("a"), F.expr(b).alias("b"), F.expr(c).alias("c"))
    if arity == 3:
        base = base.where("c <> a and c <> b")
    return base.select("qid", "qv", F.array(*[F.col(x).cast("long") for x in "abc"[:arity]]).alias("qlabels"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: customers and suppliers of the same nation, one supplier for each pair of keys; a graph with hubs."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), "c_nationkey")
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("dst"), "s_nationkey", "s_suppkey")
    return c.join(s, F.col("c_nationkey") == F.col("s_nationkey")).where("(src + s_suppkey) % 7 = 0").select(F.col("src").cast("long"), F.col("dst").cast("long"))
