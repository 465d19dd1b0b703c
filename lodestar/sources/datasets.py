"""A catalogue of datasets: their shape, type, distance and kind of search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources import native


@dataclass(frozen=True)
class DatasetSpec:
    """n rows of dim elements of dtype (float32, uint8, int8); distance euclidean or ip; search knn, knn_filtered or range."""

    name: str
    n: int
    dim: int
    dtype: str = "float32"
    distance: str = "euclidean"
    search: str = "knn"
    k: int = 10

    @property
    def kind(self) -> str:
        return {"float32": "fbin", "uint8": "u8bin", "int8": "i8bin"}[self.dtype]

    def base(self, spark: SparkSession, folder: str, crop: int | None = None) -> DataFrame:
        """The base rows, the first crop of them if given."""
        return native.read(spark, f"{folder}/{self.name}_base.{self.kind}", self.kind, min(self.n, crop or self.n))

    def rows(self, spark: SparkSession, folder: str, start: int, end: int) -> DataFrame:
        """Base rows start to end; nothing else is read."""
        return native.read(spark, f"{folder}/{self.name}_base.{self.kind}", self.kind, end - start, start)

    def blocks(self, spark: SparkSession, folder: str, rows: int = 512, split: tuple[int, int] = (1, 0)) -> Iterator[DataFrame]:
        """The base rows of shard split[1] of split[0], block by block."""
        low, high = (self.n * (split[1] + i) // split[0] for i in (0, 1))
        for at in range(low, high, rows):
            yield self.rows(spark, folder, at, min(high, at + rows))

    def queries(self, spark: SparkSession, folder: str) -> DataFrame:
        return native.read(spark, f"{folder}/{self.name}_query.{self.kind}", self.kind).select(F.col("id").alias("qid"), F.col("v").alias("qv"))

    def groundtruth(self, spark: SparkSession, folder: str, k: int | None = None) -> DataFrame:
        return native.read(spark, f"{folder}/{self.name}_gt.knn", "knn").where(F.col("rank") <= (k or self.k))


#: Public names, rows, dimension, type, distance and kind of search. Sparse sets have no dimension.
CATALOGUE = {
    s.name: s
    for s in (
        DatasetSpec("bigann-1B", 1_000_000_000, 128, "uint8"), DatasetSpec("bigann-100M", 100_000_000, 128, "uint8"), DatasetSpec("bigann-10M", 10_000_000, 128, "uint8"),
        DatasetSpec("deep-1B", 1_000_000_000, 96), DatasetSpec("deep-100M", 100_000_000, 96), DatasetSpec("deep-10M", 10_000_000, 96),
        DatasetSpec("ssnpp-1B", 1_000_000_000, 256, "uint8", search="range"), DatasetSpec("ssnpp-10M", 10_000_000, 256, "uint8", search="range"),
        DatasetSpec("ssnpp-100M", 100_000_000, 256, "uint8", search="range"), DatasetSpec("ssnpp-1M", 1_000_000, 256, "uint8", search="range"),
        DatasetSpec("text2image-1B", 1_000_000_000, 200, distance="ip"), DatasetSpec("text2image-1M", 1_000_000, 200, distance="ip"),
        DatasetSpec("text2image-10M", 10_000_000, 200, distance="ip"), DatasetSpec("text2image-100M", 100_000_000, 200, distance="ip"),
        DatasetSpec("msturing-1B", 1_000_000_000, 100), DatasetSpec("msturing-100M", 100_000_000, 100), DatasetSpec("msturing-10M", 10_000_000, 100), DatasetSpec("msturing-1M", 1_000_000, 100),
        DatasetSpec("msturing-10M-clustered", 10_000_000, 100), DatasetSpec("msturing-30M-clustered", 29_998_994, 100),
        DatasetSpec("msspacev-1B", 1_000_000_000, 100, "int8"), DatasetSpec("msspacev-100M", 100_000_000, 100, "int8"), DatasetSpec("msspacev-10M", 10_000_000, 100, "int8"), DatasetSpec("msspacev-1M", 1_000_000, 100, "int8"),
        DatasetSpec("yfcc-10M", 10_000_000, 192, "uint8", search="knn_filtered"), DatasetSpec("yfcc-10M-unfiltered", 10_000_000, 192, "uint8"),
        DatasetSpec("yfcc-10M-dummy", 10_000_000, 192, "uint8", search="knn_filtered"), DatasetSpec("yfcc-10M-dummy-unfiltered", 10_000_000, 192, "uint8"),
        DatasetSpec("sparse-small", 100_000, 0, distance="ip"), DatasetSpec("sparse-1M", 1_000_000, 0, distance="ip"), DatasetSpec("sparse-full", 8_841_823, 0, distance="ip"),
        DatasetSpec("random-xs", 10_000, 20), DatasetSpec("random-s", 100_000, 50),
        DatasetSpec("random-easy-xs", 10_000, 20), DatasetSpec("random-easy-s", 100_000, 50), DatasetSpec("random-easy-s2", 100_001, 200), DatasetSpec("random-easy", 1_000_000, 200),
        DatasetSpec("random-xs-clustered", 10_000, 20),
        DatasetSpec("random-range-xs", 10_000, 20, search="range"), DatasetSpec("random-range-s", 100_000, 50, search="range"),
        DatasetSpec("random-filter-s", 100_000, 50, search="knn_filtered"),
        DatasetSpec("openai-embedding-1M", 1_000_000, 1536),
    )
}
