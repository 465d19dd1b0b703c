"""The corpus pipeline: quality rules, language ID, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's rows to the
shared folder and reads them again for the next. All stages but the last return the columns of docs, which
may have more columns than documents, of any names.
SQL can't express these stages, so ORACLE_SQL is None and tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import jaccard, language_id, packing, quality, suffix_dedup
from lodestar.llm.common import cut

#: Share of a text's n-grams that its language must have for the text to stay.
MIN_LANGUAGE_SCORE = 0.3
TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    return quality.judge(rows, quality.fit(docs), columns=["row"]).where("kept").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known well enough; lang becomes the predicted one."""
    model = language_id.train(docs.where(~language_id.held_out()), "doc_id", "text", "lang")
    told = language_id.identify(docs.select(F.struct("*").alias("row"), "text"), model, ["row"])
    kept = told.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(F.col("row").withField("lang", F.col("lang_pred")).alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id; of equal ids the text with the smaller MD5. Rows without an id stay."""
    return jaccard.without_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of long repeated strings; those left without any text go."""
    out = suffix_dedup.without_repeats(docs).where(F.length(F.trim("text")) > 0)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality_rules", quality_rules), ("language_id", language), ("near_duplicates", near_duplicates), ("suffix_dedup", repeated_passages), ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
