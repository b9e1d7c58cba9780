"""Queries of the operators that train or search models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .lm_score import lm_scores
from .minhash import near_duplicates
from .packing import pack
from .quality import quality_scores, train_quality
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity_scores, train_toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_docs(spark, sf_dir)).drop("kept")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir)).drop("_row")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return quality_scores(docs, train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    return toxicity_scores(docs, train_toxicity(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good and not toxic."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id").distinct().withColumn("_good", F.lit(True))
    # Labels grow with the documents, so they are never broadcast, at no size.
    return lm_scores(_docs(spark, sf_dir).select("doc_id", "text").join(good.hint("merge"), "doc_id", "left"), F.col("_good"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_minhash": op2_minhash, "op3_pack": op3_pack, "op4_decontaminate": op4_decontaminate, "op8_quality": op8_quality, "op9_toxicity": op9_toxicity, "op10_lm_score": op10_lm_score}
SQL: dict[str, str] = {}
