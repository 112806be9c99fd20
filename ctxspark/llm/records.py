"""The records of raw_rows and base_examples as (src, rec_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW, BASE = "raw_rows", "base_examples"


def raw_texts(raw: DataFrame) -> DataFrame:
    """(src, rec_id, text): the non-null message contents joined by one line feed. A null prompt gives an empty text."""
    parts = F.filter(F.transform("prompt", lambda m: m["content"]), lambda c: c.isNotNull())
    return raw.where("row_id is not null").select(
        F.lit(RAW).alias("src"), F.col("row_id").alias("rec_id"), F.coalesce(F.array_join(parts, "\n"), F.lit("")).alias("text")
    )


def base_texts(base: DataFrame) -> DataFrame:
    """(src, rec_id, text): the non-null memory strings joined by one line feed."""
    return base.where("example_id is not null").select(
        F.lit(BASE).alias("src"), F.col("example_id").alias("rec_id"), F.coalesce(F.array_join("memory_strings", "\n"), F.lit("")).alias("text")
    )


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of both tables, delivered rows twice where they were delivered twice."""
    return raw_texts(spark.read.parquet(f"{sf_dir}/{RAW}.parquet")).unionByName(base_texts(spark.read.parquet(f"{sf_dir}/{BASE}.parquet")))
