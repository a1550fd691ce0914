"""The canonical frames over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), F.col("text").alias("content"), F.col("lang").alias("category"), "source", (i % 3 + 1).alias("user_id"), (i % 10 + 1).alias("importance"),
        (i % 4 + 1).alias("source_count"), ((i * 7) % 12).alias("access_count"), (i % 10 == 0).alias("is_static"), (i % 17 == 0).alias("is_forgotten"), (i % 13 == 0).alias("is_archived"),
        (i % 5 != 4).alias("is_latest"), (i - i % 5).alias("root_memory_id"), (i % 5 + 1).alias("version"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + (i % 8760) * 3600).alias("created_at"), (0.3 + (i % 40) / 4.0).alias("fsrs_stability"),
    )


def active(rows: DataFrame) -> DataFrame:
    """Not forgotten, not archived, the latest version."""
    return rows.filter(~F.col("is_forgotten") & ~F.col("is_archived") & F.col("is_latest"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("category"))


def bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, part): memories and the entities that they name."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("entity_id")).distinct()
