"""Event streams: windowed usage with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_dir


def daily(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts by day and type; state is let go once the watermark has passed a day."""
    days = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return days.select(F.to_date("window.start").cast("string").alias("day"), "event_type", "n")


def run_available(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """All files at hand through the stream into a table of the shared folder: what changed in each batch, of which the latest counts."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{path}/{pattern}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    query = daily(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))
