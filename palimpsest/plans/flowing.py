"""Registered queries on streams with state and timers, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import frames
from ..streaming import stateful
from .evolving import _PRINTS, GRADES
from .evolving import SQL as EVOLVING
from .relational import SQL as RELATIONAL
from .sql import MEMORIES

HOURS, SILENCE, BUCKETS = 24 * 30, 3 * 3600, 64


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table, file or folder of files, as a stream."""
    schema = frames.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf}/{name}.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    # a file alone can't be a stream's folder
    schema = frames.table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_window_counters(spark: SparkSession, sf: str) -> DataFrame:
    rows = stateful.drained(spark, stateful.anchored_windows(_events(spark, sf), "user_id", "ts", "event_id", 3600, 3), "append")
    return rows.groupBy(F.col("key").alias("user_id")).agg(F.max("n").alias("most"), F.count_if("limited").alias("limited"))


def stream_review_states(spark: SparkSession, sf: str) -> DataFrame:
    grade = F.element_at(F.expr(f"array({GRADES[1:-1]})"), (F.col("event_id") % 7 + 1).cast("int"))
    rows = stateful.drained(spark, stateful.reviewed(_events(spark, sf).withColumn("grade", grade), "user_id", "ts", "grade"), "update")
    last = rows.groupBy("key").agg(F.max_by(F.struct(*stateful._Reviews.names), F.struct("at", "reps")).alias("s"))
    return last.select(F.col("key").alias("id"), "s.*")


def stream_heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    """Users, when they were last seen, and whether they have been silent for three hours when all events have passed."""
    rows = stateful.drained(spark, stateful.silences(_events(spark, sf), "user_id", "ts", "event_id", SILENCE), "update")
    last = rows.groupBy("key").agg(F.max_by(F.struct("at", "status"), F.struct("at", "batch")).alias("s"))
    return last.select(F.col("key").alias("user_id"), F.date_format(F.timestamp_micros("s.at"), "yyyy-MM-dd HH:mm:ss").alias("seen"), "s.status")


def stream_near_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a user's earlier one of the last 30 days at most three bits away, and the nearest of these."""
    i = F.col("doc_id")
    rows = _documents(spark, sf).select(i.alias("id"), "text", (i % 3 + 1).alias("user_id"), F.timestamp_seconds(F.lit(1_704_067_200) + (i % 8760) * 3600).alias("at"))
    found = stateful.drained(spark, stateful.near_copies(rows, "user_id", "at", "id", "text", HOURS, buckets=BUCKETS), "append")
    best = found.groupBy("id").agg(F.min(F.struct("distance", "original_at", "original")).alias("s"))
    return best.select("id", "s.original", F.col("s.distance").cast("int").alias("distance"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return _stream(spark, sf, "documents")


def stream_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    """Events by channel for their subscribers, which are customers: half of them take purchases only."""
    c = F.col("c_custkey")
    subs = frames.table(spark, sf, "customer").select(c.alias("agent"), (c % 150).alias("channel"), F.when(c % 2 == 0, "purchase").alias("filter_type"))
    rows = stateful.fan_out(_events(spark, sf).select("event_id", "user_id", "event_type"), subs, "user_id", "event_type")
    return stateful.drained(spark, rows, "append").groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (stream_window_counters, stream_review_states, stream_heartbeats, stream_near_copies, stream_fan_out)}

SQL: dict[str, str] = {
    "stream_window_counters": RELATIONAL["window_counters"],
    "stream_review_states": EVOLVING["review_states"],
    "stream_heartbeats": f"""SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS seen,
        CASE WHEN max(ts) + INTERVAL {SILENCE} SECOND <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE THEN 'stale' ELSE 'online' END AS status FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1""",
    "stream_near_copies": f"""WITH {MEMORIES}, {_PRINTS}, timed AS MATERIALIZED (SELECT id, bits, id % 3 AS owner, to_timestamp(1704067200 + id % 8760 * 3600) AS at FROM prints)
        SELECT x.id, y.id AS original, CAST(bit_count(xor(x.bits, y.bits)) AS INTEGER) AS distance FROM timed x JOIN timed y ON x.owner = y.owner AND (y.at, y.id) < (x.at, x.id) AND y.at >= x.at - INTERVAL {HOURS} HOUR
        WHERE bit_count(xor(x.bits, y.bits)) <= 3 QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY bit_count(xor(x.bits, y.bits)), y.at, y.id) = 1""",
    "stream_fan_out": """SELECT c_custkey AS agent, count(*) AS n, max(event_id) AS last FROM events JOIN customer ON user_id = c_custkey % 150 AND (c_custkey % 2 <> 0 OR event_type = 'purchase')
        WHERE event_type NOT LIKE '%' || chr(10) || '%' GROUP BY 1""",
}
