"""Usage, feedback, service levels and trust over the event log; partial sums before every shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores


def usage_daily(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total"))


def usage_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def access_pattern(events: DataFrame) -> DataFrame:
    return events.groupBy((F.dayofweek("ts") - 1).cast("int").alias("day_of_week"), F.hour("ts").cast("int").alias("hour_of_day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def metric_summary(events: DataFrame) -> DataFrame:
    v, exact = F.col("value"), F.col("value").cast("decimal(18,6)")  # decimals sum to the same in any order
    return events.groupBy("user_id", "event_type").agg(F.coalesce(F.round(F.sum(exact).cast("double") / F.count(v), 3), F.lit(0.0)).alias("mean"), F.coalesce(F.min(v), F.lit(0.0)).alias("least"), F.coalesce(F.max(v), F.lit(0.0)).alias("most"), F.count(F.lit(1)).alias("n"))


def precision(events: DataFrame, good: list[str]) -> DataFrame:
    share = F.count_if(F.col("event_type").isin(good)) / F.count(F.lit(1))
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("signals"), scores.half_up(share, 3).alias("precision"))


def service_levels(events: DataFrame, fast: float, slow: float, failed: str) -> DataFrame:
    """Shares under two limits and of failures, in percent, and whether the targets 95, 95 and 1 are met."""
    n = F.count(F.lit(1))
    one = events.agg(n.alias("n"), (100 * F.count_if(F.col("value") < fast) / n).alias("fast"), (100 * F.count_if(F.col("value") < slow) / n).alias("slow"), (100 * F.count_if(F.col("event_type") == failed) / n).alias("errors"))
    return one.select("n", *[F.round(c, 4).alias(f"{c}_percent") for c in ("fast", "slow", "errors")], (F.col("fast") >= 95).alias("fast_met"), (F.col("slow") >= 95).alias("slow_met"), (F.col("errors") < 1).alias("errors_met"))


def groups(events: DataFrame, examples: int = 3) -> DataFrame:
    """Per type: count, first and last seen, and the first examples. A window cut to few rows before it is gathered."""
    stats = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    some = events.select("event_type", "event_id").withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))).filter(F.col("k") <= examples)
    shown = some.groupBy("event_type").agg(F.array_join(F.sort_array(F.collect_list("event_id")), ",").alias("examples"))
    return stats.join(shown, "event_type")


def trust(events: DataFrame) -> DataFrame:
    t = F.col("event_type")
    n = events.groupBy("user_id").agg(F.count_if(t == "purchase").alias("ok"), F.count_if(t == "view").alias("allowed"), F.count_if(t == "error").alias("warned"), F.count_if(F.col("value") > 99).alias("blocked"), F.count_if(F.col("value") < 1).alias("failed"), F.count(F.lit(1)).alias("total"))
    return n.select("user_id", scores.trust(*[F.col(c) for c in ("ok", "allowed", "warned", "blocked", "failed", "total")]).alias("trust"))


def strengths(events: DataFrame) -> DataFrame:
    """Preferences add 0.5 each time they are seen again."""
    return events.groupBy("user_id", F.col("event_type").alias("preference")).agg((1 + 0.5 * (F.count(F.lit(1)) - 1)).alias("strength"))


def sessions(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Episodes: a user's events with no gap of so many minutes."""
    window = F.session_window("ts", f"{minutes} minutes")
    return events.groupBy("user_id", window).agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n")).drop("session_window")
