"""Facts with validity: a fact holds until a later one of the same subject and verb says something else.

Facts are (id, subject, verb, object, valid_at). Null subjects and verbs form groups of their own; a null object
differs from any other. Ties in time go to the smaller id. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validity(facts: DataFrame) -> DataFrame:
    """``facts`` with invalid_at and invalidated_by, null while a fact still holds."""
    group = Window.partitionBy("subject", "verb")
    ahead = group.orderBy("valid_at", "id")
    # from the newest on, so that the frame only grows: each fact sees the start of the run after its own
    back = group.orderBy(F.desc("valid_at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    changed = facts.withColumn("_changed", ~F.col("object").eqNullSafe(F.lag("object").over(ahead)))
    start = F.last(F.when(F.col("_changed"), F.struct("valid_at", "id")), ignorenulls=True).over(back)
    return changed.withColumn("_next", start).select(*facts.columns, F.col("_next.valid_at").alias("invalid_at"), F.col("_next.id").alias("invalidated_by"))


def holds_at(at: str | Column) -> Column:
    """Whether a row of ``validity`` holds at a time: from valid_at on, before invalid_at."""
    at = F.to_timestamp(F.lit(at)) if isinstance(at, str) else at
    return (F.col("valid_at") <= at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at))


def causes(rows: DataFrame, key_col: str, time_col: str, hours: int) -> DataFrame:
    """``rows`` with n_before: how many of the same key came within so many hours before. No pairs are made."""
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    before = Window.partitionBy(key_col).orderBy(micros).rangeBetween(-hours * 3_600_000_000, -1)
    return rows.withColumn("n_before", F.count(F.lit(1)).over(before))


def beyond_newest(rows: DataFrame, key_cols: list[str], order_cols: list[str], keep: int) -> DataFrame:
    """The rows that keeping each key's newest ones would prune."""
    newest = Window.partitionBy(*key_cols).orderBy(*[F.desc(c) for c in order_cols])
    return rows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") > keep).drop("_n")
