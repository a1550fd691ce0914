"""Lifecycle, decay, versions and health of memories. All take ``as_of`` where the clock matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text


def clock(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def age(as_of: str, since: str = "created_at") -> Column:
    return scores.days_between(F.col(since), clock(as_of))


def decay(rows: DataFrame, as_of: str) -> DataFrame:
    r = scores.retrievability(age(as_of), F.col("fsrs_stability"))
    score = scores.decay_score(F.col("importance"), F.col("is_static"), age(as_of), F.col("fsrs_stability"))
    return rows.select("id", F.round(r, 6).alias("retrievability"), F.round(score, 6).alias("decay_score"), scores.next_interval(F.col("fsrs_stability")).alias("next_interval"))


def archivable(rows: DataFrame, as_of: str, days: float = 90, accesses: int = 2, floor: float = 0.05) -> DataFrame:
    """Old, seldom read, and hardly retrievable."""
    weak = scores.retrievability(age(as_of), F.col("fsrs_stability")) < floor
    return rows.filter(~F.col("is_static") & ~F.col("is_archived") & (age(as_of) > days) & (F.col("access_count") < accesses) & weak).select("id")


def stale(rows: DataFrame, as_of: str, days: float, k: int) -> DataFrame:
    """Important rows that nobody reads."""
    old = rows.filter((F.col("importance") >= 6) & ~F.col("is_static") & (age(as_of) > days) & (F.col("access_count") < 2))
    return old.orderBy(F.desc("importance"), "created_at", "id").limit(k).select("id", "importance", "access_count", text.preview(F.col("content"), 120).alias("preview"))


def versions_at(rows: DataFrame, at: str) -> DataFrame:
    """(root_memory_id, id, version): the latest version of each root at a time; map-side, one row a root."""
    known = rows.filter(F.col("created_at") <= clock(at))
    last = known.groupBy("root_memory_id").agg(F.max_by(F.struct("id", "version"), F.struct("created_at", "id")).alias("last"))
    return last.select("root_memory_id", "last.id", "last.version")


def version_chains(rows: DataFrame) -> DataFrame:
    """(root_memory_id, versions, chain): each root's versions in order; a chain is as long as its edits."""
    chain = F.sort_array(F.collect_list(F.struct("version", "id")))
    return rows.groupBy("root_memory_id").agg(F.count(F.lit(1)).alias("versions"), F.array_join(F.transform(chain, lambda x: F.concat_ws(":", x["version"], x["id"])), "|").alias("chain"))


def access_tiers(rows: DataFrame) -> DataFrame:
    n = F.col("access_count")
    tier = F.when(n == 0, "never").when(n < 3, "cold").when(n < 8, "warm").otherwise("hot")
    return rows.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("importance"), 4).alias("mean_importance"))


def histogram(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def snapshot(rows: DataFrame, at: str) -> DataFrame:
    """One row of counts of what there was at a time."""
    known = rows.filter(F.col("created_at") <= clock(at))
    names = ("is_static", "is_forgotten", "is_archived", "is_latest")
    return known.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(c.replace("is_", "n_")) for c in names])


def reclaimable(rows: DataFrame) -> DataFrame:
    one = rows.agg(F.count_if("is_forgotten").alias("forgotten"), F.count_if("is_archived").alias("archived"), F.count_if(~F.col("is_latest")).alias("superseded"), F.count_if(F.coalesce(F.trim("content"), F.lit("")) == "").alias("blank"))
    return one.unpivot([], ["forgotten", "archived", "superseded", "blank"], "kind", "n")


def tenants(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("memories"), F.count_if("is_static").alias("statics"), F.sum("access_count").alias("accesses"), F.max("created_at").alias("last_created"), F.sum(text.estimated_tokens(F.col("content"))).alias("tokens"))


def recent(rows: DataFrame, k: int, **equal) -> DataFrame:
    """The newest rows; each given column must equal its value, None asks nothing."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(k).select("id", "category", "source", "created_at")


def unlinked(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows that no link begins or ends at."""
    ends = links.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return rows.join(ends, "id", "left_anti").select("id", "importance")


def state(log: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Last value of each key, the one before it, and how often it was set: the two latest by map-side top-2."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    two = log.select(*keys, *order, value).withColumn("n", rank).filter("n <= 2").groupBy(*keys).agg(F.max(F.when(F.col("n") == 1, F.col(value))).alias("value"), F.max(F.when(F.col("n") == 2, F.col(value))).alias("previous_value"))
    return two.join(log.groupBy(*keys).agg(F.count(F.lit(1)).alias("updates")), keys)


def scratch(writes: DataFrame, as_of: Column, keys: list[str], at: str = "ts", order: str = "event_id", value: str = "value", minutes: Column | None = None, least: int = 1, default: int = 30, most: int = 1440) -> DataFrame:
    """(keys, value, created_at, updated_at, expires_at): of each key the last write, if it still lives at ``as_of``.

    A write lives ``minutes``, ``default`` of them where none are given, held between ``least`` and ``most``. Writes after ``as_of`` or
    without a time take no part; of writes at one time the greater ``order`` counts. One partial aggregate by key; a hot key is one row of it in each task.
    """
    lives = F.least(F.greatest(F.coalesce(F.lit(default) if minutes is None else minutes, F.lit(default)), F.lit(least)), F.lit(most)).cast("long")
    own = writes.filter(F.col(at) <= as_of).select(*keys, F.col(at).alias("_at"), F.struct(F.col(at), F.col(order), F.col(value).alias("_value"), lives.alias("_lives")).alias("_last"))
    last = own.groupBy(*keys).agg(F.min("_at").alias("created_at"), F.max("_last").alias("_last"))
    updated = F.col(f"_last.{at}")
    out = last.select(*keys, F.col("_last._value").alias("value"), "created_at", updated.alias("updated_at"), F.timestamp_add("MINUTE", F.col("_last._lives"), updated).alias("expires_at"))
    return out.filter(F.col("expires_at") > as_of)
