"""What goes into a context: budgets of tokens, cut texts, scores by age, tags, near names, pooled vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def within_budget(rows: DataFrame, budget: int, text_col: str = "content", score_col: str = "importance", id_col: str = "id") -> DataFrame:
    """(id, tokens, used): the best rows as far as their tokens fit together; rows without text take no part.

    A row takes one token at least, so no more than ``budget`` rows can fit: the running sum sees only those.
    """
    sized = rows.select(F.col(id_col).alias("id"), F.col(score_col).alias("score"), text.estimated_tokens(F.col(text_col)).alias("tokens")).filter("tokens > 0")
    best = sized.orderBy(F.desc("score"), "id").limit(budget)
    order = Window.orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return best.withColumn("used", F.sum("tokens").over(order)).filter(F.col("used") <= budget).select("id", "tokens", "used")


def truncated(content: Column, tokens: int) -> Column:
    """As much as ``tokens`` allow: up to the last sentence's end if that keeps over 60 %, else a hard cut."""
    most = tokens * 4
    head = F.left(content, F.lit(most))
    back = F.locate(" .", F.reverse(head))
    end = F.length(head) - back
    return F.when(F.length(content) <= most, content).when((back > 0) & (end - 1 > 0.6 * most), F.left(head, end)).otherwise(head)


def age_scores(rows: DataFrame, as_of: str, id_col: str = "id", time_col: str = "created_at") -> DataFrame:
    """(id, proximity, boost, freshness, stale): how near a row's time is to ``as_of``; without a time 0.5, 1, 0.5 and false."""
    days = (F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(F.col(time_col))) / 86_400_000_000
    aged = rows.select(F.col(id_col).alias("id"), days.alias("d"))
    d = F.col("d")
    return aged.select(
        "id", F.round(F.coalesce(F.exp(-F.abs(d) / 30), F.lit(0.5)), 6).alias("proximity"), F.round(F.coalesce(1 + 0.5 * F.exp(-d * d / 98), F.lit(1.0)), 6).alias("boost"),
        F.round(F.when(d.isNull(), 0.5).when(d < 0, 1.0).otherwise(F.greatest(F.lit(0.1), 1 - d / 365)), 6).alias("freshness"), F.coalesce(d > 90, F.lit(False)).alias("stale"),
    )


def tags(listed: Column, separator: str = ",") -> Column:
    """Trimmed, lower-cased, distinct tags of a separated list, blanks dropped; null if none is left."""
    found = F.array_distinct(F.filter(F.transform(F.split(listed, separator), lambda t: F.lower(F.trim(t))), lambda t: t != ""))
    return F.when(F.size(found) > 0, found)


def tag_counts(rows: DataFrame, tags_col: str = "tags") -> DataFrame:
    """(tag, n): how many rows bear each tag."""
    return rows.select(F.explode(tags_col).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def nearest_names(typed: list[str], names: DataFrame, name_col: str, most: int = 3) -> DataFrame:
    """(typed, name, distance): for each typed name the nearest known one, at most so many edits away; ties to the smaller name."""
    known = names.select(F.col(name_col).alias("name")).filter("name is not null").distinct()
    found = reduce(DataFrame.unionAll, [known.select(F.lit(t).alias("typed"), "name", F.levenshtein("name", F.lit(t), most).alias("distance")) for t in sorted(set(typed))])
    near = found.filter(F.col("distance") >= 0).groupBy("typed").agg(F.min(F.struct("distance", "name")).alias("best"))
    return near.select("typed", F.col("best.name").alias("name"), F.col("best.distance").alias("distance"))


def pooled(rows: DataFrame, key_col: str, vec_col: str, weight: Column) -> DataFrame:
    """(key, dim, value): each key's weighted mean vector, of length 1; summed in part before the shuffle."""
    parts = rows.select(F.col(key_col).alias("key"), weight.cast("double").alias("w"), F.posexplode(vec_col).alias("dim", "x"))
    sums = parts.groupBy("key", "dim").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("key")))
    return sums.select("key", "dim", F.round(F.when(norm > 0, F.col("s") / norm).otherwise(0.0), 5).alias("value"))


def day_part(time: Column) -> Column:
    return F.when(F.hour(time) < 12, "morning").when(F.hour(time) < 17, "afternoon").otherwise("evening")
