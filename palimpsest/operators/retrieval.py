"""Ranked retrieval: BM25, vectors, reciprocal rank fusion, layered recall.

Each channel is one scan that keeps numbers for each row and the query's terms only; statistics are one row, which
alone is broadcast. Ranks are taken after a top-k, so a rank's window sees k rows. Ties go to the smaller id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .graph import cut

RRF = 60


def _times(term: str) -> Column:
    """How often a term stands in ``low`` as a whole token."""
    return F.regexp_count("low", F.lit(f"(?<![a-z0-9]){term}(?![a-z0-9])"))


def bm25(rows: DataFrame, query: list[str], k: int, k1: float = 1.2, b: float = 0.75, id_col: str = "id", text_col: str = "content", where: Column | None = None) -> DataFrame:
    """(id, score): the k best rows for any of the query's terms, of those for which ``where`` holds. Rows without text match nothing.

    Texts are read once: terms are counted in place, the counts are written, and statistics and hits are read from that narrow table.
    """
    terms = sorted({t for t in query if t.isascii() and t.isalnum() and t == t.lower()})
    may = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    # explode keeps the optimiser from lower-casing the text for each count
    found = rows.select(F.col(id_col).alias("id"), may.alias("may"), F.explode(F.array(F.lower(F.coalesce(text_col, F.lit(""))))).alias("low"))
    found = found.select("id", "may", F.regexp_count("low", F.lit("[a-z0-9]{3,}")).alias("length"), *[_times(w).alias(f"tf{i}") for i, w in enumerate(terms)])
    found = cut(found)
    stats = found.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hits = found.filter("may").filter(reduce(lambda a, c: a | c, [F.col(f"tf{i}") > 0 for i in range(len(terms))])).join(F.broadcast(stats))
    parts = []
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        parts.append(idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("length") / F.col("mean"))))
    score = F.round(reduce(lambda x, y: x + y, parts), 6)
    return hits.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def nearest(rows: DataFrame, query: list[float], k: int, floor: float | None = None, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, score): the k rows of highest dot product with the query, above a floor if given."""
    score = F.round(scores.dot(F.col(vec_col), F.array(*[F.lit(float(x)) for x in query])), 6)
    found = rows.filter(F.size(vec_col) == len(query)).select(F.col(id_col).alias("id"), score.alias("score"))
    return (found if floor is None else found.filter(F.col("score") > floor)).orderBy(F.desc("score"), "id").limit(k)


def ranked(channel: DataFrame) -> DataFrame:
    """``channel`` (already cut to its best) with rank from 1."""
    return channel.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fuse(channels: list[DataFrame], k: int) -> DataFrame:
    """(id, score): sums of 1 / (60 + rank) over channels of (id, rank)."""
    every = reduce(DataFrame.unionByName, [c.select("id", "rank") for c in channels])
    return every.groupBy("id").agg(F.round(F.sum(1 / (RRF + F.col("rank"))), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def recall(layers: list[tuple[DataFrame, int, str | None]], k: int) -> DataFrame:
    """(id, source, score): layers of (id, score) by priority, each cut to so many by a column (or score); an id counts in its first layer only."""
    every = reduce(DataFrame.unionByName, [f.orderBy(*([F.desc(order)] if order else []), F.desc("score"), "id").limit(most).select("id", "score", F.lit(i).alias("source")) for i, (f, most, order) in enumerate(layers)])
    first = every.groupBy("id").agg(F.min_by("score", "source").alias("score"), F.min("source").alias("source"))
    return first.select("id", "source", "score").orderBy(F.desc("score"), "id").limit(k)
