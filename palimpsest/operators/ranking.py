"""Ranking beyond single channels: boosts, expansion along links, explanations, packing, profiles, time travel, merged sources.

Everything after a channel's top-k works on so few rows that their ranks may be taken in one window. Ties go to the smaller id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, scores, text
from .memory import clock
from .retrieval import RRF

#: What each type of question asks of a search; "personality": the most signals that are read, 0 for none.
STRATEGIES = {
    "fact_recall": {"vector_floor": 0.22, "candidates": 2.0, "words": 2.0, "expand": False, "seeds": 3, "hop1": 4, "hop2": 0, "multiplier": 0.75, "personality": 0},
    "preference": {"vector_floor": 0.12, "candidates": 3.0, "words": 4.0, "expand": True, "seeds": 5, "hop1": 6, "hop2": 2, "multiplier": 1.0, "personality": 24},
    "reasoning": {"vector_floor": 0.10, "candidates": 4.0, "words": 5.0, "expand": True, "seeds": 5, "hop1": 8, "hop2": 2, "multiplier": 1.2, "personality": 30},
    "generalization": {"vector_floor": 0.12, "candidates": 4.0, "words": 5.0, "expand": True, "seeds": 6, "hop1": 8, "hop2": 2, "multiplier": 1.2, "personality": 36},
    "temporal": {"vector_floor": 0.10, "candidates": 4.0, "words": 5.0, "expand": True, "seeds": 5, "hop1": 8, "hop2": 2, "multiplier": 1.2, "personality": 0},
}
#: What a search mode sets where a caller leaves it open.
PRESETS = {"fact": {}, "timeline": {"temporal_sort": "desc", "limit": 20, "vector_floor": 0.15}, "preference": {"vector_floor": 0.10, "include_episodes": True}, "decision": {"expand": True, "include_links": True}, "recent": {"temporal_sort": "desc", "limit": 15}}
ABSTAIN_BELOW = 0.58
CONTENT_WEIGHTS = {"caused_by": 2.0, "causes": 2.0, "updates": 1.5, "corrects": 1.5, "extends": 1.3, "contradicts": 1.3}


def blended(mix: dict[str, float]) -> dict:
    """One strategy from several by weight: numbers are summed by weight, whole ones rounded, expansion on where over 0.4 of the weight asks for it."""
    if len(mix) == 1:
        return STRATEGIES[next(iter(mix))]
    out = {}
    for k, v in STRATEGIES["fact_recall"].items():
        part = sum(w * STRATEGIES[t][k] for t, w in mix.items())
        out[k] = part > 0.4 if isinstance(v, bool) else int(part + 0.5) if isinstance(v, int) else part
    return out


def with_preset(options: dict, mode: str | None) -> dict:
    """A mode fills in what a caller leaves open."""
    return PRESETS.get(mode or "", {}) | {k: v for k, v in options.items() if v is not None}


def boosted(found: DataFrame, rows: DataFrame, as_of: str, asked: str | None = None) -> DataFrame:
    """(id, score): fused scores of (id, score), times decay, sources, permanence, nearness to the asked date, rank among links, and less for superseded rows that say so."""
    r = scores.retrievability(scores.days_between(F.col("created_at"), clock(as_of)), F.col("fsrs_stability"))
    decay = F.when(F.col("is_static"), 1.0).otherwise(0.3 + 0.7 * r)
    sources = 1 + F.least(F.col("source_count") / 10, F.lit(1.0)) * 0.05
    near = F.lit(1.0) if asked is None else 1 + 0.5 * F.exp(-F.pow(scores.days_between(F.col("created_at"), clock(asked)), F.lit(2.0)) / 98)
    rank = F.pow(1 + 0.15 * F.coalesce("pagerank", F.lit(0.0)), F.lit(2.0))
    old = F.when(~F.col("is_latest") & text.contradicts(F.coalesce("content", F.lit("")), 8), 0.65).otherwise(1.0)
    return found.join(rows, "id").select("id", (F.col("score") * decay * sources * F.when(F.col("is_static"), 1.03).otherwise(1.0) * near * rank * old).alias("score"))


def expanded(found: DataFrame, links: DataFrame, seeds: int, hop1: int, hop2: int, multiplier: float) -> DataFrame:
    """(id, score): what links lead to from the best rows, and from there once more, added as 1 / (60 + rank) of their links' strength."""
    weight = lambda c: reduce(lambda rest, p: F.when(F.col(c) == p[0], p[1]).otherwise(rest), CONTENT_WEIGHTS.items(), F.lit(1.0))
    strength = links.select("source_id", "target_id", (F.col("similarity") * weight("type") * multiplier).alias("raw"))
    order = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    first = found.withColumn("n", order).filter(F.col("n") <= seeds).select(F.col("id").alias("source_id"))
    per_seed = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("raw"), "target_id"))
    one = strength.join(F.broadcast(first), "source_id").withColumn("n", per_seed).filter(F.col("n") <= hop1).select(F.col("target_id").alias("id"), "raw")
    new = one.join(found.select("id"), "id", "left_anti").groupBy("id").agg(F.max("raw").alias("raw"))
    nearest = new.orderBy(F.desc("raw"), "id").limit(hop2).select(F.col("id").alias("source_id"))
    two = strength.join(F.broadcast(nearest), "source_id").select(F.col("target_id").alias("id"), (F.col("raw") * 0.5).alias("raw"))
    hits = one.unionByName(two).withColumn("n", F.row_number().over(Window.orderBy(F.desc("raw"), "id")))
    gained = hits.groupBy("id").agg(F.sum(1 / (RRF + F.col("n"))).alias("gain"))
    return found.join(gained, "id", "full").select("id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("score"))


def explained(rows: DataFrame) -> DataFrame:
    """(id, vector, reasons): rounded channel scores and why a row was found."""
    c = F.col
    vector = F.floor(c("semantic_score") * 1000 + 0.5) / 1000
    why = F.array(
        F.when(vector > 0.7, "strong semantic match").when(vector > 0.5, "moderate semantic match"), F.when(c("fts_score").isNotNull(), "full-text match"), F.when(c("graph_score").isNotNull(), "graph hop"),
        F.when(c("temporal_boost").isNotNull(), "temporal proximity boost"), F.when(c("is_static"), "permanent fact"), F.when(c("source_count") > 1, F.concat(F.lit("corroborated "), c("source_count").cast("string"), F.lit("x"))), F.when(c("importance") >= 8, "high importance"),
    )
    return rows.select("id", vector.alias("vector"), F.array_join(F.filter(why, lambda x: x.isNotNull()), "; ").alias("reasons"))


def packed(candidates: DataFrame, budget: int, overhead: int = 10) -> DataFrame:
    """(id, tokens): greedy first fit by score times confidence: what doesn't fit is passed over. Candidates are a few bounded layers; each needs
    over ``overhead`` tokens, so the first ``budget / overhead`` that fit are all that can. The fold reads them in order as one short list."""
    sized = candidates.filter("content is not null").select("id", (F.col("score") * F.coalesce("confidence", F.lit(1.0))).alias("score"), (F.ceil(F.length("content") / 4) + overhead).cast("long").alias("tokens"))
    item = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("score"), "id", "tokens")))

    def step(state: Column, x: Column) -> Column:
        fits = state["used"] + x["tokens"] <= budget
        return F.when(fits, F.struct((state["used"] + x["tokens"]).alias("used"), F.concat(state["ids"], F.array(F.struct(x["id"].alias("id"), x["tokens"].alias("tokens")))).alias("ids"))).otherwise(state)

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<id:long,tokens:long>>").alias("ids"))
    return sized.filter(F.col("tokens") <= budget).agg(item.alias("items")).select(F.inline(F.aggregate("items", start, step)["ids"]))


def merged_sources(sources: list[DataFrame], k: int) -> DataFrame:
    """(key, title, score): hits of several providers, one for each url or, without one, each beginning of a text: the best, ties to the first provider."""
    every = reduce(DataFrame.unionByName, [s.withColumn("provider", F.lit(i)) for i, s in enumerate(sources)])
    key = F.coalesce(F.when(F.col("url") != "", F.col("url")), F.left("text", F.lit(100)))
    best = every.groupBy(key.alias("key")).agg(F.min(F.struct((-F.col("score")).alias("s"), "provider", "title")).alias("best"))
    return best.select("key", "best.title", (-F.col("best.s")).alias("score")).orderBy(F.desc("score"), "key").limit(k)


def two_channels(near: DataFrame, words: DataFrame, k: int, floor: float = 0.3, bonus: float = 0.2) -> DataFrame:
    """(id, score): similarity above a floor, more for rows that words find too; rows that only words find score the floor."""
    both = near.filter(F.col("score") > floor).select("id", F.col("score").alias("a")).join(words.select("id", F.lit(True).alias("b")), "id", "full")
    score = F.when(F.col("a").isNull(), floor).otherwise(F.col("a") + F.when(F.col("b"), bonus).otherwise(0.0))
    return both.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def fused_with_missing(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(id, score): 1 / (60 + rank) of two channels of (id, rank); a row that a channel lacks ranks after its last."""
    last = [c.agg((F.coalesce(F.max("rank"), F.lit(0)) + 1).alias(f"last_{i}")) for i, c in enumerate((a, b))]
    both = a.select("id", F.col("rank").alias("r0")).join(b.select("id", F.col("rank").alias("r1")), "id", "full")
    for one in last:  # one row each
        both = both.join(F.broadcast(one))
    score = 1 / (RRF + F.coalesce("r0", "last_0")) + 1 / (RRF + F.coalesce("r1", "last_1"))
    return both.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def first_reasons(layers: list[tuple[DataFrame, str, float]], k: int) -> DataFrame:
    """(id, reason, score): rows of several lists (id, importance); the first list that has a row gives its reason and bonus."""
    every = reduce(DataFrame.unionByName, [f.select("id", (F.col("importance") / 10 + bonus).alias("score"), F.lit(i).alias("layer"), F.lit(reason).alias("reason")) for i, (f, reason, bonus) in enumerate(layers)])
    first = every.groupBy("id").agg(F.min_by(F.struct("reason", "score"), "layer").alias("own"))
    return first.select("id", "own.reason", F.round("own.score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def at_time(rows: DataFrame, at: str) -> DataFrame:
    """(id): the versions that were the latest of their root at a time; rows without a root count as their own."""
    known = rows.filter(F.col("created_at") <= clock(at)).withColumn("_root", F.coalesce("root_memory_id", "id"))
    return known.groupBy("_root").agg(F.max_by("id", F.struct("created_at", "id")).alias("id")).select("id")


def checked_action(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(verdict): the gravest of what static, weighty rules among the found rows say."""
    own = found.join(rows.filter(F.col("is_static") & (F.col("importance") >= 8)), "id")
    return own.agg(F.when(F.count_if(rules.guard(F.col("content"), F.col("importance")) == "warn") > 0, "warn").otherwise("allow").alias("verdict"), F.count(F.lit(1)).alias("rules"))


def reranked(hits: DataFrame, scored: Column, top: int) -> DataFrame:
    """``hits`` (id, score and what ``scored`` reads; cut to its best before) with place, ce_score and a new score.

    The ``top`` best are put in the order of ``scored`` (null last; ties as they were), and their scores grow by up to half, most for the
    first; the rest follow unchanged, without ce_score. Windows without keys: the hits are a page of results, not a table.
    """
    was = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    own = hits.withColumn("was", was).withColumn("ce_score", F.when(F.col("was") <= top, scored))
    rest = F.col("was") > top
    own = own.withColumn("place", F.row_number().over(Window.orderBy(rest, F.desc_nulls_last("ce_score"), "was")))
    n = F.least(F.count(F.lit(1)).over(Window.partitionBy()), F.lit(top))
    score = F.when(rest, F.col("score")).otherwise(F.col("score") * (1 + (n - F.col("place") + 1) / n * 0.5))
    return own.select("id", "place", "ce_score", F.round(score, 6).alias("score"))
