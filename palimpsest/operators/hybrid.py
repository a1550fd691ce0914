"""One search over all channels: the question's type chooses a strategy, channels are fused by rank, boosted, expanded along links, filled in and cut.

Words come from the inverted index, nearness from the vector index, signs of persons and owned texts from channels that a caller gives. Everything after the channels
works on the few hundred rows that they return at most. Only the asking user's rows take part, before and after links are followed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from . import people, ranking, retrieval
from .centroids import VectorIndex
from .graph import cut
from .postings import TextIndex

#: Least candidates, most candidates, most word hits, and how many times the candidates the vector index is asked for.
LEAST, MOST, MOST_WORDS, VECTOR_TIMES = 12, 200, 250, 5
LINKS_EACH, VERSIONS_EACH = 10, 100


def strategy_of(index: TextIndex, question: str, as_of: str) -> tuple[dict, str | None]:
    """(the blend of strategies for the question's types, the date that it names if its first type is temporal)."""
    q, today = F.lit(question), F.to_date(F.lit(as_of))
    row = index.spark.range(1).select(rules.question_mix(q, today).alias("mix"), rules.question_type(q, today).alias("kind"), rules.query_date(q, today).alias("day")).first()
    return ranking.blended(dict(row.mix)), row.day if row.kind == "temporal" else None


def targets(limit: int, strategy: dict) -> tuple[int, int]:
    """(candidates, word hits) that a search for ``limit`` rows asks its channels for."""
    candidates = max(limit, min(MOST, max(int(limit * strategy["candidates"]), LEAST)))
    return candidates, max(candidates, limit, min(MOST_WORDS, int(limit * strategy["words"])))


def search(
    index: TextIndex, vectors: VectorIndex, rows: DataFrame, links: DataFrame, question: str, vector: list[float], user_id: int, limit: int, as_of: str,
    signs: DataFrame | None = None, others: tuple[DataFrame, ...] = (),
) -> DataFrame:
    """(id, score, category, importance, version, links, chain): the best rows for a question and its vector.

    rows: memories with pagerank and source_count; links: (source_id, target_id, similarity, type); the vector index keeps user_id, is_forgotten, is_archived and is_latest.
    signs: (id, place, signal_type, subject, valence, intensity, source_text), read where the strategy asks for them; others: further channels (id, score), each cut to its best.
    links: up to ten of a row's strongest links to rows of the user, 'id:similarity'; chain: its versions, 'version:id' in order.
    """
    strategy, asked = strategy_of(index, question, as_of)
    candidates, words = targets(limit, strategy)
    own = rows.filter(F.col("user_id") == user_id)
    latest = own.filter(~F.col("is_forgotten") & ~F.col("is_archived") & F.col("is_latest"))
    mine = (F.col("user_id") == user_id) & ~F.col("is_forgotten") & ~F.col("is_archived") & F.col("is_latest")
    near = vectors.search(vector, VECTOR_TIMES * candidates, where=mine).filter(F.col("score") > strategy["vector_floor"])
    channels = [near, index.search(question, words, latest.select("id")), *others]
    if signs is not None and strategy["personality"]:
        channels.append(people.signal_channel(signs, latest, question, strategy["personality"]))
    fused = retrieval.fuse([retrieval.ranked(c) for c in channels], VECTOR_TIMES * candidates + words + sum(1 for _ in others) * words + strategy["personality"])
    # a few hundred rows, read several times below: the channels run once
    found = cut(ranking.boosted(F.broadcast(fused), own, as_of, asked))
    if strategy["expand"]:
        alive = own.filter(~F.col("is_forgotten")).select("id")
        ends = links.join(alive.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(alive.select(F.col("id").alias("target_id")), "target_id", "left_semi")
        found = ranking.expanded(found, ends, strategy["seeds"], strategy["hop1"], strategy["hop2"], strategy["multiplier"])
    best = cut(found.select("id", F.round("score", 7).alias("score")).orderBy(F.desc("score"), "id").limit(limit))
    return with_surroundings(best, own, links)


def with_surroundings(best: DataFrame, own: DataFrame, links: DataFrame) -> DataFrame:
    """The best rows (id, score), a top-k, filled in from a user's rows, with their strongest links and their versions."""
    best = F.broadcast(best)
    filled = own.join(best, "id").select("id", "score", "category", "importance", "version", "root_memory_id")
    ends = links.join(best.select(F.col("id").alias("source_id")), "source_id").join(own.filter(~F.col("is_forgotten")).select(F.col("id").alias("target_id")), "target_id")
    order = Window.partitionBy("source_id").orderBy(F.desc("similarity"), "target_id")
    strongest = ends.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= LINKS_EACH)
    linked = strongest.groupBy(F.col("source_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("n", F.concat_ws(":", "target_id", "similarity").alias("x")))).alias("l"))
    chains = own.join(filled.select("root_memory_id").distinct(), "root_memory_id").withColumn("n", F.row_number().over(Window.partitionBy("root_memory_id").orderBy("version", "id"))).filter(F.col("n") <= VERSIONS_EACH)
    chain = chains.groupBy("root_memory_id").agg(F.sort_array(F.collect_list(F.struct("n", F.concat_ws(":", "version", "id").alias("x")))).alias("c"))
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda s: s["x"]), "|"), F.lit(""))
    return filled.join(linked, "id", "left").join(chain, "root_memory_id", "left").select("id", "score", "category", "importance", "version", text("l").alias("links"), text("c").alias("chain"))
