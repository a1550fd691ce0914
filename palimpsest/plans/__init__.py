"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import analytics, graph, memory, retrieval
from ..sources import frames, parsers
from ..streaming import usage
from . import assembled, evolving, fields, flowing, indexed, ingest, more, relational, revised, searching, structural, voices, wording
from .sql import SQL

AS_OF = "2024-02-01 00:00:00"
RECALL_AT = "2025-06-01 00:00:00"
TERMS = ["the", "and", "that", "with"]
K = 20
#: Texts with and without hints at a changed fact.
HINTS = (None, "", "It NO LONGER works", "plain", "Changed to B", "used to run", "instead now C", "fine, but now D", "Previously E", "longer no", "was replaced")


def _memories(f: Callable, *args, **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: f(frames.memories(spark, sf), *args, **kwargs)


def _active(f: Callable, *args, **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: f(frames.active(frames.memories(spark, sf)), *args, **kwargs)


def _events(f: Callable, *args, **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: f(frames.table(spark, sf, "events"), *args, **kwargs)


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    """The embedding of the row with id 0, as a caller would pass it."""
    return [float(x) for x in frames.vectors(spark, sf).filter("id = 0").first().embedding]


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.nearest(frames.vectors(spark, sf), _query_vector(spark, sf), K)


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    words = retrieval.ranked(retrieval.bm25(frames.active(frames.memories(spark, sf)), TERMS, K))
    near = retrieval.ranked(retrieval.nearest(frames.vectors(spark, sf), _query_vector(spark, sf), K))
    return retrieval.fuse([words, near], K)


def recall_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Statics (a quarter of the limit), words, important and newest rows; scores decay, rows of a wanted source gain."""
    k = 30
    rows = frames.active(frames.memories(spark, sf))
    rate = scores.retrievability(memory.age(RECALL_AT), F.col("fsrs_stability"))
    decayed = rows.withColumn("decay", F.round(F.col("importance") * rate, 3))
    statics = rows.filter("is_static").select("id", F.lit(100.0).alias("score"), "importance")
    words = retrieval.bm25(rows, TERMS, 10).join(decayed.select("id", "decay", "importance"), "id")
    words = words.select("id", (F.col("score") * 50 * F.col("decay") / F.col("importance")).alias("score"))
    important = decayed.filter("importance >= 8").select("id", (F.col("decay") * 2).alias("score"))
    newest = rows.select("id", F.lit(1.0).alias("score"), "created_at")
    layers = [(statics, max(1, -(-k // 4)), "importance"), (words, 10, None), (important, 10, None), (newest, k, "created_at")]
    found = retrieval.recall(layers, 4 * k)
    tagged = found.join(rows.select("id", F.col("source").isin("src1", "src3", "src5").alias("wanted")), "id")
    return tagged.select("id", "source", F.round(F.col("score") * F.when(F.col("wanted"), 1.2).otherwise(1.0), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def pagerank_links(spark: SparkSession, sf: str) -> DataFrame:
    """As far as its SQL is unrolled; settled_pagerank runs the operator's own bounds."""
    return graph.pagerank(more.typed_links(spark, sf), rounds=5, settled=0).select("id", F.round("rank", 9).alias("rank"))


def settled_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pagerank(more.typed_links(spark, sf)).select("id", F.round("rank", 9).alias("rank"))


def unlinked_memories(spark: SparkSession, sf: str) -> DataFrame:
    labels = frames.table(spark, sf, "labels")
    ends = labels.select(F.col("doc_id").alias("source_id"), (F.col("doc_id") + 1).alias("target_id"))
    return memory.unlinked(frames.active(frames.memories(spark, sf)), ends)


def question_types(spark: SparkSession, sf: str) -> DataFrame:
    return frames.table(spark, sf, "conversations").select("conv_id", "turn", text.question_type(F.coalesce("text", F.lit(""))).alias("type"))


def part_name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    same = text.jaccard(text.bigrams(F.col("p_name")), text.bigrams(F.col("p_type")))
    return frames.table(spark, sf, "part").select("p_partkey", F.round(same, 6).alias("similarity"))


def token_estimates(rows: DataFrame) -> DataFrame:
    return rows.select("id", text.estimated_tokens(F.col("content")).alias("tokens"))


def contradiction_hints(rows: DataFrame) -> DataFrame:
    """Of texts with each phrase in turn, null and empty ones included."""
    phrases = F.array(*[F.lit(p) for p in HINTS])
    return rows.withColumn("content", F.element_at(phrases, (F.col("id") % len(HINTS) + 1).cast("int"))).filter(text.contradicts(F.coalesce("content", F.lit("")))).select("id")


def link_weights(rows: DataFrame) -> DataFrame:
    weighed = rows.select("source_id", "target_id", "type", scores.link_weight(F.col("type")).alias("weight"))
    return graph.spread(weighed, "source_id", "target_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "search_bm25": _active(retrieval.bm25, TERMS, K),
    "vector_topk": vector_topk,
    "hybrid_search": hybrid_search,
    "recall_layers": recall_layers,
    "list_recent": _active(memory.recent, 50, category="en", source=None),
    "stale_high_value": _active(memory.stale, AS_OF, 20.0, 50),
    "contradiction_hints": _memories(contradiction_hints),
    "access_tiers": _memories(memory.access_tiers),
    "category_histogram": _memories(memory.histogram, "category"),
    "snapshot_at_time": _memories(memory.snapshot, "2024-01-20 00:00:00"),
    "versions_at_time": _memories(memory.versions_at, "2024-01-20 00:00:00"),
    "version_chains": _memories(memory.version_chains),
    "decay_scores": _memories(memory.decay, "2025-06-01 00:00:00"),
    "auto_archive": _memories(memory.archivable, "2034-06-01 00:00:00", floor=0.5),
    "gc_counts": _memories(memory.reclaimable),
    "tenant_report": _memories(memory.tenants),
    "token_estimates": _memories(token_estimates),
    "unlinked_memories": unlinked_memories,
    "current_state": _events(memory.state, ["user_id", "event_type"], ["ts", "event_id"], "value"),
    "usage_daily": _events(analytics.usage_daily),
    "usage_totals": _events(analytics.usage_totals),
    "access_pattern": _events(analytics.access_pattern),
    "metric_summary": _events(analytics.metric_summary),
    "feedback_precision": _events(analytics.precision, ["purchase", "click"]),
    "sla_report": _events(analytics.service_levels, 100.0, 200.0, "error"),
    "error_groups": _events(analytics.groups),
    "agent_trust": _events(analytics.trust),
    "preference_strength": _events(analytics.strengths),
    "session_episodes": _events(analytics.sessions),
    "stream_usage_daily": lambda spark, sf: usage.run_available(spark, sf, "events.parquet"),
    "html_titles": lambda spark, sf: parsers.html_titles(frames.table(spark, sf, "pages")),
    "conversation_transcripts": lambda spark, sf: parsers.transcripts(frames.table(spark, sf, "conversations")),
    "question_types": question_types,
    "part_name_similarity": part_name_similarity,
    "pagerank_links": pagerank_links,
    "settled_pagerank": settled_pagerank,
    "node_roles": lambda spark, sf: graph.roles(more.typed_links(spark, sf)),
    "link_weights": lambda spark, sf: link_weights(more.typed_links(spark, sf)),
}


PARTS = (more, relational, wording, evolving, searching, structural, ingest, fields, voices, indexed, flowing, assembled, revised)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return SQL | {name: sql for part in PARTS for name, sql in part.SQL.items()}
