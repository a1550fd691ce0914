"""Registered queries on facts, links and contexts, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, facts, graph, links
from ..sources import frames
from .sql import LINKS, MEMORIES, _WEIGHT

AS_OF = "2024-06-01 00:00:00"
TYPED = ["AUTOMOBIL", "BUILDNG", "MACHNERY", "HOUSEHOULD"]
SEEDS = [1, 2]
ROUNDS = 3
BUDGET = 20_000


def typed_links(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and parts that line items join, as typed links."""
    kinds = F.array(*[F.lit(k) for k in ("similarity", "caused_by", "updates", "extends", "consolidates", "related")])
    both = graph.cut(graph.spread(frames.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")), "s", "p").distinct())
    kind, weight = F.element_at(kinds, ((F.col("s") + F.col("p")) % 6 + 1).cast("int")), (0.5 + (F.col("p") % 5) / 10.0)
    ahead = both.select((F.col("s") + 1_000_000_000).alias("source_id"), F.col("p").alias("target_id"), weight.alias("similarity"), kind.alias("type"))
    return ahead.union(ahead.select("target_id", "source_id", "similarity", "type"))


def _links(f: Callable, *args) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: f(typed_links(spark, sf), *args)


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as facts: a customer's orders of a priority have a status, from the order's date on."""
    named = [F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("verb"), F.col("o_orderstatus").alias("object"), F.col("o_orderdate").cast("timestamp").alias("valid_at")]
    return facts.validity(frames.table(spark, sf, "orders").select(*named))


def facts_validity(spark: SparkSession, sf: str) -> DataFrame:
    """-1 stands for no fact that ends this one."""
    return _facts(spark, sf).select("id", "invalid_at", F.coalesce("invalidated_by", F.lit(-1)).alias("invalidated_by"))


def facts_valid_at(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).filter(facts.holds_at("1997-01-01 00:00:00")).select("id", "subject", "verb", "object")


def causal_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return facts.causes(frames.table(spark, sf, "events"), "user_id", "ts", 24).select("event_id", "n_before")


def prune_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return facts.beyond_newest(frames.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], 5).select("event_id", "user_id", "event_type")


def day_parts(spark: SparkSession, sf: str) -> DataFrame:
    return frames.table(spark, sf, "events").groupBy(context.day_part(F.col("ts")).alias("part"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    return context.within_budget(frames.active(frames.memories(spark, sf)), BUDGET)


def truncated_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return frames.memories(spark, sf).select("id", F.length(context.truncated(F.coalesce("content", F.lit("")), 100)).cast("long").alias("kept"))


def age_scores(spark: SparkSession, sf: str) -> DataFrame:
    return context.age_scores(frames.memories(spark, sf), AS_OF)


def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames.memories(spark, sf)
    return rows.filter(F.col("created_at") > F.to_timestamp(F.lit("2024-01-05 00:00:00"))).orderBy("created_at", "id").limit(100).select("id", "created_at", "user_id")


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    return frames.table(spark, sf, "part").select("p_partkey", context.tags(F.col("p_type"), " ").alias("tags"))


def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return context.tag_counts(_tagged(spark, sf))


def tag_search(spark: SparkSession, sf: str) -> DataFrame:
    return _tagged(spark, sf).filter(F.array_contains("tags", "promo")).select("p_partkey")


def nearest_names(spark: SparkSession, sf: str) -> DataFrame:
    return context.nearest_names(TYPED, frames.table(spark, sf, "customer"), "c_mktsegment")


def pooled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return context.pooled(frames.table(spark, sf, "embeddings"), "label", "embedding", F.col("vec_id") % 3 + 1)


def orphan_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an order of over 300000."""
    orders = frames.table(spark, sf, "orders").filter("o_totalprice > 300000")
    return links.unmatched(frames.table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey", "o_custkey")


def lineage_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    parents = frames.table(spark, sf, "part").select(p.alias("id"), F.when(p > 1, F.floor(p / 2)).alias("parent_id"))
    return links.ancestors(parents, 150)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (facts_validity, facts_valid_at, causal_candidates, prune_candidates, day_parts, context_budget, truncated_lengths, age_scores, change_feed, tag_counts, tag_search, nearest_names, pooled_vectors, orphan_customers, lineage_ancestors)
} | {
    "link_neighbours": _links(links.neighbours),
    "link_hubs": _links(links.hubs),
    "strongest_links": _links(links.strongest, 3),
    "link_hops": _links(links.hops, SEEDS, 2),
    "link_communities": _links(links.communities, ROUNDS),
    "settled_communities": _links(links.communities),
}

_FACTS = """f AS (SELECT o_orderkey AS id, o_custkey AS subject, o_orderpriority AS verb, o_orderstatus AS object, CAST(o_orderdate AS TIMESTAMP) AS valid_at FROM orders),
c AS (SELECT *, object IS DISTINCT FROM lag(object) OVER (PARTITION BY subject, verb ORDER BY valid_at, id) AS changed FROM f),
facts AS (SELECT id, subject, verb, object, valid_at, first_value(CASE WHEN changed THEN valid_at END IGNORE NULLS) OVER w AS invalid_at, first_value(CASE WHEN changed THEN id END IGNORE NULLS) OVER w AS invalidated_by
    FROM c WINDOW w AS (PARTITION BY subject, verb ORDER BY valid_at, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""
_DAYS = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 86400000000.0::DOUBLE"
_TAGS = "tagged AS (SELECT p_partkey, list_distinct(list_filter(list_transform(string_split(p_type, ' '), lambda t: lower(trim(t))), lambda t: t <> '')) AS tags FROM part)"
_ENDS = "ends AS (SELECT source_id AS id, target_id AS other FROM links UNION SELECT target_id, source_id FROM links)"
_SEEDS = ", ".join(map(str, SEEDS))
_VOTES = ", ".join(
    f"""l{i + 1} AS (SELECT l{i}.id, coalesce(won, l{i}.label) AS label FROM l{i} LEFT JOIN (
        SELECT target_id AS id, label AS won FROM (SELECT target_id, label, sum(w) AS w FROM edges JOIN l{i} ON source_id = l{i}.id GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY w DESC, label) = 1) v USING (id))"""
    for i in range(ROUNDS)
)

SQL: dict[str, str] = {
    "facts_validity": f"WITH {_FACTS} SELECT id, invalid_at, coalesce(invalidated_by, -1) AS invalidated_by FROM facts",
    "facts_valid_at": f"WITH {_FACTS} SELECT id, subject, verb, object FROM facts WHERE valid_at <= TIMESTAMP '1997-01-01 00:00:00' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1997-01-01 00:00:00')",
    "causal_candidates": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS n_before FROM events",
    "prune_candidates": "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) > 5",
    "day_parts": "SELECT CASE WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 17 THEN 'afternoon' ELSE 'evening' END AS part, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "context_budget": f"""WITH {MEMORIES}, t AS (SELECT id, importance, CAST(ceil(length(coalesce(content, '')) / 4.0) AS BIGINT) AS tokens FROM active),
        u AS (SELECT id, tokens, CAST(sum(tokens) OVER (ORDER BY importance DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM t WHERE tokens > 0) SELECT * FROM u WHERE used <= {BUDGET}""",
    "truncated_lengths": f"""WITH {MEMORIES}, h AS (SELECT id, length(coalesce(content, '')) AS n, left(coalesce(content, ''), 400) AS head FROM memories),
        b AS (SELECT id, n, length(head) AS size, instr(reverse(head), ' .') AS back FROM h)
        SELECT id, CAST(CASE WHEN n <= 400 THEN n WHEN back > 0 AND size - back - 1 > 240 THEN size - back ELSE size END AS BIGINT) AS kept FROM b""",
    "age_scores": f"""WITH {MEMORIES}, a AS (SELECT id, {_DAYS} AS d FROM memories) SELECT id, round(exp(-abs(d) / 30), 6) AS proximity, round(1 + 0.5::DOUBLE * exp(-d * d / 98), 6) AS boost,
        round(CASE WHEN d < 0 THEN 1.0::DOUBLE ELSE greatest(0.1::DOUBLE, 1 - d / 365) END, 6) AS freshness, d > 90 AS stale FROM a""",
    "change_feed": f"WITH {MEMORIES} SELECT id, created_at, user_id FROM memories WHERE created_at > TIMESTAMP '2024-01-05 00:00:00' ORDER BY created_at, id LIMIT 100",
    "tag_counts": f"WITH {_TAGS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM tagged) GROUP BY 1",
    "tag_search": f"WITH {_TAGS} SELECT p_partkey FROM tagged WHERE list_contains(tags, 'promo')",
    "nearest_names": f"""SELECT typed, name, CAST(distance AS INTEGER) AS distance FROM (SELECT typed, name, levenshtein(name, typed) AS distance FROM (SELECT unnest({TYPED!r}) AS typed), (SELECT DISTINCT c_mktsegment AS name FROM customer WHERE c_mktsegment IS NOT NULL))
        WHERE distance <= 3 QUALIFY row_number() OVER (PARTITION BY typed ORDER BY distance, name) = 1""",
    "pooled_vectors": """WITH s AS (SELECT label AS key, CAST(dim AS INTEGER) AS dim, sum((vec_id % 3 + 1)::DOUBLE * x::DOUBLE) AS s FROM (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY 1, 2)
        SELECT key, dim, round(s / sqrt(sum(s * s) OVER (PARTITION BY key)), 5) AS value FROM s""",
    "orphan_customers": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)",
    "lineage_ancestors": """WITH RECURSIVE line(id, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 150 UNION ALL SELECT p_partkey // 2, depth + 1 FROM line JOIN part ON p_partkey = id WHERE p_partkey > 1 AND depth < 20) SELECT id, depth FROM line""",
    "link_neighbours": f"WITH {LINKS}, {_ENDS} SELECT id, count(*) AS n FROM ends GROUP BY 1",
    "link_hubs": f"WITH {LINKS} SELECT source_id AS id, count(*) AS n FROM links GROUP BY 1 HAVING count(*) >= 8 ORDER BY n DESC, id LIMIT 10",
    "strongest_links": f"WITH {LINKS} SELECT source_id, target_id, similarity, CAST(row_number() OVER (PARTITION BY source_id ORDER BY similarity DESC, target_id) AS INTEGER) AS rank FROM links QUALIFY rank <= 3",
    "link_hops": f"""WITH {LINKS}, {_ENDS}, h1 AS (SELECT DISTINCT other AS id FROM ends WHERE id IN ({_SEEDS})), h2 AS (SELECT DISTINCT other AS id FROM ends WHERE id IN (SELECT id FROM h1))
        SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT id, 0 AS hop FROM ends WHERE id IN ({_SEEDS}) UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY 1""",
    "link_communities": f"""WITH {LINKS}, edges AS (SELECT source_id, target_id, CAST(round(similarity * ({_WEIGHT})::DOUBLE * 100) AS BIGINT) AS w FROM links),
        l0 AS (SELECT id, id AS label FROM (SELECT source_id AS id FROM links UNION SELECT target_id FROM links)), {_VOTES} SELECT id, label FROM l{ROUNDS}""",
    "settled_communities": f"""WITH RECURSIVE {LINKS}, edges AS MATERIALIZED (SELECT source_id, target_id, CAST(round(similarity * ({_WEIGHT})::DOUBLE * 100) AS BIGINT) AS w FROM links),
        walk AS (SELECT 0 AS k, id, id AS label FROM (SELECT source_id AS id FROM links UNION SELECT target_id FROM links)
        UNION ALL SELECT k + 1, l.id, coalesce(won, label) FROM walk l LEFT JOIN (
            SELECT target_id AS id, label AS won FROM (SELECT target_id, label, sum(w) AS w FROM edges JOIN walk ON source_id = walk.id GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY w DESC, label) = 1) v ON v.id = l.id WHERE k < 15)
        SELECT id, label FROM walk WHERE k = 15""",
}
