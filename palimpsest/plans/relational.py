"""Registered queries on filters, projections, joins, aggregates, ranks, pages and sets, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import memory, relational
from ..sources import frames
from .more import typed_links
from .sql import LINKS, MEMORIES

AS_OF = "2024-06-01 00:00:00"
_AS_OF = f"TIMESTAMP '{AS_OF}'"


def _memories(spark: SparkSession, sf: str) -> DataFrame:
    return frames.memories(spark, sf)


def _active(spark: SparkSession, sf: str) -> DataFrame:
    return frames.active(frames.memories(spark, sf))


def _named(names: DataFrame, key: str, name: str) -> DataFrame:
    return names.select(F.col(key).alias("id"), F.col(name).alias("name"))


# filters


def tenant_memories(spark: SparkSession, sf: str) -> DataFrame:
    return relational.scoped(_active(spark, sf), 2).select("id", "category")


def name_search(spark: SparkSession, sf: str) -> DataFrame:
    return relational.matching(frames.table(spark, sf, "part"), "WIDGET", ["p_name", "p_type"]).select("p_partkey")


def names_equal(spark: SparkSession, sf: str) -> DataFrame:
    return relational.equal_nocase(frames.table(spark, sf, "customer"), c_mktsegment="BuildinG").select("c_custkey")


def expired_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _memories(spark, sf).withColumn("forget_after", F.timestamp_seconds(F.unix_timestamp("created_at") + F.col("importance") * 864000))
    return relational.expired(rows, AS_OF, "forget_after").select("id")


def reconsolidation_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _active(spark, sf).withColumns({"adaptive_score": F.when(F.col("id") % 3 == 0, (F.col("id") % 10) / 10.0), "recall_hits": F.col("id") % 4, "recall_misses": F.col("id") % 6})
    return relational.to_reconsolidate(rows, AS_OF).select("id")


def hot_set(spark: SparkSession, sf: str) -> DataFrame:
    rows = _memories(spark, sf).withColumn("last_accessed_at", F.when(F.col("access_count") > 4, F.timestamp_seconds(F.unix_timestamp("created_at") + F.col("access_count") * 86400)))
    return relational.hot(rows.filter(~F.col("is_forgotten")), "2024-02-20 00:00:00", 45).select("id")


def filtered_events(spark: SparkSession, sf: str) -> DataFrame:
    return relational.where(frames.table(spark, sf, "events"), event_type=["click", "error"], user_id=None, ts=("2024-01-02 00:00:00", None), value=(10.0, 150.0)).select("event_id")


def random_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: 25 rows in an order that a seed fixes."""
    return relational.shuffled(_memories(spark, sf), seed=7, k=25).select("id")


# projections


def event_props(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return frames.table(spark, sf, "events").groupBy((k % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


def prompt_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The best static rows as text, XML and JSON lines."""
    best = _active(spark, sf).filter("is_static").orderBy(F.desc("importance"), "id").limit(20)
    return best.select("id", *[relational.packed_line(kind).alias(kind) for kind in ("text", "xml", "json")])


def narratives(spark: SparkSession, sf: str) -> DataFrame:
    events = frames.table(spark, sf, "events")
    return events.filter("event_id < 500").select("event_id", relational.narrated(F.col("event_type"), F.col("user_id"), F.col("value")).alias("sentence"))


# joins


def linked_pairs(spark: SparkSession, sf: str) -> DataFrame:
    ends = _memories(spark, sf).select("id", "is_forgotten")
    own = relational.document_links(_memories(spark, sf))
    return relational.both_ends(own, ends.filter(~F.col("is_forgotten"))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    return relational.touching(typed_links(spark, sf), [1, 2, 3])


def entity_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    names = _named(frames.table(spark, sf, "part"), "p_partkey", "p_name")
    return relational.across(typed_links(spark, sf), names, 1_000_000_001)


def supplier_nations(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with the name of a nation in region 1, or 'deleted'."""
    nation = frames.table(spark, sf, "nation").filter("n_regionkey = 1")
    own = frames.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("parent"))
    return relational.with_parent(own, nation.select(F.col("n_nationkey").alias("parent"), F.col("n_name").alias("name")), "parent", "name", "deleted").select("s_suppkey", "name")


def order_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer, through the bridge, with the names of their parts."""
    mine = frames.table(spark, sf, "orders").filter("o_custkey = 1").select(F.col("o_orderkey").alias("memory_id"))
    parts = frames.table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), "p_name")
    return relational.bridged(mine, frames.bipartite(spark, sf), parts, "memory_id", "entity_id").select("memory_id", "entity_id", "p_name")


def shared_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of parts that stand in two orders or more. An order has at most seven lines, which bounds its pairs."""
    return relational.shared(frames.bipartite(spark, sf), "memory_id", "entity_id").filter("shared >= 2")


def customers_with_orders(spark: SparkSession, sf: str) -> DataFrame:
    busy = frames.table(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return frames.table(spark, sf, "customer").join(busy, "c_custkey", "left_semi").select("c_custkey")


def order_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer with how many orders and urgent ones they have, 0 included."""
    orders = frames.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return relational.counted(frames.table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey", {"orders": F.count(F.lit(1)), "urgent": F.count_if("urgent")})


# aggregates


def stats_page(spark: SparkSession, sf: str) -> DataFrame:
    return relational.stats(_memories(spark, sf))


def link_types(spark: SparkSession, sf: str) -> DataFrame:
    return memory.histogram(typed_links(spark, sf), "type")


def community_stats(spark: SparkSession, sf: str) -> DataFrame:
    return relational.community_stats(_active(spark, sf).withColumn("community", F.col("id") % 7))


def recency_tiers(spark: SparkSession, sf: str) -> DataFrame:
    rows = _memories(spark, sf).withColumn("last_accessed_at", F.when(F.col("access_count") > 4, F.col("created_at")))
    return relational.recency_tiers(rows.filter(~F.col("is_forgotten")), "2025-02-01 00:00:00")


def related_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of each order, joined; an order is as long as its lines."""
    ids = F.array_join(F.array_sort(F.collect_set("entity_id")), ",")
    return frames.bipartite(spark, sf).groupBy("memory_id").agg(ids.alias("entity_ids"))


def skill_stats(spark: SparkSession, sf: str) -> DataFrame:
    return relational.skill_stats(relational.skills(frames.table(spark, sf, "events")))


def skill_scores(spark: SparkSession, sf: str) -> DataFrame:
    return relational.skill_scores(relational.skills(frames.table(spark, sf, "events")), "2024-02-15 00:00:00")


RUBRIC = [("accuracy", 2.0, 0.0, 10.0), ("clarity", 1.0, 1.0, 5.0), ("style", 0.5, 3.0, 3.0)]


def _evaluations(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return frames.table(spark, sf, "events").select("event_id", "user_id", (i % 11).cast("double").alias("accuracy"), (i % 5 + 1).cast("double").alias("clarity"), F.lit(3.0).alias("style"))


def rubric_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluations(spark, sf).select("event_id", F.round(relational.rubric_score(RUBRIC), 6).alias("score"))


def score_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return relational.score_profiles(_evaluations(spark, sf), "user_id", [name for name, *_ in RUBRIC])


def drift_summary(spark: SparkSession, sf: str) -> DataFrame:
    severity = F.when(F.col("value") >= 150, "high").when(F.col("value") >= 50, "medium").otherwise("low")
    return frames.table(spark, sf, "events").groupBy("event_type", severity.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def tool_quality(spark: SparkSession, sf: str) -> DataFrame:
    return relational.tool_quality(frames.table(spark, sf, "events"))


def error_report(spark: SparkSession, sf: str) -> DataFrame:
    return relational.error_report(frames.table(spark, sf, "events"), "2024-01-20 00:00:00", 24 * 7)


def growth_stats(spark: SparkSession, sf: str) -> DataFrame:
    return relational.growth_stats(_memories(spark, sf), "2024-01-03 00:00:00")


def top_categories(spark: SparkSession, sf: str) -> DataFrame:
    return relational.top_categories(_memories(spark, sf), "2024-01-03 00:00:00", 24, 5)


def digest_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = _memories(spark, sf).withColumn("updated_at", F.timestamp_seconds(F.unix_timestamp("created_at") + (F.col("version") - 1) * 86400))
    return relational.digest_stats(rows, "2024-01-05 00:00:00")


def digest_new(spark: SparkSession, sf: str) -> DataFrame:
    new = _memories(spark, sf).filter(~F.col("is_forgotten") & (F.col("created_at") > F.to_timestamp(F.lit("2024-01-05 00:00:00"))))
    return new.orderBy(F.desc("importance"), F.desc("created_at"), F.desc("id")).limit(20).select("id", "category", "importance", F.left(F.coalesce("content", F.lit("")), F.lit(300)).alias("content"))


def tenant_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation with its customers, suppliers and customers' orders, counted apart and joined to the nation."""
    customers, nation = frames.table(spark, sf, "customer"), frames.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"))
    orders = frames.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderdate").alias("last_order"))
    own = customers.join(orders, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.max("last_order").alias("last_order"))
    sold = frames.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    both = nation.join(own, "nation", "left").join(sold, "nation", "left")
    return both.select("nation", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("customers", "orders", "suppliers")], "last_order")


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by status, by priority, and by both, in one pass of grouping sets."""
    sets = frames.table(spark, sf, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"]], "o_orderstatus", "o_orderpriority")
    return sets.agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n")


def gc_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _memories(spark, sf)
    events = frames.table(spark, sf, "events")
    signals = frames.table(spark, sf, "labels").select((F.col("doc_id") + 3).alias("memory_id"))
    return relational.garbage(rows, relational.document_links(rows), events, signals, "2024-02-20 00:00:00")


# ranks, orders, sets


def next_positions(spark: SparkSession, sf: str) -> DataFrame:
    """New rows get the positions after the greatest of their chain."""
    rows = _memories(spark, sf).select("id", F.col("root_memory_id").alias("chain"), "version")
    return relational.appended(rows.filter("version <= 2").withColumnRenamed("version", "position"), rows.filter("version > 2").drop("version"), "chain")


def normalised_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return relational.over_most(_active(spark, sf).select("id", "user_id", F.col("importance").cast("double").alias("rank")), "user_id", "rank").select("id", F.round("rank", 6).alias("rank"))


def dense_labels(spark: SparkSession, sf: str) -> DataFrame:
    return relational.dense_labels(_active(spark, sf).select("id", (F.col("id") * 31 % 17).alias("label")))


def decay_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = _active(spark, sf).withColumn("decay_score", F.when(F.col("id") % 3 != 0, F.round(F.col("importance") * 0.7, 3)))
    return rows.select("id", F.coalesce("decay_score", F.col("importance").cast("double")).alias("score")).orderBy(F.desc("score"), "id").limit(30)


def active_first(spark: SparkSession, sf: str) -> DataFrame:
    """Building customers first, then by name without case."""
    order = [(F.col("c_mktsegment") == "BUILDING").desc(), F.lower("c_name"), F.col("c_custkey")]
    return frames.table(spark, sf, "customer").orderBy(*order).limit(25).select("c_custkey", "c_name")


def facts_by_date(spark: SparkSession, sf: str) -> DataFrame:
    """Newest first, those without a date last."""
    dated = frames.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("at")).filter("o_orderkey < 60")
    n = F.row_number().over(Window.orderBy(F.col("at").desc_nulls_last(), "o_orderkey"))
    return dated.withColumn("place", n).select("o_orderkey", "place")


def sorted_skills(spark: SparkSession, sf: str) -> DataFrame:
    return relational.sorted_by(relational.skills(frames.table(spark, sf, "events")), "completions", k=10).select("skill", "completions")


def second_page(spark: SparkSession, sf: str) -> DataFrame:
    return _active(spark, sf).orderBy(F.desc("created_at"), F.desc("id")).offset(20).limit(20).select("id", "created_at")


def temporal_order(spark: SparkSession, sf: str) -> DataFrame:
    """The k best, then by time, rows without one first."""
    best = _active(spark, sf).orderBy(F.desc("importance"), "id").limit(20).select("id", F.when(F.col("id") % 4 != 0, F.col("created_at")).alias("created_at"))
    at = F.coalesce("created_at", F.timestamp_seconds(F.lit(0)))
    return best.withColumn("place", F.row_number().over(Window.orderBy(at, "id"))).select("id", "place")


def distinct_agents(spark: SparkSession, sf: str) -> DataFrame:
    nations = frames.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(frames.table(spark, sf, "supplier").select("s_nationkey"))
    return nations.agg(F.count_distinct("k").alias("n"))


def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Nations with customers of over 9000, against those with suppliers of over 5000: added, removed and kept."""
    a = frames.table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct()
    b = frames.table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    return relational.difference(a, b, "k")


def lineage_descendants(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    parents = frames.table(spark, sf, "part").select(p.alias("id"), F.when(p > 1, F.floor(p / 2)).alias("parent_id"))
    return relational.descendants(parents, 3)


def insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """Links of which those that are there already, and repeats, are passed over."""
    both = frames.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"))
    return relational.new_rows(both, both.filter("source_id % 2 = 0"), ["source_id", "target_id"]).groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))


def window_counters(spark: SparkSession, sf: str) -> DataFrame:
    return relational.window_counters(frames.table(spark, sf, "events"), "user_id", "ts", 3600, 3).groupBy("user_id").agg(F.max("n").alias("most"), F.count_if("limited").alias("limited"))


def stale_agents(spark: SparkSession, sf: str) -> DataFrame:
    last = frames.table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    return last.filter(F.col("seen") < F.to_timestamp(F.lit("2024-01-30 00:00:00"))).select("user_id")


def retained_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events that their channel's retention (click: 48 hours, others 168) keeps at a time."""
    hours = F.when(F.col("event_type") == "click", 48).otherwise(168)
    age = (F.unix_micros(F.to_timestamp(F.lit("2024-01-25 00:00:00"))) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    return frames.table(spark, sf, "events").filter((age >= 0) & (age <= hours)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def cursor_poll(spark: SparkSession, sf: str) -> DataFrame:
    """The next 50 events after a cursor, and where it then stands."""
    page = frames.table(spark, sf, "events").filter((F.col("event_id") > 100) & (F.col("event_type") == "click")).orderBy("event_id").limit(50)
    return page.agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("cursor"))


def ready_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of a run whose dependencies are all completed. Orders are runs, lines their steps; a step waits for the two before it."""
    line = frames.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step"), (F.col("l_linestatus") == "F").alias("done"))
    needs = line.select("run", "step", F.explode(F.array(F.col("step") - 1, F.col("step") - 2)).alias("needs")).filter("needs >= 1")
    return relational.ready(line, needs).groupBy("run").agg(F.count(F.lit(1)).alias("ready"), F.min("step").alias("first"))


def applied_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Two copies of rows merged, of each id the one changed last; ties stay as they are."""
    orders = frames.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sync_id"), F.col("o_orderstatus").alias("value"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    theirs = orders.filter("sync_id % 3 <> 0").select("sync_id", F.lit("X").alias("value"), F.timestamp_seconds(F.unix_timestamp("updated_at") + (F.col("sync_id") % 5 - 2) * 3600).alias("updated_at"))
    return relational.last_writer(orders.filter("sync_id % 2 = 0"), theirs, "sync_id", "updated_at")


def snapshot_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What a backup is verified by: rows, distinct keys and sums."""
    one = lambda t, k: frames.table(spark, sf, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"), F.count_distinct(k).alias("keys"), F.sum(k).cast("long").alias("total"))
    return one("orders", "o_orderkey").union(one("part", "p_partkey")).union(one("customer", "c_custkey"))


def artifact_store(spark: SparkSession, sf: str) -> DataFrame:
    """Texts by content: hash, how often, and where they go: inline up to 2000 bytes, else a path by hash."""
    return relational.artifacts(_memories(spark, sf).filter("content is not null"), "content", 2000)


def exported_rows(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.struct("id", "category", "importance", "version")
    return _active(spark, sf).select("id", F.to_json(fields).alias("line"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tenant_memories, name_search, names_equal, expired_rows, reconsolidation_candidates, hot_set, filtered_events, event_props, prompt_lines, narratives, linked_pairs, cluster_members, entity_neighbours,
        supplier_nations, order_parts, shared_orders, customers_with_orders, order_counts, stats_page, link_types, community_stats, recency_tiers, related_ids, skill_stats, skill_scores, rubric_scores, score_profiles,
        drift_summary, tool_quality, error_report, growth_stats, top_categories, digest_stats, digest_new, tenant_usage, status_counts, gc_classes, next_positions, normalised_ranks, dense_labels, decay_order,
        active_first, facts_by_date, sorted_skills, second_page, temporal_order, distinct_agents, set_difference, lineage_descendants, insert_or_ignore, window_counters, stale_agents, retained_events, cursor_poll,
        ready_steps, applied_changes, snapshot_checks, artifact_store, exported_rows,
    )
}

_OWN_LINKS = "own AS (SELECT id AS source_id, id * 2 + 1 AS target_id, ['similarity', 'contradicts', 'updates'][(id % 3 + 1)::INT] AS type FROM memories)"
_SKILLS = """skills AS (SELECT user_id AS skill, count(*) AS selections, count(*) FILTER (event_type = 'purchase') AS completions, count(*) FILTER (event_type IN ('click', 'purchase')) AS applied,
    max(ts) AS last_updated, user_id % 4 <> 0 AS is_active FROM events GROUP BY user_id)"""
_EVALUATED = "evaluated AS (SELECT event_id, user_id, (event_id % 11)::DOUBLE AS accuracy, (event_id % 5 + 1)::DOUBLE AS clarity, 3.0::DOUBLE AS style FROM events)"

SQL: dict[str, str] = {
    "tenant_memories": f"WITH {MEMORIES} SELECT id, category FROM active WHERE user_id = 2",
    "name_search": "SELECT p_partkey FROM part WHERE p_name ILIKE '%widget%' OR p_type ILIKE '%widget%'",
    "names_equal": "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'",
    "expired_rows": f"WITH {MEMORIES} SELECT id FROM memories WHERE created_at + to_days((importance * 10)::INT) <= {_AS_OF}",
    "reconsolidation_candidates": f"""WITH {MEMORIES}, r AS (SELECT *, CASE WHEN id % 3 = 0 THEN (id % 10) / 10.0::DOUBLE END AS adaptive, id % 4 AS hits, id % 6 AS misses FROM active)
        SELECT id FROM r WHERE adaptive < 0.3 OR (access_count > 5 AND misses > hits) OR (created_at < {_AS_OF} - INTERVAL 7 DAY AND fsrs_stability < 1.0)""",
    "hot_set": f"""WITH {MEMORIES}, r AS (SELECT *, CASE WHEN access_count > 4 THEN created_at + to_days(access_count::INT) END AS last FROM memories WHERE NOT is_forgotten)
        SELECT id FROM r WHERE coalesce(last, created_at) > TIMESTAMP '2024-02-20 00:00:00' - INTERVAL 45 DAY""",
    "filtered_events": "SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND ts >= TIMESTAMP '2024-01-02 00:00:00' AND value BETWEEN 10.0 AND 150.0",
    "event_props": "SELECT k % 10 AS k, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
    "prompt_lines": f"""WITH {MEMORIES}, best AS (SELECT id, category AS c, importance AS i, coalesce(content, '') AS t FROM active WHERE is_static ORDER BY importance DESC, id LIMIT 20)
        SELECT id, '[' || coalesce(c, '') || '] ' || t AS text, '<memory id="' || id || '" category="' || coalesce(c, '') || '" importance="' || i || '">' || chr(10) || t || chr(10) || '</memory>' AS xml,
        '{{"id":' || id || ',"category":"' || coalesce(c, '') || '","importance":' || i || '}}' AS json FROM best""",
    "narratives": """SELECT event_id, CASE event_type WHEN 'purchase' THEN 'User ' || user_id || ' bought something for ' || printf('%.2f', value) WHEN 'error' THEN 'User ' || user_id || ' met an error' WHEN 'signup' THEN 'User ' || user_id || ' signed up'
        WHEN 'click' THEN 'User ' || user_id || ' clicked' WHEN 'view' THEN 'User ' || user_id || ' viewed a page' END AS sentence FROM events WHERE event_id < 500""",
    "linked_pairs": f"WITH {MEMORIES}, {_OWN_LINKS}, kept AS (SELECT id FROM memories WHERE NOT is_forgotten) SELECT type, count(*) AS n FROM own JOIN kept a ON a.id = source_id JOIN kept b ON b.id = target_id GROUP BY 1",
    "cluster_members": f"WITH {LINKS} SELECT DISTINCT unnest([source_id, target_id]) AS id FROM links WHERE source_id IN (1, 2, 3) OR target_id IN (1, 2, 3)",
    "entity_neighbours": f"WITH {LINKS} SELECT p_partkey AS id, p_name AS name, count(*) AS n FROM links JOIN part ON p_partkey = CASE WHEN source_id = 1000000001 THEN target_id ELSE source_id END WHERE 1000000001 IN (source_id, target_id) GROUP BY 1, 2",
    "supplier_nations": "SELECT s_suppkey, coalesce(n_name, 'deleted') AS name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey = 1",
    "order_parts": "SELECT DISTINCT l_orderkey AS memory_id, l_partkey AS entity_id, p_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = 1",
    "shared_orders": """WITH b AS (SELECT DISTINCT l_orderkey AS m, l_partkey AS e FROM lineitem) SELECT x.e AS a, y.e AS b, count(*) AS shared FROM b x JOIN b y ON x.m = y.m AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= 2""",
    "customers_with_orders": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "order_counts": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent FROM customer",
    "stats_page": f"""WITH {MEMORIES} SELECT count(*) AS total, count(*) FILTER (is_forgotten) AS forgotten, count(*) FILTER (is_static AND NOT is_forgotten) AS static, count(*) FILTER (NOT is_static AND NOT is_forgotten) AS dynamic,
        count(*) FILTER (version > 1) AS versioned, count(*) FILTER (is_archived AND NOT is_forgotten) AS archived, count(DISTINCT category) AS categories, count(*) FILTER (access_count = 0) AS never_accessed FROM memories""",
    "link_types": f"WITH {LINKS} SELECT type, count(*) AS n FROM links GROUP BY 1",
    "community_stats": f"""WITH {MEMORIES} SELECT id % 7 AS community, count(*) AS n, floor(avg(importance) * 10 + 0.5) / 10 AS mean_importance, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM active GROUP BY 1 ORDER BY n DESC, community LIMIT 50""",
    "recency_tiers": f"""WITH {MEMORIES}, r AS (SELECT *, CASE WHEN access_count > 4 THEN created_at END AS last, TIMESTAMP '2025-02-01 00:00:00' AS now FROM memories WHERE NOT is_forgotten)
        SELECT CASE WHEN last IS NULL AND created_at < now - INTERVAL 90 DAY THEN 'never_accessed_90d+' WHEN last IS NULL AND created_at < now - INTERVAL 30 DAY THEN 'never_accessed_30d+' WHEN last IS NULL THEN 'never_accessed_recent'
        WHEN last < now - INTERVAL 365 DAY THEN 'cold_365d+' WHEN last < now - INTERVAL 90 DAY THEN 'cold_90d+' WHEN last < now - INTERVAL 30 DAY THEN 'cool_30d+' ELSE 'hot' END AS tier, count(*) AS n FROM r GROUP BY 1""",
    "related_ids": "SELECT l_orderkey AS memory_id, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS entity_ids FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1".replace("string_agg(DISTINCT l_partkey::VARCHAR", "string_agg(l_partkey::VARCHAR"),
    "skill_stats": f"""WITH {_SKILLS} SELECT is_active, count(*) AS n, CAST(sum(selections) AS BIGINT) AS selections, CAST(sum(completions) AS BIGINT) AS completions, round(avg(completions / selections::DOUBLE), 6) AS mean_rate FROM skills GROUP BY 1""",
    "skill_scores": f"""WITH {_SKILLS} SELECT skill, round(0.5::DOUBLE * completions / selections + 0.3::DOUBLE * applied / selections + 0.2::DOUBLE * greatest(0.0::DOUBLE, 1 - (epoch_us(TIMESTAMP '2024-02-15 00:00:00') - epoch_us(last_updated)) / 86400000000.0::DOUBLE / 90), 6) AS score FROM skills""",
    "rubric_scores": f"WITH {_EVALUATED} SELECT event_id, round((accuracy / 10.0::DOUBLE * 2.0::DOUBLE + (clarity - 1) / 4.0::DOUBLE) / 3.5::DOUBLE, 6) AS score FROM evaluated",
    "score_profiles": f"""WITH {_EVALUATED}, long AS (SELECT user_id, unnest(['accuracy', 'clarity', 'style']) AS criterion, unnest([accuracy, clarity, style]) AS score FROM evaluated)
        SELECT user_id, criterion, round(avg(score), 6) AS mean, min(score) AS least, max(score) AS most, count(*) AS n FROM long GROUP BY 1, 2""",
    "drift_summary": "SELECT event_type, CASE WHEN value >= 150 THEN 'high' WHEN value >= 50 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM events GROUP BY 1, 2",
    "tool_quality": "SELECT user_id, count(*) AS calls, count(*) FILTER (event_type <> 'error') AS successes, count(*) FILTER (event_type = 'error') AS failures, CAST(round(avg(CAST(value AS DECIMAL(18, 4))), 3) AS DOUBLE) AS mean_ms, round(count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE, 6) AS quality FROM events GROUP BY 1",
    "error_report": """WITH e AS (SELECT *, CASE WHEN value >= 150 THEN 'critical' ELSE 'error' END AS severity FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 168 HOUR AND ts <= TIMESTAMP '2024-01-20 00:00:00'),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM e)
        SELECT user_id, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, max(CASE WHEN k = 1 THEN severity END) AS severity, string_agg(event_id::VARCHAR, ',' ORDER BY k) FILTER (k <= 3) AS examples FROM r GROUP BY 1""",
    "growth_stats": f"""WITH {MEMORIES}, k AS (SELECT * FROM memories WHERE NOT is_forgotten) SELECT user_id, count(*) AS total, count(*) FILTER (access_count = 0) AS never_accessed,
        count(*) FILTER (created_at > TIMESTAMP '2024-01-03 00:00:00' - INTERVAL 1 HOUR AND created_at <= TIMESTAMP '2024-01-03 00:00:00') AS last_hour, round(avg(importance), 6) AS mean_importance FROM k GROUP BY 1""",
    "top_categories": f"""WITH {MEMORIES} SELECT coalesce(category, 'none') AS category, count(*) AS n FROM memories WHERE NOT is_forgotten AND created_at > TIMESTAMP '2024-01-03 00:00:00' - INTERVAL 24 HOUR AND created_at <= TIMESTAMP '2024-01-03 00:00:00' GROUP BY 1 ORDER BY n DESC, category LIMIT 5""",
    "digest_stats": f"""WITH {MEMORIES}, u AS (SELECT *, created_at + to_days((version - 1)::INT) AS updated_at, TIMESTAMP '2024-01-05 00:00:00' AS since FROM memories)
        SELECT user_id, count(*) FILTER (NOT is_forgotten) AS total, count(*) FILTER (created_at > since) AS new, count(*) FILTER (is_archived AND updated_at > since) AS archived, count(*) FILTER (updated_at > since AND created_at <= since) AS updated FROM u GROUP BY 1""",
    "digest_new": f"WITH {MEMORIES} SELECT id, category, importance, left(coalesce(content, ''), 300) AS content FROM memories WHERE NOT is_forgotten AND created_at > TIMESTAMP '2024-01-05 00:00:00' ORDER BY importance DESC, created_at DESC, id DESC LIMIT 20",
    "tenant_usage": """SELECT n_nationkey AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey) AS orders,
        (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, (SELECT max(o_orderdate) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey) AS last_order FROM nation""",
    "status_counts": "SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))",
    "gc_classes": f"""WITH {MEMORIES}, {_OWN_LINKS}, now AS (SELECT TIMESTAMP '2024-02-20 00:00:00' AS t), kept AS (SELECT id FROM memories WHERE NOT is_forgotten)
        SELECT 'forgotten_stale' AS kind, count(*) AS n FROM memories, now WHERE is_forgotten AND created_at < t - INTERVAL 30 DAY
        UNION ALL SELECT 'orphaned_links', count(*) FROM own WHERE source_id NOT IN (SELECT id FROM kept) OR target_id NOT IN (SELECT id FROM kept)
        UNION ALL SELECT 'expired_scratch', count(*) FROM events, now WHERE event_type = 'view' AND ts + INTERVAL 30 MINUTE < t
        UNION ALL SELECT 'old_audit', count(*) FROM events, now WHERE event_type = 'click' AND ts < t - INTERVAL 40 DAY
        UNION ALL SELECT 'old_jobs', count(*) FROM events, now WHERE event_type IN ('purchase', 'error') AND ts < t - INTERVAL 30 DAY
        UNION ALL SELECT 'orphaned_signals', count(*) FROM labels WHERE doc_id + 3 NOT IN (SELECT id FROM memories)""",
    "next_positions": f"""WITH {MEMORIES}, old AS (SELECT root_memory_id AS chain, max(version) AS last FROM memories WHERE version <= 2 GROUP BY 1)
        SELECT m.id, m.root_memory_id AS chain, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY m.root_memory_id ORDER BY m.id) AS BIGINT) AS position FROM memories m LEFT JOIN old ON chain = m.root_memory_id WHERE version > 2""",
    "normalised_ranks": f"WITH {MEMORIES} SELECT id, round(importance / max(importance) OVER (PARTITION BY user_id)::DOUBLE, 6) AS rank FROM active",
    "dense_labels": f"WITH {MEMORIES}, l AS (SELECT id, id * 31 % 17 AS label FROM active), f AS (SELECT label, row_number() OVER (ORDER BY min(id)) - 1 AS community FROM l GROUP BY 1) SELECT id, community FROM l JOIN f USING (label)",
    "decay_order": f"WITH {MEMORIES} SELECT id, CASE WHEN id % 3 <> 0 THEN round(importance * 0.7::DOUBLE, 3) ELSE importance::DOUBLE END AS score FROM active ORDER BY score DESC, id LIMIT 30",
    "active_first": "SELECT c_custkey, c_name FROM customer ORDER BY (c_mktsegment = 'BUILDING') DESC, lower(c_name), c_custkey LIMIT 25",
    "facts_by_date": "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey) AS INTEGER) AS place FROM orders WHERE o_orderkey < 60",
    "sorted_skills": f"WITH {_SKILLS} SELECT skill, completions FROM skills ORDER BY completions DESC, skill LIMIT 10",
    "second_page": f"WITH {MEMORIES} SELECT id, created_at FROM active ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20",
    "temporal_order": f"""WITH {MEMORIES}, best AS (SELECT id, CASE WHEN id % 4 <> 0 THEN created_at END AS created_at FROM active ORDER BY importance DESC, id LIMIT 20)
        SELECT id, CAST(row_number() OVER (ORDER BY coalesce(created_at, TIMESTAMP '1970-01-01'), id) AS INTEGER) AS place FROM best""",
    "distinct_agents": "SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)",
    "set_difference": """WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
        SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'kept' END AS change FROM a FULL JOIN b ON a.k = b.k""",
    "lineage_descendants": """WITH RECURSIVE line(id, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 3 UNION ALL SELECT p_partkey, depth + 1 FROM line JOIN part ON p_partkey // 2 = id AND p_partkey > 1 WHERE depth < 20) SELECT id, depth FROM line""",
    "insert_or_ignore": "SELECT l_suppkey AS target_id, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_partkey % 2 <> 0 GROUP BY 1",
    "window_counters": """WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        w AS (SELECT user_id, k, t AS began, 1 AS n FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, CASE WHEN o.t - began >= 3600000000 THEN o.t ELSE began END, CASE WHEN o.t - began >= 3600000000 THEN 1 ELSE n + 1 END FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
        SELECT user_id, CAST(max(n) AS BIGINT) AS most, count(*) FILTER (n > 3) AS limited FROM w GROUP BY 1""",
    "stale_agents": "SELECT user_id FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 00:00:00'",
    "retained_events": "SELECT event_type, count(*) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-25 00:00:00' AND ts >= TIMESTAMP '2024-01-25 00:00:00' - to_hours(CASE WHEN event_type = 'click' THEN 48 ELSE 168 END) GROUP BY 1",
    "cursor_poll": "SELECT count(*) AS n, max(event_id) AS cursor FROM (SELECT event_id FROM events WHERE event_id > 100 AND event_type = 'click' ORDER BY 1 LIMIT 50)",
    "ready_steps": """WITH s AS (SELECT l_orderkey AS run, l_linenumber AS step, l_linestatus = 'F' AS done FROM lineitem), r AS (SELECT * FROM s WHERE NOT done AND NOT EXISTS (SELECT 1 FROM s d WHERE d.run = s.run AND d.step IN (s.step - 1, s.step - 2) AND NOT d.done))
        SELECT run, count(*) AS ready, min(step) AS first FROM r GROUP BY 1""",
    "applied_changes": """WITH o AS (SELECT o_orderkey AS sync_id, o_orderstatus AS value, CAST(o_orderdate AS TIMESTAMP) AS updated_at FROM orders), a AS (SELECT * FROM o WHERE sync_id % 2 = 0),
        b AS (SELECT sync_id, 'X' AS value, updated_at + to_hours((sync_id % 5 - 2)::INT) AS updated_at FROM o WHERE sync_id % 3 <> 0)
        SELECT coalesce(a.sync_id, b.sync_id) AS sync_id, CASE WHEN a.sync_id IS NULL OR b.updated_at > a.updated_at THEN b.value ELSE a.value END AS value, CASE WHEN a.sync_id IS NULL OR b.updated_at > a.updated_at THEN b.updated_at ELSE a.updated_at END AS updated_at FROM a FULL JOIN b ON a.sync_id = b.sync_id""",
    "snapshot_checks": "SELECT 'orders' AS name, count(*) AS n, count(DISTINCT o_orderkey) AS keys, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders UNION ALL SELECT 'part', count(*), count(DISTINCT p_partkey), CAST(sum(p_partkey) AS BIGINT) FROM part UNION ALL SELECT 'customer', count(*), count(DISTINCT c_custkey), CAST(sum(c_custkey) AS BIGINT) FROM customer",
    "artifact_store": """SELECT sha256(text) AS sha256, count(*) AS n, CAST(max(octet_length(encode(text))) AS BIGINT) AS n_bytes, CASE WHEN max(octet_length(encode(text))) <= 2000 THEN 'inline' ELSE left(sha256(text), 2) || '/' || sha256(text) END AS place FROM documents WHERE text IS NOT NULL GROUP BY text""",
    "exported_rows": f"""WITH {MEMORIES} SELECT id, '{{"id":' || id || CASE WHEN category IS NULL THEN '' ELSE ',"category":"' || category || '"' END || ',"importance":' || importance || ',"version":' || version || '}}' AS line FROM active""",
}
