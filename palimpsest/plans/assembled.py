"""Registered queries on themes of signs, conversations within a length, with their SQL, and on assembled contexts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import assembly, conversations, people, relational
from ..sources import frames


def _signs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as signs of five users: what they are called is the subject."""
    p, size = F.col("p_partkey"), F.col("p_size")
    kinds = F.array(*[F.lit(k) for k in people.SECTIONS])
    return frames.table(spark, sf, "part").select(
        (p % 5).alias("user_id"), p.alias("at"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("subject"), F.element_at(kinds, (size % 6 + 1).cast("int")).alias("signal_type"),
        F.when(size % 3 == 0, "positive").when(size % 3 == 1, "negative").otherwise("neutral").alias("valence"), (size / 50.0).alias("intensity"),
    )


def profile_themes(spark: SparkSession, sf: str) -> DataFrame:
    found = people.themes(_signs(spark, sf))
    return found.select("user_id", "leader", "label", "n", F.round("intensity", 6).alias("intensity"), F.array_join("types", ",").alias("types"), F.array_join("valences", ",").alias("valences"), "mixed")


AS_OF, HITS = "2024-02-01 00:00:00", 50


def assembled_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """A context of 2000 tokens for each user, asked by the vector of the row that bears the user's number; tests hold the choice against a plain version."""
    vectors = frames.vectors(spark, sf).select("id", F.col("embedding").cast("array<double>").alias("vector"))
    rows = frames.memories(spark, sf).join(vectors, "id", "left")
    requests = rows.select("user_id").distinct().join(vectors.withColumnRenamed("id", "user_id"), "user_id").select(F.col("user_id").alias("request"), "user_id", F.col("vector").alias("q"))
    scored = requests.join(frames.active(rows).filter("vector is not null and not is_static").select("user_id", "id", "vector"), "user_id").select("request", "id", scores.cosine(F.col("q"), F.col("vector")).alias("score"))
    hits = scored.withColumn("n", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= HITS).drop("n")
    links = relational.document_links(rows).withColumn("similarity", (F.col("source_id") % 50 + 50) / 100.0)
    found = assembly.candidates(requests, hits, rows, links, AS_OF, 2000)
    return assembly.assembled(found, 2000, relevant=0.1)


EXCERPT = 600


def conversation_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of all conversations, cut to some 600 characters each conversation."""
    return conversations.within_length(frames.table(spark, sf, "conversations"), EXCERPT)


def conversation_logs(spark: SparkSession, sf: str) -> DataFrame:
    """The same, as texts."""
    return conversations.joined(conversation_excerpts(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (profile_themes, assembled_contexts, conversation_excerpts, conversation_logs)}

_KINDS = "[" + ", ".join(f"'{k}'" for k in people.SECTIONS) + "]"

_EXCERPTS = f"""WITH RECURSIVE c AS (SELECT conv_id AS conv, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS content, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS turns,
        sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    p AS MATERIALIZED (SELECT *, CASE WHEN role = 'user' AND n = 1 THEN 0 WHEN role = 'assistant' AND n >= turns - 1 THEN 1 WHEN role = 'tool' THEN 5 WHEN role = 'assistant' THEN 4 WHEN role = 'system' THEN 6 ELSE 3 END AS priority FROM c),
    o AS MATERIALIZED (SELECT conv, turn, length(content)::BIGINT AS length, (total - {EXCERPT})::BIGINT AS over, row_number() OVER (PARTITION BY conv ORDER BY priority DESC, turn) AS k FROM p WHERE total > {EXCERPT} AND priority > 0),
    walk AS (SELECT DISTINCT conv, 0::BIGINT AS k, NULL::BIGINT AS turn, 0::BIGINT AS kept, over AS excess FROM o
        UNION ALL SELECT conv, k, turn, CASE WHEN length > target THEN target // 2 END, CASE WHEN length > target THEN excess - length + 2 * (target // 2) + 21 ELSE excess END FROM (
            SELECT o.conv, o.k, o.turn, o.length, excess, greatest(200, o.length - excess) AS target FROM walk JOIN o ON o.conv = walk.conv AND o.k = walk.k + 1)),
    lines AS (SELECT p.conv, p.turn, CAST(priority AS INTEGER) AS priority, kept IS NOT NULL AS truncated, '[' || upper(role) || ']' || CASE WHEN kept IS NOT NULL THEN ' (truncated)' ELSE '' END || chr(10)
        || CASE WHEN kept IS NOT NULL THEN left(content, kept) || chr(10) || '... [truncated] ...' || chr(10) || right(content, kept) ELSE content END AS line
        FROM p LEFT JOIN (SELECT * FROM walk WHERE k > 0) USING (conv, turn))"""

SQL: dict[str, str] = {
    "conversation_excerpts": f"{_EXCERPTS} SELECT * FROM lines",
    "conversation_logs": f"{_EXCERPTS} SELECT conv, CAST(floor(turn / 1000) AS BIGINT) AS part, string_agg(line, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS text FROM lines GROUP BY ALL",
    "profile_themes": rf"""WITH RECURSIVE s AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS k, list_distinct(list_filter(string_split(regexp_replace(lower(subject), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 3)) AS w
        FROM (SELECT p_partkey % 5 AS user_id, p_partkey AS pos, concat_ws(' ', p_name, p_type, p_brand) AS subject, {_KINDS}[(p_size % 6 + 1)::INT] AS signal_type,
            CASE p_size % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS valence, p_size / 50.0::DOUBLE AS intensity FROM part)),
    walk AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS pos, NULL::BIGINT AS leader, []::STRUCT(pos BIGINT, w VARCHAR[])[] AS leaders FROM s
        UNION ALL SELECT user_id, k, pos, coalesce(found, pos), CASE WHEN found IS NULL THEN list_append(leaders, {{'pos': pos, 'w': w}}) ELSE leaders END FROM (
            SELECT s.user_id, s.k, s.pos, s.w, leaders, list_filter(leaders, lambda l: len(list_intersect(l.w, s.w)) > 0.5::DOUBLE * len(list_distinct(list_concat(l.w, s.w))))[1].pos AS found FROM walk JOIN s ON s.user_id = walk.user_id AND s.k = walk.k + 1)),
    own AS MATERIALIZED (SELECT s.*, leader FROM walk JOIN s USING (user_id, pos)),
    t AS (SELECT user_id, leader, string_agg(signal_type, ',' ORDER BY first) AS types FROM (SELECT user_id, leader, signal_type, min(pos) AS first FROM own GROUP BY ALL) GROUP BY ALL),
    v AS (SELECT user_id, leader, string_agg(valence, ',' ORDER BY first) AS valences FROM (SELECT user_id, leader, valence, min(pos) AS first FROM own GROUP BY ALL) GROUP BY ALL)
    SELECT user_id, leader, arg_min(subject, pos) AS label, count(*) AS n, round(avg(intensity), 6) AS intensity, any_value(types) AS types, any_value(valences) AS valences,
        bool_or(valence = 'positive') AND bool_or(valence = 'negative') AS mixed FROM own JOIN t USING (user_id, leader) JOIN v USING (user_id, leader) GROUP BY user_id, leader""",
}
