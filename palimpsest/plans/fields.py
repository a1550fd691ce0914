"""Registered queries on templates, front matter, scratch entries and reranked hits, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import templates
from ..operators import memory, ranking, retrieval
from ..sources import frames
from .sql import BM25

AS_OF = "2024-01-30 12:00:00"
TERMS = ("the", "and", "that", "with")
#: Words that the lexical scorer looks for.
WANTED = ("people", "from", "this", "have", "was", "were")
#: Templates, and heads of Markdown texts.
TEMPLATES = ("Dear {{name}}, {{home.city}}!", "{{home}}|{{none}}|{{home.none}}", "plain {{ name }} {{}}", "{{name}}{{name}}", "", None)
HEADS = (
    "---\nname: \"N\"\ndescription: d: e\ncategory:  c \ntags: [a, 'b', , \"c d\"]\n---\n# H", "---\ndescription: only\n---\n\n# From heading \ntext", "intro\n# First\n# Second", "---\nname: open", "---\nname: one\nname: two\ntags: x\n---", "", None,
)


def _of(values: tuple, key: str):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.col(key) % len(values) + 1).cast("int"))


def filled_templates(spark: SparkSession, sf: str) -> DataFrame:
    home = F.struct(F.col("c_mktsegment").alias("city"), F.col("c_nationkey").alias("zip"))
    values = F.to_json(F.struct(F.col("c_name").alias("name"), home.alias("home")))
    return frames.table(spark, sf, "customer").select("c_custkey", templates.interpolated(_of(TEMPLATES, "c_custkey"), values).alias("text"))


def skill_heads(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames.table(spark, sf, "part").select("p_partkey", _of(HEADS, "p_partkey").alias("raw"))
    found = rows.select("p_partkey", *[c.alias(k) for k, c in templates.front_matter(F.col("raw")).items()])
    return found.withColumn("tags", F.array_join("tags", "|"))


def live_scratch(spark: SparkSession, sf: str) -> DataFrame:
    e = frames.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    minutes = F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 60) * 40)
    live = memory.scratch(e, memory.clock(AS_OF), ["user_id", "event_type"], minutes=minutes)
    return live.select("user_id", "event_type", "value", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("created_at", "updated_at", "expires_at")])


def reranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 12 best of 20 hits by the share of the wanted words that they hold."""
    rows = frames.active(frames.memories(spark, sf))
    # 20 rows are broadcast
    hits = rows.select("id", "content").join(F.broadcast(retrieval.bm25(rows, list(TERMS), 20)), "id")
    words = F.split(F.lower("content"), "[^a-z0-9]+")
    share = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in WANTED]))) / F.lit(float(len(WANTED)))
    return ranking.reranked(hits, F.round(share, 6), 12)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (filled_templates, skill_heads, live_scratch, reranked_search)}

_NEVER_LATER = f"ts <= TIMESTAMP '{AS_OF}'"
SQL: dict[str, str] = {
    "filled_templates": """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Dear ' || c_name || ', ' || c_mktsegment || '!' WHEN 1 THEN '{"city":"' || c_mktsegment || '","zip":' || c_nationkey || '}||'
        WHEN 2 THEN 'plain {{ name }} {{}}' WHEN 3 THEN c_name || c_name WHEN 4 THEN '' END AS text FROM customer""",
    "skill_heads": "SELECT p_partkey, ['N', 'From heading', 'First', '', 'two', '', ''][(p_partkey % 7 + 1)::INT] AS name, ['d: e', 'only', '', '', '', '', ''][(p_partkey % 7 + 1)::INT] AS description, CASE WHEN p_partkey % 7 = 0 THEN 'c' END AS category, CASE p_partkey % 7 WHEN 0 THEN 'a|b|c d' WHEN 4 THEN 'x' END AS tags FROM part",
    "live_scratch": f"""WITH l AS (SELECT user_id, event_type, min(ts) AS created, max(ts) AS updated, arg_max(value, (ts, event_id)) AS value, arg_max(CASE WHEN event_id % 5 > 0 THEN greatest(least((event_id % 60) * 40, 1440), 1) ELSE 30 END, (ts, event_id)) AS minutes FROM events WHERE {_NEVER_LATER} GROUP BY ALL)
        SELECT user_id, event_type, value, strftime(created, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(updated, '%Y-%m-%d %H:%M:%S') AS updated_at, strftime(updated + to_minutes(minutes::INT), '%Y-%m-%d %H:%M:%S') AS expires_at FROM l WHERE updated + to_minutes(minutes::INT) > TIMESTAMP '{AS_OF}'""",
    "reranked_search": f"""WITH {BM25}, h AS (SELECT b.id, b.score, row_number() OVER (ORDER BY b.score DESC, b.id) AS was, round(len(list_intersect(string_split_regex(lower(m.content), '[^a-z0-9]+'), {list(WANTED)})) / {float(len(WANTED))}, 6) AS ce FROM bm25 b JOIN memories m ON m.id = b.id),
        p AS (SELECT *, CAST(row_number() OVER (ORDER BY was > 12, CASE WHEN was <= 12 THEN ce END DESC NULLS LAST, was) AS INTEGER) AS place, least(count(*) OVER (), 12) AS n FROM h)
        SELECT id, place, CASE WHEN was <= 12 THEN ce END AS ce_score, round(CASE WHEN was > 12 THEN score ELSE score * (1 + (n - place + 1) / n * 0.5) END, 6) AS score FROM p""",
}
