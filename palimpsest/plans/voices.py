"""Registered queries on signs of persons, stems, broken JSON, owned texts and keyed streams, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import repair
from ..operators import memory, people, retrieval
from ..sources import frames
from ..streaming import keyed
from .fields import AS_OF
from .fields import SQL as FIELDS
from .sql import BM25, MEMORIES

TERMS = ["the", "and", "that", "with"]
QUERY = "I really love the garden"
#: Texts with signs of each kind, and without.
SAYINGS = (
    "I love the garden and my dog.", "I really enjoy the long walks! I am very happy about it.", "I HATE THE RAIN, TRULY!", "My favorite color is the deep blue. I decided to learn Spanish.", "I am a baker. My goal is to open a shop.",
    "I care about honest work. I was sad yesterday.", "Nothing to see here", "", None, "I hate the garden, but I love it, really.", "I like tea. I dislike tea.", "I prefer ab.",
)
LEXICON = {"love": 3.0, "happy": 3.0, "hate": -3.0, "honest": 2.0}
#: What they hold: row, place, type, subject, valence, intensity.
SIGNS = (
    (0, 0, "preference", "garden", "positive", 0.75), (1, 0, "preference", "long walks", "positive", 0.7), (1, 1, "emotion", "happy", "positive", 0.75 * 1.3), (2, 0, "preference", "RAIN", "negative", 0.65),
    (3, 0, "preference", "color: deep blue", "positive", 0.8), (3, 1, "decision", "learn Spanish", "neutral", 0.5), (4, 0, "identity", "baker", "neutral", 0.7), (4, 1, "motivation", "to open a shop", "positive", 0.6),
    (5, 0, "emotion", "sad", "negative", 0.6), (5, 1, "value", "honest work", "positive", 0.8), (9, 0, "preference", "garden", "negative", 0.45),
    (10, 0, "preference", "tea", "positive", 0.6), (10, 1, "preference", "tea", "negative", 0.6),
)
#: Texts with JSON in them, and the JSON mended.
BROKEN = (
    ('Sure: {"a": 1, "b": [1, 2,],} done', '{"a": 1, "b": [1, 2]}'), ('```json\n{"a": "x"}\n```', '{"a": "x"}'), ('{"a": "unfinished', '{"a": "unfinished"}'), ('[1, 2, {"b": 3}', '[1, 2, {"b": 3}]'), ('[1, 2, 3', "[1, 2, 3]"),
    ('{"a": {"b": [1, 2', '{"a": {"b": [1, 2]}}'), ("no json", None), ("", None), (None, None), ('{"a": "brace } in \\" text", "b": [', '{"a": "brace }"}'), ('{"k": tru', None), ("[]", "[]"),
)


def _cycled(spark: SparkSession, sf: str, texts: list[str | None]) -> DataFrame:
    """(id, content): rows of documents with a text each."""
    every = F.array(*[F.lit(t) for t in texts])
    return frames.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.element_at(every, (F.col("doc_id") % len(texts) + 1).cast("int")).alias("content"))


def _signs(spark: SparkSession, sf: str) -> DataFrame:
    return people.personal_signals(_cycled(spark, sf, list(SAYINGS)), LEXICON)


def personal_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _signs(spark, sf).select("id", "place", "signal_type", "subject", "valence", F.round("intensity", 6).alias("intensity"))


def signal_channel(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames.active(frames.memories(spark, sf)).select("id", "created_at").join(_cycled(spark, sf, list(SAYINGS)), "id")
    return people.signal_channel(_signs(spark, sf), rows, QUERY, 20)


def personal_profile(spark: SparkSession, sf: str) -> DataFrame:
    return people.profile(_signs(spark, sf).withColumn("user_id", F.col("id") % 5))


def mixed_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return people.mixed_subjects(_signs(spark, sf).withColumn("user_id", F.col("id") % 5))


def repaired_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = _cycled(spark, sf, [raw for raw, _ in BROKEN])
    return rows.select("id", F.coalesce(repair.repaired_json(F.col("content")), F.lit("none")).alias("json"))


def artifact_search(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by the benchmark texts that they own, each row two of them."""
    texts = frames.table(spark, sf, "benchmark")
    hits = retrieval.bm25(texts, TERMS, 20, id_col="item_id", text_col="text")
    owners = texts.select(F.col("item_id").alias("id"), F.floor(F.col("item_id") / 2).alias("memory_id"))
    return people.owned(hits, owners, frames.active(frames.memories(spark, sf)), 20)


def promoted_scratch(spark: SparkSession, sf: str) -> DataFrame:
    e = frames.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", F.floor("value").cast("long"))
    minutes = F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 60) * 40)
    live = memory.scratch(e, memory.clock(AS_OF), ["user_id", "event_type"], minutes=minutes)
    return people.promoted(live, F.col("event_type"), F.concat(F.lit("agent"), F.col("user_id").cast("string")))


def stream_scratch(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that live when all events have passed through the stream."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    minutes = F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 60) * 40)
    sent = keyed.drained(spark, keyed.living(events, ["user_id", "event_type"], minutes=minutes), "update")
    last = sent.groupBy("user_id", "event_type").agg(F.max_by(F.struct("value", "updated", "expires", "live"), F.col("batch")).alias("s")).select("user_id", "event_type", "s.*")
    shown = [F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss").alias(f"{c}_at") for c in ("updated", "expires")]
    return last.filter("live").select("user_id", "event_type", "value", *[c for c in shown])


def stream_first_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that turns of conversations bring in for the first time, by what they are without case and blanks."""
    schema = spark.read.parquet(f"{sf}/conversations.parquet").schema
    turns = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf}/conversations.parquet")
    turns = turns.withColumn("at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") % 86_400))
    return keyed.drained(spark, keyed.first_texts(turns, "text", "at", "2 days"), "append").select("fingerprint")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (personal_signals, signal_channel, personal_profile, mixed_subjects, repaired_json, artifact_search, promoted_scratch, stream_scratch, stream_first_texts)
}


def _q(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"


def _values(rows: tuple) -> str:
    return ", ".join("(" + ", ".join(_q(x) for x in r) + ")" for r in rows)


_SIGNS = f"signs AS (SELECT doc_id AS id, place, signal_type, subject, valence, intensity::DOUBLE AS intensity FROM documents JOIN (VALUES {_values(SIGNS)}) v(k, place, signal_type, subject, valence, intensity) ON doc_id % {len(SAYINGS)} = k)"
_LAST = "arg_max({0}, (ts, event_id))"
_MINUTES = "CASE WHEN event_id % 5 > 0 THEN greatest(least((event_id % 60) * 40, 1440), 1) ELSE 30 END"
_SECTION = "CASE signal_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in people.SECTIONS.items()) + " END"
_HOLDS = " + ".join(f"contains(h, '{w}')::INT" for w in ("really", "love", "the", "garden"))

SQL: dict[str, str] = {
    "personal_signals": f"WITH {_SIGNS} SELECT * FROM signs",
    "signal_channel": rf"""WITH {MEMORIES}, {_SIGNS}, said AS (SELECT * FROM (VALUES {_values(tuple(enumerate(SAYINGS)))}) v(k, said)),
        top AS (SELECT s.*, said FROM signs s JOIN active a ON a.id = s.id JOIN said ON s.id % {len(SAYINGS)} = k ORDER BY intensity DESC, created_at DESC, s.id, place LIMIT 60),
        h AS (SELECT id, intensity, subject, trim(regexp_replace(regexp_replace(lower(said), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS h FROM top),
        p AS (SELECT id, least(1.0::DOUBLE, CASE WHEN contains(h, 'i really love the garden') THEN 0.45::DOUBLE ELSE 0 END
            + CASE WHEN len(list_filter(string_split(lower(regexp_replace(subject, '[^A-Za-z0-9 ]', ' ', 'g')), ' '), lambda w: w <> '' AND contains('i really love the garden', w))) > 0 THEN 0.05::DOUBLE ELSE 0 END
            + ({_HOLDS}) / 4.0::DOUBLE * 0.35::DOUBLE + intensity * 0.2::DOUBLE) AS score FROM h)
        SELECT id, round(max(score), 6) AS score FROM p WHERE score >= 0.3 GROUP BY id ORDER BY score DESC, id LIMIT 20""",
    "personal_profile": f"""WITH {_SIGNS}, r AS (SELECT *, id % 5 AS user_id, CAST(row_number() OVER (PARTITION BY id % 5, signal_type ORDER BY intensity DESC, id, place) AS INTEGER) AS n FROM signs)
        SELECT user_id, {_SECTION} AS section, n AS place, printf('- %s (%s, strength: %.2f)', subject, valence, intensity) AS line FROM r WHERE n <= 5""",
    "mixed_subjects": f"WITH {_SIGNS} SELECT id % 5 AS user_id, lower(replace(subject, ':', '')) AS subject, count(*) AS n FROM signs GROUP BY 1, 2 HAVING count(*) FILTER (valence = 'positive') > 0 AND count(*) FILTER (valence = 'negative') > 0",
    "repaired_json": f"SELECT doc_id AS id, coalesce(json, 'none') AS json FROM documents JOIN (VALUES {_values(tuple((i, j) for i, (_, j) in enumerate(BROKEN)))}) v(k, json) ON doc_id % {len(BROKEN)} = k",
    "artifact_search": "WITH " + BM25.replace("coalesce(content, '')", "coalesce(text, '')").replace("SELECT id, list_filter", "SELECT item_id AS id, list_filter").replace("FROM active", "FROM benchmark")
    + ", r AS (SELECT id // 2 AS id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm25) SELECT r.id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM r JOIN active a ON a.id = r.id GROUP BY r.id ORDER BY score DESC, r.id LIMIT 20",
    "promoted_scratch": f"SELECT event_type || ': ' || coalesce(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), '') AS content, 'general' AS category, 'agent' || user_id AS source, 5 AS importance FROM ({FIELDS['live_scratch']})",
    "stream_scratch": f"""WITH l AS (SELECT user_id, event_type, max(ts) AS updated, {_LAST.format('value')} AS value, {_LAST.format(_MINUTES)} AS minutes FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL)
        SELECT user_id, event_type, value, strftime(updated, '%Y-%m-%d %H:%M:%S') AS updated_at, strftime(updated + to_minutes(minutes::INT), '%Y-%m-%d %H:%M:%S') AS expires_at FROM l
        WHERE updated + to_minutes(minutes::INT) > (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "stream_first_texts": r"SELECT DISTINCT sha256(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS fingerprint FROM conversations",
}
