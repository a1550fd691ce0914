"""Registered queries on short texts, with their SQL. Rows bear phrases in turn, so that each rule meets texts that it fits and texts that it doesn't."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import extraction
from ..sources import frames

TODAY = "2024-05-31"
#: The texts.
PHRASES = (
    "I bought 3 green lamps. I love gardening because it calms me.", "She spent $1,200.50 on a new laptop, and now work as a baker.", "The server crashed yesterday and we fixed the bug.",
    "I moved to Lisbon. I hate long meetings, so I avoid them.", "When did the project start and how has it changed over time?", "Why did you choose the slow database?", "Should I learn to swim? Is it worth it?",
    "Can you recommend a good book for the weekend?", "The team no longer uses the old build and switched from make.", "We deployed the service on 2024-03-05, what was the outcome?", "I ran for 5 miles and walked 2 hours of trails.",
    "My favorite color is blue. I am excited and happy.", "The assistant recommended a faster index. It resulted in less load.", "Never delete the master table. This is critical!", "I baked a cake for the party, and earned $50 from sales.",
    "He was sad and tired 3 weeks ago.", None, "", "   ", "What happened on march 7, 2023? Tell me about the plan that the whole company discussed there.", "two weeks ago", "last monday", "Last Month", "today", "an hour ago", "10 days ago",
)
CORPUS = "the company discussed a plan for the database and the index"


def phrased(spark: SparkSession, sf: str) -> DataFrame:
    """(id, content): rows of documents with a phrase each."""
    texts = F.array(*[F.lit(p) for p in PHRASES])
    return frames.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.element_at(texts, (F.col("doc_id") % len(PHRASES) + 1).cast("int")).alias("content"))


def _today() -> Column:
    return F.to_date(F.lit(TODAY))


def _each(columns: Callable[[Column], dict[str, Column]]) -> Callable[[SparkSession, str], DataFrame]:
    """Columns of each phrase; made when the query is, as they need a session."""
    return lambda spark, sf: phrased(spark, sf).select("id", *[c.alias(k) for k, c in columns(F.col("content")).items()])


def typed_skills(spark: SparkSession, sf: str) -> DataFrame:
    """Names near to a known one, or else with its beginning."""
    known = frames.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    return extraction.corrected(["AUTOMOBIL", "BUILDING__2", "MACHINE__x", "ZZZ"], known)


def emotional_profile(spark: SparkSession, sf: str) -> DataFrame:
    own = phrased(spark, sf).select(rules.emotion(F.col("content")).alias("e")).select("e.*")
    return own.groupBy("dominant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("valence"), 6).alias("valence"), F.round(F.avg("arousal"), 6).alias("arousal"), F.count_if(F.col("valence") > 0.2).alias("positive"), F.count_if(F.col("valence") < -0.2).alias("negative"))


def rows_by_emotion(spark: SparkSession, sf: str) -> DataFrame:
    own = phrased(spark, sf).select("id", rules.emotion(F.col("content")).alias("e")).select("id", "e.*").filter("dominant = 'excitement'")
    return own.orderBy(F.desc(F.abs("valence")), F.desc("id")).limit(20).select("id", "valence")


def _owned(spark: SparkSession, sf: str) -> DataFrame:
    return phrased(spark, sf).withColumn("user_id", F.col("id") % 3 + 1)


def preferences(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.preferences(_owned(spark, sf))


def states(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.states(_owned(spark, sf))


def extracted_facts(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.facts(phrased(spark, sf))


def skipped_extractions(spark: SparkSession, sf: str) -> DataFrame:
    rows = phrased(spark, sf).withColumn("category", F.element_at(F.array(*[F.lit(x) for x in ("general", "task", "Issue", "note")]), (F.col("id") % 4 + 1).cast("int")))
    return rows.filter(extraction.skips(F.col("category"), F.col("content"))).select("id")


def signal_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = phrased(spark, sf).withColumn("intensity", (F.col("id") % 5) / 4.0)
    score = rules.signal_match("I love the garden book", F.col("content"), F.lit("book"), F.col("intensity"))
    return rows.select("id", F.round(score, 6).alias("score")).filter("score >= 0.3").orderBy(F.desc("score"), "id").limit(20)


def token_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring phrases that share more than a tenth of their words."""
    a = phrased(spark, sf).select("id", F.array_distinct(text.tokens(F.col("content"))).alias("a"))
    b = a.select((F.col("id") - 4).alias("id"), F.col("a").alias("b"))
    return a.join(b, "id").select("id", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("overlap")).filter("overlap > 0.1")


def decomposed(spark: SparkSession, sf: str) -> DataFrame:
    """The facts that texts are split into: sentences of three words or more, and how many."""
    parts = F.filter(rules.sentences(F.col("content"), 3), lambda s: F.size(F.split(s, r"\s+")) >= 3)
    return phrased(spark, sf).select("id", F.posexplode(F.slice(parts, 1, 8)).alias("place", "fact"))


def scale_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return frames.table(spark, sf, "orders").select("o_orderkey", rules.scale_tier(F.col("o_totalprice")).alias("tier"))


def send_times(spark: SparkSession, sf: str) -> DataFrame:
    e = frames.table(spark, sf, "events")
    kind = F.element_at(F.array(F.lit("hourly"), F.lit("weekly"), F.lit("daily")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select("event_id", rules.next_send(kind, F.date_trunc("hour", "ts").cast("timestamp")).alias("next"))


def episode_durations(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds from the first to the last event of each user, and the beginning of what they did."""
    return frames.table(spark, sf, "events").groupBy("user_id").agg(rules.duration(F.min("ts"), F.max("ts")).alias("seconds"))


def private_hosts(spark: SparkSession, sf: str) -> DataFrame:
    hosts = F.array(*[F.lit(h) for h in ("localhost", "10.0.0.1", "172.16.3.4", "172.40.1.1", "192.168.1.1", "example.org", "db.internal", "fd00::1", "8.8.8.8", "127.0.0.1", "")])
    return frames.table(spark, sf, "part").select("p_partkey", rules.private_host(F.element_at(hosts, (F.col("p_partkey") % 11 + 1).cast("int"))).alias("private"))


def signed_rows(spark: SparkSession, sf: str) -> DataFrame:
    own = frames.table(spark, sf, "customer")
    return own.select("c_custkey", F.sha2(rules.canonical_json({"name": F.col("c_name"), "id": F.col("c_custkey"), "nation": F.col("c_nationkey")}), 256).alias("sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (typed_skills, emotional_profile, rows_by_emotion, preferences, states, extracted_facts, skipped_extractions, signal_search, token_overlaps, decomposed, scale_tiers, send_times, episode_durations, private_hosts, signed_rows)
} | {
    "question_ladder": _each(lambda c: dict(type=rules.question_type(c, _today()))),
    "question_mix": lambda spark, sf: phrased(spark, sf).select("id", F.explode(rules.question_mix(F.col("content"), _today())).alias("type", "weight")),
    "query_dates": _each(lambda c: dict(date=rules.query_date(c, _today()))),
    "relative_dates": _each(lambda c: dict(date=rules.relative_date(c, _today()).cast("string"))),
    "emotions": lambda spark, sf: phrased(spark, sf).select("id", rules.emotion(F.col("content")).alias("e")).select("id", "e.*"),
    "chain_roles": _each(lambda c: dict(role=rules.chain_role(c), name=rules.chain_name(c))),
    "domains": _each(lambda c: dict(domain=rules.domain(c))),
    "guards": _each(lambda c: dict(verdict=rules.guard(c, F.col("id") % 10 + 1, (F.col("id") * 13) % 100))),
    "loose_claims": _each(lambda c: dict(n=F.size(rules.ungrounded_claims(c, F.lit(CORPUS))).cast("long"))),
    "sentence_counts": _each(lambda c: dict(n=F.size(rules.sentences(c)).cast("long"))),
    "match_terms": _each(lambda c: dict(query=rules.match_terms(c))),
    "canonical_tokens": _each(lambda c: dict(tokens=F.array_join(F.array_distinct(text.tokens(c)), " "))),
    "clamped_importance": lambda spark, sf: phrased(spark, sf).select("id", rules.clamped_importance(F.element_at(F.array(*[F.lit(x) for x in (None, "0", "-5", "15", "abc", " 7.5 ", "8", "")]), (F.col("id") % 8 + 1).cast("int"))).alias("importance")),
    "rejections": _each(lambda c: dict(reason=F.coalesce(rules.rejection(c, 60), F.lit("none")))),
    "corrections": _each(lambda c: dict(content=rules.correction(F.lit("It is B."), c, F.when(F.col("id") % 3 > 0, F.col("id"))))),
}

_P = "[" + ", ".join("NULL" if p is None else "'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"
_ROWS = f"p AS (SELECT doc_id AS id, {_P}[(doc_id % {len(PHRASES)} + 1)::INT] AS content FROM documents), q AS (SELECT id, content, coalesce(content, '') AS t, lower(coalesce(content, '')) AS l FROM p)"


def _s(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_MONTHS = "|".join(rules.MONTHS)
_NAMED = _s(rf"\b({_MONTHS})\s+(\d{{1,2}})(?:\s*,?\s*(\d{{4}}))?\b")
_AGO = _s(r"\b(\d+)\s+(day|week|month)s?\s+ago\b")
_NOW = f"DATE '{TODAY}'"
_DATE = rf"""CASE WHEN regexp_extract(l, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1) <> '' THEN regexp_extract(l, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1)
    WHEN regexp_extract(l, {_NAMED}, 1) <> '' THEN coalesce(nullif(regexp_extract(l, {_NAMED}, 3), ''), '{TODAY[:4]}') || '-' || lpad(list_position({list(rules.MONTHS)!r}, regexp_extract(l, {_NAMED}, 1))::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(l, {_NAMED}, 2), 2, '0')
    WHEN regexp_matches(l, '\byesterday\b') THEN strftime({_NOW} - INTERVAL 1 DAY, '%Y-%m-%d') WHEN regexp_matches(l, '\blast week\b') THEN strftime({_NOW} - INTERVAL 7 DAY, '%Y-%m-%d')
    WHEN regexp_matches(l, '\blast month\b') THEN strftime({_NOW} - INTERVAL 1 MONTH, '%Y-%m-%d') WHEN regexp_matches(l, '\btoday\b') THEN '{TODAY}'
    WHEN regexp_extract(l, {_AGO}, 2) = 'month' THEN strftime({_NOW} - to_months(regexp_extract(l, {_AGO}, 1)::INT), '%Y-%m-%d')
    WHEN regexp_extract(l, {_AGO}, 2) <> '' THEN strftime({_NOW} - to_days(regexp_extract(l, {_AGO}, 1)::INT * CASE WHEN regexp_extract(l, {_AGO}, 2) = 'week' THEN 7 ELSE 1 END), '%Y-%m-%d') END"""
_SIGN = lambda p: f"(d IS NOT NULL AND regexp_matches(l, {_s(rules.ASKING)}))" if p == "dated" else f"regexp_matches(l, {_s(p)})"
_KINDS = tuple(dict.fromkeys(k for k, _, _ in rules.SIGNS))
_MIX = ", ".join("(" + " + ".join(f"CASE WHEN {_SIGN(p)} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for kind, w, p in rules.SIGNS if kind == k) + f") AS {k}" for k in _KINDS)
_FEEL = ", ".join(f"CASE WHEN regexp_matches(l, {_s(rf'\b({words})\b')}) THEN {{'e': '{name}', 'v': {v}::DOUBLE, 'a': {a}::DOUBLE, 'k': {k}}} END" for k, (words, name, v, a) in enumerate(rules.EMOTIONS))
_EMOTIONS = f"""{_ROWS}, f AS (SELECT id, unnest(list_filter([{_FEEL}], lambda x: x IS NOT NULL)) AS x FROM q),
    m AS (SELECT id, floor(sum(x.v * abs(x.v)) / sum(abs(x.v)) * 100 + 0.5) / 100 AS valence, floor(sum(x.a * abs(x.v)) / sum(abs(x.v)) * 100 + 0.5) / 100 AS arousal, arg_min(x.e, (-abs(x.v), x.k)) AS dominant FROM f GROUP BY 1),
    emotions AS (SELECT id, coalesce(valence, 0) AS valence, coalesce(arousal, 0) AS arousal, coalesce(dominant, 'neutral') AS dominant FROM q LEFT JOIN m USING (id))"""
_CASES = lambda pairs, form: "CASE " + " ".join(f"WHEN regexp_matches(l, {_s(form.format(p))}) THEN '{k}'" for k, p in pairs)
_WORD_AGO = _s(r"^(\w+)\s+(day|week|month)s?\s+ago$")
_TOKENS = r"list_filter(string_split(trim(regexp_replace(regexp_replace({0}, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: length(w) >= 3)"
_SENT = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= {0})"

SQL: dict[str, str] = {
    "typed_skills": """WITH k AS (SELECT DISTINCT c_mktsegment AS name FROM customer), t AS (SELECT unnest(['AUTOMOBIL', 'BUILDING__2', 'MACHINE__x', 'ZZZ']) AS typed),
        n AS (SELECT typed, arg_min(name, (levenshtein(typed, name), name)) AS near FROM t, k WHERE levenshtein(typed, name) <= 3 GROUP BY 1),
        b AS (SELECT typed, min(name) AS begun FROM t, k WHERE starts_with(name, string_split(typed, '__')[1]) GROUP BY 1) SELECT typed, coalesce(near, begun, typed) AS name FROM t LEFT JOIN n USING (typed) LEFT JOIN b USING (typed)""",
    "emotions": f"WITH {_EMOTIONS} SELECT * FROM emotions",
    "emotional_profile": f"WITH {_EMOTIONS} SELECT dominant, count(*) AS n, round(avg(valence), 6) AS valence, round(avg(arousal), 6) AS arousal, count(*) FILTER (valence > 0.2) AS positive, count(*) FILTER (valence < -0.2) AS negative FROM emotions GROUP BY 1",
    "rows_by_emotion": f"WITH {_EMOTIONS} SELECT id, valence FROM emotions WHERE dominant = 'excitement' ORDER BY abs(valence) DESC, id DESC LIMIT 20",
    "skipped_extractions": f"WITH {_ROWS} SELECT id FROM q WHERE ['general', 'task', 'Issue', 'note'][(id % 4 + 1)::INT] IN ('task', 'Issue')",
    "token_overlaps": f"""WITH {_ROWS}, a AS (SELECT id, list_distinct({_TOKENS.format('l')}) AS a FROM q), j AS (SELECT x.id, x.a, y.a AS b FROM a x JOIN a y ON y.id - 4 = x.id),
        o AS (SELECT id, CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) END AS overlap FROM j) SELECT id, overlap FROM o WHERE overlap > 0.1""",
    "decomposed": rf"""WITH {_ROWS}, s AS (SELECT id, list_slice(list_filter({_SENT.format(3)}, lambda x: len(string_split_regex(x, '\s+')) >= 3), 1, 8) AS f FROM q) SELECT id, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS place, unnest(f) AS fact FROM s""",
    "scale_tiers": "SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'micro' WHEN o_totalprice < 10000 THEN 'small' WHEN o_totalprice < 50000 THEN 'medium' WHEN o_totalprice < 200000 THEN 'large' ELSE 'xlarge' END AS tier FROM orders",
    "send_times": "SELECT event_id, date_trunc('hour', ts) + to_hours(([1, 168, 24][(event_id % 3 + 1)::INT])::INT) AS next FROM events",
    "episode_durations": "SELECT user_id, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 + 0.5) AS BIGINT) AS seconds FROM events GROUP BY 1",
    "private_hosts": "SELECT p_partkey, [true, true, true, false, true, false, true, true, false, true, true][(p_partkey % 11 + 1)::INT] AS private FROM part",
    "signed_rows": """SELECT c_custkey, sha256('{"id":' || c_custkey || ',"name":"' || c_name || '","nation":' || c_nationkey || '}') AS sha256 FROM customer""",
    "question_ladder": f"WITH {_ROWS}, z AS (SELECT *, {_DATE} AS d FROM q) SELECT id, CASE {' '.join(f'WHEN {_SIGN(p)} THEN {k!r}' for k, p in rules.LADDER)} ELSE 'fact_recall' END AS type FROM z",
    "question_mix": f"""WITH {_ROWS}, z AS (SELECT *, {_DATE} AS d FROM q), m AS (SELECT id, {_MIX} FROM z), u AS (SELECT id, unnest({list(_KINDS)!r}) AS type, unnest([{', '.join(_KINDS)}]) AS score, {' + '.join(_KINDS)} AS total FROM m)
        SELECT id, type, floor(score / total * 100 + 0.5) / 100 AS weight FROM u WHERE score > 0 UNION ALL SELECT id, 'fact_recall', 1.0 FROM u WHERE type = 'temporal' AND total = 0""",
    "query_dates": f"WITH {_ROWS} SELECT id, {_DATE} AS date FROM q",
    "relative_dates": rf"""WITH {_ROWS}, r AS (SELECT id, trim(l) AS l FROM q), w AS (SELECT id, l, regexp_extract(l, {_WORD_AGO}, 1) AS w, regexp_extract(l, {_WORD_AGO}, 2) AS u FROM r),
        n AS (SELECT id, l, u, CASE WHEN w IN ('a', 'an') THEN 1 ELSE coalesce(list_position({list(rules.NUMBERS)!r}, w), try_cast(w AS INT), 0) END AS n FROM w)
        SELECT id, CAST(CAST(CASE WHEN l = 'today' THEN {_NOW} WHEN l = 'yesterday' THEN {_NOW} - INTERVAL 1 DAY WHEN u = 'month' AND n > 0 THEN {_NOW} - to_months(n::INT) WHEN u <> '' AND n > 0 THEN {_NOW} - to_days((n * CASE WHEN u = 'week' THEN 7 ELSE 1 END)::INT)
        WHEN l = 'last month' THEN {_NOW} - INTERVAL 1 MONTH WHEN l = 'last monday' THEN {_NOW} - INTERVAL 4 DAY END AS DATE) AS VARCHAR) AS date FROM n""",
    "chain_roles": rf"""WITH {_ROWS}, n AS (SELECT *, array_to_string(list_slice(list_filter(string_split_regex(t, '\s+'), lambda w: length(w) > 3), 1, 3), ' ') AS name FROM q)
        SELECT id, {_CASES(rules.ROLES, r'\b({0})\b')} ELSE 'event' END AS role, CASE WHEN name = '' THEN 'unnamed chain' ELSE name END AS name FROM n""",
    "domains": f"WITH {_ROWS} SELECT id, {_CASES(rules.DOMAINS, '{0}')} ELSE 'general' END AS domain FROM q",
    "guards": f"WITH {_ROWS} SELECT id, CASE WHEN id % 10 + 1 >= 10 OR regexp_matches(l, {_s(rules.FORBIDS)}) THEN CASE WHEN id * 13 % 100 < 30 THEN 'block' ELSE 'warn' END ELSE 'allow' END AS verdict FROM q",
    "loose_claims": rf"""WITH {_ROWS}, c AS (SELECT id, unnest(list_filter(list_transform(string_split_regex(t, '[.!?]+'), lambda x: trim(x)), lambda x: length(x) > 20)) AS c FROM q),
        w AS (SELECT id, list_filter(string_split_regex(regexp_replace(lower(c), '[^a-z0-9 ]', ' ', 'g'), '\s+'), lambda w: length(w) > 4 AND NOT list_contains({list(rules.STOPWORDS)!r}, w)) AS w FROM c),
        n AS (SELECT id, count(*) FILTER (len(w) > 0 AND len(list_filter(w, lambda x: contains({_s(CORPUS)}, x))) < 0.25 * len(w)) AS n FROM w GROUP BY 1) SELECT id, coalesce(n, 0) AS n FROM q LEFT JOIN n USING (id)""",
    "sentence_counts": f"WITH {_ROWS} SELECT id, len({_SENT.format(1)}) AS n FROM q",
    "match_terms": rf"""WITH {_ROWS} SELECT id, array_to_string(list_transform(list_filter(string_split_regex(trim(regexp_replace(t, '[^\w\s-]', ' ', 'g')), '\s+'), lambda w: w <> ''), lambda w: '"' || w || '"'), ' OR ') AS query FROM q""",
    "canonical_tokens": rf"""WITH {_ROWS}, w AS (SELECT id, unnest({_TOKENS.format('l')}) AS w, generate_subscripts({_TOKENS.format('l')}, 1) AS k FROM q), f AS (SELECT id, w, min(k) AS k FROM w GROUP BY 1, 2), g AS (SELECT id, string_agg(w, ' ' ORDER BY k) AS tokens FROM f GROUP BY 1) SELECT id, coalesce(tokens, '') AS tokens FROM q LEFT JOIN g USING (id)""",
    "clamped_importance": "SELECT doc_id AS id, ([1.0, 1.0, 1.0, 10.0, 5.0, 7.5, 8.0, 1.0][(doc_id % 8 + 1)::INT])::DOUBLE AS importance FROM documents",
    "rejections": f"WITH {_ROWS} SELECT id, CASE WHEN trim(t) = '' THEN 'empty' WHEN length(t) > 60 THEN 'too large' ELSE 'none' END AS reason FROM q",
    "corrections": f"""WITH {_ROWS} SELECT id, CASE WHEN t <> '' AND id % 3 > 0 AND id <> 0 THEN '[CORRECTION] Was: "' || left(t, 200) || '". Correct: It is B.' WHEN id % 3 > 0 AND id <> 0 THEN '[CORRECTION of #' || id || '] It is B.' ELSE 'It is B.' END AS content FROM q""",
    "signal_search": rf"""WITH {_ROWS}, n AS (SELECT id, trim(regexp_replace(regexp_replace(l, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS h FROM q),
        s AS (SELECT id, round(CASE WHEN h = '' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, CASE WHEN contains(h, 'i love the garden book') THEN 0.45::DOUBLE ELSE 0 END + 0.05::DOUBLE
        + (contains(h, 'love')::INT + contains(h, 'the')::INT + contains(h, 'garden')::INT + contains(h, 'book')::INT) / 4.0::DOUBLE * 0.35::DOUBLE + (id % 5) / 4.0::DOUBLE * 0.2::DOUBLE) END, 6) AS score FROM n)
        SELECT id, score FROM s WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 20""",
    "extracted_facts": f"""SELECT doc_id AS id, subject, verb, object, quantity, unit FROM documents JOIN (VALUES (0, 'user', 'bought', 'green lamps', 3.0::DOUBLE, NULL), (1, 'user', 'spent', 'a new laptop', 1200.5, 'dollars'), (10, 'user', 'did', 'trails', 2, 'hours'),
        (10, 'user', 'ran', NULL, 5, 'miles'), (10, 'user', 'walked', NULL, 2, 'hours'), (12, 'assistant', 'recommended', 'a faster index', NULL, NULL), (14, 'user', 'baked', 'cake', 1, NULL), (14, 'user', 'earned', 'sales', 50, 'dollars'),
        (15, 'user', 'did', 'ago', 3, 'weeks'), (25, 'user', 'did', 'ago', 10, 'days')) f(k, subject, verb, object, quantity, unit) ON doc_id % {len(PHRASES)} = k""",
    "preferences": f"""SELECT doc_id % 3 + 1 AS user_id, domain, preference, 1 + 0.5::DOUBLE * (count(*) - 1) AS strength, max(doc_id) AS evidence FROM documents JOIN (VALUES (0, 'gardening', 'likes gardening'), (3, 'general', 'dislikes long meetings'), (3, 'general', 'dislikes them'),
        (11, 'color', 'favorite: blue')) f(k, domain, preference) ON doc_id % {len(PHRASES)} = k GROUP BY 1, 2, 3""",
    "states": f"""SELECT doc_id % 3 + 1 AS user_id, key, any_value(value) AS value, CASE WHEN count(*) > 1 THEN any_value(value) END AS previous_value, count(*) AS updates FROM documents JOIN (VALUES (1, 'current_role', 'baker'), (3, 'current_location', 'Lisbon')) f(k, key, value) ON doc_id % {len(PHRASES)} = k GROUP BY 1, 2""",
}
