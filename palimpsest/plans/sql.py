"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from ..functions.scores import FACTOR, FSRS
from ..functions.text import QUESTIONS

MEMORIES = """memories AS (
    SELECT doc_id AS id, text AS content, lang AS category, source, doc_id % 3 + 1 AS user_id, doc_id % 10 + 1 AS importance,
           doc_id * 7 % 12 AS access_count, doc_id % 10 = 0 AS is_static, doc_id % 17 = 0 AS is_forgotten, doc_id % 13 = 0 AS is_archived, doc_id % 5 <> 4 AS is_latest,
           doc_id - doc_id % 5 AS root_memory_id, doc_id % 5 + 1 AS version, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id % 8760) AS created_at, 0.3::DOUBLE + (doc_id % 40) / 4.0::DOUBLE AS fsrs_stability
    FROM documents
), active AS (SELECT * FROM memories WHERE NOT is_forgotten AND NOT is_archived AND is_latest)"""

TERMS = ("and", "that", "the", "with")
_TF = ", ".join(f"len(list_filter(t, lambda w: w = '{w}')) AS tf{i}" for i, w in enumerate(TERMS))
_DF = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(TERMS)))
_SCORE = " + ".join(f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))" for i in range(len(TERMS)))
BM25 = rf"""{MEMORIES}, tokens AS (
    SELECT id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(content, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: length(w) >= 3) AS t FROM active
), counted AS (SELECT id, len(t) AS length, {_TF} FROM tokens), stats AS (SELECT count(*) AS n, avg(length) AS mean, {_DF} FROM counted),
bm25 AS (SELECT id, round({_SCORE}, 6) AS score FROM counted, stats WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(TERMS)))} ORDER BY score DESC, id LIMIT 20)"""
NEAR = """near AS (
    SELECT e.vec_id AS id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE len(e.embedding) = len(q.embedding) ORDER BY score DESC, id LIMIT 20)"""

_AGE = "(epoch_us(TIMESTAMP '{0}') - epoch_us(created_at)) / 86400000000.0::DOUBLE"
_R = f"CASE WHEN fsrs_stability <= 0 THEN 0.0 WHEN {_AGE} <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, pow(1 + {FACTOR!r}::DOUBLE * ({_AGE}) / fsrs_stability, -{FSRS[20]}::DOUBLE))) END"

LINKS = """joined AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
ahead AS (SELECT s + 1000000000 AS source_id, p AS target_id, 0.5::DOUBLE + (p % 5) / 10.0::DOUBLE AS similarity,
    ['similarity', 'caused_by', 'updates', 'extends', 'consolidates', 'related'][((s + p) % 6 + 1)::INT] AS type FROM joined),
links AS (SELECT * FROM ahead UNION ALL SELECT target_id, source_id, similarity, type FROM ahead)"""
_WEIGHT = "CASE type WHEN 'caused_by' THEN 2.0 WHEN 'causes' THEN 2.0 WHEN 'updates' THEN 1.5 WHEN 'corrects' THEN 1.5 WHEN 'extends' THEN 1.3 WHEN 'contradicts' THEN 1.3 WHEN 'consolidates' THEN 0.5 ELSE 1.0 END"


def _pagerank(rounds: int) -> str:
    steps = [f"r{i + 1} AS (SELECT nodes.id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(got, 0) AS rank FROM nodes CROSS JOIN size LEFT JOIN (SELECT target_id AS id, sum(share * rank) AS got FROM edges JOIN r{i} ON source_id = r{i}.id GROUP BY 1) g USING (id))" for i in range(rounds)]
    return f"""WITH {LINKS}, weighted AS (SELECT source_id, target_id, similarity * ({_WEIGHT})::DOUBLE AS w FROM links),
edges AS (SELECT source_id, target_id, w / sum(w) OVER (PARTITION BY source_id) AS share FROM weighted),
nodes AS (SELECT source_id AS id FROM links UNION SELECT target_id FROM links), size AS (SELECT count(*) AS n FROM nodes),
r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM nodes, size), {", ".join(steps)} SELECT id, round(rank, 9) AS rank FROM r{rounds}"""


SETTLED_PAGERANK = f"""WITH RECURSIVE {LINKS}, weighted AS (SELECT source_id, target_id, similarity * ({_WEIGHT})::DOUBLE AS w FROM links),
edges AS MATERIALIZED (SELECT source_id, target_id, w / sum(w) OVER (PARTITION BY source_id) AS share FROM weighted),
nodes AS MATERIALIZED (SELECT source_id AS id FROM links UNION SELECT target_id FROM links), size AS (SELECT count(*) AS n FROM nodes),
walk AS (SELECT 0 AS k, id, 1.0::DOUBLE / n AS rank, 1.0::DOUBLE AS most FROM nodes, size
    UNION ALL SELECT k + 1, id, new, max(abs(new - rank)) OVER () FROM (
        SELECT k, w.id, rank, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(got, 0) AS new FROM walk w CROSS JOIN size LEFT JOIN (
            SELECT target_id AS id, sum(share * rank) AS got FROM edges JOIN walk ON source_id = walk.id GROUP BY 1) g ON g.id = w.id WHERE k < 25 AND most >= 1e-6))
SELECT id, round(rank, 9) AS rank FROM walk WHERE k = (SELECT max(k) FROM walk)"""

SQL: dict[str, str] = {
    "search_bm25": f"WITH {BM25} SELECT * FROM bm25",
    "vector_topk": f"WITH {NEAR} SELECT * FROM near",
    "hybrid_search": f"""WITH {BM25}, {NEAR}, ranks AS (
        SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm25 UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM near)
        SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM ranks GROUP BY id ORDER BY score DESC, id LIMIT 20""",
    "recall_layers": f"""WITH {BM25}, decayed AS (SELECT *, round(importance * ({_R.format('2025-06-01 00:00:00')}), 3) AS decay FROM active), layers AS (
        SELECT * FROM (SELECT id, 100.0::DOUBLE AS score, 0 AS source FROM active WHERE is_static ORDER BY importance DESC, id LIMIT 8)
        UNION ALL SELECT id, b.score * 50 * decay / importance, 1 FROM (SELECT * FROM bm25 ORDER BY score DESC, id LIMIT 10) b JOIN decayed USING (id)
        UNION ALL SELECT * FROM (SELECT id, decay * 2 AS score, 2 FROM decayed WHERE importance >= 8 ORDER BY score DESC, id LIMIT 10)
        UNION ALL SELECT * FROM (SELECT id, 1.0::DOUBLE, 3 FROM active ORDER BY created_at DESC, id LIMIT 30)),
        own AS (SELECT id, min(source) AS layer, arg_min(score, source) AS score FROM layers GROUP BY id)
        SELECT id, layer AS source, round(own.score * CASE WHEN a.source IN ('src1', 'src3', 'src5') THEN 1.2 ELSE 1.0 END::DOUBLE, 6) AS score FROM own JOIN active a USING (id) ORDER BY score DESC, id LIMIT 30""",
    "list_recent": f"WITH {MEMORIES} SELECT id, category, source, created_at FROM active WHERE category = 'en' ORDER BY created_at DESC, id DESC LIMIT 50",
    "stale_high_value": f"""WITH {MEMORIES} SELECT id, importance, access_count, CASE WHEN length(content) > 120 THEN left(content, 120) || '…' ELSE content END AS preview
        FROM active WHERE importance >= 6 AND NOT is_static AND {_AGE.format("2024-02-01 00:00:00")} > 20 AND access_count < 2 ORDER BY importance DESC, created_at, id LIMIT 50""",
    "contradiction_hints": f"""WITH {MEMORIES}, h AS (SELECT id, [NULL, '', 'It NO LONGER works', 'plain', 'Changed to B', 'used to run', 'instead now C', 'fine, but now D', 'Previously E', 'longer no', 'was replaced'][(id % 11 + 1)::INT] AS content FROM memories)
        SELECT id FROM h WHERE regexp_matches(lower(coalesce(content, '')), 'no longer|changed to|used to|instead now|but now|previously')""",
    "access_tiers": f"""WITH {MEMORIES} SELECT CASE WHEN access_count = 0 THEN 'never' WHEN access_count < 3 THEN 'cold' WHEN access_count < 8 THEN 'warm' ELSE 'hot' END AS tier,
        count(*) AS n, round(avg(importance), 4) AS mean_importance FROM memories GROUP BY 1""",
    "category_histogram": f"WITH {MEMORIES} SELECT category, count(*) AS n FROM memories GROUP BY 1",
    "snapshot_at_time": f"""WITH {MEMORIES} SELECT count(*) AS total, count(*) FILTER (is_static) AS n_static, count(*) FILTER (is_forgotten) AS n_forgotten,
        count(*) FILTER (is_archived) AS n_archived, count(*) FILTER (is_latest) AS n_latest FROM memories WHERE created_at <= TIMESTAMP '2024-01-20 00:00:00'""",
    "versions_at_time": f"""WITH {MEMORIES} SELECT root_memory_id, id, version FROM memories WHERE created_at <= TIMESTAMP '2024-01-20 00:00:00'
        QUALIFY row_number() OVER (PARTITION BY root_memory_id ORDER BY created_at DESC, id DESC) = 1""",
    "version_chains": f"WITH {MEMORIES} SELECT root_memory_id, count(*) AS versions, string_agg(version || ':' || id, '|' ORDER BY version, id) AS chain FROM memories GROUP BY 1",
    "decay_scores": f"""WITH {MEMORIES}, r AS (SELECT *, {_R.format("2025-06-01 00:00:00")} AS r FROM memories)
        SELECT id, round(r, 6) AS retrievability, round(CASE WHEN is_static THEN importance::DOUBLE ELSE importance * r END, 6) AS decay_score,
        CAST(floor(fsrs_stability / {FACTOR!r}::DOUBLE * {0.9 ** (-1 / FSRS[20]) - 1!r}::DOUBLE + 0.5) AS BIGINT) AS next_interval FROM r""",
    "auto_archive": f"""WITH {MEMORIES} SELECT id FROM memories WHERE NOT is_static AND NOT is_archived AND access_count < 2
        AND {_AGE.format("2034-06-01 00:00:00")} > 90 AND {_R.format("2034-06-01 00:00:00")} < 0.5""",
    "gc_counts": f"""WITH {MEMORIES} SELECT 'forgotten' AS kind, count(*) FILTER (is_forgotten) AS n FROM memories UNION ALL SELECT 'archived', count(*) FILTER (is_archived) FROM memories
        UNION ALL SELECT 'superseded', count(*) FILTER (NOT is_latest) FROM memories UNION ALL SELECT 'blank', count(*) FILTER (coalesce(trim(content), '') = '') FROM memories""",
    "tenant_report": f"""WITH {MEMORIES} SELECT user_id, count(*) AS memories, count(*) FILTER (is_static) AS statics, CAST(sum(access_count) AS BIGINT) AS accesses, max(created_at) AS last_created,
        CAST(sum(CAST(ceil(length(coalesce(content, '')) / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM memories GROUP BY 1""",
    "token_estimates": f"WITH {MEMORIES} SELECT id, CAST(ceil(length(coalesce(content, '')) / 4.0) AS BIGINT) AS tokens FROM memories",
    "unlinked_memories": f"WITH {MEMORIES} SELECT id, importance FROM active WHERE id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND id NOT IN (SELECT doc_id + 1 FROM labels WHERE doc_id IS NOT NULL)",
    "current_state": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)
        SELECT user_id, event_type, max(value) FILTER (k = 1) AS value, max(value) FILTER (k = 2) AS previous_value, count(*) AS updates FROM o GROUP BY 1, 2""",
    "usage_daily": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    "usage_totals": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1",
    "access_pattern": "SELECT CAST(dayofweek(ts) AS INTEGER) AS day_of_week, CAST(hour(ts) AS INTEGER) AS hour_of_day, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3",
    "metric_summary": "SELECT user_id, event_type, coalesce(round(CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) / count(value), 3), 0) AS mean, coalesce(min(value), 0) AS least, coalesce(max(value), 0) AS most, count(*) AS n FROM events GROUP BY 1, 2",
    "feedback_precision": "SELECT user_id, count(*) AS signals, floor(count(*) FILTER (event_type IN ('purchase', 'click'))::DOUBLE / count(*) * 1000 + 0.5) / 1000 AS precision FROM events GROUP BY 1",
    "sla_report": """SELECT n, round(fast, 4) AS fast_percent, round(slow, 4) AS slow_percent, round(errors, 4) AS errors_percent, fast >= 95 AS fast_met, slow >= 95 AS slow_met, errors < 1 AS errors_met FROM (
        SELECT count(*) AS n, 100.0::DOUBLE * count(*) FILTER (value < 100) / count(*) AS fast, 100.0::DOUBLE * count(*) FILTER (value < 200) / count(*) AS slow, 100.0::DOUBLE * count(*) FILTER (event_type = 'error') / count(*) AS errors FROM events)""",
    "error_groups": """SELECT event_type, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, string_agg(CASE WHEN k <= 3 THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY event_id) AS examples
        FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) GROUP BY 1""",
    "agent_trust": """SELECT user_id, floor(least(100, greatest(0, 50 + least(25, 0.1::DOUBLE * ok) + least(15, 0.5::DOUBLE * allowed) - 2 * warned - 5 * blocked - least(20, 40.0::DOUBLE * failed / total))) * 10 + 0.5) / 10 AS trust FROM (
        SELECT user_id, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'view') AS allowed, count(*) FILTER (event_type = 'error') AS warned,
        count(*) FILTER (value > 99) AS blocked, count(*) FILTER (value < 1) AS failed, count(*) AS total FROM events GROUP BY 1)""",
    "preference_strength": "SELECT user_id, event_type AS preference, 1 + 0.5::DOUBLE * (count(*) - 1) AS strength FROM events GROUP BY 1, 2",
    "session_episodes": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, min(ts) AS started_at, max(ts) AS last_at, count(*) AS n FROM s GROUP BY user_id, session""",
    "stream_usage_daily": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "html_titles": "SELECT page_id, trim(regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1)) AS title FROM pages",
    "conversation_transcripts": """SELECT conv_id, CAST(floor(turn / 1000) AS BIGINT) AS part, count(*) AS messages, string_agg(upper(left(role, 1)) || substring(role, 2) || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1, 2""",
    "question_types": "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{k}'" for k, p in QUESTIONS) + " ELSE 'fact_recall' END AS type FROM conversations",
    "part_name_similarity": """WITH g AS (SELECT p_partkey, list_distinct([substring(lower(p_name), i, 2) for i in range(1, length(p_name))]) AS a, list_distinct([substring(lower(p_type), i, 2) for i in range(1, length(p_type))]) AS b FROM part)
        SELECT p_partkey, round(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM g""",
    "pagerank_links": _pagerank(5),
    "settled_pagerank": SETTLED_PAGERANK,
    "node_roles": f"""WITH {LINKS}, d AS (SELECT id, CAST(sum(i) AS BIGINT) AS indegree, CAST(sum(o) AS BIGINT) AS outdegree FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM links UNION ALL SELECT target_id, 1, 0 FROM links) GROUP BY 1)
        SELECT *, CASE WHEN indegree = 0 THEN 'source' WHEN outdegree = 0 THEN 'sink' WHEN indegree > 1 AND outdegree > 1 THEN 'hub' WHEN outdegree > 1 THEN 'fork' WHEN indegree > 1 THEN 'join' ELSE 'pipe' END AS role FROM d""",
    "link_weights": f"WITH {LINKS} SELECT DISTINCT source_id, target_id, type, CAST({_WEIGHT} AS DOUBLE) AS weight FROM links",
}
