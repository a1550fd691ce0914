"""Registered queries on composite retrieval, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking, relational, retrieval
from ..sources import frames
from .sql import BM25, MEMORIES, NEAR, _R

AS_OF, ASKED = "2025-06-01 00:00:00", "2024-01-10 00:00:00"
TERMS, K = ["the", "and", "that", "with"], 20


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return frames.active(frames.memories(spark, sf))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25(_rows(spark, sf), TERMS, K)


def _near(spark: SparkSession, sf: str) -> DataFrame:
    vectors = frames.vectors(spark, sf)
    return retrieval.nearest(vectors, [float(x) for x in vectors.filter("id = 0").first().embedding], K)


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.fuse([retrieval.ranked(_words(spark, sf)), retrieval.ranked(_near(spark, sf))], 2 * K)


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return relational.document_links(frames.memories(spark, sf)).withColumn("similarity", (F.col("source_id") % 50 + 50) / 100.0)


def _boosted(spark: SparkSession, sf: str) -> DataFrame:
    every = frames.memories(spark, sf).withColumn("pagerank", (F.col("id") % 8) / 8.0)
    return ranking.boosted(_fused(spark, sf), every, AS_OF, ASKED)


def boosted_search(spark: SparkSession, sf: str) -> DataFrame:
    return _boosted(spark, sf).select("id", F.round("score", 7).alias("score"))


def expanded_search(spark: SparkSession, sf: str) -> DataFrame:
    s = ranking.STRATEGIES["reasoning"]
    found = ranking.expanded(_boosted(spark, sf), _links(spark, sf), s["seeds"], s["hop1"], s["hop2"], s["multiplier"])
    return found.select("id", F.round("score", 7).alias("score")).orderBy(F.desc("score"), "id").limit(K)


def hydrated_search(spark: SparkSession, sf: str) -> DataFrame:
    return F.broadcast(_words(spark, sf)).join(frames.memories(spark, sf), "id").select("id", "score", "category", "importance", "version")


def source_search(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25(_rows(spark, sf), TERMS, K, where=F.contains(F.col("source"), F.lit("1")))


def facts_search(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest rows of one category, filtered before the top-k."""
    vectors = frames.vectors(spark, sf)
    return retrieval.nearest(vectors.filter("category = 1"), [float(x) for x in vectors.filter("id = 0").first().embedding], K)


def scoped_search(spark: SparkSession, sf: str) -> DataFrame:
    """Search among the rows of a project: those that labels mark good."""
    members = frames.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    scope = _rows(spark, sf).join(members.distinct().withColumn("own", F.lit(True)), "id", "left")
    return retrieval.bm25(scope, TERMS, K, where=F.col("own"))


def abstained_search(spark: SparkSession, sf: str) -> DataFrame:
    """Nothing if the best row isn't near enough: here for a vector of no row and for one of a row."""
    vectors, best = frames.vectors(spark, sf), []
    for i, q in enumerate(([0.1] * 64, [float(x) for x in vectors.filter("id = 0").first().embedding])):
        best.append(retrieval.nearest(vectors, q, 1).agg(F.lit(i).alias("query"), F.coalesce(F.max("score") < ranking.ABSTAIN_BELOW, F.lit(True)).alias("abstained")))
    return best[0].unionByName(best[1])


def explained_search(spark: SparkSession, sf: str) -> DataFrame:
    found = _near(spark, sf).select("id", F.col("score").alias("semantic_score")).join(_words(spark, sf).select("id", F.col("score").alias("fts_score")), "id", "full")
    rows = found.join(frames.memories(spark, sf), "id").withColumn("graph_score", F.when(F.col("id") % 3 == 0, 0.5)).withColumn("temporal_boost", F.when(F.col("id") % 4 == 0, 1.2))
    return ranking.explained(rows)


def episode_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.two_channels(_near(spark, sf), _words(spark, sf), K)


def skill_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.fused_with_missing(retrieval.ranked(_near(spark, sf)), retrieval.ranked(_words(spark, sf)), K)


def message_search(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that hold a word, newest first."""
    turns = frames.table(spark, sf, "conversations")
    return turns.filter(F.lower("text").rlike(r"\bthe\b")).orderBy(F.desc("conv_id"), F.desc("turn")).limit(K).select("conv_id", "turn")


def provider_merge(spark: SparkSession, sf: str) -> DataFrame:
    pages = frames.table(spark, sf, "pages").select("url", F.lit("").alias("text"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), ((F.col("page_id") * 37) % 101 / 101.0).alias("score"))
    texts = frames.table(spark, sf, "benchmark").select(F.lit(None).cast("string").alias("url"), "text", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("title"), ((F.col("item_id") * 53) % 97 / 97.0).alias("score"))
    return ranking.merged_sources([pages, texts, pages.withColumn("score", F.col("score") / 2)], 30).select("key", "title", F.round("score", 6).alias("score"))


def predicted_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    recent = lambda lang, days: rows.filter((F.col("category") == lang) & (F.col("created_at") > F.date_sub(F.lit("2024-01-08").cast("date"), days)) & (F.col("created_at") <= F.lit("2024-01-08").cast("timestamp")))
    tasks = recent("en", 3).orderBy(F.desc("importance"), F.desc("created_at"), "id").limit(5)
    issues = recent("de", 7).orderBy(F.desc("importance"), "id").limit(3)
    project = rows.join(frames.table(spark, sf, "labels").select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").orderBy(F.desc("created_at"), "id").limit(5)
    last = rows.orderBy(F.desc("created_at"), "id").limit(3)
    return ranking.first_reasons([(tasks, "unfinished_task", 0.3), (issues, "active_issue", 0.2), (project, "predicted_project", 0.1), (last, "session_continuity", 0.0)], 10)


def packed_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    statics = rows.filter("is_static").orderBy(F.desc("importance"), "id").limit(20).select("id", "content", F.lit(100.0).alias("score"))
    words = _words(spark, sf).join(rows.select("id", "content"), "id").select("id", "content", (F.col("score") * 50).alias("score"))
    important = rows.filter("importance >= 8").orderBy(F.desc("importance"), "id").limit(30).select("id", "content", (F.col("importance") * 2.0).alias("score"))
    first = None
    for layer in (statics, words, important):
        first = layer if first is None else first.unionByName(layer.join(first.select("id"), "id", "left_anti"))
    return ranking.packed(first.withColumn("confidence", F.lit(1.0)), 4000)


def user_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = relational.scoped(_rows(spark, sf), 1)
    static = rows.filter("is_static").orderBy(F.desc("importance"), "id").limit(20).select("id", F.lit("static").alias("part"))
    return static.unionByName(rows.filter("not is_static").orderBy(F.desc("created_at"), "id").limit(20).select("id", F.lit("dynamic").alias("part")))


def time_travel(spark: SparkSession, sf: str) -> DataFrame:
    """What a search at a time would find: near rows of the versions that were then the latest."""
    rows = frames.memories(spark, sf).withColumn("root_memory_id", F.when(F.col("id") % 3 != 0, F.col("root_memory_id")))
    vectors = frames.vectors(spark, sf)
    known = vectors.join(ranking.at_time(rows, "2024-01-12 00:00:00"), "id", "left_semi")
    return retrieval.nearest(known, [float(x) for x in vectors.filter("id = 0").first().embedding], K, floor=0.1)


def guarded_action(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames.memories(spark, sf).withColumn("is_static", F.col("id") % 2 == 0)
    return ranking.checked_action(_near(spark, sf), rows)


def layer_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the best rows each layer gives."""
    rows = _rows(spark, sf)
    layers = [(rows.filter("is_static").select("id", F.lit(100.0).alias("score")), 8, None), (_words(spark, sf), 10, None), (rows.select("id", F.lit(1.0).alias("score"), "created_at"), K, "created_at")]
    found = retrieval.recall(layers, K)
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        boosted_search, expanded_search, hydrated_search, source_search, facts_search, scoped_search, abstained_search, explained_search, episode_search, skill_search, message_search, provider_merge, predicted_rows, packed_context,
        user_profile, time_travel, guarded_action, layer_counts,
    )
}

_FUSED = f"""{BM25}, {NEAR}, ranks AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm25 UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM near),
    fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM ranks GROUP BY id ORDER BY score DESC, id LIMIT 40)"""
_BOOSTED = f"""{_FUSED}, boosted AS (SELECT f.id, f.score * CASE WHEN is_static THEN 1.0::DOUBLE ELSE 0.3::DOUBLE + 0.7::DOUBLE * ({_R.format(AS_OF)}) END * (1 + least((f.id % 4 + 1) / 10.0::DOUBLE, 1.0::DOUBLE) * 0.05::DOUBLE) * CASE WHEN is_static THEN 1.03::DOUBLE ELSE 1.0::DOUBLE END
    * (1 + 0.5::DOUBLE * exp(-pow((epoch_us(TIMESTAMP '{ASKED}') - epoch_us(created_at)) / 86400000000.0::DOUBLE, 2) / 98)) * pow(1 + 0.15::DOUBLE * (f.id % 8) / 8.0::DOUBLE, 2)
    * CASE WHEN NOT is_latest AND regexp_matches(lower(coalesce(content, '')), 'no longer|changed to|used to|instead now|but now|previously|was replaced|switched from') THEN 0.65::DOUBLE ELSE 1.0::DOUBLE END AS score FROM fused f JOIN memories m ON m.id = f.id)"""
_QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_DOT = f"list_inner_product(embedding::DOUBLE[], {_QUERY}::DOUBLE[])"
_SCOPED = lambda where: BM25.replace(" OR ".join(f"tf{i} > 0" for i in range(4)) + " ORDER", f"({' OR '.join(f'tf{i} > 0' for i in range(4))}) AND id IN ({where}) ORDER")

SQL: dict[str, str] = {
    "boosted_search": f"WITH {_BOOSTED} SELECT id, round(score, 7) AS score FROM boosted",
    "expanded_search": f"""WITH {_BOOSTED}, strength AS (SELECT id AS source_id, id * 2 + 1 AS target_id, (id % 50 + 50) / 100.0::DOUBLE * [1.0, 1.3, 1.5][(id % 3 + 1)::INT]::DOUBLE * 1.2::DOUBLE AS raw FROM memories),
        seeds AS (SELECT id FROM boosted ORDER BY score DESC, id LIMIT 5), one AS (SELECT target_id AS id, raw FROM strength WHERE source_id IN (SELECT id FROM seeds)),
        new AS (SELECT id, max(raw) AS raw FROM one WHERE id NOT IN (SELECT id FROM boosted) GROUP BY 1 ORDER BY raw DESC, id LIMIT 2), two AS (SELECT target_id AS id, raw * 0.5::DOUBLE AS raw FROM strength WHERE source_id IN (SELECT id FROM new)),
        hits AS (SELECT id, row_number() OVER (ORDER BY raw DESC, id) AS n FROM (SELECT * FROM one UNION ALL SELECT * FROM two)), g AS (SELECT id, sum(1.0::DOUBLE / (60 + n)) AS gain FROM hits GROUP BY 1)
        SELECT coalesce(b.id, g.id) AS id, round(coalesce(score, 0) + coalesce(gain, 0), 7) AS score FROM boosted b FULL JOIN g ON g.id = b.id ORDER BY score DESC, id LIMIT 20""",
    "hydrated_search": f"WITH {BM25} SELECT id, score, category, importance, version FROM bm25 JOIN memories USING (id)",
    "source_search": f"WITH {_SCOPED(chr(39).join(['SELECT id FROM active WHERE contains(source, ', '1', ')']))} SELECT * FROM bm25",
    "facts_search": f"SELECT vec_id AS id, round({_DOT}, 6) AS score FROM embeddings WHERE label = 1 ORDER BY score DESC, id LIMIT 20",
    "scoped_search": f"WITH {_SCOPED('SELECT doc_id FROM labels WHERE quality = 1')} SELECT * FROM bm25",
    "abstained_search": f"""SELECT 0 AS query, max(list_inner_product(embedding::DOUBLE[], list_transform(range(64), lambda x: 0.1::DOUBLE))) < 0.58 AS abstained FROM embeddings UNION ALL SELECT 1, max({_DOT}) < 0.58 FROM embeddings""",
    "explained_search": f"""WITH {BM25}, {NEAR}, f AS (SELECT coalesce(n.id, b.id) AS id, floor(n.score * 1000 + 0.5) / 1000 AS vector, b.score AS fts FROM near n FULL JOIN bm25 b ON b.id = n.id), m AS (SELECT f.*, is_static, importance FROM f JOIN memories USING (id))
        SELECT id, vector, array_to_string(list_filter([CASE WHEN vector > 0.7 THEN 'strong semantic match' WHEN vector > 0.5 THEN 'moderate semantic match' END, CASE WHEN fts IS NOT NULL THEN 'full-text match' END, CASE WHEN id % 3 = 0 THEN 'graph hop' END,
        CASE WHEN id % 4 = 0 THEN 'temporal proximity boost' END, CASE WHEN is_static THEN 'permanent fact' END, CASE WHEN id % 4 + 1 > 1 THEN 'corroborated ' || (id % 4 + 1) || 'x' END, CASE WHEN importance >= 8 THEN 'high importance' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM m""",
    "episode_search": f"""WITH {BM25}, {NEAR} SELECT coalesce(n.id, b.id) AS id, CASE WHEN n.id IS NULL THEN 0.3::DOUBLE ELSE round(n.score + CASE WHEN b.id IS NULL THEN 0.0 ELSE 0.2 END::DOUBLE, 6) END AS score
        FROM (SELECT * FROM near WHERE score > 0.3) n FULL JOIN bm25 b ON b.id = n.id ORDER BY score DESC, id LIMIT 20""",
    "skill_search": f"""WITH {BM25}, {NEAR}, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM near), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm25)
        SELECT coalesce(a.id, b.id) AS id, round(1.0::DOUBLE / (60 + coalesce(a.r, (SELECT max(r) + 1 FROM a))) + 1.0::DOUBLE / (60 + coalesce(b.r, (SELECT max(r) + 1 FROM b))), 6) AS score FROM a FULL JOIN b ON a.id = b.id ORDER BY score DESC, id LIMIT 20""",
    "message_search": r"SELECT conv_id, turn FROM conversations WHERE regexp_matches(lower(text), '\bthe\b') ORDER BY conv_id DESC, turn DESC LIMIT 20",
    "provider_merge": """WITH p AS (SELECT url AS key, 'page ' || page_id AS title, page_id * 37 % 101 / 101.0::DOUBLE AS score, 0 AS provider FROM pages), e AS (SELECT * FROM p UNION ALL SELECT left(text, 100), 'item ' || item_id, item_id * 53 % 97 / 97.0::DOUBLE, 1 FROM benchmark UNION ALL SELECT key, title, score / 2, 2 FROM p)
        SELECT key, arg_min(title, (-score, provider, title)) AS title, round(max(score), 6) AS score FROM e GROUP BY 1 ORDER BY max(score) DESC, key LIMIT 30""",
    "predicted_rows": f"""WITH {MEMORIES}, l AS (SELECT * FROM (SELECT id, importance / 10.0::DOUBLE + 0.3::DOUBLE AS score, 0 AS layer, 'unfinished_task' AS reason FROM active WHERE category = 'en' AND created_at > TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-08' ORDER BY importance DESC, created_at DESC, id LIMIT 5)
        UNION ALL SELECT * FROM (SELECT id, importance / 10.0::DOUBLE + 0.2::DOUBLE, 1, 'active_issue' FROM active WHERE category = 'de' AND created_at > TIMESTAMP '2024-01-01' AND created_at <= TIMESTAMP '2024-01-08' ORDER BY importance DESC, id LIMIT 3)
        UNION ALL SELECT * FROM (SELECT id, importance / 10.0::DOUBLE + 0.1::DOUBLE, 2, 'predicted_project' FROM active WHERE id IN (SELECT doc_id FROM labels) ORDER BY created_at DESC, id LIMIT 5)
        UNION ALL SELECT * FROM (SELECT id, importance / 10.0::DOUBLE, 3, 'session_continuity' FROM active ORDER BY created_at DESC, id LIMIT 3))
        SELECT id, arg_min(reason, layer) AS reason, round(arg_min(score, layer), 6) AS score FROM l GROUP BY 1 ORDER BY score DESC, id LIMIT 10""",
    "packed_context": f"""WITH RECURSIVE {BM25}, l AS (SELECT * FROM (SELECT id, content, 100.0::DOUBLE AS score, 0 AS layer FROM active WHERE is_static ORDER BY importance DESC, id LIMIT 20) UNION ALL SELECT id, content, b.score * 50, 1 FROM bm25 b JOIN active USING (id)
        UNION ALL SELECT * FROM (SELECT id, content, importance * 2.0::DOUBLE, 2 FROM active WHERE importance >= 8 ORDER BY importance DESC, id LIMIT 30)),
        c AS (SELECT id, content, score FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY layer) = 1), t AS (SELECT id, CAST(ceil(length(content) / 4.0) + 10 AS BIGINT) AS tokens, row_number() OVER (ORDER BY score DESC, id) AS k FROM c WHERE content IS NOT NULL AND ceil(length(content) / 4.0) + 10 <= 4000),
        w AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS id, 0::BIGINT AS tokens, 0::BIGINT AS used, false AS fits UNION ALL SELECT t.k, t.id, t.tokens, w.used + CASE WHEN w.used + t.tokens <= 4000 THEN t.tokens ELSE 0 END, w.used + t.tokens <= 4000 FROM w JOIN t ON t.k = w.k + 1) SELECT id, tokens FROM w WHERE fits""",
    "user_profile": f"WITH {MEMORIES}, u AS (SELECT * FROM active WHERE user_id = 1) SELECT * FROM (SELECT id, 'static' AS part FROM u WHERE is_static ORDER BY importance DESC, id LIMIT 20) UNION ALL SELECT * FROM (SELECT id, 'dynamic' FROM u WHERE NOT is_static ORDER BY created_at DESC, id LIMIT 20)",
    "time_travel": f"""WITH {MEMORIES}, k AS (SELECT id, created_at, CASE WHEN id % 3 <> 0 THEN root_memory_id ELSE id END AS root FROM memories WHERE created_at <= TIMESTAMP '2024-01-12 00:00:00'), l AS (SELECT arg_max(id, (created_at, id)) AS id FROM k GROUP BY root)
        SELECT vec_id AS id, round({_DOT}, 6) AS score FROM embeddings WHERE vec_id IN (SELECT id FROM l) AND round({_DOT}, 6) > 0.1 ORDER BY score DESC, id LIMIT 20""",
    "guarded_action": rf"""WITH {MEMORIES}, {NEAR}, o AS (SELECT importance, lower(coalesce(content, '')) AS l FROM near JOIN memories USING (id) WHERE id % 2 = 0 AND importance >= 8)
        SELECT CASE WHEN count(*) FILTER (importance >= 10 OR regexp_matches(l, '\bnever\b|\bdo not\b|\bdon''t\b|\bcritical\b|\bnot\b.*\ballowed\b|\bno\s+(?:purple|blue|indigo)\b')) > 0 THEN 'warn' ELSE 'allow' END AS verdict, count(*) AS rules FROM o""",
    "layer_counts": f"""WITH {BM25}, l AS (SELECT * FROM (SELECT id, 100.0::DOUBLE AS score, 0 AS source FROM active WHERE is_static ORDER BY score DESC, id LIMIT 8) UNION ALL SELECT * FROM (SELECT id, score, 1 FROM bm25 ORDER BY score DESC, id LIMIT 10)
        UNION ALL SELECT * FROM (SELECT id, 1.0::DOUBLE, 2 FROM active ORDER BY created_at DESC, id LIMIT 20)), o AS (SELECT id, min(source) AS source, arg_min(score, source) AS score FROM l GROUP BY 1 ORDER BY score DESC, id LIMIT 20) SELECT source, count(*) AS n FROM o GROUP BY 1""",
}
