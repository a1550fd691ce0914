"""Registered queries on the inverted index and the vector index, with their SQL, which stems, counts and compares by itself."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stems
from ..operators import centroids, graph, hybrid, postings, relational
from ..sources import frames
from .sql import MEMORIES, _R

AS_OF, USER, LIMIT = "2025-06-01 00:00:00", 2, 10
WHY = "Why does the orantion thatin the ononst?"
QUERY, RARE, K = "Orantions, THATIN and the règles of ononst!", "orantion hehely reings", 20

_KNOWN: dict[tuple[str, str], postings.TextIndex] = {}
_VECTORS: dict[tuple[str, str], centroids.VectorIndex] = {}


def index_of(spark: SparkSession, sf: str) -> postings.TextIndex:
    """The index over content, category and source of the memories under ``sf``: built with the session's first query, kept for the others."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _KNOWN:
        index = postings.TextIndex(spark, f"{graph.shared_dir(spark)}/index-{uuid.uuid4().hex}")
        _KNOWN[key] = index.add(frames.memories(spark, sf), F.concat_ws(" ", "content", "category", "source"))
    return _KNOWN[key]


def vectors_of(spark: SparkSession, sf: str) -> centroids.VectorIndex:
    """The vector index over all embeddings under ``sf``, kept likewise."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _VECTORS:
        index = centroids.VectorIndex(spark, f"{graph.shared_dir(spark)}/vectors-{uuid.uuid4().hex}")
        _VECTORS[key] = index.build(frames.vectors(spark, sf), keep=["category"])
    return _VECTORS[key]


def rows_with_vectors_of(spark: SparkSession, sf: str) -> centroids.VectorIndex:
    """The vector index over memories, with what a search filters by."""
    key = (spark.sparkContext.applicationId, sf, "memories")
    if key not in _VECTORS:
        rows = frames.memories(spark, sf).join(frames.vectors(spark, sf).select("id", "embedding"), "id")
        _VECTORS[key] = centroids.VectorIndex(spark, f"{graph.shared_dir(spark)}/vectors-{uuid.uuid4().hex}").build(rows, keep=["user_id", "is_forgotten", "is_archived", "is_latest"])
    return _VECTORS[key]


def full_search(spark: SparkSession, sf: str) -> DataFrame:
    """A question of one user over words and vectors, with its type's strategy, boosts, expansion, links and versions."""
    rows = frames.memories(spark, sf).withColumn("pagerank", (F.col("id") % 8) / 8.0)
    links = relational.document_links(rows).withColumn("similarity", (F.col("source_id") % 50 + 50) / 100.0)
    return hybrid.search(index_of(spark, sf), rows_with_vectors_of(spark, sf), rows, links, WHY, _query_vector(spark, sf, 1), USER, LIMIT, AS_OF)


def _query_vector(spark: SparkSession, sf: str, row: int) -> list[float]:
    return [float(x) for x in frames.vectors(spark, sf).filter(F.col("id") == row).first().embedding]


def vector_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """Exact, by bounds."""
    return vectors_of(spark, sf).search(_query_vector(spark, sf, 7), K)


def vector_index_category(spark: SparkSession, sf: str) -> DataFrame:
    """Exact, of the rows of one category."""
    return vectors_of(spark, sf).search(_query_vector(spark, sf, 11), K, where=F.col("category") == 3)


def vector_index_many(spark: SparkSession, sf: str) -> DataFrame:
    """Each hundredth row's ten nearest of the lists that it probes; tests hold its recall against all pairs."""
    return vectors_of(spark, sf).search_many(frames.vectors(spark, sf).filter("id % 100 = 0"), 10)


def index_search(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf).search(QUERY, K)


def index_tenant_search(spark: SparkSession, sf: str) -> DataFrame:
    """Of one user's active rows only; statistics are those of the whole index."""
    return index_of(spark, sf).search(RARE, K, frames.active(frames.memories(spark, sf)).filter("user_id = 2"))


def index_terms(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf).dictionary()


def stemmed_words(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the documents, and its stem."""
    words = frames.table(spark, sf, "documents").select(F.explode(postings.folded_words(F.col("text"))).alias("word")).distinct()
    return words.select("word", F.element_at(stems.stems(F.array("word")), 1).alias("stem"))


def _stem_steps() -> str:
    """CTEs from vocabulary (word) to stemmed (word, term): the suffix rules, one after another."""
    some, one, more, vowel, short = (p.replace("'", "''") for p in (stems._SOME, stems._ONE, stems._MORE, stems._VOWEL, stems._SHORT))
    twice = "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx")

    def replaced(table: dict[str, str], w: str) -> str:
        pattern = f"^(.*?)({'|'.join(sorted(table, key=len, reverse=True))})$"
        new = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
        return f"CASE WHEN regexp_matches(regexp_extract({w}, '{pattern}', 1), '{some}') THEN regexp_extract({w}, '{pattern}', 1) || CASE regexp_extract({w}, '{pattern}', 2) {new} END ELSE {w} END"

    fourth = f"^(.*?)({'|'.join(sorted(stems.FOURTH, key=len, reverse=True))})$"
    left = "regexp_replace(a, '(ed|ing)$', '')"
    return rf"""p1 AS (SELECT word, regexp_replace(regexp_replace(word, '(ss|i)es$', '\1'), '([^s])s$', '\1') AS a FROM vocabulary WHERE regexp_matches(word, '^[a-z]{{3,64}}$')),
    p2 AS (SELECT word, CASE WHEN regexp_matches(a, 'eed$') THEN CASE WHEN regexp_matches(regexp_replace(a, 'eed$', ''), '{some}') THEN regexp_replace(a, 'd$', '') ELSE a END
        WHEN regexp_matches(a, '(ed|ing)$') AND regexp_matches({left}, '{vowel}') THEN CASE WHEN regexp_matches({left}, '(at|bl|iz)$') THEN {left} || 'e'
            WHEN regexp_matches({left}, '({twice})$') THEN regexp_replace({left}, '.$', '') WHEN regexp_matches({left}, '{short}') THEN {left} || 'e' ELSE {left} END ELSE a END AS a FROM p1),
    p3 AS (SELECT word, CASE WHEN regexp_matches(a, 'y$') AND regexp_matches(regexp_replace(a, 'y$', ''), '{vowel}') THEN regexp_replace(a, 'y$', 'i') ELSE a END AS a FROM p2),
    p4 AS (SELECT word, {replaced(stems.SECOND, "a")} AS a FROM p3), p5 AS (SELECT word, {replaced(stems.THIRD, "a")} AS a FROM p4),
    p6 AS (SELECT word, CASE WHEN regexp_extract(a, '{fourth}', 1) <> '' THEN CASE WHEN regexp_matches(regexp_extract(a, '{fourth}', 1), '{more}') THEN regexp_extract(a, '{fourth}', 1) ELSE a END
        WHEN regexp_matches(regexp_extract(a, '^(.*[st])ion$', 1), '{more}') THEN regexp_extract(a, '^(.*[st])ion$', 1) ELSE a END AS a FROM p5),
    p7 AS (SELECT word, CASE WHEN regexp_matches(a, 'e$') AND (regexp_matches(regexp_replace(a, 'e$', ''), '{more}') OR regexp_matches(regexp_replace(a, 'e$', ''), '{one}') AND NOT regexp_matches(regexp_replace(a, 'e$', ''), '{short}'))
        THEN regexp_replace(a, 'e$', '') ELSE a END AS a FROM p6),
    stemmed AS (SELECT word, CASE WHEN regexp_matches(a, 'll$') AND regexp_matches(a, '{more}') THEN regexp_replace(a, 'l$', '') ELSE a END AS term FROM p7
        UNION ALL SELECT word, word FROM vocabulary WHERE NOT regexp_matches(word, '^[a-z]{{3,64}}$'))"""


STEM_STEPS = _stem_steps()
_WORDS = lambda text: rf"regexp_extract_all(strip_accents(lower({text})), '[\p{{L}}\p{{N}}]+')"


def _counted(query: str) -> str:
    """CTEs up to counts (id, term, tf); asked has the words of the query."""
    return f"""WITH {MEMORIES}, texts AS (SELECT id, unnest({_WORDS("concat_ws(' ', content, category, source)")}) AS word FROM memories),
        asked AS (SELECT unnest({_WORDS(f"'{query}'")}) AS word), vocabulary AS (SELECT word FROM texts UNION SELECT word FROM asked), {STEM_STEPS},
        counts AS (SELECT id, term, count(*) AS tf FROM texts JOIN stemmed USING (word) GROUP BY ALL)"""


def _search(query: str, where: str = "", most: int = 20) -> str:
    return f"""{_counted(query)}, sizes AS (SELECT id, count(*) AS length FROM texts GROUP BY id),
        stats AS (SELECT count(*) AS n, (SELECT count(*) FROM texts) / count(*)::DOUBLE AS mean FROM memories),
        dfs AS (SELECT term, count(*) AS df FROM counts WHERE term IN (SELECT term FROM asked JOIN stemmed USING (word)) GROUP BY term)
        SELECT id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score
        FROM counts JOIN dfs USING (term) JOIN sizes USING (id), stats {where} GROUP BY id ORDER BY score DESC, id LIMIT {most}"""


_NEAREST = """SELECT e.vec_id AS id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {0}) q WHERE len(e.embedding) = len(q.embedding) {1} ORDER BY score DESC, id LIMIT 20"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (index_search, index_tenant_search, index_terms, stemmed_words, vector_index_search, vector_index_category, vector_index_many, full_search)}

#: By hand for a reasoning question: floor 0.1, 40 candidates, 50 word hits, 200 vectors, 5 seeds with 8 links each, 2 rows of a second hop, weights times 1.2.
_FULL = f"""WITH words AS ({_search(WHY, f"WHERE id IN (SELECT id FROM active WHERE user_id = {USER})", 50)}), {MEMORIES},
    near AS (SELECT * FROM (SELECT e.vec_id AS id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e JOIN active a ON a.id = e.vec_id AND a.user_id = {USER}, (SELECT embedding FROM embeddings WHERE vec_id = 1) q
        WHERE len(e.embedding) = len(q.embedding) ORDER BY score DESC, id LIMIT 200) WHERE score > 0.1),
    ranks AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM near UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM words),
    fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM ranks GROUP BY id),
    own AS MATERIALIZED (SELECT *, id % 4 + 1 AS source_count FROM memories WHERE user_id = {USER}),
    boosted AS (SELECT id, f.score * CASE WHEN is_static THEN 1.0::DOUBLE ELSE 0.3::DOUBLE + 0.7::DOUBLE * ({_R.format(AS_OF)}) END * (1 + least(source_count / 10.0::DOUBLE, 1.0::DOUBLE) * 0.05::DOUBLE) * CASE WHEN is_static THEN 1.03::DOUBLE ELSE 1.0::DOUBLE END
        * pow(1 + 0.15::DOUBLE * (id % 8) / 8.0::DOUBLE, 2) * CASE WHEN NOT is_latest AND regexp_matches(lower(coalesce(content, '')), 'no longer|changed to|used to|instead now|but now|previously|was replaced|switched from') THEN 0.65::DOUBLE ELSE 1.0::DOUBLE END AS score FROM fused f JOIN own USING (id)),
    links AS MATERIALIZED (SELECT s.id AS source_id, t.id AS target_id, (s.id % 50 + 50) / 100.0::DOUBLE AS similarity, [1.0, 1.3, 1.5][(s.id % 3 + 1)::INT]::DOUBLE AS weight, s.is_forgotten AS gone FROM own s JOIN own t ON t.id = s.id * 2 + 1 WHERE NOT t.is_forgotten),
    strength AS (SELECT source_id, target_id, similarity * weight * 1.2::DOUBLE AS raw FROM links WHERE NOT gone), seeds AS (SELECT id FROM boosted ORDER BY score DESC, id LIMIT 5),
    one AS (SELECT target_id AS id, raw FROM strength WHERE source_id IN (SELECT id FROM seeds)), new AS (SELECT id, max(raw) AS raw FROM one WHERE id NOT IN (SELECT id FROM boosted) GROUP BY 1 ORDER BY raw DESC, id LIMIT 2),
    two AS (SELECT target_id AS id, raw * 0.5::DOUBLE AS raw FROM strength WHERE source_id IN (SELECT id FROM new)), hits AS (SELECT id, row_number() OVER (ORDER BY raw DESC, id) AS n FROM (SELECT * FROM one UNION ALL SELECT * FROM two)),
    g AS (SELECT id, sum(1.0::DOUBLE / (60 + n)) AS gain FROM hits GROUP BY 1),
    best AS (SELECT coalesce(b.id, g.id) AS id, round(coalesce(score, 0) + coalesce(gain, 0), 7) AS score FROM boosted b FULL JOIN g ON g.id = b.id ORDER BY score DESC, id LIMIT {LIMIT}),
    l AS (SELECT source_id AS id, string_agg(target_id || ':' || similarity, '|' ORDER BY similarity DESC, target_id) AS links FROM links GROUP BY 1), c AS (SELECT root_memory_id, string_agg(version || ':' || id, '|' ORDER BY version, id) AS chain FROM own GROUP BY 1)
    SELECT b.id, b.score, category, importance, version, coalesce(links, '') AS links, coalesce(chain, '') AS chain FROM best b JOIN own o ON o.id = b.id LEFT JOIN l ON l.id = b.id LEFT JOIN c ON c.root_memory_id = o.root_memory_id"""

SQL: dict[str, str] = {
    "full_search": _FULL,
    "vector_index_search": _NEAREST.format(7, ""),
    "vector_index_category": _NEAREST.format(11, "AND e.label = 3"),
    "index_search": _search(QUERY),
    "index_tenant_search": _search(RARE, "WHERE id IN (SELECT id FROM active WHERE user_id = 2)"),
    "index_terms": _counted("") + " SELECT term, count(*) AS df FROM counts GROUP BY term",
    "stemmed_words": f"WITH vocabulary AS (SELECT DISTINCT unnest({_WORDS('text')}) AS word FROM documents), {STEM_STEPS} SELECT word, term AS stem FROM stemmed",
}
