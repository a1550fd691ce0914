"""Registered queries on near copies and on states that evolve, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reviews, scores
from ..functions.scores import FACTOR, FSRS
from ..operators import relational, similar, states
from ..sources import frames
from .sql import MEMORIES, _R

AS_OF = "2025-06-01 00:00:00"
SHIFT = 1_000_000
GRADES = "[3, 4, 2, 3, 1, 3, 3]"


def _prints(spark: SparkSession, sf: str) -> DataFrame:
    return similar.simhash(frames.memories(spark, sf))


def simhashes(spark: SparkSession, sf: str) -> DataFrame:
    return _prints(spark, sf).select("id", similar.as_hex(F.col("simhash")).alias("simhash"))


def simhash_classes(spark: SparkSession, sf: str) -> DataFrame:
    return similar.simhash_classes(_prints(spark, sf))


def near_simhashes(spark: SparkSession, sf: str) -> DataFrame:
    return similar.near_simhashes(_prints(spark, sf))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors, and of every third a copy with a little of its neighbour's mixed in."""
    own = frames.vectors(spark, sf)
    other = own.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("near"))
    mixed = F.zip_with("embedding", "near", lambda x, y: x.cast("double") + 0.3 * y.cast("double"))
    both = own.filter("id % 3 = 0").join(other, "id").select((F.col("id") + SHIFT).alias("id"), mixed.alias("v"))
    norm = F.sqrt(scores.dot(F.col("v"), F.col("v")))
    return own.select("id", F.col("embedding").cast("array<double>").alias("embedding")).unionByName(both.select("id", F.transform("v", lambda x: x / norm).alias("embedding")))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similar.near_vectors(_vectors(spark, sf), 0.9)


def similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("a", "b", F.round("similarity", 6).alias("similarity"))


def contradiction_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Alike, but not the same: similarity from 0.9 up to 0.955."""
    return _pairs(spark, sf).filter("similarity < 0.955").select("a", "b")


def auto_links(spark: SparkSession, sf: str) -> DataFrame:
    return similar.strongest_pairs(_pairs(spark, sf), 6).select("source_id", "target_id", F.round("similarity", 6).alias("similarity"))


def duplicate_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return similar.duplicate_clusters(_pairs(spark, sf))


def _sourced(spark: SparkSession, sf: str) -> DataFrame:
    """How many sources each vector's row has."""
    return _vectors(spark, sf).select("id", (F.col("id") % 4 + 1).alias("source_count"))


def merged_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """What a merge leaves: anchors with their sources and those beyond the first of each row that they claim, which are archived."""
    return similar.merged(similar.duplicate_clusters(_pairs(spark, sf)), _sourced(spark, sf))


def merge_links(spark: SparkSession, sf: str) -> DataFrame:
    """The links from anchors to the rows that they claim."""
    pairs = _pairs(spark, sf)
    return similar.merge_links(similar.duplicate_clusters(pairs), pairs).withColumn("similarity", F.round("similarity", 6))


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    grade = F.element_at(F.array(*[F.lit(g) for g in (3, 4, 2, 3, 1, 3, 3)]), (F.col("event_id") % 7 + 1).cast("int"))
    return frames.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), grade.alias("grade"))


def review_states(spark: SparkSession, sf: str) -> DataFrame:
    return states.review_states(_reviews(spark, sf))


def review_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """The formulas on a grid of grades, difficulties, stabilities and days."""
    p, op = F.col("p_partkey"), reviews.COLUMNS
    g, d, s, days = (p % 4 + 1).cast("int"), (p % 10 + 1).cast("double"), (p % 30 + 1) / 2.0, (p % 50).cast("double")
    r = reviews.retrievability(s, days, op)
    columns = {"d0": reviews.first_difficulty(g, op), "s0": reviews.first_stability(g, op), "r": r, "d1": reviews.next_difficulty(d, g, op), "lapse": reviews.forget_stability(d, s, r, op), "recall": reviews.recall_stability(d, s, r, g, op),
               "same_day": reviews.same_day_stability(s, g, op), "strength": reviews.retrieval_strength(days, s, op), "kept": reviews.retention(d, r)}
    return frames.table(spark, sf, "part").select("p_partkey", *[F.round(c, 6).alias(k) for k, c in columns.items()])


def decay_estimates(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames.memories(spark, sf).withColumn("fsrs_stability", F.when(F.col("id") % 2 == 0, F.col("fsrs_stability")))
    return states.decay_estimate(rows, AS_OF)


def promotions(spark: SparkSession, sf: str) -> DataFrame:
    return states.promoted(frames.active(frames.memories(spark, sf))).select("id")


def feedback_importance(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("helpful", "irrelevant", "used", "ignored")])
    signals = frames.table(spark, sf, "events").select((F.col("event_id") % 97).alias("id"), F.col("event_id").alias("at"), F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")).alias("signal"))
    return states.with_feedback(frames.memories(spark, sf), signals)


def reconsolidated(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames.memories(spark, sf).withColumns({"recall_hits": F.col("id") % 7, "recall_misses": F.col("id") % 5})
    return states.reconsolidated(rows, relational.document_links(rows).filter(F.col("type").isin("contradicts", "updates")))


def edited_versions(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames.memories(spark, sf).select("id", "version", F.left("content", F.lit(20)).alias("content"))
    edits = frames.table(spark, sf, "events").filter("event_type = 'click'").select((F.col("event_id") % 211).alias("id"), F.col("event_id").alias("place"), F.concat(F.lit("edit "), F.col("event_id").cast("string")).alias("content"))
    return states.new_versions(rows, edits)


def commanded_rows(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("forget", "archive", "unarchive", "approve", "reject", "delete")])
    log = frames.table(spark, sf, "events").select((F.col("event_id") % 301).alias("id"), F.col("event_id").alias("at"), F.element_at(kinds, (F.col("event_id") * 7 % 6 + 1).cast("int")).alias("command"))
    return states.commanded(frames.memories(spark, sf).withColumn("status", F.lit("pending")), log)


def store_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    quotas = spark.createDataFrame([(1, 100), (2, 10)], "user_id long, quota long")
    return states.stored(frames.memories(spark, sf).select("id", "user_id", "content"), quotas, 10_000)


def causal_chains(spark: SparkSession, sf: str) -> DataFrame:
    return states.chained(frames.table(spark, sf, "events"), "user_id", "ts", 24)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        simhashes, simhash_classes, near_simhashes, similar_pairs, contradiction_pairs, auto_links, duplicate_clusters, merged_duplicates, merge_links, review_states, review_formulas, decay_estimates, promotions, feedback_importance,
        reconsolidated, edited_versions, commanded_rows, store_verdicts, causal_chains,
    )
}

_MASK = (1 << 32) - 1
_HASH = f"list_reduce({{0}}, lambda h, c: CAST(CAST(CASE WHEN xor(h, c) >= {1 << 31} THEN xor(h, c) - {1 << 32} ELSE xor(h, c) END AS DOUBLE) * {similar.FACTOR}::DOUBLE AS BIGINT) & {_MASK})"
_CODES = f"list_prepend({similar.START}::BIGINT, list_transform(string_split(w, ''), lambda c: ascii(c)::BIGINT))"
_SUMS = ", ".join(f"sum(2 * (({'low' if i < 32 else 'high'} >> {i % 32}) & 1) - 1) AS b{i}" for i in range(64))
_BITS = " + ".join(f"CASE WHEN b{i} > 0 THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(64))
_PRINTS = rf"""t AS (SELECT id, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(content, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: length(w) >= 3))) AS w FROM memories),
    words AS (SELECT DISTINCT w FROM t), codes AS (SELECT w, {_CODES} AS c FROM words), hashed AS (SELECT w, {_HASH.format('c')} AS low, {_HASH.format('list_append(c, 0::BIGINT)')} AS high FROM codes),
    sums AS (SELECT id, {_SUMS} FROM t JOIN hashed USING (w) GROUP BY 1), prints AS MATERIALIZED (SELECT m.id, coalesce({_BITS}, 0)::UHUGEINT::UBIGINT AS bits FROM memories m LEFT JOIN sums s ON s.id = m.id)"""
_COPIES = f"""v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT a.id + {SHIFT} AS id, list_transform(list_zip(a.v, b.v), lambda p: p[1] + 0.3::DOUBLE * p[2]) AS v FROM v a JOIN v b ON b.id = a.id + 1 WHERE a.id % 3 = 0),
    every AS MATERIALIZED (SELECT * FROM v UNION ALL SELECT id, list_transform(v, lambda y: y / sqrt(list_inner_product(v, v))) FROM x),
    pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_inner_product(a.v, b.v) AS s FROM every a JOIN every b ON a.id < b.id WHERE list_inner_product(a.v, b.v) >= 0.9)"""
#: Rows in order of ids: one is an anchor if none of its smaller neighbours is, and else goes to the least of these anchors.
_GREEDY = """linked AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS k, list(below) FILTER (below IS NOT NULL) AS below FROM (SELECT b AS id, a AS below FROM pairs UNION ALL SELECT a, NULL FROM pairs) GROUP BY id),
    walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS anchors UNION ALL SELECT l.k, CASE WHEN list_has_any(coalesce(below, []::BIGINT[]), anchors) THEN anchors ELSE list_append(anchors, l.id) END FROM walk JOIN linked l ON l.k = walk.k + 1),
    chosen AS (SELECT anchors FROM walk ORDER BY k DESC LIMIT 1), claimed AS (SELECT id, CASE WHEN list_contains(anchors, id) THEN id ELSE list_min(list_intersect(below, anchors)) END AS anchor FROM linked, chosen)"""
_W = [f"{w!r}::DOUBLE" for w in FSRS]
_S0 = f"greatest(0.1::DOUBLE, CASE g WHEN 1 THEN {_W[0]} WHEN 2 THEN {_W[1]} WHEN 3 THEN {_W[2]} ELSE {_W[3]} END)"
_D0 = f"greatest(1.0::DOUBLE, least(10.0::DOUBLE, {_W[4]} - exp({_W[5]} * (g - 1)) + 1))"
_EASY = f"greatest(1.0::DOUBLE, least(10.0::DOUBLE, {_W[4]} - exp({_W[5]} * 3) + 1))"
_D1 = f"greatest(1.0::DOUBLE, least(10.0::DOUBLE, {_W[7]} * {_EASY} + (1 - {_W[7]}) * (d - {_W[6]} * (g - 3) * ((10 - d) / 9))))"
_RET = f"CASE WHEN days <= 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, pow(1 + {FACTOR!r}::DOUBLE * days / s, -{_W[20]}))) END"
_LAPSE = f"greatest(0.1::DOUBLE, least(least({_W[11]} * pow(d, -{_W[12]}) * (pow(s + 1, {_W[13]}) - 1) * exp({_W[14]} * (1 - r)), s), 36500.0::DOUBLE))"
_RECALL = f"greatest(0.1::DOUBLE, least(36500.0::DOUBLE, s * (exp({_W[8]}) * (11 - d) * pow(s, -{_W[9]}) * (exp({_W[10]} * (1 - r)) - 1) * CASE WHEN g = 2 THEN {_W[15]} ELSE 1.0 END * CASE WHEN g = 4 THEN {_W[16]} ELSE 1.0 END + 1)))"
_SAME = f"greatest(0.1::DOUBLE, least(36500.0::DOUBLE, s * exp({_W[17]} * (g - 3 + {_W[18]})) * pow(s, -{_W[19]})))"
_K = "floor(({0}) * 1000 + 0.5) / 1000"

SQL: dict[str, str] = {
    "simhashes": f"WITH {MEMORIES}, {_PRINTS} SELECT id, reverse(lpad(lower(printf('%x', bits)), 16, '0')) AS simhash FROM prints",
    "simhash_classes": f"WITH {MEMORIES}, {_PRINTS} SELECT id, min(id) OVER (PARTITION BY bits) AS first FROM prints",
    "near_simhashes": f"WITH {MEMORIES}, {_PRINTS}, one AS MATERIALIZED (SELECT bits, min(id) AS id FROM prints GROUP BY 1) SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.bits, y.bits)) AS INTEGER) AS distance FROM one x JOIN one y ON x.id < y.id WHERE bit_count(xor(x.bits, y.bits)) <= 3",
    "similar_pairs": f"WITH {_COPIES} SELECT a, b, round(s, 6) AS similarity FROM pairs",
    "contradiction_pairs": f"WITH {_COPIES} SELECT a, b FROM pairs WHERE s < 0.955",
    "auto_links": f"""WITH {_COPIES}, l AS (SELECT a AS source_id, b AS target_id, s FROM pairs UNION ALL SELECT b, a, s FROM pairs)
        SELECT source_id, target_id, round(s, 6) AS similarity FROM l QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY s DESC, target_id) <= 6""",
    "duplicate_clusters": f"WITH RECURSIVE {_COPIES}, {_GREEDY} SELECT id, anchor FROM claimed",
    "merged_duplicates": f"WITH RECURSIVE {_COPIES}, {_GREEDY} SELECT anchor, CAST(anchor % 4 + 1 + sum(CASE WHEN id <> anchor THEN id % 4 ELSE 0 END) AS BIGINT) AS source_count, count(*) - 1 AS archived FROM claimed GROUP BY anchor HAVING count(*) > 1",
    "merge_links": f"WITH RECURSIVE {_COPIES}, {_GREEDY} SELECT anchor AS source_id, id AS target_id, round(s, 6) AS similarity, 'derives' AS type FROM claimed JOIN pairs ON a = anchor AND b = id",
    "review_states": f"""WITH RECURSIVE o AS MATERIALIZED (SELECT user_id AS id, epoch_us(ts) AS t, {GRADES}[(event_id % 7 + 1)::INT] AS g, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), {GRADES}[(event_id % 7 + 1)::INT]) AS k FROM events),
        w AS (SELECT id, k, t, {_S0} AS s, {_D0} AS d, 1.0::DOUBLE AS storage, CASE WHEN g <= 2 THEN 1 ELSE 2 END AS learning, 1 AS reps, CASE WHEN g = 1 THEN 1 ELSE 0 END AS lapses FROM o WHERE k = 1
        UNION ALL SELECT id, k, t, {_K.format(f'CASE WHEN days < 1 THEN {_SAME} WHEN g = 1 THEN {_LAPSE} ELSE {_RECALL} END')}, {_K.format(_D1)}, {_K.format('least(storage + CASE WHEN days >= 1 AND g = 1 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END, 10.0)')},
            CASE WHEN days < 1 THEN learning WHEN g = 1 THEN 3 ELSE 2 END, reps + 1, lapses + CASE WHEN days >= 1 AND g = 1 THEN 1 ELSE 0 END
            FROM (SELECT *, {_RET} AS r FROM (SELECT o.id, o.k, o.t, o.g, (o.t - w.t) / 86400000000.0::DOUBLE AS days, s, d, storage, learning, reps, lapses FROM w JOIN o ON o.id = w.id AND o.k = w.k + 1)))
        SELECT id, s AS stability, d AS difficulty, storage, 1.0::DOUBLE AS retrieval, CAST(learning AS INTEGER) AS learning, CAST(reps AS INTEGER) AS reps, CAST(lapses AS INTEGER) AS lapses FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1""",
    "review_formulas": f"""WITH p AS (SELECT p_partkey, p_partkey % 4 + 1 AS g, (p_partkey % 10 + 1)::DOUBLE AS d, (p_partkey % 30 + 1) / 2.0::DOUBLE AS s, (p_partkey % 50)::DOUBLE AS days FROM part), q AS (SELECT *, {_RET} AS r FROM p)
        SELECT p_partkey, round({_D0}, 6) AS d0, round({_S0}, 6) AS s0, round(r, 6) AS r, round({_D1}, 6) AS d1, round({_LAPSE}, 6) AS lapse, round({_RECALL}, 6) AS recall, round({_SAME}, 6) AS same_day,
        round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, pow(1 + days / (9.0::DOUBLE * s), -2.0::DOUBLE))), 6) AS strength, round(r * 0.7::DOUBLE + d / 10.0::DOUBLE * 0.3::DOUBLE, 6) AS kept FROM q""",
    "decay_estimates": f"""WITH {MEMORIES}, k AS (SELECT id, importance, is_static, created_at, CASE WHEN id % 2 = 0 THEN fsrs_stability ELSE {_W[2]} * (1 + least(access_count * 0.3::DOUBLE, 3.0::DOUBLE) + least((id % 4) * 0.2::DOUBLE, 1.0::DOUBLE)) END AS fsrs_stability FROM memories)
        SELECT id, round(CASE WHEN is_static THEN importance::DOUBLE ELSE importance * ({_R.format(AS_OF)}) END, 6) AS decay FROM k""",
    "promotions": f"WITH {MEMORIES} SELECT id FROM active WHERE NOT is_static AND access_count >= 8 AND id % 4 + 1 >= 3 AND fsrs_stability >= 5",
    "feedback_importance": f"""WITH RECURSIVE {MEMORIES}, o AS MATERIALIZED (SELECT event_id % 97 AS id, event_id % 4 AS g, row_number() OVER (PARTITION BY event_id % 97 ORDER BY event_id) AS k FROM events WHERE event_id % 4 IN (0, 1)),
        w AS (SELECT id, 0 AS k, importance::DOUBLE AS i FROM memories UNION ALL
            SELECT w.id, o.k, CASE WHEN g = 0 THEN least(i + 0.5::DOUBLE, 10.0::DOUBLE) ELSE greatest(i - 0.3::DOUBLE, 0.0::DOUBLE) END FROM w JOIN o ON o.id = w.id AND o.k = w.k + 1)
        SELECT id, round(arg_max(i, k), 6) AS importance FROM w GROUP BY id""",
    "reconsolidated": f"""WITH {MEMORIES}, n AS (SELECT id * 2 + 1 AS id, count(*) AS n FROM memories WHERE id % 3 IN (1, 2) GROUP BY 1), k AS (SELECT m.id, importance, coalesce(n, 0) AS n, CASE WHEN m.id % 7 + m.id % 5 > 3 THEN (m.id % 7) / (m.id % 7 + m.id % 5)::DOUBLE END AS rate FROM memories m LEFT JOIN n ON n.id = m.id),
        b AS (SELECT id, rate, greatest(1.0::DOUBLE, importance - 2.0::DOUBLE * n) AS i, CASE WHEN n > 0 THEN greatest(0.1::DOUBLE, pow(0.5::DOUBLE, n)) ELSE 1.0::DOUBLE END AS c FROM k)
        SELECT id, CASE WHEN rate > 0.7 THEN least(10.0::DOUBLE, i + 1) WHEN rate < 0.3 THEN greatest(1.0::DOUBLE, i - 1) ELSE i END AS importance, round(CASE WHEN rate > 0.7 THEN least(1.0::DOUBLE, c + 0.1::DOUBLE) ELSE c END, 6) AS confidence FROM b""",
    "edited_versions": f"""WITH {MEMORIES}, e AS (SELECT event_id % 211 AS id, event_id, row_number() OVER (PARTITION BY event_id % 211 ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_id % 211) AS n FROM events WHERE event_type = 'click')
        SELECT id, version, id NOT IN (SELECT id FROM e) AS is_latest, left(content, 20) AS content FROM memories UNION ALL SELECT id, version + k, k = n, 'edit ' || event_id FROM e JOIN memories USING (id)""",
    "commanded_rows": f"""WITH {MEMORIES}, l AS (SELECT event_id % 301 AS id, event_id AS k, ['forget', 'archive', 'unarchive', 'approve', 'reject', 'delete'][(event_id * 7 % 6 + 1)::INT] AS c FROM events),
        c AS (SELECT id, bool_or(c = 'forget') AS forgets, bool_or(c = 'delete') AS deletes, arg_max(c, k) FILTER (c IN ('archive', 'unarchive', 'reject')) AS place, arg_max(c, k) FILTER (c IN ('approve', 'reject')) AS verdict FROM l GROUP BY 1)
        SELECT id, is_forgotten OR coalesce(forgets, false) AS is_forgotten, CASE WHEN place IN ('archive', 'reject') THEN true WHEN place = 'unarchive' THEN false ELSE is_archived END AS is_archived,
            CASE verdict WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS status FROM memories LEFT JOIN c USING (id) WHERE NOT coalesce(deletes, false)""",
    "store_verdicts": f"""WITH {MEMORIES}, v AS (SELECT id, user_id, trim(coalesce(content, '')) AS t, CASE WHEN trim(coalesce(content, '')) = '' THEN 'empty' WHEN length(content) > 10000 THEN 'too_large' END AS verdict FROM memories),
        f AS (SELECT id, user_id, row_number() OVER (PARTITION BY user_id, t ORDER BY id) AS copy FROM v WHERE verdict IS NULL), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id) AS k FROM f WHERE copy = 1)
        SELECT verdict, count(*) AS n FROM v WHERE verdict IS NOT NULL GROUP BY 1 UNION ALL SELECT 'repeat', count(*) FILTER (copy > 1) FROM f
        UNION ALL SELECT 'over_quota', count(*) FILTER (k > CASE user_id WHEN 1 THEN 100 WHEN 2 THEN 10 ELSE 1e18 END) FROM o UNION ALL SELECT 'stored', count(*) FILTER (k <= CASE user_id WHEN 1 THEN 100 WHEN 2 THEN 10 ELSE 1e18 END) FROM o""",
    "causal_chains": """WITH o AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS gap FROM events), c AS (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS chain FROM o)
        SELECT user_id, CAST(chain AS BIGINT) AS chain, count(*) AS n, min(ts) AS started_at FROM c GROUP BY 1, 2""",
}
