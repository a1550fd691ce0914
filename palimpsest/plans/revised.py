"""Registered queries on patches of texts, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patches
from ..sources import frames


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and what they are without their articles; every eleventh is added, every thirteenth deleted."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    return frames.table(spark, sf, "documents").select(
        F.concat(F.lit("doc"), i, F.lit(".txt")).alias("path"), F.when(i % 11 != 0, text).alias("old"), F.when((i % 13 != 0) | (i % 11 == 0), F.replace(text, F.lit(" the "), F.lit(" "))).alias("new")
    )


def text_hunks(spark: SparkSession, sf: str) -> DataFrame:
    return patches.hunks(_pairs(spark, sf)).select("path", "start", "removed", "added", F.array_join("lines", "\n").alias("lines"))


def text_diffs(spark: SparkSession, sf: str) -> DataFrame:
    return patches.unified(_pairs(spark, sf))


def patched_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each document after a patch of three blocks, the second of which finds nothing."""
    parts = ("the", "THE"), ("no such words here", "x"), ("of", "")
    patch = "".join(f"{patches.SEARCH}\n {a}\n{patches.MIDDLE}\n{b}\n{patches.REPLACE}\n" for a, b in parts)
    return frames.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), patches.patch_type(F.lit(patch)).alias("type"), patches.patched(F.col("text"), F.lit(patch)).alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (text_hunks, text_diffs, patched_texts)}

_HUNKS = """WITH p AS (SELECT 'doc' || doc_id || '.txt' AS path, CASE WHEN doc_id % 11 <> 0 THEN coalesce(text, '') END AS old, CASE WHEN doc_id % 13 <> 0 OR doc_id % 11 = 0 THEN replace(coalesce(text, ''), ' the ', ' ') END AS new FROM documents),
    c AS (SELECT *, string_split(old, chr(10)) AS a, string_split(new, chr(10)) AS b FROM p WHERE old IS DISTINCT FROM new),
    l AS (SELECT path, old, new, unnest(range(greatest(coalesce(len(a), 0), coalesce(len(b), 0)))) AS place, a, b FROM c),
    x AS (SELECT path, old, new, place, place < coalesce(len(a), 0) AS has_old, place < coalesce(len(b), 0) AS has_new, a[place + 1] AS o, b[place + 1] AS n FROM l),
    d AS (SELECT *, place - row_number() OVER (PARTITION BY path ORDER BY place) AS island FROM x WHERE NOT (has_old AND has_new AND o = n)),
    h AS (SELECT path, any_value(old IS NULL) AS is_new, any_value(new IS NULL) AS is_gone, CAST(min(place) AS INTEGER) AS start, CAST(count(*) FILTER (has_old) AS INTEGER) AS removed, CAST(count(*) FILTER (has_new) AS INTEGER) AS added,
        concat_ws(chr(10), string_agg('-' || o, chr(10) ORDER BY place) FILTER (has_old), string_agg('+' || n, chr(10) ORDER BY place) FILTER (has_new)) AS lines FROM d GROUP BY path, island)"""

SQL: dict[str, str] = {
    "text_hunks": f"{_HUNKS} SELECT path, start, removed, added, lines FROM h",
    "text_diffs": f"""{_HUNKS} SELECT path, CASE WHEN any_value(is_new) THEN '--- /dev/null' ELSE '--- a/' || path END || chr(10) || CASE WHEN any_value(is_gone) THEN '+++ /dev/null' ELSE '+++ b/' || path END || chr(10)
        || string_agg(CASE WHEN is_new OR is_gone THEN '' ELSE '@@ -' || (start + 1) || ',' || removed || ' +' || (start + 1) || ',' || added || ' @@' || chr(10) END || lines, chr(10) ORDER BY start) AS diff FROM h GROUP BY path""",
    "patched_texts": """WITH a AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents), b AS (SELECT id, CASE WHEN contains(t, 'the') THEN left(t, instr(t, 'the') - 1) || 'THE' || substring(t, instr(t, 'the') + 3) ELSE t END AS t FROM a)
        SELECT id, 'diff' AS type, CASE WHEN contains(t, 'of') THEN left(t, instr(t, 'of') - 1) || substring(t, instr(t, 'of') + 2) ELSE t END AS text FROM b""",
}
