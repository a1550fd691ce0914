"""Registered queries on sources: formats, parsers, chunks, imports, with their SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import chunks, formats, frames

#: Beginnings of files.
SAMPLES = ("%PDF-1.7", "<!DOCTYPE html><p>", " <html>", "plain", '[{"uuid":"1","chat_messages":[]}]', '[{"title":"t","mapping":{}}]', '[{"role":"user","content":"x"}]', "[broken", None)
MARKDOWN = ("# One\ntext", "text only, and more of it than sixty characters so that it has to be cut", "a\n## Two  \nb", "", None)


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return frames.table(spark, sf, "part")


def _of(values: tuple, key: str):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.col(key) % len(values) + 1).cast("int"))


def detected_formats(spark: SparkSession, sf: str) -> DataFrame:
    rows = _part(spark, sf).select("p_partkey", _of(SAMPLES, "p_partkey").alias("content"), F.when(F.col("p_partkey") % 10 == 0, ".MD").alias("ext"), F.when(F.col("p_partkey") % 11 == 0, "text/csv; charset=utf-8").alias("media"))
    return rows.select("p_partkey", formats.detected(F.col("content"), F.col("ext"), F.col("media")).alias("format"))


def markdown_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf).select("p_partkey", formats.markdown_title(_of(MARKDOWN, "p_partkey")).alias("title"))


def html_texts(spark: SparkSession, sf: str) -> DataFrame:
    """How many words each page's text has, and none of its scripts."""
    text = formats.html_text(F.col("html"))
    pages = frames.table(spark, sf, "pages").select("page_id", F.explode(F.array(text)).alias("t"))
    return pages.select("page_id", F.size(F.filter(F.split("t", r"\s+"), lambda w: w != "")).cast("long").alias("words"), F.contains("t", F.lit("track(")).alias("scripted"))


def csv_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written as a line of CSV each, with a header, and read again."""
    c = frames.table(spark, sf, "customer")
    line = F.concat(F.lit('name,text,segment\nn'), F.col("c_custkey").cast("string"), F.lit(',"'), F.col("c_name"), F.lit(', ""x""",'), F.col("c_mktsegment"))
    rows = formats.csv_rows(c.select(F.col("c_custkey").alias("id"), line.alias("content")))
    return rows.select("id", "row", "title", "text", F.col("metadata")["segment"].alias("segment"))


def jsonl_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = frames.table(spark, sf, "events")
    line = F.when(F.col("event_id") % 7 == 0, "broken {").otherwise(F.to_json(F.struct(F.col("event_type").alias("body"), F.col("user_id").cast("string").alias("user"))))
    rows = formats.jsonl_rows(e.select(F.col("event_id").alias("id"), F.concat(F.lit("[1]\n"), line).alias("content")))
    return rows.select("id", "row", "title", "text", F.col("metadata")["user"].alias("user"))


def flat_chats(spark: SparkSession, sf: str) -> DataFrame:
    return formats.chat_lines(frames.table(spark, sf, "conversations"))


def tree_chats(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as trees: turn n hangs on turn (n - 1) / 2; read from the root down."""
    t = frames.table(spark, sf, "conversations")
    nodes = t.select("conv_id", F.col("turn").alias("node"), F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2)).alias("parent"), (F.col("turn") % 2).alias("nth"), "role", F.left("text", F.lit(20)).alias("text"))
    return formats.chat_tree(nodes)


def imported_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    dump = F.when(e % 3 == 0, F.format_string('{"memory":"m%d","type":"Fact","score":"7"}', e)).when(e % 3 == 1, F.format_string('{"text":"t%d","metadata":{"type":"event"},"app":"z"}', e)).otherwise(F.lit("{}"))
    rows = frames.table(spark, sf, "events").select("event_id", dump.alias("dump"))
    return rows.select("event_id", *[c.alias(k) for k, c in formats.imported(F.col("dump")).items()]).filter("content is not null")


def embedding_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks.chunked(frames.memories(spark, sf), chunks.embedding_pieces)
    return rows.select("id", "place", F.length("piece").cast("long").alias("size"))


def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks.chunked(frames.memories(spark, sf), chunks.document_pieces)
    return rows.select("id", "place", F.length("piece").cast("long").alias("size"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, name in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as archive:
                archive.writestr("a/notes.MD", f"# {name}")
                archive.writestr(".hidden.txt", "x")
                archive.writestr("__MACOSX/b.txt", "x")
                archive.writestr("inner.zip", "x")
                archive.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>{key}</w:t></w:p><w:p><w:t>{name}</w:t></w:p></w:document>')
            out.append(data.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "data"])


def _archives(spark: SparkSession, sf: str) -> DataFrame:
    return frames.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_name").mapInArrow(_packed, "id long, data binary")


def archive_entries(spark: SparkSession, sf: str) -> DataFrame:
    return formats.zip_entries(_archives(spark, sf)).filter("kind = 'markdown'").select("id", "name", F.decode("content", "utf-8").alias("content"))


def word_files(spark: SparkSession, sf: str) -> DataFrame:
    return formats.docx_texts(_archives(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (detected_formats, markdown_titles, html_texts, csv_cells, jsonl_lines, flat_chats, tree_chats, imported_rows, embedding_chunks, document_chunks, archive_entries, word_files)
}

_TRIM = r"regexp_replace(coalesce(text, ''), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"
#: Where the last match begins: the first one of the reversed pattern in the reversed window.
_LAST = lambda pattern: f"CASE WHEN regexp_matches(rev, '{pattern}') THEN length(win) - length(regexp_extract(rev, '(?s)^(.*?){pattern}', 1)) - length(regexp_extract(rev, '{pattern}')) ELSE -1 END"


def _walk(size: int, overlap: int, most: int | None, end: str) -> str:
    low = int(size * 0.3)
    return rf"""WITH RECURSIVE t AS (SELECT doc_id AS id, {_TRIM} AS t FROM documents), w AS (SELECT id, t, 0 AS k, 0::BIGINT AS begin, NULL::VARCHAR AS piece FROM t WHERE length(t) > {size}
        UNION ALL SELECT id, t, k + 1, begin + greatest(n - {overlap}, {low}), substring(t, (begin + 1)::BIGINT, n) FROM (SELECT *, CASE WHEN begin + {size} >= length(t) THEN length(t) - begin ELSE {end} END AS n FROM (
            SELECT *, {_LAST(r'\s[.!?]')} AS sentence, {_LAST(r'\s#{1,6}\n')} AS heading, {_LAST(r'\n\n')} AS paragraph, {_LAST(' ')} AS blank FROM (SELECT id, t, k, begin, substring(t, (begin + 1)::BIGINT, {size}) AS win, reverse(substring(t, (begin + 1)::BIGINT, {size})) AS rev FROM w WHERE begin < length(t){f' AND k < {most}' if most else ''}))))
        SELECT id, CAST(k - 1 AS INTEGER) AS place, length(regexp_replace(piece, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')) AS size FROM w WHERE k > 0 UNION ALL SELECT id, 0, length(t) FROM t WHERE length(t) BETWEEN 1 AND {size}"""


_L = lambda values: "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"
SQL: dict[str, str] = {
    "detected_formats": f"SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'markdown' WHEN p_partkey % 11 = 0 THEN 'csv' ELSE ['pdf', 'html', 'html', 'plaintext', 'chat_flat', 'chat_tree', 'messages', 'plaintext', 'plaintext'][(p_partkey % {len(SAMPLES)} + 1)::INT] END AS format FROM part",
    "markdown_titles": f"SELECT p_partkey, ['One', trim(left('{MARKDOWN[1]}', 60)), 'Two', '', ''][(p_partkey % 5 + 1)::INT] AS title FROM part",
    "csv_cells": """SELECT c_custkey AS id, 1 AS row, 'n' || c_custkey AS title, c_name || ', "x"' AS text, c_mktsegment AS segment FROM customer""",
    "jsonl_lines": "SELECT event_id AS id, 1 AS row, event_type AS title, event_type AS text, user_id::VARCHAR AS user FROM events WHERE event_id % 7 <> 0",
    "flat_chats": "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Human: ' ELSE 'Assistant: ' END || coalesce(text, '') AS line FROM conversations WHERE role IN ('user', 'assistant')",
    "tree_chats": """WITH RECURSIVE w AS (SELECT conv_id, turn, '000000' AS path FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, path || '/' || lpad((c.turn % 2)::VARCHAR, 6, '0') FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn > 0 AND (c.turn - 1) // 2 = w.turn)
        SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY path, turn) AS INTEGER) AS place, role, left(text, 20) AS text FROM w JOIN conversations USING (conv_id, turn) WHERE role <> 'system' AND trim(coalesce(text, '')) <> ''""",
    "imported_rows": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'm' ELSE 't' END || event_id AS content, CASE WHEN event_id % 3 = 0 THEN 'fact' ELSE 'episode' END AS category, CASE WHEN event_id % 3 = 0 THEN 7.0 ELSE 5.0 END::DOUBLE AS importance, CASE WHEN event_id % 3 = 0 THEN 'import' ELSE 'z' END AS source FROM events WHERE event_id % 3 < 2",
    "embedding_chunks": _walk(1440, 160, 6, "CASE WHEN sentence >= 1008 THEN sentence + 1 WHEN blank > 720 THEN blank ELSE 1440 END"),
    "document_chunks": _walk(3000, 200, None, "CASE WHEN heading > 1200 THEN heading WHEN paragraph > 1500 THEN paragraph WHEN sentence + 1 > 1500 THEN sentence + 1 ELSE 3000 END"),
    "archive_entries": "SELECT s_suppkey AS id, 'a/notes.MD' AS name, '# ' || s_name AS content FROM supplier",
    "word_files": "SELECT s_suppkey AS id, s_suppkey || chr(10) || chr(10) || s_name AS text FROM supplier",
    "html_texts": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[\s>].*?</script>', ' ', 'g'), '(?is)<style[\s>].*?</style>', ' ', 'g'), '(?is)<nav[\s>].*?</nav>', ' ', 'g'),
        '(?is)<footer[\s>].*?</footer>', ' ', 'g'), '(?is)<header[\s>].*?</header>', ' ', 'g'), '(?is)<aside[\s>].*?</aside>', ' ', 'g'), '(?is)<!--.*?-->', ' ', 'g') AS t FROM pages),
        b AS (SELECT page_id, regexp_replace(t, '(?s)<[^>]+>', ' ', 'g') AS t FROM a), c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b)
        SELECT page_id, len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')) AS words, contains(t, 'track(') AS scripted FROM c""",
}
