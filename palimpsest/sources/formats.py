"""Formats: what a file is, and its title, text and metadata, as column expressions; archives as generators over Arrow batches.

Bad lines and rows give nothing; a null text is empty.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import cut

#: Formats by extension, and by media type.
EXTENSIONS = {".md": "markdown", ".txt": "plaintext", ".text": "plaintext", ".html": "html", ".htm": "html", ".pdf": "pdf", ".docx": "docx", ".csv": "csv", ".jsonl": "jsonl", ".zip": "zip"}
MEDIA = {"text/html": "html", "application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "text/csv": "csv", "application/zip": "zip", "application/x-zip-compressed": "zip", "text/plain": "plaintext"}
#: Columns and fields that hold a text or a title, in the order in which they are tried.
TEXTS, TITLES = ("content", "text", "body", "message"), ("title", "name")
#: Categories of foreign types.
CATEGORIES = {"fact": "fact", "preference": "preference", "task": "task", "event": "episode", "note": "general"}
MOST_ENTRY = 10 << 20


def detected(content: Column, extension: Column, media: Column) -> Column:
    """The format: by extension, by media type, by the first bytes, by how the text begins, else plaintext."""
    lookup = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    t = F.ltrim(F.coalesce(content, F.lit("")))
    first = F.try_element_at(F.from_json(F.when(F.startswith(t, F.lit("[")), t), "array<map<string,string>>"), F.lit(1))
    has = lambda *keys: reduce(lambda a, b: a & b, [F.array_contains(F.map_keys(first), k) for k in keys])
    sniffed = F.when(F.startswith(t, F.lit("%PDF")), "pdf").when(F.startswith(t, F.lit("PK\x03\x04")), "zip").when(t.rlike(r"(?i)^<!doctype\s+html|^<html[\s>]"), "html")
    sniffed = sniffed.when(has("uuid", "chat_messages"), "chat_flat").when(has("title", "mapping"), "chat_tree").when(has("role", "content"), "messages").otherwise("plaintext")
    return F.coalesce(lookup(EXTENSIONS, F.lower(extension)), lookup(MEDIA, F.trim(F.split(F.lower(media), ";")[0])), sniffed)


def markdown_title(content: Column) -> Column:
    """The first heading, else the first 60 characters."""
    heading = F.regexp_extract(F.coalesce(content, F.lit("")), r"(?m)^#{1,6}\s+(.+)$", 1)
    return F.when(heading != "", F.trim(heading)).otherwise(F.trim(F.left(F.coalesce(content, F.lit("")), F.lit(60))))


def html_text(page: Column) -> Column:
    """The text of a page without scripts, styles, menus, headers and footers; tags become blanks, blocks lines."""
    t = F.coalesce(page, F.lit(""))
    for name in ("script", "style", "nav", "footer", "header", "aside"):
        t = F.regexp_replace(t, rf"(?is)<{name}[\s>].*?</{name}>", " ")
    t = F.regexp_replace(t, r"(?is)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/section|/article)[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f]+", " "), r" ?\n ?", "\n"), r"\n{3,}|^[\s]+|[\s]+$", "\n")


def csv_fields(line: Column) -> Column:
    """The fields of a line: quoted ones with "" for a quote, others up to the next comma."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(?:"((?:[^"]|"")*)"|([^,]*))'), F.lit(0))
    bare = F.transform(parts, lambda p: F.substring(p, 2, 2147483647))
    return F.transform(bare, lambda f: F.when(F.startswith(f, F.lit('"')) & (F.length(f) > 1), F.replace(F.substring(f, 2, F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(F.trim(f)))


def csv_rows(files: DataFrame) -> DataFrame:
    """(id, row, title, text, metadata) of each file's (id, content) lines: text from a column so named, else from the longest on average."""
    lines = files.select("id", F.posexplode(F.split(F.coalesce("content", F.lit("")), r"\r?\n")).alias("row", "line")).filter(F.trim("line") != "")
    fields = lines.select("id", "row", csv_fields(F.col("line")).alias("fields"))
    head = fields.filter("row = 0").select("id", F.transform("fields", lambda f: F.lower(F.trim(f))).alias("head"))
    cells = fields.filter("row > 0").join(head, "id").select("id", "row", "head", F.posexplode("fields").alias("k", "value"))
    means = cells.groupBy("id", "head", "k").agg(F.avg(F.length("value")).alias("mean")).groupBy("id", "head").agg(F.max_by("k", F.struct("mean", -F.col("k"))).alias("longest"))
    place = lambda names: F.coalesce(*[F.when(F.array_position("head", n) > 0, F.array_position("head", n)) for n in names])
    which = means.select("id", "head", F.coalesce(place(TEXTS), F.col("longest") + 1).cast("int").alias("text_at"), place(TITLES).cast("int").alias("title_at"))
    rows = fields.filter("row > 0").join(which, "id")
    pairs = F.arrays_zip(F.col("head").alias("key"), F.col("fields").alias("value"), F.sequence(F.lit(1), F.size("head")).alias("k"))
    rest = F.map_from_entries(F.transform(F.filter(pairs, lambda p: (p["k"] != F.col("text_at")) & (p["k"] != F.coalesce("title_at", F.lit(0))) & p["value"].isNotNull() & p["key"].isNotNull()), lambda p: F.struct(p["key"], p["value"])))
    title = F.coalesce(F.try_element_at("fields", F.col("title_at")), F.concat(F.lit("Row "), F.col("row").cast("string")))
    return rows.select("id", "row", title.alias("title"), F.try_element_at("fields", F.col("text_at")).alias("text"), rest.alias("metadata"))


def jsonl_rows(files: DataFrame) -> DataFrame:
    """(id, row, title, text, metadata) of each line that is an object with a text; other lines are passed over."""
    lines = files.select("id", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("row", "line"))
    own = lines.withColumn("o", F.from_json(F.when(F.startswith(F.trim("line"), F.lit("{")), F.col("line")), "map<string,string>")).filter("o is not null")
    text = F.coalesce(*[F.col("o")[k] for k in TEXTS])
    title = F.coalesce(F.col("o")["title"], F.left(text, F.lit(60)))
    return own.filter(text.isNotNull()).select("id", "row", title.alias("title"), text.alias("text"), F.map_filter("o", lambda k, v: ~k.isin(*TEXTS, "title")).alias("metadata"))


def chat_lines(turns: DataFrame, you: str = "Human", other: str = "Assistant") -> DataFrame:
    """(conv_id, turn, line): a flat chat's turns as lines; a chat of any length stays in rows."""
    who = F.when(F.col("role") == "user", you).when(F.col("role") == "assistant", other)
    return turns.filter(who.isNotNull()).select("conv_id", "turn", F.concat(who, F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))


def chat_tree(nodes: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): a tree's turns (conv_id, node, parent, nth child, role, text) from its root down, children in order, without system turns.

    Nodes carry their path; a round adds a level, and nodes that no root leads to (cycles) are never reached.
    """
    own = cut(nodes)
    front = own.filter("parent is null").select("conv_id", "node", F.lpad(F.col("nth").cast("string"), 6, "0").alias("path"))
    found = front
    while not front.isEmpty():
        down = own.select("conv_id", F.col("node").alias("child"), F.col("parent").alias("node"), "nth")
        front = cut(front.join(down, ["conv_id", "node"]).select("conv_id", F.col("child").alias("node"), F.concat("path", F.lit("/"), F.lpad(F.col("nth").cast("string"), 6, "0")).alias("path")))
        found = found.unionByName(front)
    turns = found.join(own.select("conv_id", "node", "role", "text"), ["conv_id", "node"]).filter("role <> 'system' and trim(coalesce(text, '')) <> ''")
    return turns.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("path", "node")).alias("place"), "role", "text")


def imported(dump: Column) -> dict[str, Column]:
    """The fields of a foreign memory (JSON): content, category by type, importance and tags, from whichever name holds them."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(dump, f"$.{p}") for p in paths])
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), F.lower(get("type", "category", "metadata.type")))
    return {"content": get("memory", "content", "text", "data.memory"), "category": F.coalesce(kind, F.lit("general")), "importance": F.coalesce(get("importance", "score").try_cast("double"), F.lit(5.0)), "source": F.coalesce(get("source", "agent_id", "app"), F.lit("import"))}


def zip_entries(files: DataFrame, most: int = MOST_ENTRY) -> DataFrame:
    """(id, name, content, kind): an archive's files (id, data), entry by entry; hidden files, resource forks, nested archives and entries over ``most`` bytes are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(data.as_py() or b""))
                except zipfile.BadZipFile:
                    continue
                for entry in archive.infolist():
                    name = entry.filename
                    base = name.rsplit("/", 1)[-1]
                    if entry.is_dir() or not base or base.startswith(".") or name.startswith("__MACOSX") or name.lower().endswith(".zip") or entry.file_size > most:
                        continue
                    kind = EXTENSIONS.get("." + base.rsplit(".", 1)[-1].lower(), "plaintext")
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([name]), pa.array([archive.read(entry)], pa.binary()), pa.array([kind])], ["id", "name", "content", "kind"])

    return files.select(F.col("id").cast("long").alias("id"), "data").mapInArrow(run, "id long, name string, content binary, kind string")


def docx_texts(files: DataFrame) -> DataFrame:
    """(id, text): the paragraphs of word-processor files (id, data), a blank line between; null for files that are none."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def read(data: bytes | None) -> str | None:
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data or b"")).read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        return "\n\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([read(x.as_py()) for x in batch.column(1)], pa.string())], ["id", "text"])

    return files.select(F.col("id").cast("long").alias("id"), "data").mapInArrow(run, "id long, text string")


#: Parsers by format: (id, content) to rows.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "csv": csv_rows, "jsonl": jsonl_rows, "zip": zip_entries, "docx": docx_texts,
    "markdown": lambda f: f.select("id", markdown_title(F.col("content")).alias("title"), F.col("content").alias("text")),
    "plaintext": lambda f: f.select("id", markdown_title(F.col("content")).alias("title"), F.col("content").alias("text")),
    "html": lambda f: f.select("id", F.trim(F.regexp_extract(F.coalesce("content", F.lit("")), r"(?is)<title[^>]*>([^<]*)</title>", 1)).alias("title"), html_text(F.col("content")).alias("text")),
}
