"""Parsers of raw inputs into (title, text) and transcripts, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def html_titles(pages: DataFrame) -> DataFrame:
    """(page_id, title): the text of the title element; empty if there is none."""
    return pages.select("page_id", F.trim(F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1)).alias("title"))


def transcripts(turns: DataFrame, span: int = 1000) -> DataFrame:
    """(conv_id, part, messages, transcript): 'Role: text' by turn, a blank line between, in parts of ``span`` turn numbers from 0.

    A part is one row, gathered by itself, so a conversation of any length is spread over tasks; its parts joined by a blank line, in order, are the whole.
    Turns without a number form a part of their own (null); a turn without a role counts, but has no line.
    """
    line = F.concat(F.upper(F.left("role", F.lit(1))), F.substring("role", 2, 2147483647), F.lit(": "), F.coalesce("text", F.lit("")))
    own = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    parts = turns.groupBy("conv_id", F.floor(F.col("turn") / span).alias("part"))
    return parts.agg(F.count(F.lit(1)).alias("messages"), F.array_join(F.transform(own, lambda x: x["line"]), "\n\n").alias("transcript"))
