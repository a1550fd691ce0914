"""JSON that is nearly whole: fences, words around it, trailing commas, missing quotes and brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _without_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",\s*([}\]])", "$1")


def _closed(text: Column) -> Column:
    """With a last open string, then the brackets, then the braces closed."""
    text = F.when(F.regexp_count(text, F.lit(r'(?<!\\)"')) % 2 == 1, F.concat(text, F.lit('"'))).otherwise(text)
    bare = F.regexp_replace(text, r'(?s)(?<!\\)".*?(?<!\\)"', "")
    open_ = lambda a, b: F.greatest(F.regexp_count(bare, F.lit(a)) - F.regexp_count(bare, F.lit(b)), F.lit(0))
    return _without_commas(F.concat(text, F.repeat(F.lit("]"), open_(r"\[", r"\]")), F.repeat(F.lit("}"), open_(r"\{", r"\}"))))


def repaired_json(raw: Column) -> Column:
    """The JSON in a text, as text, from its first brace or bracket to the last one that closes its kind; mended if it doesn't parse as it is.

    Null where there is none or it can't be mended so: brackets are closed before braces, whatever opened last. A text of more than one JSON value gives null.
    """
    body = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)[{\[].*", 0)
    ended = F.when(F.startswith(body, F.lit("{")), F.regexp_extract(body, r"(?s)^.+\}", 0)).otherwise(F.regexp_extract(body, r"(?s)^.+\]", 0))
    body = F.when(ended == "", body).otherwise(ended)
    body = _without_commas(F.regexp_replace(F.regexp_replace(body, r"```(?:json)?\s*", ""), r"\s*```", ""))
    # an array keeps the text from being worked out for each use
    tried = F.transform(F.array(body), lambda t: F.struct(t.alias("a"), _closed(t).alias("b")))
    best = F.transform(tried, lambda t: F.when(F.try_parse_json(t["a"]).isNotNull(), t["a"]).when(F.try_parse_json(t["b"]).isNotNull(), t["b"]))
    return F.when(body != "", best[0])
