"""Templates and front matter: column functions on texts that carry fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a place in a template, with its path.
PLACE = r"\{\{(\w+(?:\.\w+)*)\}\}"


def interpolated(template: Column, values: Column) -> Column:
    """``template`` with each {{path.of.names}} replaced by what the JSON object ``values`` holds there: nothing if it is missing or null,
    JSON if it is an object or a list. A null template is null; null or broken ``values`` hold nothing."""
    pieces, paths = F.split(template, PLACE), F.regexp_extract_all(template, F.lit(PLACE), F.lit(1))
    filled = F.zip_with(pieces, paths, lambda piece, path: F.concat(piece, F.coalesce(F.call_function("get_json_object", values, F.concat(F.lit("$."), path)), F.lit(""))))
    return F.array_join(filled, "")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"']|[\"']$", "")


def _heading(text: Column) -> Column:
    return _stripped(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))


def front_matter(raw: Column) -> dict[str, Column]:
    """name, description, category and tags of a Markdown text.

    A text that begins with --- has lines 'key: value' up to the next line that begins so; of a repeated key the last counts. Without a name
    there, or without such a head, the first heading of level 1 is the name; a head that doesn't end gives nothing. Null is as empty. category
    and tags are null where they are not given.
    """
    raw = F.coalesce(raw, F.lit(""))
    headed, end = F.startswith(raw, F.lit("---")), F.locate("\n---", raw, 4)
    head = F.when(headed & (end > 0), F.substr(raw, F.lit(5), F.greatest(end - 5, F.lit(0)))).otherwise("")
    lines = F.transform(F.split(head, "\n"), _stripped)

    def given(key: str) -> Column:
        pattern = rf"^{key}\s*:\s*(.+)$"
        own = F.filter(lines, lambda line: line.rlike(pattern))
        return F.transform(F.slice(own, -1, 1), lambda line: _stripped(_unquoted(F.regexp_extract(line, pattern, 1))))

    def value(key: str) -> Column:
        return F.get(given(key), F.lit(0))

    body = F.when(~headed, raw).when(end > 0, F.substr(raw, end + 4)).otherwise("")
    named = F.coalesce(value("name"), F.lit(""))
    tags = F.filter(F.transform(F.split(F.regexp_replace(value("tags"), r"^\[|\]$", ""), ","), lambda t: _unquoted(_stripped(t))), lambda t: t != "")
    return {"name": F.when(named == "", _heading(body)).otherwise(named), "description": F.coalesce(value("description"), F.lit("")), "category": value("category"), "tags": tags}
