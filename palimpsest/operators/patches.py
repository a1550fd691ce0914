"""Patches of texts: differences of two versions by lines, search-and-replace blocks, several files in one text.

Lines are compared place by place, each a row, so that a text of any length is spread over tasks; places that differ and follow each other are a hunk.
A missing version is a null text; an empty one has one empty line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks of search-and-replace blocks, of files in one text, and of patches.
SEARCH, MIDDLE, REPLACE = "<<<<<<< SEARCH", "=======", ">>>>>>> REPLACE"
FILE, FILES_END, FILES_BEGIN, PATCH_BEGIN = "*** File:", "*** End Files", "*** Begin Files", "*** Begin Patch"


def hunks(pairs: DataFrame) -> DataFrame:
    """(path, start, removed, added, lines) of pairs (path, old, new): the places that differ from ``start`` on (from 0), how many lines each side has there, and the lines with their signs.

    Where a version is missing, all lines of the other are one hunk.
    """
    lines = lambda c: F.when(F.col(c).isNotNull(), F.split(F.col(c), "\n", -1))
    changed = pairs.filter(~F.col("old").eqNullSafe(F.col("new"))).select("path", lines("old").alias("a"), lines("new").alias("b"))
    sized = changed.withColumns({"n_old": F.coalesce(F.size("a"), F.lit(0)), "n_new": F.coalesce(F.size("b"), F.lit(0))})
    none = F.array().cast("array<string>")
    places = sized.select("path", "n_old", "n_new", F.posexplode(F.arrays_zip(F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))).alias("place", "x"))
    present = (F.col("place") < F.col("n_old")) & (F.col("place") < F.col("n_new"))
    differ = places.filter(~(present & (F.col("x.a") == F.col("x.b"))))
    island = F.col("place") - F.row_number().over(Window.partitionBy("path").orderBy("place"))
    marked = lambda side, sign, n: F.sort_array(F.collect_list(F.when(F.col("place") < F.col(n), F.struct("place", F.concat(F.lit(sign), F.col(f"x.{side}")).alias("line")))))
    found = differ.withColumn("island", island).groupBy("path", "island").agg(F.min("place").alias("start"), marked("a", "-", "n_old").alias("gone"), marked("b", "+", "n_new").alias("came"))
    return found.select("path", "start", F.size("gone").alias("removed"), F.size("came").alias("added"), F.transform(F.concat("gone", "came"), lambda x: x["line"]).alias("lines"))


def unified(pairs: DataFrame) -> DataFrame:
    """(path, diff) of the pairs (path, old, new) that differ: heads with the path, and each hunk under its place; added and deleted texts without places."""
    place = F.col("start") + 1
    head = F.concat(F.lit("@@ -"), place, F.lit(","), F.col("removed"), F.lit(" +"), place, F.lit(","), F.col("added"), F.lit(" @@\n"))
    sides = pairs.select("path", F.col("old").isNull().alias("is_new"), F.col("new").isNull().alias("is_gone"))
    bodies = hunks(pairs).join(sides, "path")
    body = F.concat(F.when(F.col("is_new") | F.col("is_gone"), "").otherwise(head), F.array_join("lines", "\n"))
    texts = bodies.groupBy("path", "is_new", "is_gone").agg(F.sort_array(F.collect_list(F.struct("start", body.alias("body")))).alias("bodies"))
    before = F.when(F.col("is_new"), "--- /dev/null").otherwise(F.concat(F.lit("--- a/"), F.col("path")))
    after = F.when(F.col("is_gone"), "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/"), F.col("path")))
    return texts.select("path", F.concat_ws("\n", before, after, F.array_join(F.transform("bodies", lambda x: x["body"]), "\n")).alias("diff"))


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def patch_type(patch: Column) -> Column:
    """patch, full or diff, by the marks that a text has."""
    return F.when(F.contains(patch, F.lit(PATCH_BEGIN)), "patch").when(F.contains(patch, F.lit(FILES_BEGIN)) | F.contains(patch, F.lit(FILE)), "full").when(F.contains(patch, F.lit(SEARCH)), "diff").otherwise("full")


def blocks(patch: Column) -> Column:
    """array<struct<search, replace>>: the whole blocks of a patch in order, both sides trimmed; a block without its middle or end is left out."""
    middle = lambda b: F.instr(b, F.lit(MIDDLE))
    after = lambda b: F.substr(b, middle(b) + len(MIDDLE))
    end = lambda b: F.instr(after(b), F.lit(REPLACE))
    parts = F.slice(F.split(patch, SEARCH), 2, F.greatest(F.size(F.split(patch, SEARCH)) - 1, F.lit(0)))
    whole = F.filter(parts, lambda b: (middle(b) > 0) & (end(b) > 0))
    return F.transform(whole, lambda b: F.struct(_trimmed(F.left(b, middle(b) - 1)).alias("search"), _trimmed(F.left(after(b), end(b) - 1)).alias("replace")))


def patched(text: Column, patch: Column) -> Column:
    """The text after a patch's blocks, each replacing the first place of what it searches; one that finds nothing is passed over, an empty search stands at the beginning."""

    def step(state: Column, block: Column) -> Column:
        at = F.when(block["search"] == "", 1).otherwise(F.instr(state, block["search"]))
        return F.when(at > 0, F.concat(F.left(state, at - 1), block["replace"], F.substr(state, at + F.length(block["search"])))).otherwise(state)

    return F.aggregate(F.coalesce(blocks(patch), F.array().cast("array<struct<search:string,replace:string>>")), F.coalesce(text, F.lit("")), step)


def files(patch: Column) -> Column:
    """array<struct<path, body>>: the files of one text, each under a line with its mark and path; blanks at a body's end go."""
    parts = F.slice(F.split(patch, r"\*\*\* File:"), 2, F.greatest(F.size(F.split(patch, r"\*\*\* File:")) - 1, F.lit(0)))
    named = F.filter(parts, lambda p: F.instr(p, F.lit("\n")) > 0)
    body = lambda p: F.element_at(F.split(F.substr(p, F.instr(p, F.lit("\n")) + 1), r"\*\*\* End Files"), 1)
    return F.transform(named, lambda p: F.struct(_trimmed(F.left(p, F.instr(p, F.lit("\n")) - 1)).alias("path"), F.regexp_replace(body(p), r"\s+$", "").alias("body")))
