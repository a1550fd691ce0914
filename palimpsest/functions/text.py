"""Column functions on text: normal form, query tokens, tags, similarity of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(text: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and white space a blank, runs of white space one, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9\\s]", " "), "\\s+", " "))


def tokens(text: Column, least: int = 3) -> Column:
    """The words of the normal form that have ``least`` letters or more, repeats included."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= least)


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def preview(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("…"))).otherwise(text)


def bigrams(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.length(name) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substr(low, i, F.lit(2)))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


#: Question types by the first pattern that matches, in this order.
QUESTIONS = (
    ("temporal", "\\b(when|how long|last (week|month|year)|yesterday|before|after|since|days? ago)\\b"),
    ("preference", "\\b(prefer|favou?rite|like|love|enjoy|hate|recommend)"),
    ("reasoning", "\\b(why|how come|because|reason|cause)"),
    ("generalization", "\\b(usually|generally|typically|overall|in general|pattern)"),
)


def question_type(text: Column) -> Column:
    low, out = F.lower(text), F.lit("fact_recall")
    for label, pattern in reversed(QUESTIONS):
        out = F.when(low.rlike(pattern), F.lit(label)).otherwise(out)
    return out


#: Phrases that hint at a changed fact; the last two count in ranking only.
CHANGED = ("no longer", "changed to", "used to", "instead now", "but now", "previously", "was replaced", "switched from")


def contradicts(text: Column, phrases: int = 6) -> Column:
    """Whether a text holds one of the first ``phrases`` phrases."""
    return F.lower(text).rlike("|".join(CHANGED[:phrases]))
