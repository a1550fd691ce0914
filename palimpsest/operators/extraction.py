"""Rule extraction from short texts: facts, preferences and states, each pattern one pass over the rows. A null text gives nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

#: Fixed values: (subject, verb or the group that holds it, object's group, quantity's group, unit or its group, pattern). A number names a group.
FACTS = (
    ("user", 1, 3, 2, None, r"(?i)\b(bought|purchased|got|acquired|received|ordered|picked up)\s+(\d+)\s+(.+?)(?:\.|,|$)"),
    ("user", "spent", 2, 1, "dollars", r"(?i)\bspent\s+\$([\d,.]+)\s+(?:on|for)\s+(.+?)(?:\.|,|$)"),
    ("user", "has", 2, 1, None, r"(?i)\b(?:I\s+)?(?:have|has|own|got)\s+(\d+)\s+(.+?)(?:\.|,|\s+(?:and|but|so|now))"),
    ("user", "did", 3, 1, 2, r"(?i)\b(\d+(?:\.\d+)?)\s+(hours?|minutes?|mins?|days?|weeks?|months?)\s+(?:of\s+)?(.+?)(?:\.|,|$)"),
    ("user", 1, None, 2, 3, r"(?i)\b(ran|jogged|walked|hiked|swam|cycled|biked|exercised)\s+(?:for\s+)?(\d+(?:\.\d+)?)\s+(hours?|minutes?|mins?|miles?|km)"),
    ("user", 1, 2, "1", None, r"(?i)\b(made|baked|cooked|prepared)\s+(?:a\s+|some\s+)?(.+?)(?:\.|,|\s+(?:and|but|for|from|yesterday|today|last))"),
    ("user", "earned", 2, 1, "dollars", r"(?i)\b(?:earned|made|received|got paid)\s+\$([\d,.]+)(?:\s+(?:from|for|by)\s+(.+?))?(?:\.|,|$)"),
    ("assistant", 1, 2, None, None, r"(?i)\b(?:the\s+)?(?:assistant|AI|I)\s+(recommended|suggested|implemented|created|fixed|diagnosed|configured|deployed|built|wrote|designed|refactored|migrated|upgraded|replaced|analyzed|discovered|resolved|identified)\s+(.+?)(?:\.|,|$)"),
)
#: What is liked, and what isn't.
TASTES = (
    ("likes", r"(?i)\b(?:I\s+)?(love|like|enjoy|prefer|adore|am (?:really )?into)\s+(.+?)(?:\.|,|!|\s+(?:and|but|so|because))"),
    ("dislikes", r"(?i)\b(?:I\s+)?(hate|dislike|don't like|can't stand|avoid)\s+(.+?)(?:\.|,|!|\s+(?:and|but|so|because))"),
)
FAVORITE = r"(?i)\bmy favorite\s+(.+?)\s+(?:is|are)\s+(.+?)(?:\.|,|$)"
#: Keys of a user's state.
STATES = (
    ("current_role", r"(?i)\b(?:I\s+)?(?:started|began|got promoted to|now work as|am now|just became|accepted a position as)\s+(?:a\s+|an\s+|my\s+)?(.+?)(?:\.|,|$)"),
    ("current_location", r"(?i)\b(?:I\s+)?(?:moved to|relocated to|live in|living in|staying in)\s+(.+?)(?:\.|,|$)"),
)
#: Rows that nothing is extracted from.
SKIPPED = ("task", "issue", "plan")
OPENINGS = ("Session compaction summary", "[Consolidated:", "[auto-captured]")


def _group(pattern: str, n: int) -> Column:
    """All matches of a group, in order."""
    return F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(pattern), F.lit(n))


def facts(rows: DataFrame) -> DataFrame:
    """(id, subject, verb, object, quantity, unit): a row for each match of each pattern."""
    found = []
    for subject, verb, object_, quantity, unit, pattern in FACTS:
        groups = sorted({g for g in (verb, object_, quantity, unit) if isinstance(g, int)})
        one = rows.select("id", F.explode(F.arrays_zip(*[_group(pattern, g).alias(f"g{g}") for g in groups])).alias("m"))
        part = lambda g: F.col(f"m.g{g}") if isinstance(g, int) else F.lit(g).cast("string")  # noqa: E731, B023
        thing = F.left(F.trim(part(object_)), F.lit(200))
        found.append(one.select("id", F.lit(subject).alias("subject"), F.lower(part(verb)).alias("verb"), F.when(thing != "", thing).alias("object"), F.replace(part(quantity), F.lit(","), F.lit("")).try_cast("double").alias("quantity"), F.lower(part(unit)).alias("unit")))
    return reduce(DataFrame.unionByName, found)


def preferences(rows: DataFrame) -> DataFrame:
    """(user_id, domain, preference, strength, evidence): 1 and 0.5 more each time a user's preference is met again; the latest row is its evidence."""
    found = []
    for kind, pattern in TASTES:
        thing = rows.select("id", "user_id", F.explode(_group(pattern, 2)).alias("thing")).withColumn("thing", F.left(F.trim("thing"), F.lit(200)))
        found.append(thing.filter((F.length("thing") > 3) & (F.length("thing") < 100)).select("id", "user_id", rules.domain(F.col("thing")).alias("domain"), F.concat(F.lit(kind + " "), "thing").alias("preference")))
    named = rows.select("id", "user_id", F.explode(F.arrays_zip(_group(FAVORITE, 1).alias("a"), _group(FAVORITE, 2).alias("b"))).alias("m"))
    found.append(named.select("id", "user_id", F.lower(F.trim("m.a")).alias("domain"), F.concat(F.lit("favorite: "), F.trim("m.b")).alias("preference")))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("user_id", "domain", "preference").agg((1 + 0.5 * (F.count(F.lit(1)) - 1)).alias("strength"), F.max("id").alias("evidence"))


def states(rows: DataFrame) -> DataFrame:
    """(user_id, key, value, previous_value, updates): what a user said last, in the order of ids, and what before it."""
    found = []
    for key, pattern in STATES:
        one = rows.select("id", "user_id", F.posexplode(_group(pattern, 1)).alias("place", "value")).withColumn("value", F.left(F.trim("value"), F.lit(200)))
        found.append((one.filter((F.length("value") > 3) & (F.length("value") < 100)) if key == "current_role" else one).withColumn("key", F.lit(key)))
    every = reduce(DataFrame.unionByName, found)
    newest = Window.partitionBy("user_id", "key").orderBy(F.desc("id"), F.desc("place"))
    two = every.withColumn("n", F.row_number().over(newest)).filter("n <= 2").groupBy("user_id", "key").agg(F.max(F.when(F.col("n") == 1, F.col("value"))).alias("value"), F.max(F.when(F.col("n") == 2, F.col("value"))).alias("previous_value"))
    return two.join(every.groupBy("user_id", "key").agg(F.count(F.lit(1)).alias("updates")), ["user_id", "key"])


def skips(category: Column, content: Column) -> Column:
    opening = reduce(lambda a, b: a | b, [F.startswith(F.trim(F.coalesce(content, F.lit(""))), F.lit(o)) for o in OPENINGS])
    return F.lower(F.coalesce(category, F.lit("general"))).isin(*SKIPPED) | opening


def corrected(typed: list[str], known: DataFrame, name_col: str = "name", most: int = 3) -> DataFrame:
    """(typed, name): the nearest known name at most so many edits away, else the first that begins like it (up to '__'), else itself."""
    one = []
    for t in typed:
        d = F.levenshtein(F.col(name_col), F.lit(t))
        one.append(known.agg(F.lit(t).alias("typed"), F.coalesce(F.min(F.when(d <= most, F.struct(d.alias("d"), F.col(name_col).alias("n"))))["n"], F.min(F.when(F.startswith(F.col(name_col), F.lit(t.split("__")[0])), F.col(name_col))), F.lit(t)).alias("name")))
    return reduce(DataFrame.unionByName, one)
