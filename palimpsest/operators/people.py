"""Signs of persons over rows: the search channel by signs, profiles, texts that rows own, promotion of scratch entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, signals, text
from . import retrieval, similar
from .graph import cut

#: The order of a profile's sections.
SECTIONS = {"value": "CORE VALUES", "preference": "PREFERENCES", "decision": "DECISIONS", "emotion": "EMOTIONS", "identity": "IDENTITY", "motivation": "MOTIVATIONS"}


def personal_signals(rows: DataFrame, lexicon: dict[str, float] | None = None, weighed: bool = True, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, place, signal_type, subject, valence, intensity, source_text), a row for each sign; place counts a row's from 0."""
    return rows.select(F.col(id_col).alias("id"), F.posexplode(signals.signals(F.col(text_col), lexicon, weighed)).alias("place", "s")).select("id", "place", "s.*")


def signal_channel(found: DataFrame, rows: DataFrame, query: str, k: int, floor: float = 0.3) -> DataFrame:
    """(id, score): the rows whose signs fit a query best. The max(3 k, 24) strongest signs of ``rows`` are read, newer rows first among equals."""
    every = found.join(rows.select("id", "content", "created_at"), "id").orderBy(F.desc("intensity"), F.desc("created_at"), "id", "place").limit(max(3 * k, 24))
    hay = F.concat_ws(" ", "subject", "source_text", "content")
    scored = every.select("id", rules.signal_match(query, hay, F.col("subject"), F.col("intensity")).alias("score")).filter(F.col("score") >= floor)
    return scored.groupBy("id").agg(F.round(F.max("score"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def profile(found: DataFrame, most: int = 5) -> DataFrame:
    """(user_id, section, place, line): of each user and kind the strongest signs, the smaller id first among equals. A hot user's are cut to ``most`` before the shuffle."""
    label = F.coalesce(*[F.when(F.col("signal_type") == k, v) for k, v in SECTIONS.items()])
    by = Window.partitionBy("user_id", "signal_type").orderBy(F.desc("intensity"), "id", "place")
    top = found.filter(label.isNotNull()).withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= most)
    line = F.concat(F.lit("- "), "subject", F.lit(" ("), "valence", F.lit(", strength: "), F.format_number("intensity", 2), F.lit(")"))
    return top.select("user_id", label.alias("section"), F.col("_n").alias("place"), line.alias("line"))


def mixed_subjects(found: DataFrame) -> DataFrame:
    """(user_id, subject, n): subjects, but for case and marks, of which a user has signs for and against. Counts meet, not signs."""
    by = found.withColumn("subject", text.normal(F.col("subject"))).groupBy("user_id", "subject")
    counts = by.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("valence") == "positive").alias("_for"), F.count_if(F.col("valence") == "negative").alias("_against"))
    return counts.filter("_for > 0 and _against > 0").select("user_id", "subject", "n")


def owned(hits: DataFrame, owners: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(id, score): rows by the ranks of the texts that they own, a term for each hit. ``hits`` (id, score) are the best texts, ``owners`` (id, memory_id).

    A hit whose owner isn't among ``rows`` keeps its rank and gives nothing.
    """
    # hits are a top-k, so ranks and the broadcast are bounded by it
    ranked = retrieval.ranked(hits).join(owners, "id").select(F.col("memory_id").alias("id"), "rank")
    return retrieval.fuse([rows.select("id").join(F.broadcast(ranked), "id")], k)


def promoted(entries: DataFrame, key: Column, agent: Column, value: str = "value", category: str = "general", importance: int = 5) -> DataFrame:
    """(content, category, source, importance): a row to store for each scratch entry, 'key: value', nothing for a null value."""
    return entries.select(F.concat(key, F.lit(": "), F.coalesce(F.col(value).cast("string"), F.lit(""))).alias("content"), F.lit(category).alias("category"), agent.alias("source"), F.lit(importance).alias("importance"))


def theme_leaders(subjects: DataFrame) -> DataFrame:
    """(user_id, at, leader): of each user's subjects (user_id, at, subject) in order of ``at``, the first earlier leader that shares over half of both's words; one without is a leader.

    Equal sets of words go the same way, so each set is taken once, where it first stands. Sets that can share over half have one of the rarer halves of their words in common:
    these halves are joined, and what meets is compared. Leaders are then decided in rounds, all users and all that wait for nothing at once. A subject without words leads
    itself.
    """
    words = subjects.select("user_id", "at", F.array_sort(F.array_distinct(text.tokens(F.col("subject")))).alias("words"))
    worded = cut(words.filter(F.size("words") > 0))
    sets = cut(worded.groupBy("user_id", "words").agg(F.min("at").alias("at")))
    often = sets.select("user_id", F.explode("words").alias("word")).groupBy("user_id", "word").agg(F.count(F.lit(1)).alias("often"))
    ranked = sets.select("user_id", "at", F.size("words").alias("size"), F.explode("words").alias("word")).join(often, ["user_id", "word"])
    rare = ranked.withColumn("place", F.row_number().over(Window.partitionBy("user_id", "at").orderBy("often", "word"))).filter("2 * place <= size + 1")
    half = cut(rare.select("user_id", "at", "size", "word"))
    other = half.select("user_id", "word", F.col("at").alias("later"), F.col("size").alias("size_later"))
    met = half.join(other, ["user_id", "word"]).filter("at < later and 2 * size > size_later and 2 * size_later > size").select("user_id", "at", "later").distinct()
    side = lambda x, w: sets.select("user_id", F.col("at").alias(x), F.col("words").alias(w))
    both = met.join(side("at", "x"), ["user_id", "at"]).join(side("later", "y"), ["user_id", "later"]).filter(text.jaccard(F.col("x"), F.col("y")) > 0.5)
    node = lambda x: F.struct("user_id", F.col(x).alias("at"))
    claimed = similar.duplicate_clusters(both.select(node("at").alias("a"), node("later").alias("b"))).select("id.user_id", "id.at", F.col("anchor.at").alias("leader"))
    led = sets.join(claimed, ["user_id", "at"], "left").select("user_id", "words", F.coalesce("leader", "at").alias("leader"))
    alone = words.filter(F.size("words") == 0).select("user_id", "at", F.col("at").alias("leader"))
    return worded.join(led, ["user_id", "words"]).select("user_id", "at", "leader").unionByName(alone)


def themes(found: DataFrame) -> DataFrame:
    """(user_id, leader, label, n, intensity, types, valences, mixed) of signs (user_id, at, subject, signal_type, valence, intensity): those of one leader are a theme, under the leader's subject.

    Types and valences come in the order in which they first stand; mixed: some sign is for it and some against.
    """
    own = cut(found.join(theme_leaders(found.select("user_id", "at", "subject")), ["user_id", "at"]))
    counts = own.groupBy("user_id", "leader").agg(
        F.count(F.lit(1)).alias("n"), F.avg("intensity").alias("intensity"), F.min_by("subject", "at").alias("label"), (F.bool_or(F.col("valence") == "positive") & F.bool_or(F.col("valence") == "negative")).alias("mixed")
    )

    def listed(column: str, name: str) -> DataFrame:
        first = own.groupBy("user_id", "leader", column).agg(F.min("at").alias("first"))
        return first.groupBy("user_id", "leader").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", column))), lambda x: x[column]).alias(name))

    return counts.join(listed("signal_type", "types"), ["user_id", "leader"]).join(listed("valence", "valences"), ["user_id", "leader"])


def theme_lines(theme: DataFrame, most: int = 8) -> DataFrame:
    """(user_id, place, line): of each user the themes of most signs, the earlier first among equals, as sentences."""
    by = Window.partitionBy("user_id").orderBy(F.desc("n"), "leader")
    top = theme.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most)
    strength = F.format_string("%.2f", "intensity")
    strong = F.concat(F.lit('- "'), "label", F.lit('" is a strong theme ('), F.col("n"), F.lit(" signals, avg intensity: "), strength, F.lit("). Types: "), F.array_join("types", ", "), F.lit(". Valences: "), F.array_join("valences", ", "), F.lit("."))
    weak = F.concat(F.lit('- "'), "label", F.lit('" ('), F.col("n"), F.when(F.col("n") > 1, " signals").otherwise(" signal"), F.lit(", intensity: "), strength, F.lit(", "), F.array_join("valences", "/"), F.lit(")"))
    return top.select("user_id", "place", F.when(F.col("n") >= 3, strong).otherwise(weak).alias("line"))
