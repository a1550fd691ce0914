"""Signs of a person in short texts: likes, dislikes, favourites, decisions, identity, values, aims, emotions, each with an intensity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type, valence, intensity, pattern; the groups that hold the subject.
PATTERNS = (
    ("preference", "positive", 0.6, r"(?i)\b(?:I\s+)?(love|like|enjoy|prefer|adore|am (?:really )?into)\s+(.+?)(?:\.|,|!|\s+(?:and|but|so|because))", (2,)),
    ("preference", "negative", 0.6, r"(?i)\b(?:I\s+)?(hate|dislike|don't like|can't stand|avoid)\s+(.+?)(?:\.|,|!|\s+(?:and|but|so|because))", (2,)),
    ("preference", "positive", 0.8, r"(?i)\bmy favorite\s+(.+?)\s+(?:is|are)\s+(.+?)(?:\.|,|\z)", (1, 2)),
    ("decision", "neutral", 0.5, r"(?i)\b(?:I\s+)?(?:decided to|chose to|going to|switched to|opted for|picked|went with)\s+(.+?)(?:\.|,|!|\z)", (1,)),
    ("identity", "neutral", 0.7, r"(?i)\b(?:I\s+)?(?:am a|'m a|consider myself|identify as)\s+(.+?)(?:\.|,|!|\z)", (1,)),
    ("value", "positive", 0.7, r"(?i)\b(?:important to me|matters to me|I believe in|I value|I care about)\s+(.+?)(?:\.|,|!|\z)", (1,)),
    ("motivation", "positive", 0.6, r"(?i)\b(?:I want to|my goal is|I aspire to|I'm trying to|I hope to|I aim to)\s+(.+?)(?:\.|,|!|\z)", (1,)),
)
#: Words of emotion by precedence, valence, intensity.
EMOTIONS = (
    ("happy", "positive", 0.6), ("excited", "positive", 0.8), ("grateful", "positive", 0.7), ("proud", "positive", 0.7), ("relieved", "positive", 0.5), ("thrilled", "positive", 0.9),
    ("content", "positive", 0.5), ("sad", "negative", 0.6), ("angry", "negative", 0.8), ("frustrated", "negative", 0.7), ("anxious", "negative", 0.6), ("stressed", "negative", 0.7),
    ("disappointed", "negative", 0.6), ("overwhelmed", "negative", 0.8), ("lonely", "negative", 0.7), ("worried", "negative", 0.5), ("bored", "negative", 0.4),
)
#: Single words that raise or lower an intensity.
INTENSIFIERS = {
    "very": 1.3, "really": 1.3, "absolutely": 1.4, "extremely": 1.4, "incredibly": 1.4, "super": 1.3, "totally": 1.3, "deeply": 1.3, "strongly": 1.3, "highly": 1.3,
    "somewhat": 0.7, "slightly": 0.7, "barely": 0.5, "hardly": 0.5, "mildly": 0.6,
}


def _cleaned(subject: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(subject), "(?i)^(a |an |the |my |our )", ""), 1, 200)


def _matched(content: Column, kind: str, valence: str, intensity: float, pattern: str, groups: tuple[int, ...]) -> Column:
    every = lambda g: F.regexp_extract_all(content, F.lit(pattern), F.lit(g))
    found = F.arrays_zip(every(0).alias("whole"), *[every(g).alias(f"g{g}") for g in groups])
    subject = lambda m: reduce(lambda a, b: F.concat(a, F.lit(": "), b), [_cleaned(m[f"g{g}"]) for g in groups])
    own = F.transform(found, lambda m: _signal(F.lit(kind), subject(m), F.lit(valence), F.lit(intensity), F.trim(m["whole"])))
    return own if len(groups) > 1 else F.filter(own, lambda s: F.length(s["subject"]).between(3, 100))


def _signal(kind: Column, subject: Column, valence: Column, intensity: Column, source: Column) -> Column:
    return F.struct(kind.alias("signal_type"), subject.alias("subject"), valence.alias("valence"), intensity.alias("intensity"), source.alias("source_text"))


def _felt(sentence: Column) -> Column:
    """The first emotion in order whose word a sentence holds, else null."""
    ladder = [F.when(F.contains(F.lower(sentence), F.lit(w)), _signal(F.lit("emotion"), F.lit(w), F.lit(v), F.lit(i), F.substring(sentence, 1, 500))) for w, v, i in EMOTIONS]
    return F.coalesce(*ladder)


def _weighed(signal: Column, lexicon: dict[str, float]) -> Column:
    held = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    source = signal["source_text"]
    words = F.split(F.lower(source), r"\s+")
    start = signal["intensity"]
    if lexicon:
        table = F.create_map(*[F.lit(x) for pair in lexicon.items() for x in (pair[0], float(pair[1]))])
        known = F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull())
        mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)
        start = F.when(F.size(known) > 0, held(start + mean * 0.05)).otherwise(start)
    times = F.create_map(*[F.lit(x) for pair in INTENSIFIERS.items() for x in pair])
    level = F.aggregate(words, start, lambda s, w: held(s * F.coalesce(F.try_element_at(times, w), F.lit(1.0))))
    level = F.least(F.lit(1.0), level + F.when(F.contains(source, F.lit("!")), 0.1).otherwise(0.0))
    loud = (source == F.upper(source)) & (F.length(source) > 5)
    return signal.withField("intensity", F.least(F.lit(1.0), level + F.when(loud, 0.2).otherwise(0.0)))


def signals(content: Column, lexicon: dict[str, float] | None = None, weighed: bool = True) -> Column:
    """array<struct<signal_type, subject, valence, intensity, source_text>> of a text, in the order of the rules.

    Subjects lose a leading article and count with 3 to 100 characters (favourites at any length); a sentence of over 5 characters gives one
    emotion at most. ``weighed``: values and aims as well, and intensities moved by the mean of ``lexicon`` (word to score) over the sign's words,
    by intensifiers, exclamation marks and capitals; without it neither. A null or empty text gives an empty array. All in built-in functions.
    """
    content = F.coalesce(content, F.lit(""))
    plain = [_matched(content, *p) for p in PATTERNS[:5]]
    parts = F.filter(F.transform(F.split(content, r"[.!?]+\s+|\n+"), lambda s: F.trim(s)), lambda s: F.length(s) > 5)
    plain.append(F.filter(F.transform(parts, _felt), lambda s: s.isNotNull()))
    if not weighed:
        return F.concat(*plain)
    return F.transform(F.concat(*plain, *[_matched(content, *p) for p in PATTERNS[5:]]), lambda s: _weighed(s, lexicon or {}))
