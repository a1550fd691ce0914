"""English stems of full-text tokens: the published suffix rules of 1980, each a pass of built-in functions over an array of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_SOME, _ONE, _MORE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
_VOWEL, _SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"
#: The suffixes that are replaced after a stem of one measure or more, in two rounds.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: The suffixes that fall after a stem of two measures or more.
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _plural(w: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(w, "(ss|i)es$", "$1"), "([^s])s$", "$1")


def _past(w: Column) -> Column:
    """eed after a measure to ee; ed and ing fall after a vowel, and what is left gets its e back or loses a doubled letter."""
    left = F.regexp_replace(w, "(ed|ing)$", "")
    whole = F.when(left.rlike("(at|bl|iz)$"), F.concat(left, F.lit("e"))).when(left.rlike(r"([^aeiouylsz])\1$"), F.regexp_replace(left, ".$", "")).when(left.rlike(_SHORT), F.concat(left, F.lit("e")))
    return F.when(w.rlike("eed$"), F.when(F.regexp_replace(w, "eed$", "").rlike(_SOME), F.regexp_replace(w, "d$", "")).otherwise(w)).when(w.rlike("(ed|ing)$") & left.rlike(_VOWEL), whole.otherwise(left)).otherwise(w)


def _y(w: Column) -> Column:
    return F.when(w.rlike("y$") & F.regexp_replace(w, "y$", "").rlike(_VOWEL), F.regexp_replace(w, "y$", "i")).otherwise(w)


def _replaced(table: dict[str, str]):
    pattern = f"^(.*?)({'|'.join(sorted(table, key=len, reverse=True))})$"

    def step(w: Column) -> Column:
        stem, suffix = F.regexp_extract(w, pattern, 1), F.regexp_extract(w, pattern, 2)
        new = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), suffix)
        return F.when(stem.rlike(_SOME), F.concat(stem, new)).otherwise(w)

    return step


def _dropped(w: Column) -> Column:
    pattern = f"^(.*?)({'|'.join(sorted(FOURTH, key=len, reverse=True))})$"
    ion = F.regexp_extract(w, "^(.*[st])ion$", 1)
    stem = F.regexp_extract(w, pattern, 1)
    return F.when(stem != "", F.when(stem.rlike(_MORE), stem).otherwise(w)).when(ion.rlike(_MORE), ion).otherwise(w)


def _end(w: Column) -> Column:
    left = F.regexp_replace(w, "e$", "")
    return F.when(w.rlike("e$") & (left.rlike(_MORE) | left.rlike(_ONE) & ~left.rlike(_SHORT)), left).otherwise(w)


def _double(w: Column) -> Column:
    return F.when(w.rlike("ll$") & w.rlike(_MORE), F.regexp_replace(w, "l$", "")).otherwise(w)


def stems(words: Column) -> Column:
    """The stems of an array of lower-case words. Words of fewer than 3 or more than 64 letters, and those with other characters, stay; null elements stay null."""
    out = words
    # one pass for each rule: the one before it is worked out once
    for step in (_plural, _past, _y, _replaced(SECOND), _replaced(THIRD), _dropped, _end, _double):
        out = F.transform(out, step)
    return F.zip_with(words, out, lambda w, s: F.when(w.rlike("^[a-z]{3,64}$"), s).otherwise(w))
