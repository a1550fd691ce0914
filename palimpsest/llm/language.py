"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent n-grams (1 to 3 letters, words padded with a blank) in order of rank. A
document's distance to a language is the sum, over its own most frequent n-grams, of how far each stands out
of its place in the language's profile; an n-gram that the profile lacks counts as out by the profile's
length. The nearest language wins, ties to the one that sorts first.

N-grams are counted under a 16-bit hash. A text of any length takes one pass in pieces of at most
``_SLICE_CHARS`` (cut before a character that is no letter, where one is near) and a fixed table of counts.

Learning takes, for each language, at most ``SAMPLE_PER_LANGUAGE`` documents (those of least id hash): a bound
on the classifier's fit. Ids are chosen first, without their texts: a limit on the hash, from a count, lets
about four times as many through as are taken. What it predicts on is every whole text.

Defined results. A null text, or one without letters, is ``und`` with score 0. With nothing to learn from all
are ``und``. Rows without an id are not learned from. Ties in an n-gram's frequency go to the smaller hash. Repeated rows give repeated results; an
empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import free_name

PROFILE = 400
SAMPLE_PER_LANGUAGE = 500
UNKNOWN = "und"
#: Of 10,000 documents in learned languages, noisy ones included, none scores under 0.42; texts in other scripts score under 0.1.
REJECT_BELOW = 0.3
ENOUGH = 40
_SIZE = 1 << 16
_SLICE_CHARS = 1 << 19
#: Short texts are worked on together, so many characters and rows at once: their numbers take some 100 bytes a character.
_HELD_CHARS, _HELD_ROWS = 1 << 17, 512


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code of each character: itself in lower case if it is a letter (or a mark on one), else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
        elif 0x300 <= i < 0x370:
            out[i] = i
    return out


def _gram_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of many texts one after the other, and where each text's begin (one bound more than texts); none for a text without letters."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    codes = _letters()[np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")]
    blank = codes == 32
    owner = np.repeat(np.arange(len(texts)), lengths)
    lettered = np.bincount(owner[~blank & ~((codes >= 0x300) & (codes < 0x370))], minlength=len(texts)) > 0
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # one blank after each word
    keep &= lettered[owner]
    owner = owner[keep]
    c = codes[keep].astype(np.uint64)
    before = np.concatenate([[32], c[:-1]]).astype(np.uint64)
    before2 = np.where(before == 32, np.uint64(32), np.concatenate([[32, 32], c[:-2]])[: len(c)].astype(np.uint64))
    one = c * np.uint64(0x9E3779B97F4A7C15)
    two = one + before * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
    three = two + before2 * np.uint64(0x165667B19E3779F9) + np.uint64(1)
    grams = np.stack([one, two, three], axis=1)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return (grams >> np.uint64(48)).astype(np.uint16), bounds


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces, cut before a character that is no letter where the last 1000 of a piece hold one."""
    at = 0
    while at < len(text):
        end = min(at + _SLICE_CHARS, len(text))
        if end < len(text):
            end = next((i for i in range(end, end - 1000, -1) if not text[i].isalpha()), end)
        yield text[at:end]
        at = end


def _grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(text's number, its hashed n-grams), many short texts at once and a long one piece by piece (then its number comes again)."""
    held: list[int] = []
    size = 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        if held:
            grams, bounds = _gram_ids([texts[i] for i in held])
            for k, i in enumerate(held):
                yield i, grams[bounds[k] : bounds[k + 1]].ravel()

    for i, t in enumerate(texts):
        if len(t) > _SLICE_CHARS:
            for piece in _pieces(t):
                yield i, _gram_ids([piece])[0].ravel()
            continue
        if size + len(t) > _HELD_CHARS:
            yield from flush()
            held, size = [], 0
        held.append(i)
        size += len(t)
    yield from flush()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``_HELD_ROWS`` rows at most: a batch's texts never stand beside their copies as a whole."""
    for batch in batches:
        for at in range(0, batch.num_rows, _HELD_ROWS):
            yield batch.slice(at, _HELD_ROWS)


def _ranked(grams: np.ndarray | None, counts: np.ndarray | None, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, from the n-grams themselves or from a table of counts."""
    if counts is None and grams.size > 4096:
        counts = np.bincount(grams, minlength=_SIZE)
    if counts is None:
        ids, n = np.unique(grams, return_counts=True)
    else:
        ids = np.flatnonzero(counts)
        n = counts[ids]
    return ids[np.argsort(-n, kind="stable")[:most]]


def sample_ids(rows: DataFrame, key: str, sample: int) -> DataFrame:
    """(key, id): of each key the ``sample`` ids of least hash. Ids alone travel, and few of them: rows (key, id) whose hash lies over
    a limit that the key's count gives stay where they are, so a key that most rows share is no task's burden."""
    span = float(1 << 62)
    limits = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key, F.when(F.col("n") <= 4 * sample, span).otherwise(4 * sample / F.col("n") * span).alias("limit"))
    hash_ = F.shiftrightunsigned(F.xxhash64("id"), 2)
    near = rows.join(F.broadcast(limits), key).filter(hash_ <= F.col("limit")).select(key, "id").distinct()
    first = Window.partitionBy(key).orderBy(F.xxhash64("id"), "id")
    return near.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= sample).select(key, "id")


def learn_profiles(labelled: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_PER_LANGUAGE) -> dict[str, list[int]]:
    """Each language's n-grams by rank. What reaches the driver is ``PROFILE`` numbers for each language."""
    rows = labelled.select(labelled[lang_col].alias("lang"), labelled[id_col].alias("id"), labelled[text_col].alias("text")).filter("lang is not null and id is not null and text is not null")
    # a key for each language and at most ``sample`` ids for each are broadcast
    chosen = rows.join(F.broadcast(sample_ids(rows.select("lang", "id"), "lang", sample)), ["lang", "id"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            total: dict[str, np.ndarray] = {}
            for i, grams in _grams(texts):
                own = total.setdefault(langs[i], np.zeros(_SIZE, np.int64))
                own += np.bincount(grams, minlength=_SIZE)
            for lang, counts in total.items():
                ids = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids)), pa.array(ids.astype(np.int32)), pa.array(counts[ids])], ["lang", "gram", "n"])

    counts = chosen.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for row in sorted(top.select("lang", "rank", "gram").collect()):
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score", with_text: bool = False) -> DataFrame:
    """``docs`` with lang_as and score_as (1 less the distance over the greatest there can be); its text, if kept, comes last."""
    rest = [f.name for f in docs.schema.fields if f.name != text_col]
    kept = len(rest) + with_text
    schema = docs.select(*[docs[c] for c in [*rest, text_col][:kept]]).schema.add(lang_as, "string").add(score_as, "double")
    langs = sorted(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full((len(langs), _SIZE), -1, np.int64)
        for i, lang in enumerate(langs):
            place[i, profiles[lang]] = np.arange(len(profiles[lang]))
        for batch in _slices(batches):
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            best, score = [UNKNOWN] * len(texts), [0.0] * len(texts)

            def decide(i: int, ids: np.ndarray) -> None:
                if len(ids) and langs:
                    there = place[:, ids]
                    out = np.where(there < 0, PROFILE, np.minimum(np.abs(there - np.arange(len(ids))), PROFILE)).sum(axis=1)
                    k = int(out.argmin())
                    best[i], score[i] = langs[k], float(1 - out[k] / (PROFILE * len(ids)))

            long: dict[int, np.ndarray] = {}
            for i, grams in _grams(texts):
                if len(texts[i]) > _SLICE_CHARS:
                    long[i] = long.get(i, 0) + np.bincount(grams, minlength=_SIZE)
                else:
                    decide(i, _ranked(grams, None))
            for i, counts in long.items():
                decide(i, _ranked(None, counts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(best, pa.string()), pa.array(score, pa.float64())], schema.fieldNames())

    return docs.select(*[docs[c] for c in rest], docs[text_col]).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for the documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from those that aren't held out."""
    named = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    profiles = learn_profiles(named.filter(~held_out()))
    return predict_language(named.select("doc_id", held_out().alias("held_out"), "text"), profiles)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without those that no language fits; all other rows and columns as they are.

    Rejected are texts that are null or without letters, and those of ``ENOUGH`` characters or more whose score is below ``REJECT_BELOW``:
    most of their n-grams stand in no profile, as in other scripts or random letters. Where no row has a known language there is nothing to
    measure by: what has a letter stays.
    """
    profiles = learn_profiles(docs.filter(~held_out(id_col)), lang_col, id_col, text_col)
    if not profiles:
        return docs.filter(docs[text_col].rlike(r"\p{L}"))
    lang, score = free_name(docs, "found_lang"), free_name(docs, "found_score")
    found = predict_language(docs, profiles, text_col, lang, score, with_text=True)
    return found.filter((F.col(lang) != UNKNOWN) & ((F.col(score) >= REJECT_BELOW) | (F.length(found[text_col]) < ENOUGH))).select(*docs.columns)
