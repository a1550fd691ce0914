"""Periodic runs of words: power-of-two naming (Karp, Miller, Rosenberg) with candidates on grids.

A run is a stretch of words that repeats with some least period and that no neighbouring word extends. Each
stretch of 2**j words of a document gets a name, equal for equal stretches: level 0 names words, level j + 1
the pairs of names of level j that stand 2**j apart, by sorting these pairs. Stretches that stand alone in
their document are left without a name, as nothing can be equal to them or to what holds them; in prose
nearly all are dropped within a few levels. The longest common extension of two places is read off by
descending the levels, to the right and to the left, so there are neither hashes nor sorted suffixes.

For each period q the places 0, q, 2q ... are a grid. A run of exponent 2 or more has a place of the grid
in its first q words whose next words come again q later, for as long as the run demands; one comparison of
names of that length tells. Of a run's grid places only the first is extended. A stretch found with several
periods keeps the least, which divides the others.

Each document is worked on by itself, whole, many documents at once in NumPy; nothing is shuffled.
Names of a batch take 4 bytes a word and level, at most ``TOP + 1`` levels; longer extensions take the top
level in repeated steps.

Defined results. A null text, and one without words, has no runs and collapses to an empty text. A null id is
kept. Repeated rows give repeated results; other columns of the input, whatever their names, take no part; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ._text import slices, words

#: Names are given to stretches of up to 2**TOP words.
TOP = 16
#: Grid places that are looked at together.
CHUNK = 1 << 21

RUNS = ArrayType(StructType().add("start", "long").add("length", "long").add("period", "long"))


def packed_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the words alone, one after another."""
    length = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    mark = np.zeros(len(buf) + 1, np.int8)
    mark[start] += 1
    np.subtract.at(mark, end, 1)
    return buf[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)], offsets


def numbered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes."""
    array = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return array.dictionary_encode().indices.to_numpy().astype(np.int64)


def name_levels(codes: np.ndarray, bounds: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """(names, tops): names[j, i] is that of the 2**j words from place i on; tops[d] the last level with names in document d.

    A place without a name has a negative number of its own; so has the place behind the last word.
    """
    total = len(codes)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    tops = np.full(len(bounds) - 1, -1)
    alone = -1 - np.arange(total + 1, dtype=np.int32)
    at, key = np.arange(total), doc * (int(codes.max(initial=0)) + 1) + codes
    levels = []
    while len(at):
        _, name, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[name] > 1
        row = alone.copy()
        row[at[again]] = name[again]
        at = at[again]
        levels.append(row)
        tops[doc[at]] = len(levels) - 1
        if len(levels) > top:
            break
        step = 1 << (len(levels) - 1)
        at = at[at + step < total]
        at = at[(row[at + step] >= 0) & (doc[at + step] == doc[at])]
        key = row[at].astype(np.int64) * (total + 1) + row[at + step]
    return np.array(levels if levels else [alone]), tops


def extend(names: np.ndarray, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from a and b on (or, back, before them) are equal, by descending levels; a < b in one document."""
    k = np.zeros(len(a), np.int64)
    for j in range(len(names) - 1, -1, -1):
        step, live = 1 << j, np.arange(len(a))
        while len(live):
            x, y = (a[live] - k[live] - step, b[live] - k[live] - step) if back else (a[live] + k[live], b[live] + k[live])
            # -1 is the place behind the last word; only a place before the first word is sent there
            live = live[(x >= 0) & (names[j, np.maximum(x, -1)] == names[j, np.maximum(y, -1)])]
            k[live] += step
            if j < len(names) - 1:
                break
    return k


def _grid(bounds: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, period) for the periods 1 .. most[d] of each document and all places of their grids, in chunks."""
    size = np.diff(bounds)
    doc = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    places = np.maximum((size[doc] - 1) // np.maximum(period, 1), 0)
    upto = np.cumsum(places)
    first = 0
    while first < len(doc):
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + CHUNK, side="right")))
        n = places[first:last]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        d, q = np.repeat(doc[first:last], n), np.repeat(period[first:last], n)
        yield d, bounds[d] + nth * q, q
        first = last


def find_runs(codes: np.ndarray, bounds: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs of at least ``least`` words and ``exponent`` periods, by document, start, period; starts count from bounds[0]."""
    names, tops = name_levels(codes, bounds)
    size = np.diff(bounds)
    longest = int(size.max(initial=0)) // exponent
    q = np.arange(longest + 2)
    # the first grid place of a run goes on for so many words at least
    sure = np.maximum(least, exponent * q) - 2 * q + 1
    level = np.minimum(np.frexp(np.maximum(sure, 1))[1] - 1, TOP)
    level = np.minimum.accumulate(level[::-1])[::-1]
    # periods whose level a document has no names for have no run in it
    most = np.minimum(np.where(size >= least, size // exponent, 0), np.searchsorted(level[1:], tops, side="right"))
    half = np.minimum(np.frexp(np.maximum(q, 1))[1] - 1, len(names) - 1)
    found = []
    for d, i, p in _grid(bounds, most):
        lv = level[p]
        hit = np.flatnonzero(names[lv, i] == names[lv, i + p])
        d, i, p = d[hit], i[hit], p[hit]
        # the grid place before it belongs to the same run if the p words between come again p later: two names overlap over them
        h = half[p]
        prev = np.maximum(i - p, -1)
        same = (i - p >= bounds[d]) & (p < 2 << h) & (names[h, prev] == names[h, i]) & (names[h, i - (1 << h)] == names[h, i + p - (1 << h)])
        d, i, p = d[~same], i[~same], p[~same]
        left = extend(names, i, i + p, back=True)
        length = p + left + extend(names, i, i + p)
        ok = length >= np.maximum(least, exponent * p)
        found.append(np.stack([d, i - left, length, p])[:, ok])
    runs = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    d, start, length, p = runs[:, np.lexsort((runs[3], runs[2], runs[1]))]
    first = np.ones(len(d), bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(length) != 0)
    d, start, length, p = d[first], start[first], length[first], p[first]
    order = np.lexsort((p, start))
    return d[order], start[order], length[order], p[order]


def kept_text(data: np.ndarray, offsets: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of documents): the kept words of each document joined by one blank."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[keep]
    length = np.diff(offsets)[keep]
    blank = np.zeros(len(doc), np.int64)
    blank[1:] = doc[1:] == doc[:-1]
    end = np.cumsum(length + blank)
    out = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    held = data[np.repeat(keep, np.diff(offsets))]
    out[np.arange(len(held)) + np.repeat(np.cumsum(blank), length)] = held
    upto = np.searchsorted(doc, np.arange(len(bounds)))
    return out, np.concatenate([[0], end])[upto]


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, runs (start, length, period, in this order) and collapsed, the text without repetitions.

    A run has at least ``least`` words and ``exponent`` (2 or more) periods. Collapsed is the text's words but for
    those that some run holds after its first period, joined by one blank.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    schema = docs.select(docs[id_col].alias("doc_id")).schema.add("n_words", "long").add("runs", RUNS).add("collapsed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for first, end, buf, edges in slices(batch, "text"):
                start, stop, bounds = words(buf, edges)
                data, offsets = packed_words(buf, start, stop)
                d, at, length, period = find_runs(numbered(data, offsets), bounds, least, exponent)
                mark = np.zeros(len(start) + 1, np.int64)
                np.add.at(mark, at + period, 1)
                np.subtract.at(mark, at + length, 1)
                text, upto = kept_text(data, offsets, bounds, np.cumsum(mark[:-1]) == 0)
                rows = pa.StructArray.from_arrays([pa.array(x) for x in (at - bounds[d], length, period)], fields=list(kind))
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(end - first + 1)).astype(np.int32)), rows)
                texts = pa.Array.from_buffers(pa.large_string(), end - first, [None, pa.py_buffer(upto), pa.py_buffer(text)])
                columns = [batch.column(0).slice(first, end - first), pa.array(np.diff(bounds)), runs, texts.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h the checksum of the id, one document in ten (h % 10 = 0) has its words from a on repeated with period p.

    a is floor(h / 10) modulo the number of words n, p is 1 + floor((n - a) / (3 + floor(h / 10) % 8)). A null id plants nothing.
    """
    listed = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    g, n = F.expr("crc32(cast(doc_id AS string)) div 10"), F.size("w")
    a = F.pmod("g", n)
    p = F.lit(1) + F.expr("(size(w) - a) div (3 + g % 8)")
    chosen = (F.expr("crc32(cast(doc_id AS string)) % 10") == 0) & F.col("text").isNotNull()
    base = docs.select("doc_id", "text", F.when(chosen, listed).alias("w"), g.alias("g"))
    base = base.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    cycle = F.expr("array_join(transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE element_at(w, CAST(1 + a + (i - a) % p AS int)) END), ' ')")
    return base.select("doc_id", F.when(F.col("a").isNotNull(), cycle).otherwise(F.col("text")).alias("text"))


def sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the longest run, runs_sha256, collapsed_sha256 of the planted documents."""
    found = periodic_runs(planted(docs))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"), "n_words")
    length = -F.col("best.less")
    milli = F.expr("(1000 * -best.less) div best.period")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
