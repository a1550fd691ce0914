"""Suffix-array deduplication in the manner of the difference-cover algorithm, distributed.

The suffixes of all documents' bytes are ordered only as far as repeats of ``length`` bytes can be told:

1. Sample. As in a difference cover, a sample of suffixes is taken such that from every place of a repeat a
   sampled suffix lies at the same distance in all its copies. The sample is chosen by content (the least
   hashed gram of each window), which holds across documents where places modulo a number don't; about one
   suffix in ``W / 2`` is sampled.
2. Sort sampled triples, recurse on names. A sampled suffix is named by the triple of names of its thirds,
   those by the triples of theirs, down to three bytes; 3 ** 5 = 243 bytes are named so. The sampled suffixes
   are dealt out and sorted by name; a suffix whose name no neighbour shares repeats nothing and leaves.
3. Merge the remaining suffixes. The suffixes between samples stand before a named one: those with the same
   name and distance are ordered by what precedes the sample and what follows the named part.
4. Compare adjacent prefixes. Neighbours in that order that agree on ``length`` bytes are repeats. Their
   spans are joined per document.

Names are hashes of 128 bits in place of ranks: equal prefixes have equal names without a global numbering.
Neighbours are compared by the names of what they share and by the bytes of the rest.

Sorts are Spark's and spill. A name's suffixes are read in sorted order and merged in runs of at most
``RUN_ROWS``; a name of very many documents is dealt over tasks by its count (map-side sums). Where a name has
several runs, each of a run's different windows is sent on by 128 bits of hash and compared across runs, so no
group, however large, is gathered.

Defined results. A null text is empty. A document without an id is kept whole and meets no other. Rows that
repeat an id count as that one document. An empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import discard, materialize

LENGTH = 400
NAMED = 3**5
GRAM = 64
RUN_ROWS = 8192
#: Merged at a time, so that a task's arrays stay small.
MERGE_BYTES = 1 << 19


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray, level: int) -> np.ndarray:
    return T.mix(a * np.uint64(0x9E3779B97F4A7C15) + T.mix(b + np.uint64(level)) + c * np.uint64(0xC2B2AE3D27D4EB4F))


def names(buf: np.ndarray, sample: np.ndarray, seed: int = 0) -> np.ndarray:
    """Names (64 bits of them for each seed) of the ``NAMED`` bytes from each sampled place on: triples of bytes first, then triples of names."""
    codes = T._CODES[seed][buf]
    named = _triple(codes[:-2], codes[1:-1], codes[2:], 1)[sample[:, None] + np.arange(0, NAMED, 3)]
    level = 2
    while named.shape[1] > 1:
        named = _triple(named[:, 0::3], named[:, 1::3], named[:, 2::3], level)
        level += 1
    return named[:, 0]


def _samples(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sample, nearest start, farthest start, document): the sampled places with the suffixes that lie before them.

    The suffix from s on belongs to the first least gram in [s, s + W). Those of one sample are one run of s.
    """
    w = length - NAMED + 1
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none
    sums = T.rolling(buf)
    at = np.arange(len(buf) - GRAM + 1)
    grams = T.span_hash(sums, at, at + GRAM)
    low = T.sliding_min(grams, w)
    ok = T.within(offsets, length)[: len(low)]
    starts = np.flatnonzero(ok)
    if not len(starts):
        return none, none, none, none
    # first place of the window's least gram: the next minimizer whose gram it is
    places = T.minimizers(grams, ok, w)
    k = np.searchsorted(places, starts)
    sample = places[k]
    wrong = np.flatnonzero(grams[sample] != low[starts])
    while len(wrong):
        k[wrong] += 1
        sample[wrong] = places[k[wrong]]
        wrong = wrong[grams[sample[wrong]] != low[starts[wrong]]]
    cut = np.flatnonzero((np.diff(sample) != 0) | (np.diff(starts) != 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]]) - 1
    sample = sample[first]
    return sample, starts[last], starts[first], np.searchsorted(offsets, sample, side="right") - 1


def sample_names(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(name, doc_id, times): each document's different names of sampled suffixes, and how often each stands there."""
    schema = docs.select(F.lit(0).cast("long").alias("name"), "doc_id").schema.add("times", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, buf, offsets in T.slices(batch, "text"):
                sample, _, _, doc = _samples(buf, offsets, length)
                if not len(sample):
                    continue
                name = names(buf, sample)
                order = np.lexsort((name, doc))
                doc, name = doc[order], name[order]
                at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])))
                times = np.diff(np.append(at, len(doc)))
                yield pa.RecordBatch.from_arrays([T.as_long(name[at]), batch.column(0).take(pa.array(first + doc[at])), pa.array(times)], schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def shared_names(found: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """(doc_id, names array<struct<name, parts>>): names that a neighbour in sorted order shares, and over how many parts each is dealt."""
    counts = found.groupBy("name").agg(F.sum("times").alias("n")).filter("n > 1")
    counts = materialize(counts.select("name", F.ceil(2 * F.col("n") / run_rows).cast("int").alias("parts")), "counts")
    out = materialize(found.join(counts, "name").groupBy("doc_id").agg(F.collect_set(F.struct("name", "parts")).alias("names")), "names")
    discard(counts)
    return out


def contexts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(name, more, part, parts, doc_id, start, ahead, count, near): for each sampled suffix with a shared name, the count suffixes before it.

    start: where the first of them begins, ahead: how far from the sample; near: the bytes before the sample and after its named part that
    they reach, one run of count + length - NAMED - 1 bytes in which each suffix is known by length - NAMED.
    """
    zero = F.lit(0).cast("long")
    schema = docs.select(zero.alias("name"), zero.alias("more"), F.lit(0).alias("part"), F.lit(0).alias("parts"), "doc_id").schema.add("start", "long").add("ahead", "integer").add("count", "integer").add("near", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends, values = lists.offsets.to_numpy(), lists.values
            flat, parts = values.field("name").to_numpy().view(np.uint64), values.field("parts").to_numpy()
            for first, _, buf, offsets in T.slices(batch, "text"):
                sample, near, far, doc = _samples(buf, offsets, length)
                if not len(sample):
                    continue
                name = names(buf, sample)
                many = np.zeros(len(sample), np.int32)
                bounds = np.searchsorted(doc, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    a, b = bounds[i], bounds[i + 1]
                    if b > a:
                        own, some = flat[ends[first + i] : ends[first + i + 1]], parts[ends[first + i] : ends[first + i + 1]]
                        order = np.argsort(own)
                        at = order[np.minimum(np.searchsorted(own[order], name[a:b]), len(own) - 1)]
                        many[a:b] = np.where(own[at] == name[a:b], some[at], 0)
                sample, near, far, doc, name, many = (x[many > 0] for x in (sample, near, far, doc, name, many))
                if not len(sample):
                    continue
                # a name of many parts is dealt arbitrarily; what is found doesn't depend on it
                part = np.where(many > 1, T.mix(T._CODES[1][buf[far]] * T.U64(3) + sample.astype(np.uint64)) % many.astype(np.uint64), 0).astype(np.int32)
                # bytes far .. sample and sample + NAMED .. near + length, gathered at once
                left, right = sample - far, near + length - sample - NAMED
                size = left + right
                ends_ = np.cumsum(size)
                k = np.arange(ends_[-1]) - np.repeat(ends_ - size, size)
                place = np.repeat(far, size) + k + np.where(k >= np.repeat(left, size), NAMED, 0)
                data = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, ends_).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf[place]))])
                columns = [T.as_long(name), T.as_long(names(buf, sample, 1)), pa.array(part), pa.array(many), batch.column(0).take(pa.array(first + doc)), pa.array(far - offsets[doc]), pa.array((sample - far).astype(np.int32)), pa.array((near - far + 1).astype(np.int32)), data]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return docs.select("doc_id", "text", "names").mapInArrow(run, schema)


def _alike(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` bytes (8 or more) from a and from b on are equal."""
    eight = np.ndarray(max(0, len(buf) - 7), "<u8", buffer=buf, strides=(1,))
    same = np.ones(len(a), bool)
    for k in [*range(0, size - 7, 8), size - 8]:
        same &= eight[a + k] == eight[b + k]
    return same


class Merged:
    """Every suffix of some sampled suffixes' contexts, in an order in which equal prefixes are neighbours."""

    def __init__(self, table: pa.Table, length: int):
        near = table.column("near").combine_chunks()
        offsets = np.frombuffer(near.buffers()[1], np.int32)[near.offset : near.offset + len(near) + 1].astype(np.int64)
        buf = np.ascontiguousarray(np.frombuffer(near.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
        name, more = (table.column(c).to_numpy().view(np.uint64) for c in ("name", "more"))
        count, beyond = table.column("count").to_numpy().astype(np.int64), length - NAMED
        row = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at, start = (offsets[:-1] - offsets[0])[row] + step, table.column("start").to_numpy()[row] + step
        distance = (table.column("ahead").to_numpy().astype(np.int64)[row] - step).astype(np.uint64)
        sums = T.rolling(buf)
        key = T.mix(T.span_hash(sums, at, at + beyond) ^ T.mix(name[row] + distance))
        order = np.argsort(key, kind="stable")
        self.row, self.start, self.key = row[order], start[order], key[order]
        at, distance = at[order], distance[order]
        #: Whether a suffix has the same ``length`` bytes as the one before it: the same name at the same distance, and equal bytes beside it.
        same = self.key[1:] == self.key[:-1]
        k = np.flatnonzero(same)
        a, b = self.row[k], self.row[k + 1]
        same[k] = (name[a] == name[b]) & (more[a] == more[b]) & (distance[k] == distance[k + 1]) & _alike(buf, at[k], at[k + 1], beyond)
        self.same = same
        self._sums = lambda at_: T.span_hash(T.rolling(buf, 1), at_, at_ + beyond)
        self._at, self._more, self._distance = at, more, distance

    def second_key(self, some: np.ndarray) -> np.ndarray:
        """64 more bits of hash of some suffixes' prefixes."""
        return T.mix(self._sums(self._at[some]) ^ T.mix(self._more[self.row[some]] + self._distance[some]))


def repeats(found: DataFrame, length: int = LENGTH, run_rows: int = RUN_ROWS) -> DataFrame:
    """(doc_id, start, end): spans of bytes covered by repeats."""
    schema = found.select("doc_id").schema.add("start", "long").add("end", "long").add("key", "long").add("more", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, split in T.key_runs(batches, run_rows, MERGE_BYTES):
            merged = Merged(table, length)
            row, start, same = merged.row, merged.start, merged.same
            doc = table.column("doc_id").combine_chunks()
            code = doc.dictionary_encode().indices.to_numpy().astype(np.int64)
            # a place met twice (rows that repeat an id) is one
            other = same & ((code[row[1:]] != code[row[:-1]]) | (start[1:] != start[:-1]))
            group = np.cumsum(np.append(True, ~same)) - 1
            hit = (np.bincount(group[1:][other], minlength=group[-1] + 1) > 0)[group]
            # the suffixes of a row that repeat overlap: one span
            low, high = np.full(len(doc), np.iinfo(np.int64).max), np.full(len(doc), -1)
            np.minimum.at(low, row[hit], start[hit])
            np.maximum.at(high, row[hit], start[hit] + length)
            rows = np.flatnonzero(high >= 0)
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(rows)), pa.array(low[rows]), pa.array(high[rows]), none, none], schema.fieldNames())
            # the rest of the name is elsewhere: each different suffix goes on by its key
            open_ = (table.column("parts").to_numpy()[row] > 1) | split
            first = np.flatnonzero(np.append(True, ~same) & open_)
            if len(first):
                columns = [doc.take(pa.array(row[first])), pa.array(start[first]), pa.array(start[first] + length), T.as_long(merged.key[first]), T.as_long(merged.second_key(first))]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    merged = materialize(found.repartition("name", "part").sortWithinPartitions("name").mapInArrow(run, schema), "repeats")
    across = merged.filter("key is not null")
    place = F.struct("doc_id", "start")
    ends = across.groupBy("key", "more").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high")
    across = across.join(materialize(ends.select("key", "more"), "across"), ["key", "more"])
    return merged.filter("key is null").select("doc_id", "start", "end").unionByName(across.select("doc_id", "start", "end"))


def spans(docs: DataFrame, length: int = LENGTH, run_rows: int = RUN_ROWS) -> DataFrame:
    """(doc_id, spans array<struct<start, end>>): what repeats cover of each document, ascending, not yet joined."""
    known = docs.filter("doc_id is not null").select("doc_id", "text")
    sampled = materialize(sample_names(known, length), "sampled")
    shared = shared_names(sampled, run_rows)
    discard(sampled)
    found = repeats(contexts(known.join(shared, "doc_id"), length), length, run_rows)
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_content: bool = True, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for."""
    named = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    found = materialize(spans(named, length, run_rows), "spans")
    schema = named.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if with_content:
        schema = schema.add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[], [], [], [], []]
                for text, own in zip(part.column(1).to_pylist(), part.column(2)):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    kept, reached, removed, n = [], 0, 0, 0
                    if own.is_valid and len(own):
                        start, end = own.values.field("start").to_numpy(), np.maximum.accumulate(own.values.field("end").to_numpy())
                        cut = np.flatnonzero(start[1:] > end[:-1]) + 1
                        for a, b in zip(start[np.append(0, cut)].tolist(), end[np.append(cut - 1, len(end) - 1)].tolist()):
                            kept.append(raw[reached:a])
                            reached, removed, n = b, removed + min(b, len(raw)) - a, n + 1
                    kept.append(raw[reached:])
                    content = b"".join(kept)
                    for column, value in zip(out, (len(raw), removed, n, hashlib.sha256(content).hexdigest(), content)):
                        column.append(value)
                columns = [part.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(out[4], pa.binary())] * with_content, schema.fieldNames())

    return named.join(found, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    return remove_repeats(docs, length, with_content=False)
