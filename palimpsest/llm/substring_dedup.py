"""Substring deduplication by relative Lempel-Ziv parsing of words.

The reference is the corpus itself: each document is factored relative to all that stands before it. The
reference is dealt over the cluster in blocks, by content: a segment is a run of words whose windows have one
anchor (the least of a window's word-grams, chosen by content alone, so equal windows have equal anchors), and
a block holds the segments of some anchors in the order of documents, as the codes of their words. Anchors
that occur once in the corpus are left out: what they lie in occurs once.

A block is indexed by its windows, each with its first place. Its segments are factored against that index: a
factor begins where a window is found and goes on as long as the windows after it are found right behind at
the same source. Each window is looked up, so a factor's boundary is checked by the windows that lie across
it; factors have a window's length at least and become the duplicate spans. Neighbouring factors of one source
are one span. Where a block would exceed ``BLOCK_ROWS`` segments, its anchor's segments lie in several blocks:
each is factored by itself, and of what it doesn't find, each window's first place goes on to be compared with
the other blocks'.

Anchors are sent once for each document, about one for ``(W + 1) / 2`` words; windows that a document repeats
itself are found where it lies, and only the first of them travels. Anchors are counted by map-side sums; one
of very many documents is split over tasks by its count. All look-ups are shuffles by hash and sorts that
spill; no group is gathered anywhere but a document's own places. Three passes read the texts.

Defined results. A null or empty text has no words: nothing is removed, and its kept text is empty. A document
without an id is kept whole and is no source. Rows that repeat an id count as that one document. Words are
compared by 32 bits of hash each, windows by 128 bits over these. An empty table gives an empty result; other
columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from . import _text as T
from ._store import discard, materialize

WORDS = 20
GRAM = 6
#: Segments in a block, and its bytes.
BLOCK_ROWS = 8192
BLOCK_BYTES = 1 << 20


def _codes(buf: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds of each document's words)."""
    start, end, bounds = T.words(buf, offsets)
    return T.span_hash(T.rolling(buf, seed), start, end), bounds


def _lows(codes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word-grams, the least gram of the window from each word on, whether that window lies in one document)."""
    grams = T.ngram_hash(codes, GRAM)
    low = T.sliding_min(grams, n - GRAM + 1)
    return grams, low, T.within(bounds, n)[: len(low)]


def anchors(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(anchor, doc_id): each document's different anchors."""
    schema = docs.select(F.lit(0).cast("long").alias("anchor"), "doc_id").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, buf, offsets in T.slices(batch, "text"):
                codes, bounds = _codes(buf, offsets)
                grams, low, ok = _lows(codes, bounds, n)
                if not ok.any():
                    continue
                # places that are the least of some window: one row for each document and anchor
                chosen = T.minimizers(grams, ok, n - GRAM + 1)
                doc, anchor = np.searchsorted(bounds, chosen, side="right") - 1, grams[chosen]
                order = np.lexsort((anchor, doc))
                doc, anchor = doc[order], anchor[order]
                new = np.append(True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]))
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([T.as_long(anchor[at]), batch.column(0).take(pa.array(first + doc[at]))], schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def repeated_anchors(found: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, anchors array<struct<anchor, parts>>): each document's anchors that other documents have too, and over how many parts each is dealt."""
    counts = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counts = materialize(counts.select("anchor", F.ceil(2 * F.col("n") / block_rows).cast("int").alias("parts")), "counts")
    both = found.join(counts, "anchor").groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "parts")).alias("anchors"))
    out = materialize(both, "anchors")
    discard(counts)
    return out


def own_repeats(codes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, first start), by document and start: windows that stand earlier in their own document; starts from 0 over all."""
    h, more = T.ngram_hash(codes, n), T.ngram_hash(codes, n, seed=1)
    at = np.flatnonzero(T.within(bounds, n)[: len(h)])
    if not len(at):
        return at, at, at
    doc = np.searchsorted(bounds, at, side="right") - 1
    order = np.lexsort((h[at], doc))  # stable: starts ascend among equals
    at, doc = at[order], doc[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[at[1:]] != h[at[:-1]]) | (more[at[1:]] != more[at[:-1]]))
    first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    doc, at, first = doc[~new], at[~new], first[~new]
    order = np.argsort(at, kind="stable")
    return doc[order], at[order], first[order]


def segments(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(anchor, part, parts, doc_id, start, codes): runs of windows that have one repeated anchor, with the codes of their words.

    Windows that stand earlier in their own document are left out. codes: 32 bits a word.
    """
    schema = docs.select(F.lit(0).cast("long").alias("anchor"), F.lit(0).alias("part"), F.lit(0).alias("parts"), "doc_id").schema.add("start", "long").add("codes", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            values = lists.values
            flat, parts = values.field("anchor").to_numpy().view(np.uint64), values.field("parts").to_numpy()
            for first, end, buf, offsets in T.slices(batch, "text"):
                codes, bounds = _codes(buf, offsets)
                _, low, ok = _lows(codes, bounds, n)
                if not len(low):
                    continue
                many = np.zeros(len(low), np.int32)
                for i in range(end - first):
                    a, b = bounds[i], min(bounds[i + 1], len(low))
                    if b > a:
                        own, some = flat[ends[first + i] : ends[first + i + 1]], parts[ends[first + i] : ends[first + i + 1]]
                        order = np.argsort(own)
                        at = order[np.minimum(np.searchsorted(own[order], low[a:b]), len(own) - 1)]
                        many[a:b] = np.where(own[at] == low[a:b], some[at], 0)
                ok &= many > 0
                ok[own_repeats(codes, bounds, n)[1]] = False
                start = np.flatnonzero(ok)
                if not len(start):
                    continue
                cut = np.flatnonzero((np.diff(start) != 1) | (low[start[1:]] != low[start[:-1]])) + 1
                begin, stop = start[np.append(0, cut)], start[np.append(cut - 1, len(start) - 1)] + n
                doc = np.searchsorted(bounds, begin, side="right") - 1
                part = np.where(many[begin] > 1, T.mix(codes[begin] + T.U64(1)) % many[begin].astype(np.uint64), 0).astype(np.int32)
                size = stop - begin
                ends_ = np.cumsum(size)
                place = np.repeat(begin, size) + np.arange(ends_[-1]) - np.repeat(ends_ - size, size)
                words = (codes[place] >> T.U64(32)).astype("<u4")
                data = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((np.append(0, ends_) * 4).astype(np.int32)), pa.py_buffer(words)])
                columns = [T.as_long(low[begin]), pa.array(part), pa.array(many[begin]), batch.column(0).take(pa.array(first + doc)), pa.array(begin - bounds[doc]), data]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return docs.select("doc_id", "text", "anchors").mapInArrow(run, schema)


class Block:
    """Segments of the reference and the index of their windows; segments come by document and start."""

    def __init__(self, table: pa.Table, n: int):
        codes = table.column("codes").combine_chunks()
        bounds = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1].astype(np.int64) // 4
        words = np.frombuffer(codes.buffers()[2], "<u4")[bounds[0] : bounds[-1]].astype(np.uint64)
        bounds = bounds - bounds[0]
        self.at = np.flatnonzero(T.within(bounds, n)[: max(0, len(words) - n + 1)])
        self.segment = np.searchsorted(bounds, self.at, side="right") - 1
        self.start = table.column("start").to_numpy()[self.segment] + self.at - bounds[self.segment]
        self.key, self.more = T.ngram_hash(words, n)[self.at], T.ngram_hash(words, n, seed=1)[self.at]
        order = np.lexsort((self.more, self.key))  # stable: of equal windows the first place comes first
        key, more = self.key[order], self.more[order]
        new = np.append(True, (key[1:] != key[:-1]) | (more[1:] != more[:-1])) if len(order) else np.zeros(0, bool)
        #: The first place of each window.
        self.first = np.empty(len(order), np.int64)
        self.first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        doc = table.column("doc_id").combine_chunks().dictionary_encode().indices.to_numpy()[self.segment]
        #: Windows with another place before them; one that rows of the same id hold at the same place is one.
        self.later = (doc != doc[self.first]) | (self.start != self.start[self.first])

    def factors(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, length in words): the greedy factors of all segments, each at the source ``first[place]``."""
        found = np.flatnonzero(self.later)
        if not len(found):
            return found, found
        source, segment = self.first[found], self.segment
        goes_on = (np.diff(found) == 1) & (segment[found[1:]] == segment[found[:-1]]) & (np.diff(source) == 1) & (segment[source[1:]] == segment[source[:-1]])
        begin = np.flatnonzero(np.append(True, ~goes_on))
        return found[begin], np.diff(np.append(begin, len(found))) + n - 1


def block_factors(found: DataFrame, n: int = WORDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, start, length, src_id, src_start): each segment's factors against the blocks of its anchor."""
    schema = found.select("doc_id").schema.add("start", "long").add("length", "long").add("src_id", found.schema["doc_id"].dataType).add("src_start", "long").add("h", "long").add("more", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, split in T.key_runs(batches, block_rows, BLOCK_BYTES):
            block = Block(table, n)
            doc = table.column("doc_id").combine_chunks()
            at, length = block.factors(n)
            source = block.first[at]
            ids = [doc.take(pa.array(block.segment[x])) for x in (at, source)]
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([ids[0], pa.array(block.start[at]), pa.array(length), ids[1], pa.array(block.start[source]), none, none], schema.fieldNames())
            # what lies in several blocks: first places go on
            open_ = (table.column("parts").to_numpy()[block.segment] > 1) | split
            at = np.flatnonzero(open_ & (block.first == np.arange(len(block.first))))
            if len(at):
                columns = [doc.take(pa.array(block.segment[at])), pa.array(block.start[at]), pa.array(np.full(len(at), n)), pa.nulls(len(at), doc.type), pa.nulls(len(at), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, T.as_long(block.key[at]), T.as_long(block.more[at])], schema.fieldNames())

    dealt = found.repartition("anchor", "part").sortWithinPartitions("anchor", "doc_id", "start")
    return dealt.mapInArrow(run, schema)


def factors(docs: DataFrame, n: int = WORDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, factors array<struct<start, length, src_id, src_start>>): for each document with any, its factors against the blocks."""
    known = docs.filter("doc_id is not null").select("doc_id", "text")
    chosen = materialize(anchors(known, n), "chosen")
    shared = repeated_anchors(chosen, block_rows)
    discard(chosen)
    found = materialize(block_factors(segments(known.join(shared, "doc_id"), n), n, block_rows), "found")
    discard(shared)
    across = found.filter("h is not null").select("h", "more", "doc_id", "start", "length")
    first = materialize(across.groupBy("h", "more").agg(F.min(F.struct("doc_id", "start")).alias("src")), "first")
    across = across.join(first, ["h", "more"]).filter("src.doc_id <> doc_id or src.start <> start")
    every = found.filter("h is null").select("doc_id", "start", "length", "src_id", "src_start").union(across.select("doc_id", "start", "length", "src.doc_id", "src.start"))
    out = materialize(every.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "src_id", "src_start")).alias("factors")), "factors")
    discard(found, first)
    return out


def parse(start: np.ndarray, length: np.ndarray, source: np.ndarray, src_start: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The spans (start, length, source, source start) of one document: its factors in order, those that go on at the same source as one."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, end, source, shift = start[order], (start + length)[order], source[order], (src_start - start)[order]
    cut = np.flatnonzero((source[1:] != source[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] > np.maximum.accumulate(end)[:-1])) + 1
    begin, last = np.append(0, cut), np.append(cut, len(start))
    return [(int(start[a]), int(end[a:b].max() - start[a]), source[a], int(start[a] + shift[a])) for a, b in zip(begin, last)]


def remove_copies(docs: DataFrame, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text", with_factors: bool = True, with_text: bool = True, carry: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, kept_sha256, and if asked for factors, kept_text and carried columns.

    factors: array<struct<start, length, src_id, src_start>> in words, the duplicate spans with their sources.
    Carried columns come last, as carried_0, carried_1, ...
    """
    carried = [docs[c].alias(f"carried_{i}") for i, c in enumerate(carry)]
    named = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *carried)
    found = factors(named, n, block_rows)
    joined = named.join(found, "doc_id", "left").select("doc_id", "text", "factors", *[f"carried_{i}" for i in range(len(carry))])
    schema = named.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if with_factors:
        item = StructType().add("start", "integer").add("length", "integer").add("src_id", named.schema["doc_id"].dataType).add("src_start", "integer")
        schema = schema.add("factors", ArrayType(item))
    if with_text:
        schema = schema.add("kept_text", "string")
    for i in range(len(carry)):
        schema = schema.add(named.schema[f"carried_{i}"])

    def repeats_of(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each row the factors (start, length, source start) that stand earlier in the row itself."""
        for first, end, buf, offsets in T.slices(part, "text"):
            codes, bounds = _codes(buf, offsets)
            doc, start, source = own_repeats(codes, bounds, n)
            start, source = start - bounds[doc], source - bounds[doc]
            cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(start) != 1) | (np.diff(source) != 1)) + 1
            begin = np.append(0, cut) if len(doc) else cut
            length = np.diff(np.append(begin, len(doc))) + n - 1
            doc, start, source = doc[begin], start[begin], source[begin]
            cuts = np.searchsorted(doc, np.arange(end - first + 1))
            for a, b in zip(cuts, cuts[1:]):
                yield start[a:b], length[a:b], source[a:b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[], [], [], [], []]
                for doc_id, text, copied, (start, length, src_start) in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), repeats_of(part)):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    total, spans = len(words), []
                    if doc_id is not None and (len(start) or copied.is_valid):
                        src_id = np.full(len(start), doc_id, object if isinstance(doc_id, str) else None)
                        if copied.is_valid:
                            own = copied.values
                            start, length, src_start = (np.concatenate([own.field(k).to_numpy(), x]) for k, x in (("start", start), ("length", length), ("src_start", src_start)))
                            src_id = np.concatenate([own.field("src_id").to_numpy(zero_copy_only=False), src_id])
                        spans = parse(start, length, src_id, src_start)
                        covered = np.zeros(total + 1, np.int64)
                        for begin, size, _, _ in spans:  # rows that repeat an id may hold fewer words
                            covered[min(begin, total)] += 1
                            covered[min(begin + size, total)] -= 1
                        words = list(compress(words, (np.cumsum(covered[:-1]) == 0).tolist()))
                    removed = total - len(words)
                    kept = b" ".join(words)
                    for column, value in zip(out, (total, removed, hashlib.sha256(kept).hexdigest(), spans, kept)):
                        column.append(value)
                columns = [part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
                if with_factors:
                    item = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("src_id", part.column(0).type), ("src_start", pa.int32())])
                    columns.append(pa.array([[dict(zip(("start", "length", "src_id", "src_start"), s)) for s in spans] for spans in out[3]], pa.list_(item)))
                if with_text:
                    columns.append(pa.array(out[4], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*columns, *part.columns[3:]], schema.fieldNames())

    return joined.mapInArrow(run, schema)


def digest(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    return remove_copies(docs, n, with_factors=False, with_text=False)


def cut_copies(docs: DataFrame, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with what is kept of each text (words joined by one blank), and its length where a column holds it."""
    rest = tuple(c for c in docs.columns if c != text_col)
    found = remove_copies(docs, n, id_col, text_col, with_factors=False, carry=rest)
    columns = {c: F.col(f"carried_{i}").alias(c) for i, c in enumerate(rest)} | {text_col: F.col("kept_text").alias(text_col)}
    if length_col:
        columns[length_col] = F.length("kept_text").cast(docs.schema[length_col].dataType).alias(length_col)
    return found.select(*[columns[c] for c in docs.columns])
