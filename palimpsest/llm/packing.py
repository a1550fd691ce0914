"""Bounded-space online best-fit packing of token sequences.

Documents are tokenized where they lie; only ids' lengths and digests (or the ids too, where asked for)
travel. Pieces are dealt at random to packers of about ``PIECES_PER_PACKER`` each. A packer reads its pieces
one by one: each goes to the open bin it fits best, found in a bitset with one bit for each free space in use;
if none has room, a bin is opened, and if that makes more than ``open_bins``, the fullest closes. So a packer's
memory is bounded by the open bins, and more packers share more pieces.

A document longer than the capacity is cut into full pieces; only its first piece may be shorter.

Defined results. A null text is empty: its only id is the end id. Repeated rows are packed as often as they
stand there. An empty table gives an empty result. Other columns take no part.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize

CAPACITY = 2048
OPEN_BINS = 8192
PIECES_PER_PACKER = 20_000


@functools.lru_cache(maxsize=2)
def load_tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizer's JSON file, with its added tokens."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    # the printable stand-ins of byte-level vocabularies: printable Latin-1 is itself, the rest follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def tokenize(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of each document."""
    schema = docs.select(docs[id_col].alias("doc_id")).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_tokenizer(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, piece, start, length, crc, out = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    # an added token that a text spells out is that token, as in the tokenizer's own library
                    spelt = text and any(x in text for x in encoding.special_tokens_set)
                    found = encoding.encode(text, allowed_special="all") if spelt else encoding.encode_ordinary(text or "")
                    ids = np.array([*found, end_id], "<u4")
                    first = (len(ids) - 1) % capacity + 1
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        raw = ids[a:b].tobytes()
                        row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(raw))
                        if with_ids:
                            out.append(raw)
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(out, pa.binary())] * with_ids, schema.fieldNames())

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


class OpenBins:
    """Open bins by free space: a bitset of the free spaces in use, and the bins of each."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.count, self.opened = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.bins[free]
        bin_ = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:
            self.bins[left].append(bin_)
            self.bits |= 1 << left
            self.count += 1
            if self.count > self.limit:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
        return bin_, self.capacity - free


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """``pieces`` (with doc_id, piece, start, length and ids_crc32) with sequence_id and offset added.

    A packer gets its pieces longest first, ties by their ids and digests: so it opens fewer bins than in the order of arrival, and one
    that is run again gives the same places.
    """
    pieces = materialize(pieces, "pieces")
    packers = max(1, -(-pieces.count() // per_packer))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    at = pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    key = F.xxhash64("doc_id", "piece", "start")
    dealt = pieces.repartition(packers, key).sortWithinPartitions(F.col("length").desc(), key, "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's pieces with the sequence and offset that each got."""
    return best_fit(tokenize(docs, path, pattern, capacity, end_id, with_ids, id_col, text_col), capacity)
