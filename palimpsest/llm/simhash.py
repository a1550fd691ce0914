"""SimHash near-dedup by pivot distance tables.

Each document has a 64-bit fingerprint; different fingerprints are few rows however often a text is copied.
A table holds each fingerprint's Hamming distances to fixed reference fingerprints (pivots). By the triangle
inequality two fingerprints within ``most`` bits differ by no more than ``most`` in any coordinate.

The pivots are a base and, for each of ``most + 2`` blocks of bits, references that differ from the base within that block
only: distance to such a reference less distance to the base depends on the block alone. Two fingerprints within
``most`` bits have two blocks in common, so for some two blocks all these differences are equal: they are the join
key. Rows with one key meet in one task, sorted by their distance to the base; rows further apart there than ``most``
are not looked at, pairs with a greater difference in any coordinate are discarded, and the survivors are verified
on the fingerprints. Only links that join something new leave the task.

A key of more than ``LIMIT`` fingerprints is open: its fingerprints are dealt anew with the bits of the two blocks added to the key
(these are what the distances to references one bit off the base tell) and two of four smaller blocks of the other
bits. After at most three such steps no bits are left to differ by, so that a group is bounded whatever the data are, and no pair is lost.

Defined results. Null texts and texts without words have fingerprint zero, linked like any other. Rows with a null id
take part; they don't count for the least id, and where no other row is reached component_id is null. Repeated rows
give repeated results; other columns of the input, whatever their names, take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize
from ._text import LOWER, key_runs, slices, words
from .components import connected_components
from .periodic import kept_text, packed_words

WORDS = 3
SEED = 42
#: Fingerprints of a key that meet in one task; keys of more are dealt anew.
LIMIT = 1024
#: References in each block of the first table; smaller blocks have one for each bit.
REFERENCES = 8
RUN_ROWS, RUN_BYTES = 200_000, 32 << 20
_LANES = np.uint64(0x0101010101010101)


def bit_majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each document d the 64 bits that are set in over half of h[bounds[d]:bounds[d + 1]]; zero without any."""
    size = np.diff(bounds)
    blocks = -(-size // 255)
    nth = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = np.repeat(bounds[:-1], blocks) + 255 * nth
    some = np.flatnonzero(blocks)
    first = (np.cumsum(blocks) - blocks)[some]
    out = np.zeros(len(size), np.uint64)
    for bit in range(8 if len(h) else 0):
        # the lanes of a 64-bit sum of 255 hashes hold eight counts at once
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, at).view(np.uint8).reshape(-1, 8)
        count = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        over = (2 * count > size[some, None]).astype(np.uint64)
        out[some] |= np.bitwise_or.reduce(over << np.arange(bit, 64, 8, dtype=np.uint64), axis=1)
    return out


def fingerprints(docs: DataFrame, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): one row per row; a fingerprint's bits as of a signed number."""
    schema = docs.select(docs[id_col].alias("doc_id")).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for first, end, buf, edges in slices(batch, "text"):
                start, stop, bounds = words(buf, edges)
                data, offsets = packed_words(LOWER[buf], start, stop)
                text, _ = kept_text(data, offsets, bounds, np.ones(len(start), bool))
                size = np.diff(bounds)
                # where words stand in the joined text: a blank before each but a document's first
                blank = np.ones(len(start), np.int64)
                blank[bounds[:-1][size > 0]] = 0
                begin = offsets[:-1] + np.cumsum(blank)
                close = begin + np.diff(offsets)
                shingles = np.where(size >= n, size - n + 1, np.minimum(size, 1))
                own = np.zeros(len(size) + 1, np.int64)
                np.cumsum(shingles, out=own[1:])
                doc = np.repeat(np.arange(len(size)), shingles)
                head = bounds[doc] + np.arange(len(doc)) - own[doc]
                tail = head + np.minimum(size[doc], n) - 1
                view = memoryview(text)
                h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(begin[head].tolist(), close[tail].tolist())), np.uint64, len(doc))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(bit_majority(h, own).view(np.int64))], ["doc_id", "fp"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks_of(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` dealt into n blocks, nearly equal and in order."""
    return [[int(x) for x in part] for part in np.array_split(bits, n)]


def pivot_base() -> int:
    return int(np.random.default_rng(SEED).integers(0, 1 << 63)) << 1 | 1


def references(block: list[int]) -> list[int]:
    """Masks within a block: by these its references differ from the base. Half the bits each, or each bit of a small block."""
    if len(block) <= REFERENCES:
        return [1 << b for b in block]
    rng = np.random.default_rng([SEED, *block])
    return [sum(1 << int(b) for b in rng.choice(block, len(block) // 2, replace=False)) for _ in range(REFERENCES)]


def coordinate(pivot: int) -> Column:
    """The distance of fp to a pivot."""
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(pivot))))


def dealt(distinct: DataFrame, most: int) -> DataFrame:
    """(key, choice, fp): each fingerprint under each choice of two blocks, the key being the differences of its table there."""
    blocks = blocks_of(list(range(64)), most + 2)
    base = pivot_base()
    table = distinct.select("fp", *[(coordinate(base ^ m) - coordinate(base)).cast("byte").alias(f"c{j}_{r}") for j, block in enumerate(blocks) for r, m in enumerate(references(block))])
    keys = []
    for k, (i, j) in enumerate(combinations(range(most + 2), 2)):
        chosen = [c for c in table.columns if c.startswith((f"c{i}_", f"c{j}_"))]
        keys.append(F.struct(F.xxhash64(F.lit(k), *chosen).alias("key"), F.array(F.lit(k)).alias("choice")))
    return table.select("fp", F.explode(F.array(*keys)).alias("x")).select("x.key", "x.choice", "fp")


def fixed_bits(choice: tuple[int, ...], most: int) -> tuple[int, list[int]]:
    """(mask of the bits in the chosen blocks, the other bits), a choice of two blocks of those left at each level."""
    free, mask = list(range(64)), 0
    for k in choice:
        blocks = blocks_of(free, most + 2)
        i, j = list(combinations(range(most + 2), 2))[k]
        mask |= sum(1 << b for b in blocks[i] + blocks[j])
        free = [b for x, block in enumerate(blocks) if x not in (i, j) for b in block]
    return mask, free


def refined(open_rows: DataFrame, depth: int, most: int) -> DataFrame:
    """(key, choice, fp) of the rows of open keys, one level deeper: the bits of all blocks chosen so far are the key."""
    n = (most + 2) * (most + 1) // 2
    levels = [[]]
    for _ in range(depth + 2):
        levels = [[*c, k] for c in levels for k in range(n)]
    masks = F.array(*[F.lit(signed(fixed_bits(tuple(c), most)[0])) for c in levels])
    deeper = open_rows.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.concat("choice", F.array(k)))).alias("choice"))
    number = F.aggregate("choice", F.lit(0), lambda at, k: at * n + k)
    bits = F.col("fp").bitwiseAND(F.element_at(masks, number + 1))
    return deeper.select(F.xxhash64("choice", bits).alias("key"), "choice", "fp").distinct()


def pivot_table(fp: np.ndarray, most: int) -> np.ndarray:
    """The distances of each fingerprint to all pivots of the first table."""
    base = pivot_base()
    pivots = [base, *[base ^ m for block in blocks_of(list(range(64)), most + 2) for m in references(block)]]
    return np.stack([np.bitwise_count(fp ^ np.uint64(p)) for p in pivots]).astype(np.int8)


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` (least row of each component, compressed) with the links a-b added."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (labels[labels] != labels).any():
            labels = labels[labels]


def group_links(key: np.ndarray, fp: np.ndarray, most: int) -> np.ndarray:
    """labels: for each row the first row of its key that links within ``most`` bits lead to. Rows ascend by key, then by distance to the base."""
    table = pivot_table(fp, most)
    labels = np.arange(len(fp))
    at, lag = np.arange(len(fp)), 0
    while True:
        lag += 1
        at = at[at + lag < len(fp)]
        # both ascend within a key, so a row that has no partner at this lag has none beyond
        at = at[(key[at] == key[at + lag]) & (table[0, at + lag] - table[0, at] <= most)]
        if not len(at):
            return labels
        near = at
        for row in table[1:]:
            near = near[np.abs(row[near] - row[near + lag]) <= most]
        near = near[np.bitwise_count(fp[near] ^ fp[near + lag]) <= most]
        labels = joined(labels, near, near + lag)


def links(members: DataFrame, most: int) -> DataFrame:
    """(u, v) of fingerprints: all that links within the keys of ``members`` (key, fp) lead to, as few pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in key_runs(batches, RUN_ROWS, RUN_BYTES):
            fp = table.column(1).to_numpy().view(np.uint64)
            labels = group_links(table.column(0).to_numpy(), fp, most)
            other = np.flatnonzero(labels != np.arange(len(labels)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)) for x in (labels[other], other)], ["u", "v"])

    rows = members.select("key", "fp").repartition("key").sortWithinPartitions("key", coordinate(pivot_base()))
    return rows.mapInArrow(run, "u long, v long")


def near_fingerprints(distinct: DataFrame, most: int = 2) -> DataFrame:
    """(u, v): links between different fingerprints (fp long, each once) that join all that lies within ``most`` bits."""
    rows, found, depth = materialize(dealt(distinct, most), "dealt"), [], 0
    while True:
        # so few bits are free then that a key can't have more than 2**free fingerprints
        last = len(fixed_bits((0,) * (depth + 1), most)[1]) <= 2 * (most + 2)
        crowded = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > (1 << 62 if last else LIMIT)).select("key"), "crowded")
        found.append(materialize(links(rows.join(crowded, "key", "left_anti"), most), "near"))
        if last or crowded.isEmpty():
            break
        rows, depth = materialize(refined(rows.join(crowded, "key", "left_semi"), depth, most), "dealt"), depth + 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_copies(docs: DataFrame, most: int = 2, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, fingerprint (16 hexadecimal digits), component_id, the least doc_id that links of at most ``most`` differing bits lead to."""
    prints = materialize(fingerprints(docs, n, id_col, text_col), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    parts = materialize(connected_components(near_fingerprints(distinct.select("fp"), most)), "parts")
    linked = distinct.join(parts.withColumnRenamed("id", "fp"), "fp")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    known = linked.join(least, "component").select("fp", "component_id")
    alone = distinct.join(parts, distinct.fp == parts.id, "left_anti").select("fp", F.col("least").alias("component_id"))
    label = materialize(known.unionByName(alone), "labels")
    # plain tables on both sides: Spark splits a fingerprint that many rows share
    return prints.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
