"""Near copies by fingerprints and by vectors: candidates meet on keys, equal ones first become one; all found pairs are checked.

Rows without text or vector take no part; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from .graph import cut

BITS = 64
#: Start and factor of the 32-bit token hash, which multiplies in doubles.
START, FACTOR = 2166136261, 16777619
#: Numbers in the vectors of a block that meets others whole in one task, and the most rows of it.
BLOCK, BLOCK_ROWS = 1 << 22, 1 << 16


def token_hash(codes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """32 bits of each row of codes, of which the first ``length`` count: each is mixed in, the product rounded to a double and cut to 32 bits."""
    h = np.full(len(codes), START, np.int64)
    for i in range(codes.shape[1]):
        x = h ^ codes[:, i]
        signed = np.where(x >= 1 << 31, x - (1 << 32), x)
        h = np.where(i < length, (signed * float(FACTOR)).astype(np.int64) & 0xFFFFFFFF, h)
    return h


def _token_bits(tokens: pa.Array) -> np.ndarray:
    """64 bits of each token (ASCII): the low ones hash it, the high ones it and a zero."""
    data = [t.encode() for t in tokens.to_pylist()]
    order = np.argsort([len(t) for t in data], kind="stable")
    out = np.zeros(len(data), np.uint64)
    # tokens of about the same length together, so that one very long token doesn't widen the others
    for part in np.array_split(order, max(1, len(order) // 4096)):
        length = np.array([len(data[i]) for i in part], np.int64)
        width = int(length.max(initial=0)) + 1
        codes = np.frombuffer(b"".join(data[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width).astype(np.int64)
        out[part] = token_hash(codes, length).astype(np.uint64) | token_hash(codes, length + 1).astype(np.uint64) << np.uint64(32)
    return out


def simhash(rows: DataFrame, id_col: str = "id", text_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, simhash, and the columns ``keep``): 64 bits, bit i set if more of a text's different tokens have it than haven't; 0 for a text without tokens.

    One row for each row, so it works on streams too. Each different token of a batch is hashed once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(1)
                token = lists.flatten().dictionary_encode()
                h = _token_bits(token.dictionary)[token.indices.to_numpy()] if len(token) else np.zeros(0, np.uint64)
                size = pc.list_value_length(lists).to_numpy().astype(np.int64)
                some = np.flatnonzero(size)
                value = np.zeros(len(size), np.uint64)
                if len(some):
                    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    count = np.add.reduceat(bits, (np.cumsum(size) - size)[some], axis=0, dtype=np.int32)
                    value[some] = np.packbits(2 * count > size[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value.view(np.int64)), *part.columns[2:]], schema.fieldNames())

    own = rows.select(F.col(id_col).alias("id"), F.array_distinct(text.tokens(F.col(text_col))).alias("tokens"), *keep)
    schema = own.select("id", F.lit(0).cast("long").alias("simhash"), *keep).schema
    return own.mapInArrow(run, schema)


def as_hex(bits: Column) -> Column:
    """16 digits, the lowest four bits first."""
    return F.reverse(F.lower(F.lpad(F.hex(bits), 16, "0")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def simhash_classes(prints: DataFrame) -> DataFrame:
    """(id, first): equal fingerprints are one, named by their least id."""
    first = prints.groupBy("simhash").agg(F.min("id").alias("first"))
    return prints.join(first, "simhash").select("id", "first")


def near_simhashes(prints: DataFrame, most: int = 3, blocks: int = 6, owner: str | None = None) -> DataFrame:
    """(a, b, distance): pairs of classes of fingerprints at most ``most`` bits apart, a < b; of one owner each if a column for it is named.

    Of ``blocks`` blocks of bits, ``blocks - most`` are equal in such a pair: pairs meet on each choice of so many. Half of the bits make a
    key, so that keys stay rare as rows grow; no pair of one class is made.
    """
    prints = prints.withColumn("owner", F.lit(0) if owner is None else F.col(owner))
    one = prints.groupBy("owner", "simhash").agg(F.min("id").alias("id"))
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    block = [F.shiftrightunsigned("simhash", cuts[i]).bitwiseAND((1 << (cuts[i + 1] - cuts[i])) - 1) for i in range(blocks)]
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64(*[block[i] for i in chosen]).alias("key")) for k, chosen in enumerate(combinations(range(blocks), blocks - most))])
    keyed = cut(one.select("owner", "id", "simhash", F.inline(keys)))
    other = keyed.select("owner", "k", "key", F.col("id").alias("b"), F.col("simhash").alias("other"))
    pairs = keyed.join(other, ["owner", "k", "key"]).filter("id < b").select(F.col("id").alias("a"), "b", hamming(F.col("simhash"), F.col("other")).alias("distance"))
    return pairs.filter(F.col("distance") <= most).distinct()


def bands_for(least: float, bits: int, recall: float) -> int:
    """How many bands of ``bits`` planes find a pair of similarity ``least`` with a chance of ``recall``: a plane has both on one side with 1 - angle / pi."""
    agree = (1 - np.arccos(min(1.0, max(-1.0, least))) / np.pi) ** bits
    return 1 if agree >= 1 else int(np.ceil(np.log(1 - recall) / np.log(1 - agree)))


def _near_by_planes(one: DataFrame, dims: int, bits: int, bands: int, seed: int) -> DataFrame:
    """(owner, a, b): rows that are on the same side of all planes of some band."""

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).normal(size=(bands * bits, dims))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                side = (flat.reshape(part.num_rows, dims) @ planes.T > 0).reshape(part.num_rows, bands, bits)
                key = (side * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                take = pa.array(np.repeat(np.arange(part.num_rows), bands))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), pa.array(np.tile(np.arange(bands, dtype=np.int32), part.num_rows)), pa.array(key.ravel()), part.column(2).take(take)], ["id", "band", "key", "owner"])

    keyed = cut(one.select("id", "v", "owner").mapInArrow(sides, one.select("id", F.lit(0).alias("band"), F.lit(0).cast("long").alias("key"), "owner").schema))
    return keyed.select("owner", F.col("id").alias("a"), "band", "key").join(keyed.select("owner", F.col("id").alias("b"), "band", "key"), ["owner", "band", "key"]).filter("a < b").select("a", "b").distinct()


def _near_by_blocks(one: DataFrame, least: float, numbers: int = BLOCK) -> DataFrame:
    """(a, b, similarity): all pairs of similarity ``least`` or more. Rows of one owner and length are dealt to blocks of about ``numbers`` components, eight at least if they are many; each two blocks meet in a group of their own.

    The work grows with the square of the rows, what is shuffled with rows times blocks; nothing but found pairs leaves a group. Products are screened in
    single precision, with room for its error, and those left are added up in doubles from the first component on.
    """
    some = one.withColumn("dims", F.size("v"))
    size = some.groupBy("owner", "dims").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.when(F.col("n") < 2048, 1).otherwise(F.greatest(F.lit(8), F.ceil(F.col("n") / F.lit(BLOCK_ROWS)), F.ceil(F.col("n") * F.col("dims") / numbers))).cast("int"))
    own = some.join(F.broadcast(size) if size.count() < 10_000 else size, ["owner", "dims"])
    own = own.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = own.select("owner", "dims", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "v")
    schema = one.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity")).schema

    def run(key: tuple, group: pa.Table) -> pa.Table:
        dims, x, y = (k.as_py() for k in key[1:])
        block, ids = group["block"].to_numpy(), group["id"].combine_chunks()
        v = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims)
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        with np.errstate(over="ignore", invalid="ignore"):
            single = v.astype(np.float32)
            norm = np.sqrt((v * v).sum(1))
            columns = single[right].T.copy()
            first, second, found = [], [], []
            for at in range(0, len(left), 512):
                part = left[at : at + 512]
                room = 1e-6 * (8 + dims**0.5) * norm[part].max() * norm[right].max(initial=0.0)
                # not "at least", so that what isn't a number stays for the exact sum
                i, j = np.nonzero(~(single[part] @ columns < np.float32(least - room)))
                i, j = part[i], right[j]
                if x == y:
                    i, j = i[i < j], j[i < j]
                for k in range(0, len(i), 1 << 20):
                    p, q = i[k : k + (1 << 20)], j[k : k + (1 << 20)]
                    total = np.zeros(len(p))
                    for d in range(dims):
                        total += v[p, d] * v[q, d]
                    near = ~(total < least)
                    first.append(p[near]), second.append(q[near]), found.append(total[near])
        none = np.zeros(0, np.int64)
        p, q = (ids.take(pa.array(np.concatenate([none, *z]))) for z in (first, second))
        less = pc.less(p, q)
        return pa.table([pc.if_else(less, p, q), pc.if_else(less, q, p), pa.array(np.concatenate([np.zeros(0), *found]))], schema.fieldNames())

    return dealt.groupBy("owner", "dims", "x", "y").applyInArrow(run, schema)


def near_vectors(
    rows: DataFrame, least: float, recall: float = 0.99, bits: int | None = None, seed: int = 1, id_col: str = "id", vec_col: str = "embedding", owner: str | None = None, exact: bool | None = None
) -> DataFrame:
    """(a, b, similarity): pairs of unit vectors of similarity ``least`` or more, a < b; equal vectors (of one owner, if a column for it is named) are one row, the least id.

    Every pair is found, by comparing blocks of rows, unless ``bits`` names planes or ``exact`` is False: then vectors on the same side of random planes meet, in as many bands
    as find a pair of similarity ``least`` with a chance of ``recall``; what meets is checked exactly. ``bits``, the planes of a band, then grows with the rows, so that a key
    holds few of them, and the bands grow with it: the chance stays. Where many rows lie alike, that makes more candidates than the exact way shuffles rows.
    Vectors with a null component take no part, and those of different lengths don't meet.
    """
    held = rows.filter(F.col(vec_col).isNotNull() & ~F.exists(F.col(vec_col), lambda x: x.isNull())).withColumn("owner", F.lit(0) if owner is None else F.col(owner))
    one = cut(held.groupBy("owner", F.col(vec_col).cast("array<double>").alias("v")).agg(F.min(id_col).alias("id")).filter(F.size("v") > 0))
    if exact or (exact is None and bits is None):
        return cut(_near_by_blocks(one, least))
    dims = one.select(F.max(F.size("v"))).first()[0] or 0
    if not dims:
        return one.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity")).limit(0)
    own = one.filter(F.size("v") == dims)
    bits = bits or max(10, int(np.ceil(np.log2(max(1, one.count()) / 64))))
    pairs = _near_by_planes(own, dims, bits, bands_for(least, bits, recall), seed)
    side = lambda x: one.select(F.col("id").alias(x), F.col("v").alias(f"v{x}"))
    checked = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", scores.dot(F.col("va"), F.col("vb")).alias("similarity"))
    return checked.filter(F.col("similarity") >= least)


def strongest_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """(source_id, target_id, similarity): links both ways, of each row the k strongest."""
    both = pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), "similarity").unionByName(pairs.select(F.col("b").alias("source_id"), F.col("a").alias("target_id"), "similarity"))
    order = Window.partitionBy("source_id").orderBy(F.desc("similarity"), "target_id")
    return both.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")


def duplicate_clusters(pairs: DataFrame) -> DataFrame:
    """(id, anchor): in order of ids, each row not yet claimed is an anchor and claims its greater neighbours.

    In rounds: a row without an undecided smaller neighbour is an anchor; neighbours of anchors are claimed. Ends when all are decided.
    """
    edges = cut(pairs.select("a", "b").distinct())
    state = cut(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.lit(0).alias("kind")))  # 0 open, 1 anchor, 2 claimed
    while True:
        # of each row, what its smaller neighbours are
        below = edges.join(state.select(F.col("id").alias("a"), "kind"), "a").groupBy(F.col("b").alias("id")).agg(F.count_if(F.col("kind") == 0).alias("open"), F.count_if(F.col("kind") == 1).alias("anchors"))
        kind = F.when(F.col("kind") != 0, F.col("kind")).when(F.coalesce("anchors", F.lit(0)) > 0, 2).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0)
        state = cut(state.join(below, "id", "left").select("id", kind.alias("kind")))
        if state.filter("kind = 0").isEmpty():
            break
    anchors = state.filter("kind = 1").select("id")
    claimed = edges.join(anchors.withColumnRenamed("id", "a"), "a").join(state.filter("kind = 2").select(F.col("id").alias("b")), "b").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("anchor"))
    return anchors.select("id", F.col("id").alias("anchor")).unionByName(claimed)


def merged(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """(anchor, source_count, archived) of clusters (id, anchor) with claimed rows: the anchor's sources, and of each row that it claims those beyond the first. rows: (id, source_count)."""
    own = clusters.join(rows, "id")
    count = F.coalesce("source_count", F.lit(1))
    total = F.sum(F.when(F.col("id") == F.col("anchor"), count).otherwise(count - 1))
    return own.groupBy("anchor").agg(total.alias("source_count"), (F.count(F.lit(1)) - 1).alias("archived")).filter("archived > 0")


def merge_links(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source_id, target_id, similarity, type): a link from each anchor to each row that it claims."""
    claimed = clusters.filter("id <> anchor").select(F.col("anchor").alias("a"), F.col("id").alias("b"))
    return claimed.join(pairs, ["a", "b"]).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), "similarity", F.lit("derives").alias("type"))
