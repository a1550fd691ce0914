"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document is the set of its word n-grams, each a 64-bit hash. Documents with equal sets are one node of the
join, so copies cost one row a task. Two sets of J >= t have sizes within t of each other and differ in at
most D elements, D by their band of sizes. For each band the hash space is cut into more than D buckets; of
two linked sets some bucket that isn't empty holds the same elements. A tile is the sets of one band that
agree on one bucket: all pairs that can be linked meet in a tile, and sets that share no more than a passage
seldom do. A set whose elements leave too many buckets empty for that argument also enters tiles by each
element of its prefix (its least hashes), which finds its links to sets of the same kind.

Tiles are resolved without listing their pairs: each set is compared with the tile's first. Where that leaves
sets of a tile in different components, the sets are compared by the bitmaps: bits in common, and what the
bitmaps' collisions can hide, bound the overlap from above. Of the pairs that pass, first as few as would join
the sets are intersected exactly, as sorted arrays, and then those whose components are still apart. Nothing
large is gathered: many sets are compared in bounded blocks, two at a time.

Defined results. Without words (or text) a set is empty and linked with nothing. With fewer than n words the
whole sequence is the only n-gram. Rows that repeat an id count as rows of one document: the greatest set
size is given and its links are those of all its rows. A document without an id is linked with nothing. An
empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._store import free_name, materialize
from .components import connected_components

#: The threshold 0.8 as fractions; the bounds below follow from it.
NUM, DEN = 80, 100
N = 5
#: Ids up to this number are broadcast (8 bytes each); beyond it texts are shuffled to them.
BROADCAST_IDS = 2_000_000
TILE_ROWS = 256
BITS = 1 << 14
#: Of a tile's bits, so many are held as a table at a time.
COLUMNS = 8192

U64 = np.uint64


def bands(limit: int) -> np.ndarray:
    """Least size of each band, up to beyond ``limit``."""
    out = [1]
    while out[-1] <= 2 * limit:
        out.append(max(out[-1] + 1, -(-out[-1] * DEN // NUM)))
    return np.array(out)


def differences(low: np.ndarray) -> np.ndarray:
    """The most elements in which linked sets can differ, the smaller one in band i: (a + b) / 9 with b <= 5/4 a."""
    top = low[1:] - 1
    return (top + top * DEN // NUM) * (DEN - NUM) // (DEN + NUM)


def sets_of(buf: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, bounds): the different n-grams of each document, by document and hash."""
    low = T.LOWER[buf]
    start, end, bounds = T.words(low, offsets)
    codes = T.span_hash(T.rolling(low), start, end)
    grams = T.ngram_hash(codes, n, seed=n)
    at = np.flatnonzero(T.within(bounds, n)[: len(grams)])
    doc, h = np.searchsorted(bounds, at, side="right") - 1, grams[at]
    size = np.diff(bounds)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        whole = [T.ngram_hash(codes[bounds[i] : bounds[i + 1]], int(size[i]), seed=int(size[i]))[0] for i in short]
        doc, h = np.concatenate([doc, short]), np.concatenate([h, np.array(whole, np.uint64)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))
        doc, h = doc[new], h[new]
    return doc, h, np.searchsorted(doc, np.arange(len(offsets)))


def set_ids(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; 0 for empty ones."""
    sums = np.append(U64(0), np.cumsum(T.mix(h ^ U64(0x5851F42D4C957F2D))))
    size = np.diff(bounds)
    return np.where(size > 0, T.mix(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(np.uint64)) | U64(1), U64(0))


def tile_keys(doc: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of every tile that each set enters."""
    size = np.diff(bounds)
    low = bands(int(size.max(initial=1)))
    most = differences(low)
    own = np.searchsorted(low, size, side="right") - 1
    least = np.searchsorted(low, np.maximum(1, -(-size * NUM // DEN)), side="right") - 1
    docs, keys = [], []
    mixed = T.mix(h)
    rank = np.arange(len(h)) - bounds[doc]
    for role in (0, 1):
        band = own - role
        takes = (size > 0) & (band >= least)
        some = takes[doc]
        if not some.any():
            continue
        d, band_of = doc[some], band[doc[some]]
        buckets = (-(-most * 11 // 10) + 3)[band_of].astype(np.uint64)
        bucket = ((h[some] >> U64(32)) * buckets) >> U64(32)
        at = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (bucket[1:] != bucket[:-1])))
        content = np.add.reduceat(mixed[some], at)
        docs.append(d[at])
        keys.append(T.mix(content ^ T.mix((band_of[at].astype(np.uint64) << U64(32)) + bucket[at] + U64(1))))
        # too few buckets in use: enter by the prefix too
        used = np.bincount(d[at], minlength=len(size))
        thin = takes & (used <= most[np.maximum(band, 0)])
        if thin.any():
            prefix = size - -(-size * NUM // DEN) + 1
            by = thin[doc] & (rank < prefix[doc])
            docs.append(doc[by])
            keys.append(T.mix(h[by] + T.mix(band[doc[by]].astype(np.uint64) + U64(0x71DE))))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(keys)


def document_sets(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n_shingles, set_id): every row's set; set_id is null for empty ones."""
    schema = docs.select("doc_id").schema.add("n_shingles", "long").add("set_id", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, offsets in T.slices(batch, "text"):
                _, h, bounds = sets_of(buf, offsets, n)
                ids = set_ids(h, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(np.diff(bounds)), pa.array(ids.view(np.int64), mask=ids == 0)], schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def tile_rows(docs: DataFrame, n: int = N) -> DataFrame:
    """(key, set_id): the tiles that each set enters; a set met again in a task is not sent again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, buf, offsets in T.slices(batch, "text", T.SLICE_BYTES // 2):
                doc, h, bounds = sets_of(buf, offsets, n)
                ids = set_ids(h, bounds)
                new = np.zeros(len(ids), bool)
                for i, x in enumerate(ids.tolist()):
                    if x and x not in seen:
                        new[i] = True
                        seen.add(x)
                if len(seen) > 1_000_000:
                    seen.clear()
                keep = new[doc]
                at, key = tile_keys(doc[keep], h[keep], np.searchsorted(doc[keep], np.arange(len(offsets))))
                for k in range(0, len(key), 100_000):
                    yield pa.RecordBatch.from_arrays([T.as_long(key[k : k + 100_000]), T.as_long(ids[at[k : k + 100_000]])], ["key", "set_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, set_id long")


def shared_tiles(rows: DataFrame) -> DataFrame:
    """(key, set_id, first): tiles of two sets or more, each set once, with the tile's first."""
    order = Window.partitionBy("key").orderBy("set_id")
    marked = rows.select("key", "set_id", F.first("set_id").over(order).alias("first"), F.lag("set_id").over(order).alias("before"), F.lead("set_id").over(order).alias("after"))
    later = (F.col("set_id") != F.col("first")) & (F.col("before") != F.col("set_id"))
    leads = (F.col("set_id") == F.col("first")) & (F.col("after") != F.col("set_id"))
    return marked.filter(later | leads).select("key", "set_id", "first")


def bitmap(h: np.ndarray) -> bytes:
    """A bit for each element by the top 14 bits of its hash; kept as the places of the set bits while they are few."""
    at = (h >> U64(50)).astype(np.uint16)
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    if len(at) < BITS // 16:
        return at.tobytes()
    out = np.zeros(BITS, np.uint8)
    out[at] = 1
    return np.packbits(out).tobytes()


def places(bits: bytes) -> np.ndarray:
    """The set bits of a bitmap."""
    if len(bits) == BITS // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))).astype(np.uint16)
    return np.frombuffer(bits, np.uint16)


def overlap_bounds(maps: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """For each two sets the most elements that they can share: bits in common and the fewer collisions."""
    own = [places(m) for m in maps]
    n, count = len(own), np.array([len(x) for x in own])
    row, column = np.repeat(np.arange(n), count), np.concatenate(own)
    times = np.bincount(column, minlength=BITS)
    # a bit that one map alone has is in no overlap, one that all have is in every overlap
    some = (times > 1) & (times < n)
    number, total = np.cumsum(some) - 1, int(some.sum())
    keep = some[column]
    row, column = row[keep], number[column[keep]]
    shared = np.full((n, n), (times == n).sum(), np.float32)
    for at in range(0, total, COLUMNS):
        inside = (column >= at) & (column < at + COLUMNS)
        b = np.zeros((n, min(COLUMNS, total - at)), np.float32)
        b[row[inside], column[inside] - at] = 1
        shared += b @ b.T
    hidden = sizes - count
    return shared + np.minimum(hidden[:, None], hidden[None, :])


def forest(ok: np.ndarray, part: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the pairs in the symmetric table ``ok``, enough to span what they join; a part is one node from the start."""
    _, code = np.unique(part, return_inverse=True)
    order = np.argsort(code, kind="stable")
    members = np.split(order, np.flatnonzero(np.diff(code[order])) + 1)
    left, u, v = np.ones(len(code), bool), [], []
    for seed in range(len(code)):
        if not left[seed]:
            continue
        queue = members[code[seed]].tolist()
        left[queue] = False
        while queue:
            x = queue.pop()
            for y in np.flatnonzero(ok[x] & left).tolist():
                if left[y]:
                    u.append(x), v.append(y)
                    more = members[code[y]].tolist()
                    left[more] = False
                    queue += more
    return u, v


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of linked sets of sizes a and b."""
    return -(-NUM * (a + b) // (DEN + NUM))


def signatures(docs: DataFrame, wanted: DataFrame, n: int = N) -> DataFrame:
    """(set_id, size, bits, elements) of the sets of the wanted (doc_id, set_id)."""
    few = wanted.count() <= BROADCAST_IDS
    chosen = docs.select("doc_id", "text").join(F.broadcast(wanted.select("doc_id")) if few else wanted.select("doc_id"), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat an id; they seldom meet elsewhere, where they would do no harm
        for batch in batches:
            for _, _, buf, offsets in T.slices(batch, "text"):
                _, h, bounds = sets_of(buf, offsets, n)
                ids = set_ids(h, bounds)
                new = [i for i, x in enumerate(ids.tolist()) if x and x not in seen and not seen.add(x)]
                if len(seen) > 1_000_000:
                    seen.clear()
                own = [h[bounds[i] : bounds[i + 1]] for i in new]
                columns = [T.as_long(ids[new]), pa.array(np.diff(bounds)[new]), pa.array([bitmap(x) for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["set_id", "size", "bits", "elements"])

    return chosen.mapInArrow(run, "set_id long, size long, bits binary, elements binary")


def linked(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that are linked: bounded by bitmaps, then intersected exactly."""
    side = lambda x: signs.select(F.col("set_id").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}"))

    def can(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(f"size_{x}").to_numpy() for x in "uv")
            ok = (NUM * np.maximum(a, b) <= DEN * np.minimum(a, b))
            maps = [batch.column(f"bits_{x}") for x in "uv"]
            for i in np.flatnonzero(ok):
                ok[i] = overlap_bounds([m[int(i)].as_py() for m in maps], np.array([a[i], b[i]]))[0, 1] >= needed(a[i], b[i])
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(ok)), batch.column("v").filter(pa.array(ok))], ["u", "v"])

    def are(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("elements_u"), batch.column("elements_v")):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(DEN * shared >= NUM * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(ok, pa.bool_())), batch.column("v").filter(pa.array(ok, pa.bool_()))], ["u", "v"])

    bounded = materialize(pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(can, "u long, v long"), "bounded")
    # only the arrays of these sets travel
    ids = materialize(bounded.select(F.explode(F.array("u", "v")).alias("set_id")).distinct(), "ids")
    own = signs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "set_id", "left_semi")
    array = lambda x: own.select(F.col("set_id").alias(x), F.col("elements").alias(f"elements_{x}"))
    return bounded.join(array("u"), "u").join(array("v"), "v").mapInArrow(are, "u long, v long")


def open_tiles(tiles: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, set_id): the tiles in which some sets lie apart; of tiles of the same sets, one."""
    known = tiles.join(parts.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    same = known.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("members"), F.min("component").alias("low"), F.max("component").alias("high"))
    one = same.filter("low <> high").groupBy("rows", "members").agg(F.min("key").alias("key"))
    return materialize(tiles.join(one.select("key"), "key").select("key", "set_id"), "open")


def apart(tiles: DataFrame, parts: DataFrame, signs: DataFrame, spanning: bool, tile_rows_: int = TILE_ROWS) -> DataFrame:
    """(key, u, v): pairs of one tile but not of one component whose bitmaps allow a link; if spanning, enough to span them in each block."""
    known = tiles.join(parts.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    same = known.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("component").alias("low"), F.max("component").alias("high"))
    rows = known.join(same.filter("low <> high").select("key", "rows"), "key").join(signs.select("set_id", "size", "bits"), "set_id")
    blocks = F.ceil(F.col("rows") / tile_rows_).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("set_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    member = F.struct("set_id", "component", "size", "bits", "block")
    # two blocks of a tile at a time
    meeting = rows.groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(member).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, i, j, members in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                own = members.values
                ids, part, size, block = (own.field(k).to_numpy() for k in ("set_id", "component", "size", "block"))
                if part.min() == part.max():
                    continue
                bound = overlap_bounds(own.field("bits").to_pylist(), size)
                ok = (bound >= needed(size[:, None], size[None, :])) & (part[:, None] != part[None, :])
                ok &= (NUM * np.maximum(size[:, None], size[None, :])) <= DEN * np.minimum(size[:, None], size[None, :])
                if i != j:
                    ok &= block[:, None] != block[None, :]
                u, v = forest(ok, part) if spanning else np.nonzero(np.triu(ok))
                if len(u):
                    a, b = ids[u], ids[v]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), key)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["key", "u", "v"])

    return meeting.select("key", "i", "j", "members").mapInArrow(run, "key long, u long, v long")


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components of ``parts`` with the links added: what is left to link are the components found so far."""
    label = lambda x: parts.select(F.col("id").alias(x), F.col("component").alias(f"part_{x}"))
    across = links.join(label("u"), "u", "left").join(label("v"), "v", "left").select(F.coalesce("part_u", "u").alias("u"), F.coalesce("part_v", "v").alias("v"))
    own = parts.select(F.col("id").alias("u"), F.col("component").alias("v"))
    return materialize(connected_components(own.union(across)), "parts")


def set_components(docs: DataFrame, sets: DataFrame, n: int = N) -> DataFrame:
    """(id, component) of every set that is linked with another."""
    tiles = materialize(shared_tiles(tile_rows(docs, n)), "tiles")
    members = tiles.select("set_id").distinct()
    wanted = materialize(sets.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id")).join(members, "set_id"), "wanted")
    signs = materialize(signatures(docs, wanted, n), "signatures")

    star = materialize(tiles.filter("set_id <> first").select(F.col("first").alias("u"), F.col("set_id").alias("v")).distinct(), "star")
    edges = materialize(linked(star, signs), "links")
    parts = materialize(connected_components(edges), "parts")
    # first as few pairs as can join what lies apart, then all that are still apart
    tried, groups = star, open_tiles(tiles, parts)
    for spanning in (True, False):
        found = materialize(apart(groups, parts, signs, spanning), "apart")
        pairs = found.select("u", "v").distinct().join(tried, ["u", "v"], "left_anti")
        links = materialize(linked(pairs, signs), "links")
        if not links.isEmpty():
            parts = joined(parts, links)
        tried = tried.union(found.select("u", "v"))
        groups = groups.join(found.select("key").distinct(), "key", "left_semi")
    return parts


def join_components(docs: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (the least doc_id that it is linked with, itself included)."""
    named = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    known = named.filter("doc_id is not null")
    sets = materialize(document_sets(named, n), "sets")
    usable = sets.filter("doc_id is not null")
    parts = set_components(known, usable, n)
    node = usable.filter("set_id is not null").join(parts.withColumnRenamed("id", "set_id"), "set_id", "left").select("doc_id", F.coalesce("component", "set_id").alias("component"))
    least = node.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = node.join(least, "component").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return sets.join(labels, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one of least id, all columns as they are."""
    found = join_components(docs, n, id_col, text_col)
    name = free_name(docs, "gone")
    gone = materialize(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col] == gone[name], "left_anti")
