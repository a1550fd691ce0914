"""Exact top-k inner-product search by no-random-access aggregation.

Candidates are dealt to blocks; a block keeps one sorted list for each dimension. A query reads all lists of
a block from the end where its products are greatest, some depth at a time. What it has read gives each
candidate a lower bound (unread products taken at their list's least) and an upper bound (at the value last
read). Candidates whose upper bound is below the k-th lower bound drop out; reading ends when few are left or
the lists are at their end, and the final scores of those left are resolved. Blocks answer alone; a query's
best of all blocks are then merged.

Every block of queries meets every block of candidates: that is the stated query set against all rows. Each
candidate travels once, to its block, whose lists are sorted once; the queries are copied to each block, in
bounded blocks of their own, and read one block at a time. No table is broadcast.

Defined results. Vectors null, empty, or with null or non-finite components take no part; vectors of other
lengths than the query's aren't its candidates. A row with the query's id is the query's own. Repeated ids
count as rows. Ties go to the smaller id. An empty table gives an empty result. Other columns take no part.
Components of more than ``SMALL`` after scaling have blocks of their own, in which, as for queries with such, products are added as
whole numbers of any size: order is exact for all finite components, and a score beyond 64 bits is given as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES_PER_BLOCK = 4096
#: Sums of products of whole numbers up to this are exact in doubles, for up to 2**13 dimensions.
SMALL = 1 << 20
LONGEST = (1 << 63) - 1
#: More than any score's magnitude: components are under 2**1024, times a scale.
_BEYOND = 1 << 2400
#: Parts of each list that are read before bounds are compared again.
DEPTHS = (0.1, 0.35, 0.7, 1.0)


def integers(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<double>, dim, large): floor(scale * x) of each component; rows that take part only. large: v has x itself, as scaling it may leave the doubles."""
    x = rows.select(rows[id_col].alias("vec_id"), rows[vec_col].cast("array<double>").alias("x"))
    x = x.filter(F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))))
    large = F.exists("x", lambda c: F.abs(c) * scale > SMALL) | (F.size("x") > 1 << 13)
    whole = F.transform("x", lambda c: F.floor(c * scale).cast("double"))
    return x.select("vec_id", F.when(large, F.col("x")).otherwise(whole).alias("v"), F.size("x").alias("dim"), large.cast("int").alias("large"))


def exact_scores(vectors: list[list[int]], query: list[int]) -> list[int]:
    return [sum(a * b for a, b in zip(v, query)) for v in vectors]


def beyond(score: int) -> str | None:
    """Of a score that no long holds a text that sorts as the number does; nothing for others."""
    return None if abs(score) <= LONGEST else f"{score + _BEYOND:0600x}"


class Lists:
    """The sorted lists of a block."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(vectors.T, self.order, axis=1)
        #: Where in each list a row stands: a row has been read there once that place has.
        self.place = np.empty_like(self.order, dtype=np.int32)
        np.put_along_axis(self.place, self.order, np.arange(len(vectors), dtype=np.int32)[None], axis=1)

    def best(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) among which the k highest are, all ties of the k-th included; skip: rows that don't count."""
        n, dims = self.vectors.shape
        # read from the greatest product on: lists with positive weights from their end, the others from their beginning
        ups, downs = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        lists, up = np.concatenate([ups, downs]), np.arange(len(ups) + len(downs)) < len(ups)
        weight = query[lists][:, None]
        least = np.where(up, self.sorted[lists, 0], self.sorted[lists, -1]) * query[lists]
        partial, alive, done = np.zeros(n), ~skip, 0
        for part in DEPTHS:
            depth = max(int(n * part), min(n, 2 * k)) if part < 1 else n
            if depth <= done:
                continue
            low, high = n - depth, n - done
            ids = np.concatenate([self.order[ups, low:high], self.order[downs, done:depth]])
            products = np.concatenate([self.sorted[ups, low:high], self.sorted[downs, done:depth]]) * weight
            partial += np.bincount(ids.ravel(), weights=products.ravel(), minlength=n)
            head = np.where(up, self.sorted[lists, low], self.sorted[lists, depth - 1]) * query[lists]
            done = depth
            rows = np.flatnonzero(alive)
            if len(rows) > k and done == n:
                # all is read: sums are scores
                alive[rows[partial[rows] < np.partition(partial[rows], len(rows) - k)[len(rows) - k]]] = False
            elif len(rows) > k:
                place = self.place[lists] if len(rows) == n else self.place[lists[:, None], rows]
                unread = np.concatenate([place[: len(ups)] < low, place[len(ups) :] >= depth]).astype(np.float64)
                lower, upper = partial[rows] + np.stack([least, head]) @ unread
                bar = np.partition(lower, len(rows) - k)[len(rows) - k]
                alive[rows[upper < bar]] = False
            if alive.sum() <= 4 * k or done == n:
                break
        rows = np.flatnonzero(alive)
        return rows, self.vectors[rows] @ query


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest integer inner product for each query."""
    rows, asked = integers(vectors, id_col, vec_col, scale), integers(queries, id_col, vec_col, scale)
    blocks = max(1, -(-rows.count() // CANDIDATES_PER_BLOCK))
    # a block's candidates come first, then its queries; equal ids are spread by their vectors
    own = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    # large rows have blocks of negative numbers
    side = F.when(F.col("large") == 1, -1 - F.col("block")).otherwise(F.col("block")).alias("block")
    candidates = rows.withColumn("block", own).select(side, "dim", F.lit(0).alias("asks"), "vec_id", "v", "large")
    some = rows.groupBy("large").agg(F.count(F.lit(1)).alias("n")).filter("large = 1").count()
    numbers = F.sequence(F.lit(-blocks if some else 0), F.lit(blocks - 1))
    questions = asked.select(F.explode(numbers).alias("block"), "dim", F.lit(1).alias("asks"), "vec_id", "v", "large")
    dealt = candidates.unionByName(questions).repartition(F.col("block"), F.col("dim")).sortWithinPartitions("block", "dim", "asks")
    schema = "query_id long, vec_id long, score long, beyond string"

    def matrix(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([b.column(3).to_numpy() for b in parts])
        flat = np.concatenate([b.column(4).flatten().to_numpy(zero_copy_only=False) for b in parts])
        return ids, flat.reshape(len(ids), -1).astype(np.float64)

    def whole(v: np.ndarray, large: bool) -> list[int]:
        # floor of a product that doubles may not hold: a double is a whole number over a power of two
        return [a * scale // b for a, b in (float(x).as_integer_ratio() for x in v)] if large else [int(x) for x in v]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: tuple[int, int] | None = None
        held: list[pa.RecordBatch] = []
        lists, ids, exact = None, np.zeros(0, np.int64), None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
            for a, b in zip(cuts, cuts[1:]):
                at, asks, part = (int(keys[a, 0]), int(keys[a, 1])), keys[a, 2], batch.slice(a, b - a)
                if at != block:
                    block, held, lists, exact = at, [], None, None
                if not asks:
                    held.append(part)
                    continue
                if held:  # the first queries of a block: its candidates are all there
                    ids, vectors_ = matrix(held)
                    lists, held = Lists(vectors_), []
                if lists is None:
                    continue
                out: list[tuple[list, ...]] = []
                for query_id, weight, large in zip(*matrix([part]), part.column(5).to_pylist()):
                    if block[0] < 0 or large:
                        exact = exact or [whole(v, block[0] < 0) for v in lists.vectors]
                        score = exact_scores(exact, whole(weight, bool(large)))
                        best = sorted((i for i in range(len(ids)) if ids[i] != query_id), key=lambda i: (-score[i], ids[i]))[:k]
                        out.append(([query_id] * len(best), ids[best].tolist(), [max(-LONGEST - 1, min(LONGEST, score[i])) for i in best], [beyond(score[i]) for i in best]))
                    else:
                        found, score = lists.best(weight, k, ids == query_id)
                        best = np.lexsort((ids[found], -score))[:k]
                        out.append(([query_id] * len(best), ids[found][best].tolist(), score[best].astype(np.int64).tolist(), [None] * len(best)))
                columns = [[x for c in column for x in c] for column in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["query_id", "vec_id", "score", "beyond"])

    found = dealt.mapInArrow(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
