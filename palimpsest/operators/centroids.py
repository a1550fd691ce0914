"""A vector index on disk: lists around centroids, searched by the nearest lists or exactly by bounds.

Centroids are fitted to a bounded sample (the ``SAMPLE`` rows of least id hash); every row is assigned to its nearest one and written to that
one's list. There are about sqrt(rows) lists, ``MOST_LISTS`` at most, so that centroids are few numbers that any task can hold.
Beside each list stands its radius, the greatest distance of a row from the centroid: by Cauchy and Schwarz no row of a list has
a dot product with q above q . c + |q| r.

A search with ``probes`` reads the lists of highest q . c only; what it finds is scored exactly, and how many of the true nearest it meets is measured by
``recall``. Without, it reads these first for a threshold, then every list whose bound reaches it: the result is exact. Many queries at once
are dealt to the lists that they probe: a list's rows and its queries meet in blocks of bounded size, and only each query's best of a block leave it.

Vectors that are null, of another dimension than the first by id, or hold null or non-finite numbers are in no list. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores

SAMPLE = 20_000
MOST_LISTS = 1024
ROUNDS = 12
#: Lists that an exact search reads first.
PROBES = 12
#: Of the nearest rows of so many of the sample's rows this share must stand in the lists that an approximate search reads.
TRIED, SHARE = 200, 0.97
#: Rows of a list, and queries that probe it, which meet in one task; scores that a task holds; queries that are dealt at once.
TOGETHER = 65_536
PAIRS = 1 << 22
AT_ONCE = 256


def fitted_probes(sample: np.ndarray, centres: np.ndarray, k: int = 10) -> int:
    """How many lists hold ``SHARE`` of the k nearest of some rows of the sample, by dot product."""
    own, _ = assigned(sample, centres)
    tried = sample[:TRIED]
    scores_ = tried @ sample.T
    scores_[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
    best = np.argsort(-scores_, axis=1)[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(-(tried @ centres.T), axis=1), axis=1)
    found = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(found[int(SHARE * (len(found) - 1))]) + 1 if len(found) else 1


def fit_centroids(sample: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k centroids by Lloyd's rounds from rows drawn far apart; an empty one takes the row farthest from its own."""
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    chosen = [int(rng.integers(len(sample)))]
    gap = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = gap.sum()
        chosen.append(int(rng.choice(len(sample), p=gap / total)) if total > 0 else len(chosen))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centres = sample[chosen].copy()
    for _ in range(ROUNDS):
        own, gap = assigned(sample, centres)
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        for c, row in zip(np.flatnonzero(count == 0), np.argsort(-gap)):
            centres[c] = sample[row]
    return centres


def assigned(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, distance to it) of each row."""
    square = (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)[None]
    own = square.argmin(1)
    return own, np.sqrt(((rows - centres[own]) ** 2).sum(1))


def _usable(v: Column, dims: int) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (F.size(v) == dims) & F.forall(v, fine)


class VectorIndex:
    """The index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._lists = None

    def build(self, rows: DataFrame, keep: list[str] | None = None, id_col: str = "id", vec_col: str = "embedding") -> VectorIndex:
        """Lists of all rows with the columns ``keep`` beside them, to filter by."""
        keep = keep or []
        named = rows.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *keep)
        first = named.agg(F.min_by(F.size("v"), "id").alias("dims")).first()
        dims = first.dims or 0
        named = named.filter(_usable(F.col("v"), dims))
        n = named.count()
        sample = np.array([r.v for r in named.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()], float).reshape(n and -1, dims)
        centres = fit_centroids(sample, max(1, min(MOST_LISTS, int(n**0.5)))) if n else np.zeros((0, dims))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
                    own, gap = assigned(flat, centres)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(gap)], [*batch.schema.names, "list", "gap"])

        listed = named.mapInArrow(run, named.withColumns({"list": F.lit(0), "gap": F.lit(0.0)}).schema)
        listed.repartition("list").sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{self.path}/rows")
        own = self.spark.read.schema(listed.schema).parquet(f"{self.path}/rows") if n else listed
        sizes = own.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"))
        middle = self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list int, centre array<double>")
        middle.join(sizes, "list").coalesce(1).write.parquet(f"{self.path}/lists")
        self.spark.createDataFrame([(dims, n, fitted_probes(sample, centres) if n else 1)], "dims int, n long, probes int").write.parquet(f"{self.path}/about")
        return self

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, centre, radius) of the lists that have rows: ``MOST_LISTS`` at most."""
        if self._lists is None:
            found = self.spark.read.parquet(f"{self.path}/lists").orderBy("list").collect()
            self._lists = (np.array([r.list for r in found], int), np.array([r.centre for r in found], float), np.array([r.radius for r in found], float))
        return self._lists

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        out = self.spark.read.parquet(f"{self.path}/rows")
        return out if lists is None else out.filter(F.col("list").isin(lists))

    def _best(self, lists: list[int], query: list[float], k: int, where: Column | None) -> DataFrame:
        rows = self.rows(lists) if where is None else self.rows(lists).filter(where)
        score = F.round(scores.dot(F.col("v"), F.array(*[F.lit(float(x)) for x in query])), 6)
        return rows.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)

    def search(self, query: list[float], k: int, probes: int | None = None, where: Column | None = None) -> DataFrame:
        """(id, score): the k rows of highest dot product with the query for which ``where`` holds; exact unless ``probes`` says how many lists are read."""
        lists, centres, radius = self.lists()
        q = np.array(query, float)
        if not len(lists) or len(q) != centres.shape[1]:
            return self.spark.createDataFrame([], "id long, score double")
        order = np.argsort(-(centres @ q), kind="stable")
        first = [int(x) for x in lists[order[: probes or PROBES]]]
        if probes or len(first) == len(lists):
            return self._best(first, query, k, where)
        found = self._best(first, query, k, where).collect()
        least = found[-1].score if len(found) == k else -np.inf
        bound = centres @ q + np.linalg.norm(q) * radius
        # scores are rounded to six digits, and a bound is a float too
        reach = [int(x) for x in lists[bound >= least - 1e-5]]
        return self._best(sorted({*first, *reach}), query, k, where)

    def search_many(self, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
        """(query_id, rank, id, score): of each query the k best of the rows in the ``probes`` lists nearest to it (as many as were fitted to the sample), but for itself."""
        probes = probes or self.spark.read.parquet(f"{self.path}/about").first().probes
        lists, centres, _ = self.lists()
        dims = centres.shape[1] if len(lists) else 0
        named = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).cast("array<double>").alias("q")).filter(_usable(F.col("q"), dims))
        row_parts = {r.list: -(-r.n // TOGETHER) for r in self.spark.read.parquet(f"{self.path}/lists").select("list", "n").collect()}
        parts, query_parts = np.array([row_parts[x] for x in lists], int), max(1, -(-named.count() // TOGETHER))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows if len(lists) else 0, AT_ONCE):
                    part = batch.slice(start, AT_ONCE)
                    flat = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
                    near = np.argsort(-(flat @ centres.T), axis=1, kind="stable")[:, :probes].ravel()
                    at = np.repeat(np.arange(part.num_rows), len(near) // part.num_rows)
                    again = np.repeat(np.arange(len(near)), parts[near])  # once for each part of a list's rows
                    row_part = np.arange(len(again)) - np.repeat(np.cumsum(parts[near]) - parts[near], parts[near])
                    columns = [part.column(i).take(pa.array(at[again])) for i in (0, 1, 2)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(lists[near][again].astype(np.int32)), pa.array(row_part.astype(np.int32))], ["query_id", "q", "query_part", "list", "row_part"])

        named = named.withColumn("query_part", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int"))
        dealt = named.mapInArrow(deal, named.withColumns({"list": F.lit(0), "row_part": F.lit(0)}).schema)
        pieces = F.create_map(*[F.lit(int(x)) for pair in row_parts.items() for x in pair]) if row_parts else F.create_map(F.lit(0), F.lit(1))
        rows = self.rows().select("id", "v", "list", F.pmod(F.xxhash64("id"), F.element_at(pieces, F.col("list"))).cast("int").alias("row_part"))
        rows = rows.withColumn("query_part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))
        keys = ["list", "row_part", "query_part"]
        types = [f"{name} {df.schema[of].dataType.simpleString()}" for name, df, of in (("query_id", named, "query_id"), ("id", rows, "id"))]
        hits = rows.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(lambda own, asked: _best_pairs(own, asked, k), f"{', '.join(types)}, score double")
        hits = hits.select("query_id", "id", F.round("score", 6).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _best_pairs(own: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """(query_id, id, score): the k best of the rows (id, v) for each query (query_id, q), but for itself."""
    n, dims = own.num_rows, len(asked["q"][0]) if asked.num_rows else 0
    ids, names = own["id"].combine_chunks(), asked["query_id"].combine_chunks()
    picked_rows, picked_queries, found = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    if n and asked.num_rows:
        order = pc.sort_indices(ids).to_numpy()
        ids = ids.take(pa.array(order))
        v = pc.list_flatten(own["v"]).to_numpy().reshape(n, dims)[order]
        q = pc.list_flatten(asked["q"]).to_numpy().reshape(-1, dims)
        self_at = pc.fill_null(pc.index_in(names, ids), -1).to_numpy(zero_copy_only=False)
        step = max(1, PAIRS // n)
        for start in range(0, len(q), step):
            score = v @ q[start : start + step].T
            here = self_at[start : start + step]
            score[here[here >= 0], np.flatnonzero(here >= 0)] = -np.inf
            top = min(k, n)
            least = np.partition(score, n - top, axis=0)[n - top]
            # the products above may differ from plain sums in the last digits, so that all within the rounding are summed again
            row, col = np.nonzero((score >= least - 2e-6) & (score > -np.inf))
            exact = np.zeros(len(row))
            for d in range(dims):
                exact += v[row, d] * q[start + col, d]
            by = np.lexsort((row, -np.round(exact, 6), col))
            row, col, exact = row[by], col[by], exact[by]
            keep = np.arange(len(col)) - np.searchsorted(col, col) < k
            picked_rows.append(row[keep]), picked_queries.append(start + col[keep]), found.append(exact[keep])
    at = lambda x: pa.array(np.concatenate(x))
    return pa.table([names.take(at(picked_queries)), ids.take(at(picked_rows)), at(found)], ["query_id", "id", "score"])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): of the exact rows (query_id, id) the share that was found."""
    pairs = lambda x: x.select("query_id", "id")
    hits = pairs(exact).join(pairs(found).withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def exact_many(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score) by comparing each of a bounded set of queries (id, v) with every row (id, v): the measure for ``recall``."""
    pairs = rows.join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), F.col("id") != F.col("query_id"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    hits = pairs.select("query_id", "id", F.round(scores.dot(F.col("v"), F.col("q")), 6).alias("score"))
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


