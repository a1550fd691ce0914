"""Graph operators as joins and partial aggregates; iterations cut their lineage at written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one is set only where it is unset and Spark runs in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Rows that a task sorts or tells apart.
ROWS = 500_000
#: Links of a block.
BLOCK = 1 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys to as many partitions as have about ``ROWS`` rows each: these stay apart, where Spark would put together what is small in compressed bytes. Counts the rows."""
    return df.repartition(max(8, -(-df.count() // ROWS)), *keys)


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Like ``cut``, for tables that are joined in each round: by sorting, as a broadcast would send them through the driver each time."""
    return cut(df).hint("merge")


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` has written, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Written to the shared folder in buckets by a key: joins and sums by it don't shuffle the table again."""
    spark = df.sparkSession
    name = f"graph_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.read.table(name)


def blocked(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (source_id, target_id, w), shuffled once: with the block that a target is in, a range of ids of about ``BLOCK`` links, and (block, source_id, w) of the sources that each block wants to hear of.

    In each round of a walk only the values of sources are sent to the blocks that want them. Where links run between ranges of ids that lie together these are about as many as nodes, otherwise as links at most.
    """
    edges = cut(edges)
    parts = max(8, -(-edges.count() // BLOCK))
    dealt = bucketed(edges.repartitionByRange(parts, "target_id").withColumn("block", F.spark_partition_id()), "block", parts)
    wanted = cut(dealt.groupBy("block", "source_id").agg(F.sum("w").alias("w")))
    drop(edges)
    return dealt, bucketed(wanted.repartition(parts, "source_id"), "source_id", parts)


def sent(edges: DataFrame, wanted: DataFrame, values: DataFrame) -> DataFrame:
    """The links with the values (id, value) of their sources; to be planned under ``by_block``."""
    told = wanted.select("block", "source_id").join(values.hint("shuffle_hash"), wanted["source_id"] == values["id"]).select("block", "source_id", "value")
    return edges.join(told.hint("shuffle_hash"), ["block", "source_id"])


#: A block of links in the order of their targets: how many each of ``targets`` has, and each link's place in ``sources`` (ascending), its weight, and whether that is known (empty where all are).
PACKED = "block long, sources array<long>, targets array<long>, n binary, at binary, w binary, known binary"


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in the least width that holds them, after its name in 8 bytes."""
    kind = np.dtype(next(t for t in ("u1", "i1", "u2", "i2", "i4", "i8") if np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max))
    return kind.str.encode().ljust(8) + x.astype(kind).tobytes()


def widened(cell: pa.Scalar) -> np.ndarray:
    """What ``_narrow`` has written."""
    kind = cell.as_buffer()
    return np.frombuffer(kind, bytes(kind[:8]).decode().strip(), offset=8)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (source_id, target_id, w) that come in the order of targets, in blocks of ``BLOCK`` or a little more, and a rest."""
    waiting, rows, made = [], 0, 0

    def packed() -> pa.RecordBatch:
        source, target, w = pa.Table.from_batches(waiting).columns
        sources, at = np.unique(source.to_numpy(), return_inverse=True)
        targets, n = np.unique(target.to_numpy(), return_counts=True)
        known = w.is_valid().to_numpy().tobytes() if w.null_count else b""
        block = (TaskContext.get().partitionId() << 32) + made
        columns = [pa.array([block]), pa.array([sources], pa.list_(pa.int64())), pa.array([targets], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (_narrow(n), _narrow(at), _narrow(w.fill_null(0).to_numpy()), known))]
        return pa.RecordBatch.from_arrays(columns, ["block", "sources", "targets", "n", "at", "w", "known"])

    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= 2 * BLOCK:
            yield packed()
            waiting, rows, made = [], 0, made + 1
    if rows:
        yield packed()


def packed(edges: DataFrame, about: int) -> tuple[DataFrame, DataFrame]:
    """About so many links (source_id, target_id, w; longs, ends not null), shuffled once: ``PACKED`` blocks of 2 * ``BLOCK`` links or little more, and (block, at, source_id), what each block wants to hear of and where it stands there.

    Links are dealt by ranges of target and source: a target's links lie in one block, or in several that follow each other, each of which then begins or ends with that target.
    """
    parts = max(8, -(-about // BLOCK))
    rows = edges.repartitionByRange(parts, "target_id", "source_id").sortWithinPartitions("target_id").mapInArrow(_pack, PACKED)
    blocks = bucketed(rows, "block", parts)
    wanted = blocks.select("block", F.posexplode("sources").alias("at", "source_id"))
    return blocks, bucketed(wanted.repartition(parts, "source_id"), "source_id", parts)


@contextmanager
def by_block(df: DataFrame) -> Iterator[None]:
    """Tables that meet by block and another key may lie by block alone."""
    key, spark = "spark.sql.requireAllClusterKeysForCoPartition", df.sparkSession
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def pagerank(links: DataFrame, rounds: int = 25, damping: float = 0.85, settled: float = 1e-6) -> DataFrame:
    """(id, rank): weighted ranks over (source_id, target_id, similarity, type); dangling rank isn't dealt out again.

    Ends after ``rounds``, or with the round in which no rank moves by ``settled``; 0 runs all rounds.
    """
    weight = F.col("similarity") * scores.link_weight(F.col("type"))
    edges, wanted = blocked(links.filter("source_id IS NOT NULL").select("source_id", "target_id", weight.alias("w")))
    ends = wanted.select(F.col("source_id").alias("id"), "w").unionAll(edges.select("block", F.col("target_id").alias("id")).distinct().select("id", F.lit(None).cast("double")))
    nodes = kept(ends.groupBy("id").agg(F.sum("w").alias("total")))
    n = nodes.count()
    ranks = nodes.withColumns({"rank": F.lit(1.0 / max(1, n)), "moved": F.lit(1.0)})
    new = F.lit((1 - damping) / max(1, n)) + damping * F.coalesce("got", F.lit(0.0))
    for done in range(rounds):
        met = sent(edges, wanted, ranks.select("id", (F.col("rank") / F.col("total")).alias("value")))
        got = met.groupBy("block", F.col("target_id").alias("id")).agg(F.sum(F.col("w") * F.col("value")).alias("got")).select("id", "got")
        with by_block(edges):
            step = kept(ranks.join(got, "id", "left").select("id", "total", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")))
        if done:
            drop(ranks)
        ranks = step
        if settled and (step.agg(F.max("moved")).first()[0] or 0.0) < settled:
            break
    return ranks.select("id", "rank")


def roles(links: DataFrame) -> DataFrame:
    """(id, indegree, outdegree, role)."""
    ends = links.select(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(links.select("target_id", F.lit(0), F.lit(1)))
    n = ends.groupBy("id").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))
    i, o = F.col("indegree"), F.col("outdegree")
    return n.withColumn("role", F.when(i == 0, "source").when(o == 0, "sink").when((i > 1) & (o > 1), "hub").when(o > 1, "fork").when(i > 1, "join").otherwise("pipe"))
