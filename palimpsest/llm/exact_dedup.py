"""Exact deduplication: grouped by a 128-bit content hash, with bytes compared inside the groups.

DataFrame functions only. Rows are counted by hash first (map-side sums, so that a hash which a third
of all rows share costs one row a task); only texts of hashes seen twice are then compared, each once a task.
Rows get their group's verdict by hash alone, and by hash and text where a hash stands for several texts.

Defined results. A null text counts as empty; empty texts are one group like any other. Repeated rows
(same id, same text) count as rows and share their id's verdict. A null id is smaller than any other;
a group of null ids keeps null. Other columns of the input, whatever their names, take no part. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import free_name, materialize

#: Hashes of repeated texts up to this number are broadcast (16 bytes each); beyond it texts are shuffled to them.
BROADCAST_HASHES = 1_000_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "largest" or "smallest" id of a group of equal texts stays.
    """
    best = F.max if keep == "largest" else F.min
    text = F.coalesce(docs[text_col], F.lit(""))
    base = docs.select(docs[id_col].alias("doc_id"), text.alias("content"), F.unhex(F.md5(text)).alias("h"), F.sha2(text, 256).alias("text_sha256"))
    rows = base.drop("content")
    groups = materialize(rows.groupBy("h").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    repeated = groups.filter("group_size > 1").select("h")
    few = repeated.count() <= BROADCAST_HASHES
    # equal bytes, not only equal hashes: a collision splits here
    shared = base.join(F.broadcast(repeated) if few else repeated, "h", "left_semi")
    classes = shared.groupBy("h", "content").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = materialize(classes.withColumn("classes", F.count(F.lit(1)).over(Window.partitionBy("h"))).withColumn("content", F.when(F.col("classes") > 1, F.col("content"))), "classes")
    # the content goes along only where a hash stands for several texts; both sides are plain tables, so Spark splits a hash that many rows share
    verdicts = groups.filter("group_size = 1").unionByName(classes.filter("classes = 1").select("h", "keep_id", "group_size"))
    alike = rows.join(verdicts, "h")
    split = classes.filter("classes > 1")
    apart = base.join(F.broadcast(split.select("h").distinct()) if few else split.select("h").distinct(), "h", "left_semi").join(split, ["h", "content"])

    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return alike.select(*columns).unionByName(apart.select(*columns))


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``docs`` with one row for each different text, all columns as they are.

    Rows are ranked by hash and content; each task first drops all but its best row of a text, so that a text
    which a third of all rows share sends one row a task.
    """
    content = F.coalesce(docs[text_col], F.lit(""))
    order = docs[id_col].desc_nulls_last() if keep == "largest" else docs[id_col].asc_nulls_last()
    best = Window.partitionBy(F.unhex(F.md5(content)), content).orderBy(order)
    rank = free_name(docs, "rank")
    return docs.withColumn(rank, F.row_number().over(best)).filter(F.col(rank) == 1).drop(rank)
