"""Neighbourhoods over typed links (source_id, target_id, similarity, type): joins on keys, no pairs within a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .graph import cut, drop, packed, spread, widened


def both_ways(links: DataFrame) -> DataFrame:
    """(id, other): each link once from either end."""
    return spread(links.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).union(links.select("target_id", "source_id")), "id", "other").distinct()


def neighbours(links: DataFrame) -> DataFrame:
    """(id, n): how many others each row is linked with, in either direction."""
    return both_ways(links).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def hubs(links: DataFrame, least: int = 8, k: int = 10) -> DataFrame:
    """(id, n): the k rows of most links out, of those with ``least`` or more."""
    n = links.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n") >= least).orderBy(F.desc("n"), "id").limit(k)


def strongest(links: DataFrame, k: int) -> DataFrame:
    """Each source's k links of highest similarity, ties to the smaller target."""
    order = Window.partitionBy("source_id").orderBy(F.desc("similarity"), "target_id")
    return spread(links, "source_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("source_id", "target_id", "similarity", "rank")


def hops(links: DataFrame, seeds: list[int], most: int = 2) -> DataFrame:
    """(id, hop): what is reached from the seeds in at most so many links, and the least number of them."""
    ends = cut(both_ways(links))
    near = ends.filter(F.col("id").isin(seeds)).select(F.col("other").alias("id")).distinct()
    found = ends.filter(F.col("id").isin(seeds)).select("id", F.lit(0).alias("hop")).union(near.select("id", F.lit(1)))
    for hop in range(2, most + 1):
        near = ends.join(near, "id", "left_semi").select(F.col("other").alias("id")).distinct()
        found = found.union(near.select("id", F.lit(hop)))
    return found.groupBy("id").agg(F.min("hop").alias("hop"))


def _voted(own: pa.Table, told: pa.Table) -> pa.Table:
    """Votes (id, label, w) of a block's links, by the labels (at, label) of its sources: of a target whose links are all here the one that wins, of the first and the last target all."""
    n, at, w = (widened(own[c][0]) for c in ("n", "at", "w"))
    known = np.frombuffer(own["known"][0].as_buffer(), np.bool_)
    label = np.empty(told.num_rows, np.int64)
    label[told["at"].to_numpy()] = told["label"].to_numpy()
    names, code = np.unique(label, return_inverse=True)
    pair = np.repeat(np.arange(len(n)) * len(names), n) + code[at]
    order = np.argsort(pair)
    first = np.flatnonzero(np.diff(pair[order], prepend=-1))
    target, code = np.divmod(pair[order[first]], len(names))
    total = np.add.reduceat(w[order], first, dtype=np.int64)
    some = np.logical_or.reduceat(known[order], first) if len(known) else np.ones(len(first), bool)
    weight = np.where(some, total, np.iinfo(np.int64).min)
    best = np.maximum.reduceat(weight, np.flatnonzero(np.diff(target, prepend=-1)))[target]
    least = np.flatnonzero(weight == best)
    goes = (target == 0) | (target == len(n) - 1)
    goes[least[np.diff(target[least], prepend=-1) > 0]] = True
    columns = [pa.array(own["targets"][0].values.to_numpy()[target[goes]]), pa.array(names[code[goes]]), pa.array(total[goes], mask=~some[goes])]
    return pa.Table.from_arrays(columns, ["id", "label", "w"])


def communities(links: DataFrame, rounds: int = 15) -> DataFrame:
    """(id, label): each round a row takes the label of most weight among its sources, ties to the smaller label.

    Weights are whole hundredths, so that sums don't depend on their order. Rows that nothing points to keep theirs.
    Ends after ``rounds``, or with the round in which no label changes. Links lie in blocks and are shuffled once; a round exchanges
    labels that blocks want to hear of and votes that may win.
    """
    kind = links.schema["source_id"].dataType
    weight = F.round(F.col("similarity") * scores.link_weight(F.col("type")) * 100).cast("long")
    edges = links.select(F.col("source_id").cast("long").alias("source_id"), F.col("target_id").cast("long").alias("target_id"), weight.alias("w"))
    whole = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    blocks, wanted = packed(edges.filter(whole), links.count())
    ends = wanted.select("source_id").unionAll(blocks.select(F.explode("targets"))).unionAll(edges.filter(~whole).select(F.explode(F.array("source_id", "target_id"))))
    labels = cut(ends.distinct().select(F.col("source_id").alias("id"), F.col("source_id").alias("label")))
    none = F.lit(None).cast("long")
    for _ in range(rounds):
        told = wanted.join(labels.hint("shuffle_hash"), wanted.source_id == labels.id).select("block", "at", "label")
        heard = blocks.select("block", "targets", "n", "at", "w", "known").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_voted, "id long, label long, w long")
        votes = heard.groupBy("id", "label").agg(F.sum("w").alias("w")).withColumn("own", none)
        every = votes.unionByName(labels.select("id", none.alias("label"), none.alias("w"), F.col("label").alias("own")))
        won = every.groupBy("id").agg(F.max_by("label", F.struct(F.col("label").isNotNull(), "w", -F.col("label"))).alias("won"), F.max("own").alias("own"))
        step = cut(won.select("id", F.coalesce("won", "own").alias("label"), (F.col("won") != F.col("own")).alias("changed")))
        drop(labels)
        labels = step
        if step.filter("changed").isEmpty():
            break
    drop(blocks, wanted)
    return labels.select(F.col("id").cast(kind), F.col("label").cast(kind))


def unmatched(rows: DataFrame, others: DataFrame, key: str, other_key: str) -> DataFrame:
    """``rows`` that nothing in ``others`` refers to."""
    return rows.join(others.select(F.col(other_key).alias(key)).distinct(), key, "left_anti")


def ancestors(parents: DataFrame, start: int, depth: int = 20) -> DataFrame:
    """(id, depth): the line above a row in (id, parent_id), its own depth 0, as far as ``depth``."""
    return parents.sparkSession.sql(
        """WITH RECURSIVE line(id, depth) AS (
            SELECT id, 0 FROM {parents} WHERE id = {start}
            UNION ALL
            SELECT p.parent_id, line.depth + 1 FROM line JOIN {parents} p ON p.id = line.id WHERE p.parent_id IS NOT NULL AND line.depth < {depth}
        ) SELECT id, depth FROM line""",
        parents=parents, start=start, depth=depth,
    )
