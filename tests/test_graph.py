"""Iterated graph operators, run to their own bounds, against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import graph, links

SCHEMA = "source_id long, target_id long, similarity double, type string"
WEIGHT = {"caused_by": 2.0, "updates": 1.5, "extends": 1.3, "consolidates": 0.5, "related": 1.0}


def made_up(n, out, seed):
    rng = random.Random(seed)
    return [(i, j, rng.randint(5, 9) / 10, rng.choice(sorted(WEIGHT))) for i in range(n) for j in rng.sample([x for x in range(n) if x != i], out)]


def plain_ranks(edges, settled, most=25):
    ids = {x for e in edges for x in e[:2]}
    total = {i: sum(s * WEIGHT[t] for a, _, s, t in edges if a == i) for i in ids}
    ranks = {i: 1 / len(ids) for i in ids}
    for done in range(1, most + 1):
        new = {i: 0.15 / len(ids) + 0.85 * sum(ranks[a] * s * WEIGHT[t] / total[a] for a, b, s, t in edges if b == i) for i in ids}
        moved, ranks = max(abs(new[i] - ranks[i]) for i in ids), new
        if moved < settled:
            break
    return ranks, done


def plain_labels(edges, most):
    labels = {x: x for e in edges for x in e[:2]}
    for done in range(1, most + 1):
        votes = {}
        for a, b, s, t in edges:
            own = votes.setdefault(b, {})
            own[labels[a]] = own.get(labels[a], 0) + round(s * WEIGHT[t] * 100)
        new = {i: min(votes[i], key=lambda x, i=i: (-votes[i][x], x)) if i in votes else label for i, label in labels.items()}
        same, labels = new == labels, new
        if same:
            break
    return labels, done


@pytest.mark.parametrize("out", [1, 8])
def test_pagerank_runs_until_settled(spark, out):
    edges = made_up(30, out, 5)
    want, done = plain_ranks(edges, 1e-6)
    assert (done < 25) == (out == 8)
    got = {r.id: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, SCHEMA)).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    every = plain_ranks(edges, 0)[0]
    assert out == 1 or max(abs(want[i] - every[i]) for i in want) > 1e-9  # the stop shows in the ranks


def test_communities_run_until_settled(spark):
    edges = [(i, i + 1, 0.5, "related") for i in range(10)]  # a label that travels ten links
    want, done = plain_labels(edges, 15)
    assert 10 < done < 15 and set(want.values()) == {0} and plain_labels(edges, 3)[0] != want
    assert {r.id: r.label for r in links.communities(spark.createDataFrame(edges, SCHEMA)).collect()} == want
    edges = [(0, 1, 0.5, "related"), (1, 0, 0.5, "related")]  # labels that change places for ever
    want, done = plain_labels(edges, 15)
    assert done == 15 and {r.id: r.label for r in links.communities(spark.createDataFrame(edges, SCHEMA)).collect()} == want


def test_empty_graph(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert graph.pagerank(none).count() == 0 and links.communities(none).count() == 0


def test_rows_stay_in_bounded_partitions(spark, monkeypatch):
    """However few bytes rows take, a task gets about ``ROWS`` of them."""
    monkeypatch.setattr(graph, "ROWS", 100)
    rows = spark.range(2000).select((F.col("id") % 50).alias("source_id"), F.col("id").alias("target_id"), F.lit(0.5).alias("similarity"), F.lit("updates").alias("type"))
    assert links.both_ways(rows).rdd.getNumPartitions() == 40 and links.both_ways(rows).count() == 4000 - 50
    assert links.strongest(rows, 3).rdd.getNumPartitions() == 20 and links.strongest(rows, 3).count() == 150


def test_links_are_shuffled_once(spark, monkeypatch):
    """In a round links stay where they lie: what is exchanged are values of nodes."""
    monkeypatch.setattr(graph, "BLOCK", 40)
    rows = made_up(60, 8, 9)
    edges, wanted = graph.blocked(spark.createDataFrame(rows, SCHEMA).select("source_id", "target_id", F.col("similarity").alias("w")))
    assert edges.select("block").distinct().count() == 12 and edges.select("block", "target_id").distinct().count() == edges.select("target_id").distinct().count()
    with graph.by_block(edges):
        met = graph.sent(edges, wanted, spark.range(60).withColumn("value", F.lit(1.0))).groupBy("block", "target_id").agg(F.sum("value").alias("n"))
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert sum(r.n for r in met.collect()) == 480
    assert plan.count("Exchange hashpartitioning(block") == 1 and plan.count("Exchange") == 2, plan
    want = plain_ranks(rows, 1e-6)[0]
    assert {r.id: r["rank"] for r in graph.pagerank(spark.createDataFrame(rows, SCHEMA)).collect()} == pytest.approx(want, abs=1e-12)


def test_communities_exchange_labels_and_votes_only(spark, monkeypatch):
    """Links are shuffled once, into blocks of bounded size; what a round shuffles grows with nodes and blocks, and a target of more links than a block has is right."""
    monkeypatch.setattr(graph, "BLOCK", 40)
    blocks = []
    pack, join = links.packed, links._voted
    monkeypatch.setattr(links, "packed", lambda edges, about: blocks.append(pack(edges, about)) or blocks[0])
    monkeypatch.setattr(links, "drop", lambda *_: None)
    rows = made_up(60, 8, 9) + [(i, 1000, 0.5 + i % 3 / 10, "updates") for i in range(2000, 2300)]  # 300 links to one target
    rows += [(2000, 2000 + i % 4, 0.5, "related") for i in range(200)]  # a link many times over
    want, done = plain_labels(rows, 15)
    assert {r.id: r.label for r in links.communities(spark.createDataFrame(rows, SCHEMA)).collect()} == want
    dealt, wanted = blocks[0]
    sizes = [r for r in dealt.select("block", "n", "targets", "sources").collect()]
    n = [int(np.frombuffer(r.n, r.n[:8].decode().strip(), offset=8).sum()) for r in sizes]
    assert sum(n) == len(rows) and len(n) > 8
    assert sum(1000 in r.targets for r in sizes) > 3 and wanted.count() == sum(len(r.sources) for r in sizes)
    label = pa.table({"at": pa.array(range(len(sizes[0].sources)), pa.int32()), "label": pa.array([7] * len(sizes[0].sources), pa.int64())})
    own = pa.Table.from_pylist([dealt.filter(F.col("block") == sizes[0].block).first().asDict()])
    assert join(own, label).num_rows == len(sizes[0].targets)  # of all a target's links one vote goes on


def test_communities_of_odd_links(spark):
    """Ends and weights that are null, weights below zero, wide ids."""
    rows = [(1, 2, None, "updates"), (3, 2, None, "updates"), (4, 5, -0.5, "updates"), (6, 5, None, "updates"), (None, 7, 0.5, "updates"), (8, None, 0.5, "updates"), (1 << 60, 9, 3e12, "related"), (10, 9, 299.0, "related")]
    got = {r.id: r.label for r in links.communities(spark.createDataFrame(rows, SCHEMA), 1).collect()}
    assert got == {None: None, 1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 1 << 60, 10: 10, 1 << 60: 1 << 60}
