"""Rules in which one step's order or one user's rows decide, with cases that tell them from nearby ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import extraction, similar, states, structure


def test_each_field_follows_its_own_last_command(spark):
    rows = spark.createDataFrame([(i, False, False, "pending") for i in range(1, 8)], "id long, is_forgotten boolean, is_archived boolean, status string")
    log = [
        (1, 1, "forget"), (1, 2, "approve"), (2, 1, "delete"), (2, 2, "approve"), (3, 1, "archive"), (3, 2, "approve"), (4, 1, "reject"), (4, 2, "approve"),
        (5, 1, "approve"), (5, 2, "reject"), (5, 3, "unarchive"), (6, 1, "archive"), (6, 2, "unarchive"), (6, 3, "forget"),
    ]
    out = {r.id: (r.is_forgotten, r.is_archived, r.status) for r in states.commanded(rows, spark.createDataFrame(log, "id long, at long, command string")).collect()}
    assert out == {
        1: (True, False, "approved"), 3: (False, True, "approved"), 4: (False, True, "approved"), 5: (False, False, "rejected"), 6: (True, False, "pending"), 7: (False, False, "pending"),
    }


@pytest.mark.parametrize("partitions", [1, 7])
def test_feedback_is_kept_within_bounds_at_each_signal(spark, partitions):
    rng = random.Random(2)
    kinds = ["helpful", "irrelevant", "used", "ignored"]
    log = [(rng.randrange(5), k, rng.choices(kinds, [1, 1, 1, 1] if k < 200 else [4, 1, 1, 1])[0]) for k in range(400)] + [(7, 1, "helpful"), (7, 2, "irrelevant"), (8, 1, "irrelevant"), (8, 2, "helpful"), (9, 1, "used"), (None, 1, "helpful")]
    start = {**{i: float(3 * i) for i in range(4)}, 4: 10.0, 7: 10.0, 8: 0.0, 9: 4.0, 10: 5.0}
    want = dict(start)
    for i, _, s in sorted(x for x in log if x[0] is not None):
        want[i] = min(10.0, want[i] + 0.5) if s == "helpful" else max(0.0, want[i] - 0.3) if s == "irrelevant" else want[i]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows, signals = spark.createDataFrame(list(start.items()), "id long, importance double"), spark.createDataFrame(log, "id long, at long, signal string")
        assert {r.id: r.importance for r in states.with_feedback(rows, signals).collect()} == pytest.approx(want, abs=1e-6)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert want[7] == pytest.approx(9.7) and want[8] == pytest.approx(0.5) and want[9] == 4.0


def test_users_never_meet(spark):
    rows = spark.createDataFrame([(1, 1, "I live in Lisbon. I really enjoy the gardening."), (2, 2, "I live in Berlin. I really enjoy the gardening.")], "id long, user_id long, content string")
    found = extraction.states(rows).collect()
    assert {(r.user_id, r.previous_value, r.updates) for r in found if r.key == "current_location"} <= {(1, None, 1), (2, None, 1)}
    assert {r.strength for r in extraction.preferences(rows).collect()} <= {1.0}
    prints = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 1, 1), (4, 2, 7)], "id long, user_id long, simhash long")
    assert {(r.a, r.b) for r in similar.near_simhashes(prints, owner="user_id").collect()} == {(1, 3), (2, 4)}
    assert {(r.a, r.b) for r in similar.near_simhashes(prints).collect()} == {(1, 3), (1, 4), (3, 4)}
    same = spark.createDataFrame([(i, i % 2, [1.0, 0.01 * i]) for i in range(4)], "id long, user_id long, embedding array<double>")
    for exact in (False, True):
        assert {(r.a, r.b) for r in similar.near_vectors(same, 0.9, owner="user_id", exact=exact).collect()} == {(0, 2), (1, 3)}


def planted(n, dims, least):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1)[:, None]
    off = rng.normal(size=(n, dims))
    off -= (off * v).sum(1)[:, None] * v
    off /= np.linalg.norm(off, axis=1)[:, None]
    s = rng.uniform(least + 0.002, least + 0.02, n)[:, None]
    return v, s * v + np.sqrt(1 - s**2) * off


@pytest.mark.parametrize("bits", [10, 16, 22])
def test_recall_at_the_threshold_stays(spark, bits):
    a, b = planted(300, 24, 0.9)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate([*a, *b])], "id long, embedding array<double>")
    found = {(r.a, r.b) for r in similar.near_vectors(rows, 0.9, bits=bits).collect()}
    assert sum((i, i + 300) in found for i in range(300)) >= 294
    assert similar.bands_for(0.9, bits, 0.99) > similar.bands_for(0.95, bits, 0.99) > 0


def test_exact_pairs(spark):
    a, b = planted(200, 6, 0.9)
    v = np.concatenate([a, b])
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [1.0])], "id long, embedding array<double>")
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if v[i] @ v[j] >= 0.9}
    assert {(r.a, r.b) for r in similar.near_vectors(rows, 0.9, exact=True).collect()} == want
    assert similar.near_vectors(rows.limit(0), 0.9).count() == 0


def test_no_pair_is_missed(spark):
    """Planes of a band miss some pairs at the threshold; without them all are found, in many blocks too, in other lengths too."""
    a, b = planted(2000, 24, 0.9)
    v = [*a, *b, *(x[:12] / np.linalg.norm(x[:12]) for x in a[:5]), *(x[:12] / np.linalg.norm(x[:12]) + 1e-4 for x in a[:5])]
    rows = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(9000, [None, 1.0])], "id long, embedding array<double>")
    near = {(i, j) for i, j in zip(*np.nonzero(np.triu(np.array(v[:4000]) @ np.array(v[:4000]).T >= 0.9, 1)))} | {(4000 + i, 4005 + i) for i in range(5)}
    found = {(r.a, r.b): r.similarity for r in similar.near_vectors(rows, 0.9).collect()}
    assert {p for p in found if p[1] < 4000 or p[1] - p[0] == 5} == near and len(near) >= 2005
    assert all(abs(s - v[i] @ v[j]) < 1e-12 for (i, j), s in found.items())


def test_merged_sources(spark):
    pairs = spark.createDataFrame([(1, 2, 0.95), (2, 3, 0.95), (4, 5, 0.99)], "a long, b long, similarity double")
    clusters = similar.duplicate_clusters(pairs)
    rows = spark.createDataFrame([(1, 3), (2, 4), (3, 2), (4, None), (5, 1)], "id long, source_count int")
    assert {tuple(r) for r in similar.merged(clusters, rows).collect()} == {(1, 6, 1), (4, 1, 1)}
    assert {(r.source_id, r.target_id, r.type) for r in similar.merge_links(clusters, pairs).collect()} == {(1, 2, "derives"), (4, 5, "derives")}


def plain_cycles(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)

    def reach(x):
        seen, queue = set(), [x]
        while queue:
            for y in near.get(queue.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    queue.append(y)
        return seen

    far = {x: reach(x) for e in edges for x in e}
    return {x: max(y for y in far[x] if x in far[y]) for x in far if x in far[x]}


def test_cycles(spark):
    frame = lambda e: spark.createDataFrame(e, "u long, v long")
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (6, 7), (8, 1), (10, 11), (11, 12), (12, 10), (20, 21), (21, 20), (21, 22), (22, 20)]
    assert {r.id: r.cycle for r in structure.cycles(frame([*edges, (9, 9)])).collect()} == plain_cycles(edges)
    rng = random.Random(6)
    edges = [(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(38)) if a != b]
    assert {r.id: r.cycle for r in structure.cycles(frame(edges)).collect()} == plain_cycles(edges)
    assert structure.cycles(frame([(1, 2)])).collect() == [] and structure.cycles(frame([])).collect() == []


def test_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)], "u long, v long")
    assert [r.id for r in structure.shortest_path(edges, 0, 70).orderBy("place").collect()] == list(range(71))
    assert structure.shortest_path(edges, 70, 0).filter(F.lit(True)).collect() == []
