"""Betweenness and communities against plain versions."""

import random
from collections import defaultdict, deque

import pytest

from palimpsest.operators import centrality


def brandes(edges):
    near, total = defaultdict(list), {x: 0.0 for e in edges for x in e}
    for a, b in set(edges):
        near[a].append(b)
    for s in total:
        ways, dist, before, order, queue = defaultdict(float, {s: 1.0}), {s: 0}, defaultdict(list), [], deque([s])
        while queue:
            x = queue.popleft()
            order.append(x)
            for y in near[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    queue.append(y)
                if dist[y] == dist[x] + 1:
                    ways[y] += ways[x]
                    before[y].append(x)
        behind = defaultdict(float)
        for y in reversed(order):
            for x in before[y]:
                behind[x] += ways[x] / ways[y] * (1 + behind[y])
            if y != s:
                total[y] += behind[y]
    n = len(total)
    return {x: v / ((n - 1) * (n - 2)) if n > 2 else v for x, v in total.items()}


def quality(edges, label):
    m = sum(edges.values())
    k, inside = defaultdict(float), 0.0
    for (a, b), w in edges.items():
        k[label[a]] += w
        k[label[b]] += w
        inside += w if label[a] == label[b] else 0
    return inside / m - sum((x / (2 * m)) ** 2 for x in k.values())


def plain_louvain(edges):
    """One node at a time, in order of ids, level by level."""
    name = {x: x for e in edges for x in e}
    while True:
        near, k = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for (a, b), w in edges.items():
            near[a][b] += w
            near[b][a] += w
            k[a] += w
            k[b] += w
        m2, label, weight, moved = sum(k.values()), {x: x for x in k}, dict(k), False
        again = True
        while again:
            again = False
            for x in sorted(k):
                to = defaultdict(float)
                for y, w in near[x].items():
                    if y != x:
                        to[label[y]] += w
                weight[label[x]] -= k[x]
                best = max([label[x], *sorted(to)], key=lambda c: to[c] - k[x] * weight.get(c, 0) / m2)
                if to[best] - k[x] * weight.get(best, 0) / m2 > to[label[x]] - k[x] * weight[label[x]] / m2 + 1e-12:
                    label[x], again, moved = best, True, True
                weight[label[x]] = weight.get(label[x], 0) + k[x]
        name = {x: label[c] for x, c in name.items()}
        if not moved:
            return name
        folded = defaultdict(float)
        for (a, b), w in edges.items():
            folded[tuple(sorted((label[a], label[b])))] += w
        edges = folded


@pytest.mark.parametrize("seed, n, m, pairs", [(2, 14, 30, 100), (3, 25, 32, 10**6)])
def test_betweenness(spark, seed, n, m, pairs):
    rng = random.Random(seed)
    edges = [(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b]
    frame = spark.createDataFrame(edges + edges[:3] + [(5, 5), (None, 3), (3, None)], "u long, v long")
    got = {r.id: r.centrality for r in centrality.betweenness(frame, pairs).collect()}
    assert got == pytest.approx(brandes(edges), abs=1e-9) and max(got.values()) > 0


def test_betweenness_in_bounded_groups(spark, monkeypatch):
    """A group holds at most ``SIZE`` pairs or one source, and sums its messages in pieces."""
    for name, value in (("SIZE", 12), ("PARTS", 3), ("CHUNK", 4), ("TASK", 64)):
        monkeypatch.setattr(centrality, name, value)
    edges = [(0, x) for x in range(1, 9)] + [(x, 9) for x in range(1, 9)] + [(9, 10), (10, 0), (10, 11), (11, 12)]
    groups, sent = [], centrality.cut

    def cut(df):
        out = sent(df)
        if "block" in df.columns:
            groups.append(out.filter("kind = 'level'").selectExpr("coalesce(max(length(at)) / 4, 0) AS n").first().n)
        return out

    monkeypatch.setattr(centrality, "cut", cut)
    got = {r.id: r.centrality for r in centrality.betweenness(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == pytest.approx(brandes(edges), abs=1e-9) and got[0] > 0
    assert 0 < max(groups) <= 12


def test_betweenness_of_little(spark):
    frame = lambda rows: spark.createDataFrame(rows, "u long, v long")
    assert centrality.betweenness(frame([])).collect() == []
    assert {r.id: r.centrality for r in centrality.betweenness(frame([(1, 2)])).collect()} == {1: 0.0, 2: 0.0}
    assert {r.id: r.centrality for r in centrality.betweenness(frame([(1, 2), (2, 3)])).collect()} == {1: 0.0, 2: 0.5, 3: 0.0}


@pytest.mark.parametrize("seed", [1, 2])
def test_louvain(spark, seed):
    rng = random.Random(seed)
    edges = {}
    for _ in range(260):  # eight groups of ten with few edges between them
        a = rng.randrange(80)
        b = a // 10 * 10 + rng.randrange(10) if rng.random() < 0.85 else rng.randrange(80)
        if a != b:
            edges[min(a, b), max(a, b)] = 1.0
    frame = spark.createDataFrame([*edges, *[(b, a) for a, b in list(edges)[:20]], (3, 3)], "u long, v long")
    label = {r.id: r.community for r in centrality.louvain(frame).collect()}
    assert set(label) == {x for e in edges for x in e}
    assert all(c == min(x for x in label if label[x] == c) for c in label.values())
    assert quality(edges, label) >= quality(edges, plain_louvain(edges)) - 0.02


def test_louvain_of_little(spark):
    frame = lambda rows: spark.createDataFrame(rows, "u long, v long, w double")
    assert centrality.louvain(frame([])).collect() == []
    two = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (11, 12, 1.0), (12, 13, 1.0), (11, 13, 1.0), (3, 11, 0.1)]
    assert {r.id: r.community for r in centrality.louvain(frame(two), "w").collect()} == {1: 1, 2: 1, 3: 1, 11: 11, 12: 11, 13: 11}


def test_betweenness_of_a_long_way(spark, monkeypatch):
    """Of a graph that a task can hold no table is written for each level, whatever tasks and blocks its sources are dealt to."""
    written, sent = [], centrality.cut
    monkeypatch.setattr(centrality, "cut", lambda df: written.append(df) or sent(df))
    for name, value in (("WALK", 64), ("WALKS", 5), ("SIZE", 130), ("CHUNK", 130)):
        monkeypatch.setattr(centrality, name, value)
    edges = [(x, x + 1) for x in range(40)] + [(3, 30), (30, 7), (41, 20), (7, 42), (42, 9), (7, 43), (43, 9)]
    frame = spark.createDataFrame(edges, "u long, v long")
    got = {r.id: r.centrality for r in centrality.betweenness(frame).collect()}
    assert got == pytest.approx(brandes(edges), abs=1e-9) and max(got.values()) > 0 and len(written) <= 4


def test_betweenness_by_levels(spark, monkeypatch):
    monkeypatch.setattr(centrality, "SIZE", 20)
    rng = random.Random(3)
    edges = [(a, b) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(32)) if a != b]
    got = {r.id: r.centrality for r in centrality.betweenness(spark.createDataFrame(edges, "u long, v long"), 300).collect()}
    assert got == pytest.approx(brandes(edges), abs=1e-9) and max(got.values()) > 0
