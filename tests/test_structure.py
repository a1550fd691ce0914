"""Graph structure, folds and cuts against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import reviews
from palimpsest.operators import ranking, similar, structure
from palimpsest.operators.graph import kept
from palimpsest.sources import chunks, formats


def graph(seed, n, m):
    rng = random.Random(seed)
    return sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def parts(edges, nodes):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    label = {}
    for x in sorted(nodes):
        queue = [x] if x not in label else []
        while queue:
            y = queue.pop()
            if y not in label:
                label[y] = x
                queue += near[y]
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_bridges(spark, seed):
    edges = graph(seed, 40, 42)
    frame = spark.createDataFrame(edges + [(7, 7), (None, 3)], "u long, v long")
    nodes = {x for e in edges for x in e}
    label = parts(edges, nodes)
    assert {r.id: r.component for r in structure.components(frame).collect()} == label
    want = {e for e in edges if len(set(parts([x for x in edges if x != e], nodes).values())) > len(set(label.values()))}
    assert {(r.a, r.b) for r in structure.bridges(frame).collect()} == want and want


def test_empty_graph(spark):
    empty = spark.createDataFrame([], "u long, v long")
    assert not structure.components(empty).collect() and not structure.levels(empty).collect() and not structure.bridges(empty).collect() and not structure.shortest_path(empty, 1, 2).collect()


def test_path_and_levels(spark):
    frame = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (6, 7), (7, 6)], "u long, v long")
    assert [r.id for r in structure.shortest_path(frame, 1, 5).orderBy("place").collect()] == [1, 2, 3, 5]
    assert {r.id: r.level for r in structure.levels(frame).collect()} == {1: 0, 2: 1, 4: 1, 3: 2, 5: 3, 6: None, 7: None}


def test_duplicate_clusters_are_greedy(spark):
    """1-2, 2-3: 2 is claimed by 1, so 3 is an anchor of its own."""
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 9), (7, 9)], "a long, b long")
    assert {r.id: r.anchor for r in similar.duplicate_clusters(pairs).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 9: 5, 7: 7}


def test_hamming_pairs(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(6)]
    prints = [(len(base) * k + i, b ^ sum(1 << rng.randrange(63) for _ in range(k))) for i, b in enumerate(base) for k in range(5)]
    prints.append((99, base[0]))
    one = {}
    for i, p in sorted(prints):
        one.setdefault(p, i)
    want = {(i, j, (p ^ q).bit_count()) for p, i in one.items() for q, j in one.items() if i < j and (p ^ q).bit_count() <= 3}
    assert {tuple(r) for r in similar.near_simhashes(spark.createDataFrame(prints, "id long, simhash long")).collect()} == want and want


def test_reviews():
    s = reviews.review(None, 3, 0.0)
    assert s[4:] == (2, 1, 0) and s[0] == pytest.approx(2.3065)
    lapse = reviews.review(s, 1, 5.0)
    assert lapse[4:] == (3, 2, 1) and lapse[0] < s[0] and lapse[2] == 1.3
    assert reviews.review(s, 3, 0.5)[4:] == (2, 2, 0) and reviews.review(s, 4, 30.0)[0] > reviews.review(s, 2, 30.0)[0]


def test_chunks_and_strategies():
    assert list(chunks.embedding_pieces("")) == [] and list(chunks.embedding_pieces(" a ")) == ["a"]
    text = "One sentence here. " * 200
    pieces = list(chunks.embedding_pieces(text))
    assert len(pieces) <= 6 and all(len(p) <= 1440 and p.endswith(".") for p in pieces)
    headed = "x " * 1000 + "\n## Head\n" + "y " * 1200
    assert list(chunks.document_pieces(headed))[0] == ("x " * 1000).strip()
    assert ranking.blended({"temporal": 1.0}) == ranking.STRATEGIES["temporal"]
    assert ranking.blended({"fact_recall": 0.5, "reasoning": 0.5})["expand"] is True and ranking.with_preset({"limit": None, "x": 1}, "timeline")["limit"] == 20


def test_odd_archives(spark):
    files = spark.createDataFrame([(1, None), (2, bytearray(b"no archive"))], "id long, data binary")
    assert formats.zip_entries(files).count() == 0 and [r.text for r in formats.docx_texts(files).collect()] == [None, None]


def test_sentences_end_in_the_last_three_tenths():
    """1440 * 0.7 is under 1008 in doubles: a sentence that ends at 1007 is too early, one at 1008 is not."""
    text = lambda at: "x" * at + ". " + "y " * 900
    assert len(next(chunks.embedding_pieces(text(1007)))) > 1400 and len(next(chunks.embedding_pieces(text(1008)))) == 1009


def test_rounds_send_no_table_through_the_driver(spark, capsys):
    """Small as it is, a table that a round joins isn't broadcast."""
    edges = spark.range(1, 60).select(F.col("id").alias("u"), F.floor(F.col("id") / 2).alias("v"))
    kept(edges).join(edges, "u").explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_ego(spark):
    """Either way along the edges, nearest first; loops, repeats and null ends are in no graph."""
    frame = spark.createDataFrame([(1, 2), (1, 2), (3, 2), (3, 4), (4, 5), (2, 2), (None, 1), (9, 8)], "u long, v long")
    ego = lambda *args: sorted(tuple(r) for r in structure.ego(frame, *args).collect())
    assert ego([1], 2, 50) == [(1, 2), (3, 2)] and ego([1, 9], 1, 50) == [(1, 2), (9, 8)]
    assert ego([1], 3, 3) == [(1, 2), (3, 2)] and ego([1], 4, 50) == [(1, 2), (3, 2), (3, 4), (4, 5)] and ego([7], 2, 50) == []


def ordered(edges, nodes):
    """Whether all nodes go when those that nothing points to are taken away again and again."""
    left = set(nodes)
    while free := {x for x in left if not any(v == x and u in left for u, v in edges)} & left:
        left -= free
    return not left


def test_topologies(spark, monkeypatch):
    """Of long ways, open, closed and with a short cut or a loop; and of random graphs: a table isn't written for each step of a way."""
    rng, graphs = random.Random(6), []
    for k in range(40):
        n = rng.choice([2, 3, 5, 9])
        graphs.append((n, {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(n + k % 3)) if a != b and (k % 2 or a < b)}))
    way = {(i, i + 1) for i in range(299)}
    graphs += [(300, way), (300, way | {(299, 0)}), (300, way | {(0, 299)}), (300, way | {(150, 140)}), (300, way | {(150, 140), (0, 299)}), (1, set()), (2, {(0, 1), (1, 0)})]
    want = {}
    for g, (n, edges) in enumerate(graphs):
        whole = len(set(parts(edges, range(n)).values())) == 1
        i, o = ([sum(e[side] == x for e in edges) for x in range(n)] for side in (1, 0))
        kind = "Single-Node" if n == 1 else "Disconnected" if not whole else "Cycle" if not ordered(edges, range(n)) else "Pipeline" if max(i + o) <= 1 else None
        want[g] = (n, kind or ("Tree" if len(edges) == n - 1 and i.count(0) == 1 else "Fork-Join" if max(i) > 1 and max(o) > 1 else "DAG"))
    nodes = spark.createDataFrame([(g, 1000 * g + x) for g, (n, _) in enumerate(graphs) for x in range(n)], "g long, id long")
    edges = spark.createDataFrame([(g, 1000 * g + a, 1000 * g + b) for g, (_, e) in enumerate(graphs) for a, b in [*e, (0, 0)]], "g long, u long, v long")
    written = []
    monkeypatch.setattr(structure, "kept", lambda df: written.append(df) or kept(df))
    assert {r.g: (r.nodes, r.topology) for r in structure.topologies(nodes, edges).collect()} == want
    assert {k for _, k in want.values()} >= {"Single-Node", "Disconnected", "Cycle", "Pipeline"} and len(written) < 150


def test_topologies_of_no_edges(spark):
    nodes, edges = spark.createDataFrame([(1, 5), (2, 6), (2, 7)], "g long, id long"), spark.createDataFrame([], "g long, u long, v long")
    assert {tuple(r) for r in structure.topologies(nodes, edges).collect()} == {(1, 1, "Single-Node"), (2, 2, "Disconnected")}
