"""The inverted index and the vector index against plain versions."""

import math
import random
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import stems
from palimpsest.operators import centroids, postings

#: Words and their stems.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size",
    "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "digitizer": "digit", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal", "sensitiviti": "sensit",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "airliner": "airlin", "adjustable": "adjust",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control",
    "roll": "roll", "as": "as", "générales": "générales", "generalizations": "gener", "oscillators": "oscil", "": "",
}


def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/index"


def plain_bm25(texts, query, k, allowed=None):
    words = {i: Counter((t or "").lower().split()) for i, t in texts.items()}
    n, mean = len(words), sum(sum(c.values()) for c in words.values()) / len(words)
    found = {}
    for i, c in words.items():
        score = 0.0
        for t in query:
            df = sum(t in o for o in words.values())
            if c[t]:
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
        if score and (allowed is None or i in allowed):
            found[i] = score
    return sorted(found.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]


def made_up(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return {i * 7: " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.choice([0, 1, 3, 10, 80]))) or None for i in range(n)}


def check(found, want):
    got = [(r.id, r.score) for r in found.collect()]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)
    assert {i for i, _ in got[:-1]} >= {i for i, s in want if s > want[-1][1] + 1e-5}


@pytest.mark.parametrize("tile, first", [(4096, 64), (8, 2)])
def test_text_index(spark, monkeypatch, tile, first):
    monkeypatch.setattr(postings, "TILE", tile)
    monkeypatch.setattr(postings, "FIRST", first)
    texts = made_up(400, 1)
    frame = lambda rows: spark.createDataFrame(list(rows), "id long, content string")
    index = postings.TextIndex(spark, folder()).add(frame([*texts.items(), (None, "w1 w2")]), F.col("content"))
    for query in (["w50"], ["w0", "w40", "w55"], ["w3", "none"]):
        check(index.search(query, 10), plain_bm25(texts, query, 10))
    odd = {i for i in texts if i % 2}
    check(index.search(["w7", "w30"], 10, frame((i, None) for i in odd)), plain_bm25(texts, ["w7", "w30"], 10, odd))
    assert index.search(["none"], 5).collect() == [] and index.search("!!", 5).collect() == []
    if tile == 8:  # tiles whose bound stays under the threshold are left out
        plan = index.plan(["w3"])
        bounds, least = index.bounds(plan), index.threshold(plan, 3)
        assert 0 < bounds.filter(F.col("bound") >= least).count() < bounds.count()
    # a second segment, deleted rows, and both as one
    more = {i + 1: t for i, t in made_up(150, 2).items()}
    index.add(frame(more.items()), F.col("content"))
    both = texts | more
    check(index.search(["w2", "w51"], 10), plain_bm25(both, ["w2", "w51"], 10))
    gone = {i for i, _ in plain_bm25(both, ["w51"], 4)}
    index.delete(frame((i, None) for i in gone))
    check(index.search(["w51"], 10), plain_bm25(both, ["w51"], 10, set(both) - gone))
    index.add(frame([(min(gone), "w51 w51 w51")]), F.col("content"))
    assert index.search(["w51"], 1).first().id == min(gone)
    small = index.compact(folder())
    left = {i: t for i, t in both.items() if i not in gone and t} | {min(gone): "w51 w51 w51"}
    check(small.search(["w51"], 10), plain_bm25(left, ["w51"], 10))


def test_words_and_stems(spark):
    [row] = spark.range(1).select(postings.folded_words(F.lit("Règles, ÉTÉ d'Été! x_1 日本 ½")).alias("w"), postings.folded_words(F.lit(None).cast("string")).alias("none")).collect()
    assert row.w == ["regles", "ete", "d", "ete", "x", "1", "日本", "½"] and row.none == []
    words = [w for w in STEMS if w]
    [row] = spark.range(1).select(stems.stems(F.array(*[F.lit(w) for w in words])).alias("s")).collect()
    assert dict(zip(words, row.s)) == {w: STEMS[w] for w in words}


def test_tiles_are_bounded_by_tokens(spark, monkeypatch):
    """Few long texts are dealt to several tiles, and words of one stem make one posting."""
    monkeypatch.setattr(postings, "TOKENS", 1000)
    monkeypatch.setattr(postings, "AT_ONCE", 300)
    rows = [(i, "links linked link " * 40 + f"w{i % 3} ") for i in range(50)]
    index = postings.TextIndex(spark, folder()).add(spark.createDataFrame(rows, "id long, content string"), F.col("content"))
    blocks = index._read("blocks").select("term", "tile", F.explode("postings").alias("p")).select("term", "tile", "p.*")
    tiles = blocks.groupBy("tile").agg(F.sum("tf").alias("n")).collect()
    assert len(tiles) >= 4 and sum(r.n for r in tiles) == 50 * 121 and max(r.n for r in tiles) < 3000
    assert sorted((r.id, r.tf, r.length) for r in blocks.filter("term = 'link'").collect()) == [(i, 120, 121) for i in range(50)]
    assert {r.term: r.df for r in index.dictionary().collect()} == {"link": 50, "w0": 17, "w1": 17, "w2": 16}


def test_empty_text_index(spark):
    index = postings.TextIndex(spark, folder()).add(spark.createDataFrame([], "id long, content string"), F.col("content"))
    assert index.search("anything", 5).collect() == [] and index.dictionary().count() == 0


def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n // 20, dims))[rng.integers(n // 20, size=n)] + 0.4 * rng.normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1)[:, None]


def test_vector_index(spark):
    v = vectors(2000, 16, 3)
    rows = [(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)]
    bad = [(5000, None, 0), (5001, [1.0], 0), (5002, [float("nan")] * 16, 0), (5003, [None] * 16, 0), (None, [1.0] * 16, 0)]
    frame = spark.createDataFrame(rows + bad, "id long, embedding array<double>, kind int")
    index = centroids.VectorIndex(spark, folder()).build(frame, ["kind"])
    assert index.rows().count() == 2000
    exact = lambda q, k, ok: sorted(((round(float(v[i] @ q), 6), -i) for i in range(2000) if ok(i)), reverse=True)[:k]
    for q in (v[3], v[77], -v[5], 3 * v[9]):
        query = [float(x) for x in q]
        got = [(r.score, -r.id) for r in index.search(query, 10).collect()]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in exact(q, 10, lambda i: True)], abs=2e-6)
        got = [(r.score, -r.id) for r in index.search(query, 10, where=F.col("kind") == 1).collect()]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in exact(q, 10, lambda i: i % 3 == 1)], abs=2e-6)
    queries = frame.filter("id % 100 = 0 and id < 2000")
    found = index.search_many(queries, 10)
    true = centroids.exact_many(index.rows().select("id", "v"), queries.select("id", F.col("embedding").alias("v")), 10)
    [row] = centroids.recall(found, true).collect()
    assert row.queries == 20 and row.recall >= 0.9
    [row] = centroids.recall(index.search_many(queries, 10, probes=2000), true).collect()
    assert row.recall == 1.0
    assert index.search([1.0], 5).collect() == []


def test_many_queries_meet_lists_in_blocks(spark, monkeypatch):
    """Lists of many copies are split, ties go to the smaller id, and only the best of a block leave it."""
    monkeypatch.setattr(centroids, "TOGETHER", 16)
    monkeypatch.setattr(centroids, "PAIRS", 50)
    monkeypatch.setattr(centroids, "AT_ONCE", 7)
    v = np.vstack([vectors(200, 8, 4), np.tile(vectors(20, 8, 5)[:1], (100, 1))])
    frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<double>")
    index = centroids.VectorIndex(spark, folder()).build(frame)
    queries = frame.filter("id % 5 = 0")
    true = centroids.exact_many(index.rows().select("id", "v"), queries.select("id", F.col("embedding").alias("v")), 10)
    got = index.search_many(queries, 10, probes=300)
    pick = lambda x: sorted((r.query_id, r["rank"], r.id, r.score) for r in x.collect())
    assert pick(got) == pick(true)
    own = pa.table({"id": list(range(300)), "v": [list(x) for x in v]})
    best = centroids._best_pairs(own, pa.table({"query_id": [0, 250], "q": [list(v[0]), list(v[250])]}), 10)
    assert best.num_rows == 20 and best["id"].to_pylist()[10:] == list(range(200, 210))


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index = centroids.VectorIndex(spark, folder()).build(rows)
    queries = rows.filter("id % 100 = 0")
    true = centroids.exact_many(index.rows().select("id", "v"), queries.select("id", F.col("embedding").cast("array<double>").alias("v")), 10)
    assert centroids.recall(index.search_many(queries, 10), true).first().recall >= 0.9


def test_empty_vector_index(spark):
    index = centroids.VectorIndex(spark, folder()).build(spark.createDataFrame([], "id long, embedding array<double>"))
    assert index.search([1.0], 5).collect() == []
