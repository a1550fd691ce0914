"""Exact dedup, n-gram Jaccard join, substring and suffix dedup against plain versions."""

import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, jaccard, substring_dedup, suffix_dedup

DATA = "/root/testdata/sf0.01/documents.parquet"
#: Columns of the operators' own that a caller's table may hold too.
CLASHING = ("h", "key", "name", "names", "set_id", "anchor", "anchors", "starts", "spans", "content", "kept", "component", "rank", "gone", "found_lang")
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * len(CLASHING)) for r in rows], SCHEMA).repartition(3)


def edge_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, long_, near = text(60), text(30_000), text(120)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "One TWO"), (6, "one two three four five"), (7, "é ß 日本 one"), (8, "a b " * 300), (9, "a b " * 299 + "c")]
    rows += [(10 + i, text(15) + " " + shared + "\n" + text(9)) for i in range(5)]
    rows += [(20, long_), (21, long_ + " more"), (22, long_[1000:])]
    for i in range(25):  # near copies from one to many changed words
        words = near.split()
        for _ in range(i // 2):
            words[rng.randrange(len(words))] = word()
        rows.append((30 + i, " ".join(words)))
    rows += [(60 + i, near) for i in range(40)]
    rows += [(100 + i, text(rng.randint(1, 40))) for i in range(60)]
    return rows


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet(DATA).select("doc_id", "text")
    return docs, [tuple(r) for r in docs.collect()]


def found(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect()}


def both(spark, documents):
    yield documents
    rows = edge_rows()
    yield frame(spark, rows), rows


def test_exact(spark, documents):
    for docs, rows in both(spark, documents):
        groups = {}
        for d, t in rows:
            groups.setdefault(t or "", []).append(d)
        want = {d: (max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows}
        assert found(exact_dedup.exact_dedup(docs), "keep_id", "group_size", "kept", "text_sha256") == want
        stay = exact_dedup.keep_distinct(docs)
        assert stay.columns == docs.columns
        assert {r.doc_id for r in stay.collect()} == {max(g) for g in groups.values()}


def test_exact_repeated_rows_and_null_ids(spark):
    rows = [(1, "x"), (1, "x"), (None, "x"), (None, "y"), (2, "X")]
    out = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect())
    assert out == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 1, True)]
    assert {(r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(frame(spark, [(1, "x"), (2, "x")]), keep="smallest").collect()} == {(1, 2)}


def test_exact_compares_bytes_in_groups(spark):
    """Texts of one hash are told apart: the plan groups by content below the hash."""
    plan = exact_dedup.exact_dedup(frame(spark, [(1, "x")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "content" in plan


def test_jaccard(spark, documents):
    for docs, rows in both(spark, documents):
        assert found(jaccard.join_components(docs), "n_shingles", "component_id") == brute.jaccard(rows)


def test_jaccard_random_thresholds(spark):
    """Sets of all sizes, changed little by little: pairs lie close to the threshold on both sides."""
    rng = random.Random(11)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 6, 8, 12, 20, 40, 90, 300]))]
        for _ in range(12):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
    assert found(jaccard.join_components(frame(spark, rows)), "n_shingles", "component_id") == brute.jaccard(rows)


def test_jaccard_large_tiles_in_blocks(spark, monkeypatch):
    """A tile of many sets that are near its first one only in part."""
    monkeypatch.setattr(jaccard.apart, "__defaults__", (4,))
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = list(words)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(60)] = f"v{rng.randrange(1000)}"
        rows.append((i, " ".join(own)))
    assert found(jaccard.join_components(frame(spark, rows)), "n_shingles", "component_id") == brute.jaccard(rows)


def test_jaccard_keeps_one(spark):
    rows = edge_rows()
    want = {c for _, c in brute.jaccard(rows).values()}
    stay = jaccard.keep_one(frame(spark, rows))
    assert stay.columns == ["doc_id", "text", *CLASHING]
    assert {r.doc_id for r in stay.collect()} == want


def test_substring(spark, documents):
    for docs, rows in both(spark, documents):
        assert found(substring_dedup.digest(docs), "n_words", "n_removed", "kept_sha256") == brute.substring(rows)


def test_substring_factors(spark):
    """Each factor's words are those of its source, earlier than itself."""
    rows = edge_rows()
    text = {d: brute.words(t) for d, t in rows}
    n = 0
    for r in substring_dedup.remove_copies(frame(spark, rows)).collect():
        for f in r.factors:
            n += 1
            assert (f.src_id, f.src_start) < (r.doc_id, f.start) and f.length >= substring_dedup.WORDS
            assert text[r.doc_id][f.start : f.start + f.length] == text[f.src_id][f.src_start : f.src_start + f.length]
    assert n > 10


@pytest.mark.parametrize("block_rows", [2, 7, 50])
def test_substring_small_blocks(spark, block_rows):
    """Anchors whose segments lie in several blocks and parts; a document's rows twice."""
    rows = edge_rows()
    want = brute.substring(rows)
    docs = frame(spark, rows + rows[40:50])
    assert found(substring_dedup.remove_copies(docs, with_factors=False, with_text=False, block_rows=block_rows), "n_words", "n_removed", "kept_sha256") == want


def test_substring_cuts_text(spark):
    docs = frame(spark, edge_rows()).withColumn("n_chars", F.length("text").cast("long"))
    cut = substring_dedup.cut_copies(docs, length_col="n_chars")
    assert cut.columns == docs.columns
    for r in cut.collect():
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize("run_rows", [suffix_dedup.RUN_ROWS, 2, 9])
def test_suffix(spark, documents, run_rows):
    rows = documents[1] if run_rows > 2 else edge_rows()
    docs = documents[0] if run_rows > 2 else frame(spark, rows)
    out = suffix_dedup.remove_repeats(docs, with_content=False, run_rows=run_rows)
    assert found(out, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix(rows)


def test_suffix_repeated_rows_in_small_runs(spark):
    rows = edge_rows()
    docs = frame(spark, rows + rows[40:50])
    assert found(suffix_dedup.remove_repeats(docs, with_content=False, run_rows=3), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix(rows)


def test_suffix_small_length_of_edges(spark):
    rows = edge_rows()
    assert found(suffix_dedup.digest(frame(spark, rows)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix(rows)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(None, "x"), (None, "x")], [(1, "x " * 500), (1, "x " * 500)]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame([(*r, *[None] * len(CLASHING)) for r in rows], SCHEMA)
    for f in (exact_dedup.exact_dedup, exact_dedup.keep_distinct, jaccard.join_components, substring_dedup.digest, suffix_dedup.digest):
        out = f(docs).collect()
        assert len(out) == (len(rows) if f is not exact_dedup.keep_distinct else len({t or "" for _, t in rows})), f
