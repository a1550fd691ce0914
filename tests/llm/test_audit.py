"""Source divergence audit, periodic runs and SimHash copies against plain versions."""

import hashlib
import random
import zlib

import brute
import duckdb
import numpy as np
import pytest

from palimpsest.llm import divergence, periodic, queries, simhash

DATA = "/root/testdata/sf0.001"
CLASHING = ("w", "a", "p", "g", "fp", "key", "choice", "term", "count", "documents", "first", "v", "n", "none", "value", "rank", "runs", "component")
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHING)


def frame(spark, rows):
    """rows: (doc_id, text[, lang, source])"""
    return spark.createDataFrame([(*r, *([None] * (4 - len(r))), *[None] * len(CLASHING)) for r in rows], SCHEMA).repartition(3)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# periodic runs


@pytest.mark.parametrize("top, chunk", [(1, 5), (3, 1 << 21), (16, 1 << 21)])
def test_runs_of_sequences(monkeypatch, top, chunk):
    monkeypatch.setattr(periodic, "TOP", top)
    monkeypatch.setattr(periodic, "CHUNK", chunk)
    monkeypatch.setattr(periodic.name_levels, "__defaults__", (top,))
    rng = random.Random(top)
    for _ in range(120):
        docs, (least, exponent) = [], (rng.choice([2, 6]), rng.choice([2, 3, 4]))
        for _ in range(rng.randint(1, 6)):
            n, k = rng.choice([0, 1, 5, 6, 7, 20, 60, 200]), rng.choice([1, 2, 3, 50])
            w = [rng.randrange(k) for _ in range(n)]
            if n > 5 and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        bounds = np.cumsum([0, *map(len, docs)])
        got = [[] for _ in docs]
        for d, s, n, q in zip(*periodic.find_runs(np.array([x for w in docs for x in w], np.int64), bounds, least, exponent)):
            got[d].append((s - bounds[d], n, q))
        assert got == [brute.runs(w, least, exponent) for w in docs]


def planted(doc_id, text):
    w, h = brute.words(text), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def run_row(doc_id, text):
    w = planted(doc_id, text)
    found = brute.runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha(lines), sha(brute.collapsed(w, found)))


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = collected(queries.op12_periodic_runs(spark, DATA), *RUN_COLUMNS)
    assert got == sorted((run_row(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 10


def test_periodic_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a a a a a a"), (6, "x a b a b a b a b"), (7, "é ß é ß é ß é ß é"), (8, "la " * 5000), (9, "a b c " * 40 + "z " + "b " * 9)]
    rows += [(i, "one two three four five six seven eight") for i in range(100, 160)] + [(160, "one two " * 9)] * 3 + [(None, "a b " * 9)]
    got = collected(periodic.digest(frame(spark, rows)), *RUN_COLUMNS)
    assert got == sorted((run_row(*r) for r in rows), key=str)
    assert periodic.digest(frame(spark, rows).limit(0)).count() == 0
    [row] = periodic.periodic_runs(frame(spark, [(6, "x a b a b  a b a b y")])).collect()
    assert ([tuple(r) for r in row.runs], row.collapsed, row.n_words) == ([(1, 8, 2)], "x a b y", 10)


# SimHash


def test_fingerprints_and_components(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    prints = {d: brute.fingerprint(t) for d, t in texts.items()}
    parts = brute.hamming_components(prints)
    got = collected(queries.op13_simhash_near_dedup(spark, DATA), "doc_id", "fingerprint", "component_id")
    assert got == sorted(((d, f"{x:016x}", parts[d]) for d, x in prints.items()), key=str)


@pytest.mark.parametrize("limit", [1024, 20, 3])
@pytest.mark.parametrize("most", [1, 2, 3])
def test_links_of_crowded_keys(spark, monkeypatch, limit, most):
    monkeypatch.setattr(simhash, "LIMIT", limit)
    rng = random.Random(most)
    centres, prints = [rng.getrandbits(64) for _ in range(4)], set()
    for _ in range(300):
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randrange(8)):
            x ^= 1 << b
        prints.add(x)
    if limit == 1024 and most == 2:
        prints |= {centres[0] ^ x for x in range(1500)}  # more than a key may hold
    prints = {simhash.signed(x): x for x in prints}
    found = simhash.near_fingerprints(spark.createDataFrame([(x,) for x in prints], "fp long"), most).collect()
    assert all(r.u in prints and r.v in prints for r in found)
    order = sorted(prints)
    labels = simhash.joined(np.arange(len(order)), np.array([order.index(r.u) for r in found], int), np.array([order.index(r.v) for r in found], int))
    assert {x: order[k] for x, k in zip(order, labels)} == brute.hamming_components(prints, most)


def test_simhash_edges(spark):
    near = " ".join(f"word{i}" for i in range(4000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, near), (8, near + " more"), (8, near + " more"), (None, "one"), (None, "alone here")]
    prints = [brute.fingerprint(t) for _, t in rows]
    parts = brute.hamming_components(dict(enumerate(prints)))
    members = {k: [rows[i][0] for i in parts if parts[i] == k and rows[i][0] is not None] for k in parts.values()}
    want = sorted(((d, f"{prints[i]:016x}", min(members[parts[i]], default=None)) for i, (d, _) in enumerate(rows)), key=str)
    assert collected(simhash.near_copies(frame(spark, rows)), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_copies(frame(spark, rows).limit(0)).count() == 0


# source divergence

AUDIT = ("lang", "source", "part", "item", "value", "rank")


def audit_rows():
    rng = random.Random(5)
    vocabulary = ["the", "The", "été", "日本", "x", "naïve", "it's", "a1b", "zebra", "Ämter"]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.randint(2, 10)]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", "ü", None])) for i in range(250)]
    rows += [(900, None, "en", "empty"), (901, "123 !!", "fr", "a"), (902, "rare words only", "fr", "b"), (903, "x " * 50_000, "en", "s1"), (904, "the", "en", "s1"), (904, "the", "en", "s1"), (None, "the x", "", "")]
    return rows


def test_audit(spark):
    rows = audit_rows()
    want = brute.divergence([r[1:] for r in rows])
    assert sorted(collected(divergence.audit(frame(spark, rows)), *AUDIT)) == want
    con = duckdb.connect()
    documents = frame(spark, rows).toPandas()
    con.register("documents", documents)
    assert sorted(con.execute(f"SELECT {', '.join(AUDIT)} FROM ({queries.ORACLE_SQL['op11_source_divergence']})").fetchall()) == want


def test_audit_in_small_parts(spark, monkeypatch):
    """Runs that go over batches, counts that are given away early, and slices of a few bytes give the same rows."""
    monkeypatch.setattr(divergence, "HELD_ROWS", 7)
    monkeypatch.setattr(divergence, "SLICE", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = audit_rows()[:120]
        assert sorted(collected(divergence.audit(frame(spark, rows), min_documents=3), *AUDIT)) == brute.divergence([r[1:] for r in rows], 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_audit_of_nothing(spark):
    assert divergence.audit(frame(spark, audit_rows()).limit(0)).count() == 0
    few = [(1, None, "en", "a"), (2, "x", "en", "b")]
    assert collected(divergence.audit(frame(spark, few)), *AUDIT) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_audit_in_int64(spark):
    """Shares of counts beyond 64-bit products are exact."""
    c, n, v = 10**14, 3 * 10**14, 10**6
    [row] = spark.createDataFrame([(c, n, v)], "c long, n long, v long").select(divergence.share("c", "n", "v").alias("p"), divergence.share("c", "0L", "0L").alias("none")).collect()
    assert (row.p, row.none) == (1 + 10**9 * (c + 2) // (n + 2 * v), None)
