"""Byte-level BPE, packing and top-k search against the tokenizer libraries and plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

from palimpsest.llm import bpe, packing, topk

DATA = "/root/testdata/sf0.001"
RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
ODD = [None, "", " ", "  a", "a  b", "\n\n x \n", "don't  STOP!!", "é日本語 🙂🙂", "x" * 3000, "1234567 890", "<|endoftext|>", "tab\there\r\nand", " nbsp em", "ab " * 20_000, "a\n b\n", "\x00\x01"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=load_tiktoken_bpe(RANKS), special_tokens={})


def rows_of(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "x")], "doc_id long, text string")
    return docs.union(extra).selectExpr("*", "1 as ids", "2 as piece", "3 as length", "4 as sequence_id")


def test_round_trip(spark, reference):
    docs = rows_of(spark)
    want = {}
    for r in docs.collect():
        ids = np.array(reference.encode_ordinary(r.text or ""), "<u4")
        want[r.doc_id] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    out = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, RANKS, PATTERN).collect()}
    assert out == want
    assert bpe.round_trip(docs.limit(0), RANKS, PATTERN).count() == 0


def test_encode_and_decode_frames(spark, reference):
    docs = rows_of(spark)
    encoded = bpe.encode_documents(docs, RANKS, PATTERN)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in encoded.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(text[r.doc_id])
    for r in bpe.decode_documents(encoded, RANKS, PATTERN).collect():
        assert bytes(r.content).decode() == text[r.doc_id]
    with pytest.raises(ValueError):
        bpe.load_encoder(RANKS, PATTERN).decode(np.array([10**6], "<u4"))


def test_appends_and_edits(reference):
    """A piece under edit has the ids of the whole piece encoded anew."""
    encoder, rng = bpe.load_encoder(RANKS, PATTERN), random.Random(1)
    made = bpe.EditableEncoding(encoder, b"")
    for _ in range(60):
        data = made.data
        if rng.random() < 0.5:
            made.append(bytes(rng.choice(b"abcdeinrst") for _ in range(rng.randint(1, 8))))
        elif data:
            a = rng.randrange(len(data))
            made.replace(a, min(len(data), a + rng.randint(0, 5)), bytes(rng.choice(b"abest") for _ in range(rng.randint(0, 4))))
        assert made.ids() == reference._encode_single_piece(made.data)


def test_packing(spark):
    docs = rows_of(spark)
    tokenizer = Tokenizer.from_file(JSON)
    out = packing.pack_documents(docs, JSON, PATTERN).toPandas()
    for r in docs.filter("doc_id is not null").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        own = out[out.doc_id == r.doc_id].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids)
        assert (own.length[1:] == 2048).all() and len(own) == -(-len(ids) // 2048)
        at = 0
        for p in own.itertuples():
            assert (p.start, p.ids_crc32) == (at, zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
    total = 0
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == np.append(0, g.length.cumsum().to_numpy()[:-1]).tolist() and g.length.sum() <= 2048
        total += 1
    assert total <= 1.02 * out.length.sum() / 2048 + 1


def test_packing_bounded_bins():
    """Closing the fullest keeps the open bins bounded; each piece fits."""
    rng, bins, fill = random.Random(4), packing.OpenBins(100, 3), {}
    for _ in range(2000):
        n = rng.randint(1, 100)
        bin_, offset = bins.place(n)
        assert fill.get(bin_, 0) == offset and offset + n <= 100
        fill[bin_] = offset + n
        assert bins.count <= 3
    assert packing.pack_documents  # the frame form is covered above


def test_packing_empty(spark):
    assert packing.pack_documents(rows_of(spark).limit(0), JSON, PATTERN).count() == 0


def plain_topk(vectors, queries, k=10):
    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v)

    rows = [(i, np.floor(np.array(v, float) * 1024).astype(np.int64)) for i, v in vectors if usable(v)]
    out = []
    for q, v in queries:
        if usable(v):
            v = np.floor(np.array(v, float) * 1024).astype(np.int64)
            best = sorted((-int(u @ v), i) for i, u in rows if i != q and len(u) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", 100)
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    out = topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))
    assert sorted(map(tuple, out.collect())) == plain_topk(rows, [r for r in rows if r[0] % 100 == 0])


def test_topk_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(4)], "x") for i in range(1, 60)]
    rows += [(100, None, "x"), (200, [1.0, None, 0.0, 0.0], "x"), (300, [float("nan")] * 4, None), (400, [float("inf"), 0.0, 0.0, 0.0], None), (500, [0.0] * 4, None), (600, [1.0, 1.0], "x"), (700, [], "x"), (5, rows[5][1], "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    plain = [r[:2] for r in rows]
    out = topk.top_k(vectors, vectors.filter("vec_id % 5 = 0"), k=7)
    asked = {r[0]: r for r in plain if r[0] % 5 == 0}
    got = sorted(map(tuple, out.filter("query_id <> 5").collect()))
    assert got == [r for r in plain_topk(plain, asked.values(), 7) if r[0] != 5]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_topk_of_large_components(spark):
    """Order is exact for all finite components; scores beyond 64 bits are the nearest long."""
    import math
    from fractions import Fraction

    rng = random.Random(1)
    rows = []
    for i in range(120):
        kind = rng.random()
        values = [rng.uniform(-1, 1) for _ in range(5)] if kind < 0.6 else rng.choices([1e30, -1e30, 2.0**45, 1.0, -3.5, 1e-3] if kind < 0.8 else [1.7e308, -1e300, 5e10], k=5)
        rows.append((i, values))
    whole = {i: [math.floor(Fraction(x) * 1024) for x in v] for i, v in rows}
    want = []
    for q in range(0, 120, 7):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:10]
        want += [(q, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(vectors, vectors.filter("vec_id % 7 = 0")).collect())) == sorted(want)
