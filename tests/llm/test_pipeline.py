"""The pipeline against plain versions of its stages, stage by stage and as a whole."""

import random

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found_lang string, found_score string, gone string, rank string"


def rows():
    rng = random.Random(8)
    words = {"en": "the and of to in that was with for his they this have from".split(), "de": "der und die das ist nicht mit auch eine sich wird dem des von".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "ly", "en", "er", str(rng.randrange(40))]) for _ in range(n))
    out = [(i, text(lang, rng.randint(3, 160)), lang) for i, lang in enumerate(["en", "de"] * 40)]
    passage, near = text("en", 70), text("de", 120).split()
    out += [(100 + i, text("en", 30) + " " + passage + " " + text("en", 20), "en") for i in range(5)]
    out += [(110 + i, out[3][1], "de") for i in range(6)]
    for i in range(8):
        own = list(near)
        own[rng.randrange(120)] = f"x{i}"
        out.append((120 + i, " ".join(own), "de"))
    out += [(130, None, "en"), (131, "", None), (132, "12 34 !!", "en"), (133, "你好世界" * 30, None), (134, "ok", None), (135, text("en", 40), None)]
    return out


def frame(spark, rows_):
    return spark.createDataFrame([(d, t, lang, "s", len(t or ""), "a", "b", "c", "d") for d, t, lang in rows_], SCHEMA).repartition(3)


def expected(rows_):
    """What each stage keeps: [(doc_id, text)], and the texts after the fourth."""
    known = [(d, t) for d, t, _ in rows_ if t and any(c.isalpha() for c in t) and "你" not in t]
    largest = {}
    for d, t in known:
        largest[t] = max(d, largest.get(t, d))
    distinct = [(d, t) for d, t in known if largest[t] == d]
    component = brute.jaccard(distinct)
    apart = [(d, t) for d, t in distinct if component[d][1] == d]
    seen, cut = set(), {}
    for d, t in sorted(apart):
        w = t.encode().split()
        drop = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                drop[i : i + 20] = [True] * 20
            seen.add(key)
        cut[d] = b" ".join(x for x, gone in zip(w, drop) if not gone).decode()
    return [dict(known), dict(distinct), dict(apart), cut]


def test_pipeline_stages(spark, tmp_path):
    own, docs = rows(), None
    docs = frame(spark, own)
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], expected(own)):
        docs = stage(spark, docs, "")
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert sum(len(t.split()) for t in expected(own)[3].values()) < sum(len(t.split()) for t in expected(own)[2].values())
    packed = corpus_pipeline.STAGES[4][1](spark, docs, "").collect()
    encoding = packing.load_tokenizer(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"), corpus_pipeline.public_tokenizers.PATTERN)
    want = {d: len(encoding.encode_ordinary(t)) + 1 for d, t in expected(own)[3].items()}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and {r.doc_id for r in packed} == set(want)


def test_run_on_tables(spark, tmp_path):
    own = rows()
    frame(spark, own).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(expected(own)[3])


def test_without_labels_nothing_readable_goes(spark):
    own = [(d, t, None) for d, t, _ in rows()]
    kept = corpus_pipeline.identify_language(spark, frame(spark, own), "")
    assert {r.doc_id for r in kept.collect()} == {d for d, t, _ in own if t and any(c.isalpha() for c in t)}


@pytest.mark.parametrize("own", [[], [(None, None, None)], [(1, "same text here", "en"), (1, "same text here", "en"), (None, "no id", "en")]])
def test_odd_tables(spark, own):
    docs = frame(spark, own)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() == {0: 0, 1: 0, 3: 2}[len(own)]


def test_very_long_text(spark):
    """A text many times the size of a slice, through the language and exact stages."""
    text = "the cat and the dog " * 120_000
    docs = frame(spark, [(1, text, "en"), (2, "der hund und die katze " * 30, "de"), (3, "the cat and the dog " * 30, "en"), (4, text, "en")])
    kept = corpus_pipeline.drop_exact_copies(spark, corpus_pipeline.identify_language(spark, docs, ""), "")
    assert {r.doc_id for r in kept.select(F.col("doc_id")).collect()} == {2, 3, 4}
