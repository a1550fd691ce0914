"""Language ID, toxicity, HTML text: held-out accuracy and plain versions; odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import html, language, toxicity

DATA = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out and lang is not null and text rlike '[a-z]'").toPandas()
    assert len(out) > 100 and (out.lang == out.lang_pred).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_language_distances_are_out_of_place_sums(spark):
    """The score of one text from its definition, with plain counts."""
    profiles = {"a": [5, 6, 7], "b": [6, 9]}
    text = "ab ab c"
    grams, bounds = language._gram_ids([text])
    ids = language._ranked(grams[bounds[0] : bounds[1]].ravel(), None)
    dist = {x: sum(min(language.PROFILE, abs(p.index(g) - r)) if g in p else language.PROFILE for r, g in enumerate(ids)) for x, p in profiles.items()}
    row = language.predict_language(spark.createDataFrame([(1, text)], "doc_id long, text string"), profiles).first()
    assert row.lang_pred == min(sorted(dist), key=dist.get)
    assert row.score == pytest.approx(1 - dist[row.lang_pred] / (language.PROFILE * len(ids)))


def test_language_odd_rows(spark):
    rows = [(1, None, "en", "s"), (2, "", "en", None), (3, "123 !!", None, "s"), (4, "the cat and the dog", "en", "s"), (None, "le chat et le chien", "fr", "s"), (4, "the cat and the dog", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, found_lang string")
    out = language.identify(docs).collect()
    assert len(out) == 6 and [r.lang_pred for r in out if r.doc_id in (1, 2, 3)] == ["und"] * 3
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    assert language.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.assess(docs, labels).join(labels, "doc_id").filter("held_out and toxic is not null").toPandas()
    toxic, clean = out[out.toxic == 1], out[out.toxic == 0]
    assert (toxic.predicted == 1).mean() > 0.85 and (clean.predicted == 0).mean() > 0.95
    assert ((out.score >= toxicity.THRESHOLD) == (out.predicted == 1)).all()


def test_automaton_is_edit_distance():
    lexicon = toxicity.Lexicon(["scoundrel", "villain"], [])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = np.random.default_rng(1)
    for term in lexicon.words:
        for _ in range(300):
            word = list(term)
            for _ in range(rng.integers(0, 4)):
                at = rng.integers(0, len(word))
                kind = rng.integers(0, 3)
                if kind == 0:
                    word[at] = "x"
                elif kind == 1 and len(word) > 4:
                    del word[at]
                else:
                    word.insert(at, "q")
            word = "".join(word)
            want = any(distance(word, t) <= toxicity.allowed(len(t)) for t in lexicon.words)
            assert (lexicon.kind(word) != 0) == want, word


def test_quotation_and_abuse_differ():
    lexicon = toxicity.Lexicon(["scoundrel"], [])
    direct, quoted = lexicon.features("you are a scoundrel"), lexicon.features("he said that a scoundrel did it")
    assert direct[0] > 0 and direct[3] == 0 and quoted[0] == 0 and quoted[3] > 0
    assert lexicon.features("you are a scoundrell")[2] > 0


def test_toxicity_stemmed_words_are_met_with_edits():
    lexicon = toxicity.Lexicon([], ["scound"], ["scoundrel"])
    assert [lexicon.kind(w) for w in ("scoundrel", "scoundrels", "scuondrel", "skoundrel", "ground")] == [toxicity.STEM, toxicity.STEM, toxicity.FUZZY, toxicity.FUZZY, 0]


def test_toxicity_copies_count_once(spark):
    base = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = [(1, " ".join(base[:k] + ["changed"] + base[k:])) for k in range(40, 60)] + [(0, " ".join(base)), (1, "alone in this text"), (1, ""), (0, "")]
    kept = toxicity.without_copies(spark.createDataFrame(rows, "y int, text string")).collect()
    copies = [r for r in kept if r.y == 1 and "changed" in r.text]
    assert 1 <= len(copies) <= 2 and {(r.y, r.text) for r in kept} - {(r.y, r.text) for r in copies} == {rows[20], rows[21], rows[22], rows[23]}


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 0), (3, "x", None), (None, "y", 1), (3, "x", 1)], "doc_id long, text string, toxic int")
    for labels in ([], [(1, 1)], [(3, 0), (3, 1), (None, 1), (4, None)]):
        out = toxicity.assess(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.assess(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) {document.write("<p>no</p>")}</script></head><body>
<header class="site-header"><p>Our site</p></header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<article><h1>A title &amp; more</h1><p>First   paragraph of the <b>article</b>,
with two lines&nbsp;and text.</p><p>Second paragraph, it goes on and on with &eacute; and &#8364;.<div class="ad"><p>Buy now</p></div><p>Third paragraph closes the story.</p></article>
<div class="comments"><div class="comment"><p>Nice article, thanks a lot.</p></div></div><footer class="footer"><p>Copyright privacy policy</p></footer></body></html>"""


def test_html_page(spark):
    docs = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, ""), (None, "u", "<p>unclosed <b>markup"), (2, "u", None)], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html.extract(docs).collect()}
    assert out[1] == "A title & more\nFirst paragraph of the article, with two lines and text.\nSecond paragraph, it goes on and on with é and €.\nThird paragraph closes the story."
    assert out[2] == "" and out[3] == ""
    assert html.extract(docs.limit(0)).count() == 0


def test_html_all_pages(spark):
    out = html.extract(spark.read.parquet(f"{DATA}/pages.parquet")).toPandas()
    assert (out.n_chars == out.text.str.len()).all()
    assert not out.text.str.contains("<script|<div|</p>|document.write", regex=True).any()


def test_lstm_gradients():
    """Back propagation against finite differences."""
    import random

    rng = random.Random(2)
    pages = [html.labelled(html.made_up(rng)) for _ in range(3)]
    params = html.initial(np.random.default_rng(3))
    before = {k: v.copy() for k, v in params.items()}
    x, mask = html.pad([html.vectors(f, params)[0] for f, _ in pages])
    y = np.zeros(mask.shape)
    for i, (_, wanted) in enumerate(pages):
        y[i, : len(wanted)] = wanted

    def loss(p):
        c = html.forward(x, mask, p)[0]
        return -np.where(mask, y * np.log(c) + (1 - y) * np.log(1 - c), 0).sum() / mask.sum()

    _, joint, tape_f, _ = html.forward(x, mask, params, keep=True)
    d = np.where(mask, html.forward(x, mask, params)[0] - y, 0) / mask.sum()
    _, dw, _ = html._back((d[..., None] * params["out"])[..., : html.HIDDEN], tape_f, params["wf"], x.shape[2])
    for at in [(0, 0), (5, 20), (26, 40), (33, 60)]:
        up = {k: v.copy() for k, v in before.items()}
        up["wf"][at] += 1e-5
        assert (loss(up) - loss(before)) / 1e-5 == pytest.approx(dw[at], abs=1e-5)


def test_language_holds_few_texts_at_once(monkeypatch):
    """However large Spark's batches are, short texts are worked on in parts bounded by rows and characters, each once and in order."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1300))], ["id"])
    parts = list(language._slices(iter([batch, batch.slice(0, 0), batch.slice(5, 3)])))
    assert [p.num_rows for p in parts] == [512, 512, 276, 3] and pa.Table.from_batches(parts)["id"].to_pylist() == [*range(1300), 5, 6, 7]
    sizes, own = [], language._gram_ids
    monkeypatch.setattr(language, "_gram_ids", lambda texts: sizes.append(sum(map(len, texts))) or own(texts))
    texts = ["ab cd " * 200] * 300 + ["x" * 200_000, "y z"]
    found = list(language._grams(texts))
    assert [i for i, _ in found] == list(range(302)) and max(sizes[:-2]) <= 1 << 17
    assert all(np.array_equal(grams, own([texts[i]])[0].ravel()) for i, grams in found[::60])
