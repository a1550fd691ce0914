"""The labeller reads the words of blocks of every length."""

import random

import numpy as np

from palimpsest.llm import html


def vector(text):
    params = html.initial(np.random.default_rng(1))
    params["word"] = np.random.default_rng(2).normal(size=params["word"].shape)
    return html.vectors([html.Block(text, [1, 2], 0.0)], params)[0][0, html.DIM : 2 * html.DIM]


def test_words_of_long_blocks_count():
    long = "one two three four five six seven eight nine ten eleven twelve thirteen"
    assert not np.allclose(vector(long), vector(long.replace("seven", "other")))


def test_case_and_punctuation_do_not_count():
    assert np.allclose(vector("Home Comments"), vector("home, comments!"))
    text = "We use cookies, as told in our Privacy policy; subscribe to read on and on."
    assert np.allclose(vector(text), vector(text.lower().replace(",", "").replace(";", "").replace(".", "")))


def test_held_out_accuracy():
    rng = random.Random(3001)
    pages = [html.labelled(html.made_up(rng)) for _ in range(200)]
    right = np.concatenate([got == np.array(wanted, bool) for got, (_, wanted) in zip(html.label([found for found, _ in pages], html.trained()), pages)])
    assert len(right) > 3000 and right.mean() > 0.99
