"""Leader clustering of signs against a plain version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import people

SCHEMA = "user_id long, at long, subject string, signal_type string, valence string, intensity double"


def words(s):
    return {t for t in re.split("[^a-z0-9]+", s.lower()) if len(t) >= 3}


def plain(rows):
    """-> {(user, leader): [rows]}, each row going to the first theme that shares over half of both's words"""
    themes = {}
    for row in sorted(rows, key=lambda r: r[1]):
        own = words(row[2])
        for (user, leader), held in themes.items():
            first = words(held[0][2])
            if user == row[0] and own | first and len(own & first) / len(own | first) > 0.5:
                held.append(row)
                break
        else:
            themes[row[0], row[1]] = [row]
    return themes


def made_up(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "long", "walks", "tea", "green", "garden", "dogs", "honest", "work", "rain"]
    rows = []
    for at in range(n):
        subject = " ".join(rng.choices(vocabulary, weights=[9, 5, 3, 2, 2, 1, 1, 1, 1, 1], k=rng.choice([0, 1, 2, 3, 4, 6])))
        rows.append((rng.randrange(3), at, rng.choice([subject, subject.upper(), "ab, c!"]), rng.choice(["value", "emotion", "identity"]), rng.choice(["positive", "negative", "neutral"]), rng.randrange(1, 100) / 100))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_themes(spark, seed):
    rows = made_up(seed, 220)
    got = {(r.user_id, r.leader): (r.label, r.n, round(r.intensity, 9), r.types, r.valences, r.mixed) for r in people.themes(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {}
    for key, held in plain(rows).items():
        kinds, sides = list(dict.fromkeys(r[3] for r in held)), list(dict.fromkeys(r[4] for r in held))
        want[key] = (held[0][2], len(held), round(sum(r[5] for r in held) / len(held), 9), kinds, sides, {"positive", "negative"} <= set(sides))
    assert got == want and max(v[1] for v in want.values()) > 3


def test_theme_lines(spark):
    rows = [(1, k, "long walks", "value", "positive", 0.5) for k in range(3)] + [(1, 5, "tea", "emotion", "negative", 0.25), (2, 6, "x", "value", "neutral", 1.0), (2, 7, "Tea house", "value", "positive", 0.5), (2, 8, "the tea house", "value", "negative", 1.0)]
    lines = people.theme_lines(people.themes(spark.createDataFrame(rows, SCHEMA))).orderBy("user_id", "place").collect()
    assert [(r.user_id, r.line) for r in lines] == [
        (1, '- "long walks" is a strong theme (3 signals, avg intensity: 0.50). Types: value. Valences: positive.'), (1, '- "tea" (1 signal, intensity: 0.25, negative)'),
        (2, '- "Tea house" (2 signals, intensity: 0.75, positive/negative)'), (2, '- "x" (1 signal, intensity: 1.00, neutral)'),
    ]
    assert people.themes(spark.createDataFrame([], SCHEMA)).filter(F.lit(True)).count() == 0
