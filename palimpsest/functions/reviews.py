"""Spaced repetition (FSRS-6): each formula once, for columns and for numbers alike.

``op`` is the arithmetic: ``COLUMNS`` for Spark columns, ``NUMBERS`` for Python floats. Grades run from 1 (again) to 4 (easy);
states are 0 new, 1 learning, 2 review, 3 relearning.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

from pyspark.sql import functions as F

from .scores import FACTOR, FSRS

COLUMNS = SimpleNamespace(exp=F.exp, pow=lambda x, y: F.pow(x, F.lit(y)), least=lambda x, y: F.least(F.lit(x) if isinstance(x, float) else x, F.lit(y) if isinstance(y, float) else y), greatest=lambda x, y: F.greatest(F.lit(x) if isinstance(x, float) else x, F.lit(y) if isinstance(y, float) else y), when=lambda c, a, b: F.when(c, a).otherwise(b))
NUMBERS = SimpleNamespace(exp=math.exp, pow=math.pow, least=min, greatest=max, when=lambda c, a, b: a if c else b)
#: Bounds of stability and difficulty, and the greatest storage strength.
LEAST, MOST, MOST_STORAGE = 0.1, 36500.0, 10.0


def _within(x, low, high, op):
    return op.greatest(low, op.least(high, x))


def first_difficulty(grade, op):
    return _within(FSRS[4] - op.exp(FSRS[5] * (grade - 1)) + 1, 1.0, 10.0, op)


def first_stability(grade, op):
    s = op.when(grade == 1, FSRS[0], op.when(grade == 2, FSRS[1], op.when(grade == 3, FSRS[2], FSRS[3])))
    return op.greatest(LEAST, s)


def retrievability(stability, days, op):
    return _within(op.pow(1 + FACTOR * days / stability, -FSRS[20]), 0.0, 1.0, op)


def next_difficulty(difficulty, grade, op):
    easy = max(1.0, min(10.0, FSRS[4] - math.exp(FSRS[5] * 3) + 1))
    moved = difficulty - FSRS[6] * (grade - 3) * ((10 - difficulty) / 9)
    return _within(FSRS[7] * easy + (1 - FSRS[7]) * moved, 1.0, 10.0, op)


def forget_stability(difficulty, stability, r, op):
    s = FSRS[11] * op.pow(difficulty, -FSRS[12]) * (op.pow(stability + 1, FSRS[13]) - 1) * op.exp(FSRS[14] * (1 - r))
    return op.greatest(LEAST, op.least(op.least(s, stability), MOST))


def recall_stability(difficulty, stability, r, grade, op):
    gain = math.exp(FSRS[8]) * (11 - difficulty) * op.pow(stability, -FSRS[9]) * (op.exp(FSRS[10] * (1 - r)) - 1)
    gain = gain * op.when(grade == 2, FSRS[15], 1.0) * op.when(grade == 4, FSRS[16], 1.0)
    return _within(stability * (gain + 1), LEAST, MOST, op)


def same_day_stability(stability, grade, op):
    return _within(stability * op.exp(FSRS[17] * (grade - 3 + FSRS[18])) * op.pow(stability, -FSRS[19]), LEAST, MOST, op)


def retention(storage, retrieval):
    return retrieval * 0.7 + storage / MOST_STORAGE * 0.3


def retrieval_strength(days, stability, op):
    """What is left of it after so many days."""
    return _within(op.pow(1 + days / (9.0 * stability), -2.0), 0.0, 1.0, op)


def effective_stability(stability, accesses, sources):
    """A column: the stability if it is known, else estimated from reads and sources."""
    guess = FSRS[2] * (1 + F.least(accesses * 0.3, F.lit(3.0)) + F.least((sources - 1) * 0.2, F.lit(1.0)))
    return F.when(stability > 0, stability).otherwise(guess)


def review(state: tuple | None, grade: int, days: float) -> tuple:
    """(stability, difficulty, storage, retrieval, learning, reps, lapses) after a review; ``state`` None is a new row."""
    if state is None or state[4] == 0:
        return first_stability(grade, NUMBERS), first_difficulty(grade, NUMBERS), 1.0, 1.0, 1 if grade <= 2 else 2, 1, 1 if grade == 1 else 0
    s, d, storage, _, learning, reps, lapses = state
    r = 1.0 if days <= 0 else retrievability(s, days, NUMBERS)
    if days < 1:
        new, gain = same_day_stability(s, grade, NUMBERS), 0.1
    elif grade == 1:
        new, gain, learning, lapses = forget_stability(d, s, r, NUMBERS), 0.3, 3, lapses + 1
    else:
        new, gain, learning = recall_stability(d, s, r, grade, NUMBERS), 0.1, 2
    thousandths = lambda x: math.floor(x * 1000 + 0.5) / 1000
    return thousandths(new), thousandths(next_difficulty(d, grade, NUMBERS)), thousandths(min(storage + gain, MOST_STORAGE)), 1.0, learning, reps + 1, lapses
