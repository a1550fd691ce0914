"""Column functions on vectors, dates and memory states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The published FSRS-6 weights w0 .. w20.
FSRS = (0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542)
FACTOR = 0.9 ** (-1 / FSRS[20]) - 1

#: Weights of link types; others weigh 1.
LINK_WEIGHTS = {"caused_by": 2.0, "causes": 2.0, "updates": 1.5, "corrects": 1.5, "extends": 1.3, "contradicts": 1.3, "consolidates": 0.5}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def days_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400_000_000.0)


def retrievability(days: Column, stability: Column) -> Column:
    """FSRS-6: 0 without stability, 1 before any time has gone by."""
    r = F.pow(1 + F.lit(FACTOR) * days / stability, F.lit(-FSRS[20]))
    return F.when(stability <= 0, 0.0).when(days <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), r)))


def first_stability(grade: int) -> float:
    return max(0.1, FSRS[grade - 1])


def next_interval(stability: Column, retention: float = 0.9) -> Column:
    if not 0 < retention < 1:
        return F.lit(0).cast("long")
    return F.floor(stability / FACTOR * (retention ** (-1 / FSRS[20]) - 1) + 0.5).cast("long")


def decay_score(importance: Column, is_static: Column, days: Column, stability: Column) -> Column:
    return F.when(is_static, importance.cast("double")).otherwise(importance * retrievability(days, stability))


def half_up(x: Column, digits: int) -> Column:
    """Halves go up, negative ones too."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def link_weight(kind: Column) -> Column:
    pairs = [F.lit(x) for k, v in LINK_WEIGHTS.items() for x in (k, v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit(1.0))


def trust(ok: Column, allowed: Column, warned: Column, blocked: Column, failed: Column, total: Column) -> Column:
    raw = 50 + F.least(F.lit(25.0), 0.1 * ok) + F.least(F.lit(15.0), 0.5 * allowed) - 2 * warned - 5 * blocked - F.when(total > 0, F.least(F.lit(20.0), 40.0 * failed / total)).otherwise(0.0)
    return half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)), 1)
