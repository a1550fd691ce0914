"""Contexts against a plain version that walks over rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import assembly

AS_OF = "2024-03-01 00:00:00"
ROWS = "id long, user_id long, content string, vector array<double>, day int, version long, root_memory_id long, is_static boolean, is_forgotten boolean, is_archived boolean, is_latest boolean, source_count int"


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def tokens(content):
    return math.ceil(len(content) / 4)


def plain(user, q, hits, rows, links, budget, strategy, relevant):
    share = {"precision": (0.2, 0.82), "balanced": (0.3, 0.8), "breadth": (0.3, 0.9)}[strategy]
    by = {r[0]: r for r in rows if r[1] == user}
    live = {i: r for i, r in by.items() if not (r[8] or r[9]) and r[10]}
    out, seen, vectors, used = [], set(), [], 0
    near = lambda v: v is not None and any(cosine(v, w) > 0.88 for w in vectors)

    def put(i, layer, score, n, v, covers):
        nonlocal used
        out.append((i, layer, math.floor(score * 100 + 0.5) / 100, n))
        used += n
        seen.update(covers)
        if v is not None:
            vectors.append(v)

    statics = [((cosine(q, r[3]) if r[3] else 0.5) + min((r[11] or 1) / 20, 0.1), i) for i, r in live.items() if r[7] and r[2]]
    for s, i in sorted(statics, key=lambda x: (-x[0], x[1])):
        if used + tokens(live[i][2]) > budget * share[0]:
            break
        put(i, "static", 100 * s, tokens(live[i][2]), live[i][3], [i])
    chosen = []
    for s, i in sorted(((s, i) for i, s in hits.items() if i in live and live[i][2]), key=lambda x: (-x[0], x[1])):
        r = live[i]
        if i in seen:
            continue
        if used + tokens(r[2]) > budget * share[1]:
            break
        if not near(r[3]) and s >= relevant:
            put(i, "semantic", s * (1.1 if r[4] > 58 else 1.0), tokens(r[2]), r[3], [i])
            chosen.append(i)
    for i in chosen[:8]:
        if used >= budget * 0.72:
            break
        chain = sorted((r[5], r[0]) for r in by.values() if r[6] == by[i][6])
        if len(chain) < 2:
            continue
        day = lambda k: f"2024-{'01' if by[k][4] < 31 else '02'}-{by[k][4] % 31 + 1:02d}"
        body = f"[Evolution of memory #{by[i][6]}]\n" + "\n".join(f"v{v} ({day(k)}): {by[k][2] or ''}" for v, k in chain)
        if used + tokens(body) > budget * 0.75:
            break
        put(-by[i][6], "evolution", 70, tokens(body), None, [k for _, k in chain])
    for i in chosen[:5] if strategy != "precision" else []:
        if used >= budget * 0.85:
            break
        for s, t in sorted(((s, t) for a, t, s in links if a == i and t in by and not by[t][8] and by[t][2]), key=lambda x: (-x[0], x[1])):
            if t in seen:
                continue
            if used + tokens(by[t][2]) > budget * 0.88:
                break
            if not near(by[t][3]):
                put(t, "linked", 50 * s, tokens(by[t][2]), by[t][3], [t])
    newest = sorted((r for r in live.values() if not r[7] and r[2]), key=lambda r: (-r[4], -r[0]))[:5]
    for r in newest if used < budget * 0.93 else []:
        if r[0] in seen:
            continue
        if used + tokens(r[2]) > budget * 0.93:
            break
        if not near(r[3]):
            put(r[0], "recent", 10, tokens(r[2]), r[3], [r[0]])
    return out


@pytest.mark.parametrize("strategy, budget", [("balanced", 300), ("precision", 150), ("breadth", 1200)])
def test_contexts(spark, strategy, budget):
    rng = random.Random(budget)
    base = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(12)]
    rows = []
    for i in range(120):
        v = [x + rng.gauss(0, 0.15) for x in rng.choice(base)] if rng.random() < 0.9 else None
        body = "".join(rng.choice("abc de") for _ in range(rng.choice([0, 10, 60, 150]))) or rng.choice([None, ""])
        rows.append((i + 1, i % 2, body, v, rng.randrange(60), i % 3, (i // 6) * 10, rng.random() < 0.15, rng.random() < 0.05, rng.random() < 0.05, rng.random() < 0.8, rng.choice([None, 1, 3])))
    links = [(a, b, rng.randrange(100) / 100) for a, b in ((rng.randrange(1, 121), rng.randrange(1, 121)) for _ in range(300))]
    asked = {7: (0, base[0]), 8: (1, base[1]), 9: (5, base[2])}
    hits = {k: {r[0]: round(cosine(q, r[3]), 6) for r in rows if r[3] and r[1] == u} for k, (u, q) in asked.items()}
    hits = {k: dict(sorted(h.items(), key=lambda x: -x[1])[:30]) for k, h in hits.items()}
    frame = spark.createDataFrame(rows, ROWS).withColumn("created_at", F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("day") * 86_400))
    found = assembly.candidates(
        spark.createDataFrame([(k, u, q) for k, (u, q) in asked.items()], "request long, user_id long, q array<double>"), spark.createDataFrame([(k, i, s) for k, h in hits.items() for i, s in h.items()], "request long, id long, score double"),
        frame, spark.createDataFrame(links, "source_id long, target_id long, similarity double"), AS_OF, budget,
    )
    got = {}
    for r in assembly.assembled(found, budget, strategy, relevant=0.3).orderBy("request", "place").collect():
        got.setdefault(r.request, []).append((r.id, r.layer, r.score, r.tokens))
    want = {k: plain(u, q, hits[k], rows, links, budget, strategy, 0.3) for k, (u, q) in asked.items()}
    assert got == {k: v for k, v in want.items() if v}
    assert {x[1] for v in want.values() for x in v} >= {"semantic"}
