"""Conversations within a length against a plain version."""

import random

import pytest

from palimpsest.operators import conversations

SCHEMA = "conv_id long, turn long, role string, text string, tool string, failed boolean"


def plain(turns, most):
    """turns: [(turn, role, text, tool, failed)] in order -> [(turn, truncated, line)]"""
    body, cut, n = {t[0]: t[2] or "" for t in turns}, set(), len(turns)

    def rank(i):
        _, role, _, _, failed = turns[i]
        if role == "user" and i == 0:
            return 0
        if role == "assistant":
            return 1 if i >= n - 2 else 4
        return (2 if failed else 5) if role == "tool" else 6 if role == "system" else 3

    total = sum(map(len, body.values()))
    for i in sorted(range(n), key=lambda i: -rank(i)) if total > most else []:
        t = turns[i][0]
        if total <= most:
            break
        if rank(i) == 0:
            continue
        target, old = max(200, len(body[t]) - (total - most)), body[t]
        if len(old) > target:
            body[t] = old[: target // 2] + "\n... [truncated] ...\n" + old[-(target // 2) :]
            cut.add(t)
        total -= len(old) - len(body[t])
    label = lambda role, tool, failed: f"[TOOL{': ' + tool if tool else ''}{' ERROR' if failed else ''}]" if role == "tool" else f"[{role.upper()}]"
    return [(t, t in cut, f"{label(role, tool, failed)}{' (truncated)' if t in cut else ''}\n{body[t]}") for t, role, _, tool, failed in turns]


@pytest.mark.parametrize("most", [300, 1500, 4000])
def test_within_length(spark, most):
    rng = random.Random(most)
    rows, talks = [], {}
    for conv in range(40):
        turns = []
        for turn in range(rng.choice([1, 2, 3, 8, 20])):
            role = rng.choice(["user", "assistant", "tool", "system"]) if turn else rng.choice(["user", "system"])
            text = rng.choice([None, "", "é" * rng.randrange(190, 230), "".join(rng.choices("ab c", k=rng.randrange(900)))])
            turns.append((turn * 3 + 5, role, text, rng.choice([None, "", "grep"]) if role == "tool" else None, rng.random() < 0.3 if role == "tool" else None))
        talks[conv] = turns
        rows += [(conv, *t) for t in turns]
    rng.shuffle(rows)
    lines = conversations.within_length(spark.createDataFrame(rows, SCHEMA), most, tool="tool", is_error="failed")
    got = {}
    for r in lines.orderBy("conv", "turn").collect():
        got.setdefault(r.conv, []).append((r.turn, r.truncated, r.line))
    want = {c: plain(t, most) for c, t in talks.items()}
    assert got == want and any(x[1] for v in want.values() for x in v)
    texts = {r.conv: r.text for r in conversations.joined(lines).collect()}
    assert texts == {c: "\n\n---\n\n".join(x[2] for x in v) for c, v in want.items()}
    assert conversations.within_length(spark.createDataFrame([], SCHEMA), most).count() == 0
