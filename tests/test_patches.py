"""Patches against plain versions."""

import random

from pyspark.sql import functions as F

from palimpsest.operators import patches


def plain(path, old, new):
    """Lines of the difference, place by place."""
    if old is None or new is None:
        sign, body = ("+", new) if old is None else ("-", old)
        return "\n".join(["--- /dev/null" if old is None else f"--- a/{path}", "+++ /dev/null" if new is None else f"+++ b/{path}", *(sign + x for x in body.split("\n"))])
    a, b, out, k = old.split("\n"), new.split("\n"), [f"--- a/{path}", f"+++ b/{path}"], 0
    while k < max(len(a), len(b)):
        j = k
        while j < max(len(a), len(b)) and not (j < len(a) and j < len(b) and a[j] == b[j]):
            j += 1
        if j > k:
            out += [f"@@ -{k + 1},{max(0, min(j, len(a)) - k)} +{k + 1},{max(0, min(j, len(b)) - k)} @@", *("-" + x for x in a[k:j]), *("+" + x for x in b[k:j])]
        k = max(j, k + 1)
    return "\n".join(out)


def test_differences(spark):
    rng = random.Random(8)
    text = lambda: "\n".join(rng.choice(["a", "b", "", "long line"]) for _ in range(rng.randrange(9)))
    rows = [(f"p{i}", rng.choice([None, text(), text(), text()]), rng.choice([None, text(), text(), text()])) for i in range(120)] + [("same", "x", "x"), ("none", None, None), ("empty", "", None), ("new", None, "")]
    got = {r.path: r["diff"] for r in patches.unified(spark.createDataFrame(rows, "path string, old string, new string")).collect()}
    assert got == {p: plain(p, a, b) for p, a, b in rows if a != b}


def test_blocks(spark):
    cases = [
        ("one two two", "<<<<<<< SEARCH\n two \n=======\n2\n>>>>>>> REPLACE\n", "one 2 two", "diff"), ("abc", "<<<<<<< SEARCH\nx\n=======\ny\n>>>>>>> REPLACE<<<<<<< SEARCH\nb\n=======\n>>>>>>> REPLACE", "ac", "diff"),
        ("abc", "<<<<<<< SEARCH\nb\n>>>>>>> REPLACE", "abc", "diff"), ("abc", "<<<<<<< SEARCH\n=======\nTop\n>>>>>>> REPLACE", "Topabc", "diff"), (None, "plain", "", "full"), ("a$1", "<<<<<<< SEARCH\n$1\n=======\n$&\\\n>>>>>>> REPLACE", "a$&\\", "diff"),
        ("x", "*** Begin Patch\n", "x", "patch"), ("x", None, "x", "full"),
    ]
    frame = spark.createDataFrame([(i, t, p) for i, (t, p, _, _) in enumerate(cases)], "i long, t string, p string")
    got = frame.select("i", patches.patched(F.col("t"), F.col("p")).alias("out"), F.coalesce(patches.patch_type(F.col("p")), F.lit("full")).alias("kind")).orderBy("i").collect()
    assert [(r.out, r.kind) for r in got] == [(o, k) for _, _, o, k in cases]


def test_files(spark):
    patch = "*** Begin Files\n*** File: a/b.md\nline\n\n*** File:c\nx\n*** End Files\nrest"
    [row] = spark.createDataFrame([(patch,)], "p string").select(patches.files(F.col("p")).alias("f"), patches.patch_type(F.col("p")).alias("k")).collect()
    assert ([tuple(x) for x in row.f], row.k) == ([("a/b.md", "line"), ("c", "x")], "full")
