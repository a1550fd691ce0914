"""Structure of graphs given as edges (u, v): components, order, cycles, depth, bridges, paths, topology, boundaries.

Iterations are joins on node keys between tables that are written each round; a round moves one row for each node or edge, so nothing is
gathered. Loops of a node with itself and null ends are left out; a graph without edges gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .graph import kept, spread


def _clean(edges: DataFrame) -> DataFrame:
    return kept(spread(edges.select("u", "v").filter("u <> v"), "u", "v").distinct())


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select("v", "u"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each node the least node that it hangs together with.

    Each round nodes take the least label of their neighbours, then the label of that label, so long chains shrink by halves.
    """
    edges = _clean(edges)
    both = kept(_both(edges))
    label = kept(both.groupBy(F.col("u").alias("id")).agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        near = both.join(label, both.v == label.id).groupBy("u").agg(F.min("label").alias("near"))
        hop = label.join(near, label.id == near.u).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # a label's own label may be smaller still
        root = label.select(F.col("id").alias("label"), F.col("label").alias("root"))
        step = kept(hop.join(root, "label", "left").select("id", F.least("label", F.coalesce("root", "label")).alias("label"), "old"))
        label = step.select("id", "label")
        if step.filter("label <> old").isEmpty():
            return label.select("id", F.col("label").alias("component"))


def levels(edges: DataFrame) -> DataFrame:
    """(id, level): the longest way from a source, by peeling nodes that nothing open points to; null on cycles and behind them."""
    edges = _clean(edges)
    nodes = kept(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    done, left, level = None, edges, 0
    open_ = nodes
    while True:
        free = kept(open_.join(left.select(F.col("v").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(level).alias("level")))
        if free.isEmpty():
            rest = open_.select("id", F.lit(None).cast("int").alias("level"))
            return rest if done is None else done.unionByName(rest)
        done = free if done is None else done.unionByName(free)
        open_ = kept(open_.join(free.select("id"), "id", "left_anti"))
        left = kept(left.join(free.select(F.col("id").alias("u")), "u", "left_anti"))
        level += 1


def _peeled(edges: DataFrame) -> DataFrame:
    """The edges left when nodes that nothing points to, and nodes that point to nothing, are taken away until there are none."""
    while True:
        starts, ends = edges.select(F.col("u").alias("id")).distinct(), edges.select(F.col("v").alias("id")).distinct()
        inner = starts.join(ends, "id", "left_semi")
        left = kept(edges.join(inner.withColumnRenamed("id", "u"), "u", "left_semi").join(inner.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v"))
        if left.count() == edges.count():
            return left
        edges = left


def _spread(label: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): labels that each node takes from those that point to it, until the greatest has gone as far as it can; a round joins each edge once."""
    while True:
        came = edges.join(label.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.max("label").alias("came"))
        step = kept(label.join(came, "id", "left").select("id", F.greatest("label", F.coalesce("came", "label")).alias("label"), F.col("label").alias("old")))
        label = step.select("id", "label")
        if step.filter("label <> old").isEmpty():
            return label


def cycles(edges: DataFrame) -> DataFrame:
    """(id, cycle): the nodes that reach themselves, with the greatest node that they reach and are reached by; nodes between two cycles are in none.

    What no cycle can hold is peeled off at both ends. Rings by themselves are found as components. In what is left the greatest label goes along the edges; the nodes that its owner
    is reached by within one label are a strong component and leave the graph, and so on.
    """
    edges, found = _peeled(_clean(edges)), []
    while not edges.isEmpty():
        part = components(edges)
        side = lambda x: edges.groupBy(F.col(x).alias("id")).agg(F.count(F.lit(1)).alias(f"n_{x}"))  # noqa: E731, B023
        ring = part.join(side("u"), "id").join(side("v"), "id").groupBy("component").agg(F.max(F.greatest("n_u", "n_v")).alias("most"), F.max("id").alias("cycle")).filter("most = 1").select("component", "cycle")
        rings = kept(part.join(ring, "component").select("id", "cycle"))
        found.append(rings)
        edges = kept(edges.join(rings.select(F.col("id").alias("u")), "u", "left_anti"))
        if edges.isEmpty():
            break
        nodes = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        label = _spread(kept(nodes.withColumn("label", F.col("id"))), edges)
        name = lambda x: label.select(F.col("id").alias(x), F.col("label").alias(f"label_{x}"))  # noqa: E731, B023
        inside = kept(edges.join(name("u"), "u").join(name("v"), "v").filter("label_u = label_v").select("u", "v"))
        # back along the edges within a label: 1 where its owner can be reached
        back = _spread(kept(label.select("id", F.when(F.col("id") == F.col("label"), 1).otherwise(0).alias("label"))), inside.select(F.col("v").alias("u"), F.col("u").alias("v")))
        strong = kept(label.join(back.filter("label = 1").select("id"), "id").select("id", F.col("label").alias("cycle")))
        several = strong.groupBy("cycle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cycle")
        found.append(kept(strong.join(several, "cycle").select("id", "cycle")))
        gone = strong.select(F.col("id").alias("u"))
        edges = _peeled(edges.join(gone, "u", "left_anti").join(gone.withColumnRenamed("u", "v"), "v", "left_anti").select("u", "v"))
    if not found:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("cycle")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def breadth(level: DataFrame) -> DataFrame:
    """(levels, widest, in_cycles): how deep an order is, how many nodes stand side by side at most, how many have no place."""
    width = level.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return width.agg(F.count("level").alias("levels"), F.coalesce(F.max(F.when(F.col("level").isNotNull(), F.col("n"))), F.lit(0)).alias("widest"), F.coalesce(F.sum(F.when(F.col("level").isNull(), F.col("n"))), F.lit(0)).alias("in_cycles"))


def _degrees(edges: DataFrame) -> DataFrame:
    """(part, id, i, o): edges into and out of the nodes of edges (part, u, v)."""
    ends = edges.select("part", F.col("u").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select("part", "v", F.lit(1), F.lit(0)))
    return ends.groupBy("part", "id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))


def cyclic(edges: DataFrame) -> DataFrame:
    """(part): the components that hold a cycle, of distinct edges (part, u, v), u <> v, with their component.

    Where each node is pointed to, or each points to another, there is one; where edges are one less than nodes, there is none. Others lose their first and last nodes, and some of those
    with one edge in and one out, which the nodes at either side of them then skip, so long ways shrink by a share in each round; a loop that this leaves is a cycle.
    """
    left, found, turn = kept(edges.select("part", "u", "v")), [], 0
    while True:
        degree = kept(_degrees(left))
        loops = left.filter("u = v").groupBy("part").agg(F.lit(True).alias("loop"))
        state = degree.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("o").alias("m"), F.min("i").alias("i"), F.min("o").alias("o")).join(loops, "part", "left")
        state = kept(state.select("part", ((F.col("i") > 0) | (F.col("o") > 0) | F.coalesce("loop", F.lit(False))).alias("cycle"), (F.col("m") == F.col("n") - 1).alias("tree")))
        found.append(state.filter("cycle").select("part"))
        still = kept(left.join(state.filter("not cycle and not tree"), "part", "left_semi"))
        if still.isEmpty():
            return reduce(DataFrame.unionByName, found)
        inner = kept(degree.filter("i > 0 and o > 0").select("id", ((F.col("i") == 1) & (F.col("o") == 1)).alias("thin")))
        name = lambda x: inner.select(F.col("id").alias(x), F.col("thin").alias(f"thin_{x}"))  # noqa: E731, B023
        core = still.join(name("u"), "u").join(name("v"), "v")
        # of thin nodes that follow each other at most every second one goes
        heads = lambda x: F.pmod(F.xxhash64(x, F.lit(turn)), F.lit(2)) == 1  # noqa: E731, B023
        core = kept(core.withColumn("go", F.col("thin_v") & heads("v") & ~(F.col("thin_u") & heads("u"))))
        into = core.filter("go").select(F.col("u").alias("before"), F.col("v").alias("gone"))
        out = core.join(into.select("gone"), F.col("u") == F.col("gone"), "left_semi").select("part", F.col("u").alias("gone"), F.col("v").alias("after"))
        rest = core.filter("not go").join(into.select("gone"), F.col("u") == F.col("gone"), "left_anti").select("part", "u", "v")
        left = kept(rest.unionByName(into.join(out, "gone").select("part", F.col("before").alias("u"), F.col("after").alias("v"))).distinct())
        turn += 1


def topologies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, nodes, topology) of each group's graph: nodes (g, id), edges (g, u, v) within their group. Ids are unique over groups."""
    own = kept(edges.select("g", "u", "v").filter("u <> v").distinct())
    parts = components(own).withColumnRenamed("component", "part")
    linked = own.join(parts.withColumnRenamed("id", "u"), "u").select("part", "u", "v")
    degree = _degrees(linked)
    loose = cyclic(linked).withColumn("loose", F.lit(True))
    per = nodes.join(degree, "id", "left").join(loose, "part", "left").fillna(0, ["i", "o"]).withColumn("part", F.coalesce("part", "id"))
    g = per.groupBy("g").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("part").alias("parts"), F.count_if("loose").alias("loose"), F.max("i").alias("i"), F.max("o").alias("o"), F.count_if(F.col("i") == 0).alias("sources"), F.sum("o").alias("edges"))
    c = F.col
    kind = F.when(c("nodes") == 1, "Single-Node").when(c("parts") > 1, "Disconnected").when(c("loose") > 0, "Cycle").when((c("i") <= 1) & (c("o") <= 1), "Pipeline")
    kind = kind.when((c("edges") == c("nodes") - 1) & (c("sources") == 1), "Tree").when((c("i") > 1) & (c("o") > 1), "Fork-Join").otherwise("DAG")
    return g.select("g", "nodes", kind.alias("topology"))


def _tree(both: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """((id, parent, depth), depth of the last): breadth first from the roots, each node under the least of its possible parents."""
    tree = kept(roots.select("id", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth")))
    front, depth = tree, 0
    while True:
        depth += 1
        reached = both.join(front.select(F.col("id").alias("u")), "u").groupBy(F.col("v").alias("id")).agg(F.min("u").alias("parent"))
        front = kept(reached.join(tree.select("id").hint("merge"), "id", "left_anti").select("id", "parent", F.lit(depth).alias("depth")))
        if front.isEmpty():
            return tree, depth - 1
        tree = tree.unionByName(front)


def bridges(edges: DataFrame) -> DataFrame:
    """(a, b): edges, a < b, without which their ends would hang together no more.

    Each edge outside of a breadth-first tree gets 64 random bits, xor-ed at both ends; summed up the tree from below, a tree edge's bits are those
    of the edges that go around it. None: a bridge (but for one chance in 2 ** 64 for each edge).
    """
    one = _clean(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    both = kept(_both(one))
    parts = components(one)
    tree, deepest = _tree(both, parts.select(F.col("component").alias("id")).distinct())
    tree = kept(tree)
    own = tree.filter("parent is not null").select(F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"))
    around = one.join(own, ["u", "v"], "left_anti").withColumn("bits", F.xxhash64("u", "v", F.lit("around")))
    value = kept(around.select(F.explode(F.array("u", "v")).alias("id"), "bits").groupBy("id").agg(F.bit_xor("bits").alias("bits")))
    found = None
    for depth in range(deepest, 0, -1):
        level = kept(tree.filter(F.col("depth") == depth).join(value, "id", "left").select("id", "parent", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))
        free = level.filter("bits = 0").select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))
        found = free if found is None else found.unionByName(free)
        value = kept(value.unionByName(level.select(F.col("parent").alias("id"), "bits")).groupBy("id").agg(F.bit_xor("bits").alias("bits")))
    return found if found is not None else one.select(F.col("u").alias("a"), F.col("v").alias("b")).limit(0)


def shortest_path(edges: DataFrame, start: int, end: int) -> DataFrame:
    """(place, id): a shortest way along the edges, the least where several are; empty if there is none. Ends when no new node is reached."""
    edges = _clean(edges)
    spark = edges.sparkSession
    front = spark.range(1).select(F.lit(start).cast("long").alias("id"), F.array(F.lit(start).cast("long")).alias("path"))
    seen = kept(front.select("id"))
    while True:
        hit = front.filter(F.col("id") == end)
        if not hit.isEmpty():
            return hit.select(F.posexplode("path").alias("place", "id"))
        step = front.join(edges, front.id == edges.u).groupBy(F.col("v").alias("id")).agg(F.min("path").alias("path"))
        front = kept(step.join(seen, "id", "left_anti").select("id", F.concat("path", F.array("id")).alias("path")))
        if front.isEmpty():
            break
        seen = kept(seen.union(front.select("id")))
    return front.limit(0).select(F.posexplode("path").alias("place", "id"))


def removal(edges: DataFrame, node: int) -> DataFrame:
    """(before, after): components with and without a node; nodes that it leaves alone count as components."""
    edges = _clean(edges)
    nodes = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    rest = edges.filter((F.col("u") != node) & (F.col("v") != node))
    n = lambda e, own: own.join(components(e), "id", "left").agg(F.count_distinct(F.coalesce("component", "id")).alias("n"))
    before, after = n(edges, nodes).withColumnRenamed("n", "before"), n(rest, nodes.filter(F.col("id") != node)).withColumnRenamed("n", "after")
    return before.join(F.broadcast(after))


def boundary(edges: DataFrame, inside: Column) -> DataFrame:
    """(direction, n): edges into, out of and within a part of the graph; ``inside`` takes a column's name through {}."""
    kept = edges.withColumns({"a": inside("u"), "b": inside("v")})
    kind = F.when(F.col("a") & F.col("b"), "within").when(F.col("a"), "out").when(F.col("b"), "in")
    return kept.groupBy(kind.alias("direction")).agg(F.count(F.lit(1)).alias("n")).filter("direction is not null")


def ego(edges: DataFrame, seeds: list[int], depth: int, most: int) -> DataFrame:
    """(u, v): the edges among the nodes at most ``depth`` steps from the seeds, of which the ``most`` nearest, smaller ids first."""
    one = _clean(edges)
    both = kept(spread(_both(one), "u", "v").distinct())
    roots = both.filter(F.col("u").isin(seeds)).select(F.col("u").alias("id")).distinct()
    found = front = kept(roots.withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        front = kept(both.join(front.select(F.col("id").alias("u")), "u").select(F.col("v").alias("id")).distinct().join(found.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        found = found.unionByName(front)
    near = F.broadcast(found.orderBy("depth", "id").limit(most).select("id"))
    return one.join(near.select(F.col("id").alias("u")), "u", "left_semi").join(near.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v")


def cooccurrence(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b, score): 0.2 likeness of names, 0.5 shared rows (ten are all), 0.3 nearness in time. names: (id, name, at)."""
    side = lambda x: names.select(F.col("id").alias(x), F.col("name").alias(f"name_{x}"), F.col("at").alias(f"at_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    same = text.jaccard(text.bigrams(F.col("name_a")), text.bigrams(F.col("name_b")))
    near = F.exp(-F.abs(F.datediff("at_a", "at_b")) / 30)
    return both.select("a", "b", (0.2 * same + 0.5 * F.least(F.col("shared") / 10, F.lit(1.0)) + 0.3 * near).alias("score"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(q): how much edges keep within labels (id, label): the sum over them of 1 less the product of degrees over 2 m, over 2 m."""
    one = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    degree = _both(one).groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("k")).join(labels, "id")
    side = lambda x: degree.select(F.col("id").alias(x), F.col("k").alias(f"k_{x}"), F.col("label").alias(f"label_{x}"))
    sums = one.join(side("u"), "u").join(side("v"), "v").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("label_u") == F.col("label_v")).alias("inside"), F.sum(F.when(F.col("label_u") == F.col("label_v"), F.col("k_u") * F.col("k_v")).otherwise(0)).alias("product"))
    return sums.select(F.round((F.col("inside") - F.col("product") / (2 * F.col("m"))) / (2 * F.col("m")), 4).alias("q"))
