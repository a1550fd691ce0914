"""Betweenness and communities of graphs given as edges (u, v), as joins that run level by level or round by round.

Loops of a node with itself, repeated edges and null ends are left out; a graph without edges gives an empty result. Tables of a
round are deleted once the next one stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .graph import ROWS, cut, drop

#: Pairs of a source and a node that are worked on together; more nodes take more batches of sources.
PAIRS = 200_000_000
#: Pairs of a node and a source in a group, parts that nodes are dealt into at least, messages that a group sums at once, and pairs that a task works on, group by group.
SIZE, PARTS, CHUNK, TASK = 1 << 20, 8, 1 << 22, 1 << 22
#: Pairs that a task walks where the graph is sent to it, and tasks at most.
WALK, WALKS = 1 << 26, 512
#: Places (32 bits: a node's number in its part, times the block's sources, plus the source's number) and values (64 bits), packed.
FIELDS = "part int, block int, kind string, at binary, value binary"
SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("kind", pa.string()), ("at", pa.binary()), ("value", pa.binary())])
#: Rounds without a gain after which a level of communities is settled.
IDLE = 3
#: A round that gains less counts as one without a gain.
LEAST_GAIN = 1e-4


def _packed(at: np.ndarray, value: np.ndarray) -> list[bytes]:
    return [at.astype(np.int32).tobytes(), value.astype(np.float64).tobytes()]


def _rows(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The places and values of a group's rows of one kind."""
    own = table.filter(pa.compute.equal(table["kind"], kind))
    return np.frombuffer(b"".join(own["at"].to_pylist()), np.int32), np.frombuffer(b"".join(own["value"].to_pylist()), np.float64)


def _sent(block: int, at: np.ndarray, value: np.ndarray, ends: np.ndarray, nodes: int, wide: int) -> Iterator[tuple]:
    """Messages along a part's edges (local, other part, other local), in order: what goes to the same place is summed, at most about ``CHUNK`` of them at once."""
    local = at // wide
    degree = np.bincount(ends[:, 0], minlength=nodes)
    first, n = np.cumsum(degree) - degree, degree[local]
    cuts = np.unique(np.concatenate([np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), CHUNK), side="right"), [len(n)]]))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        entry = np.repeat(np.arange(lo, hi), n[lo:hi])
        place = np.arange(len(entry)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi]) + first[local[entry]]
        key, own = np.unique(ends[place, 1].astype(np.int64) << 32 | ends[place, 2] * wide + at[entry] % wide, return_inverse=True)
        total = np.bincount(own, value[entry], minlength=len(key))
        bounds = np.flatnonzero(np.diff(key >> 32, prepend=-1))
        for i, j in zip(bounds, [*bounds[1:], len(key)]):
            yield (int(key[i] >> 32), block, "message", *_packed(key[i:j] & 0xFFFFFFFF, total[i:j]))


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, SCHEMA.types)], schema=SCHEMA)


def _dealt(edges: DataFrame, nodes: DataFrame, near: str, far: str) -> DataFrame:
    """A row for each part of the nodes: the ends of its edges, in order, and how many nodes it has."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("part").alias(f"{x}_part"), F.col("local").alias(f"{x}_local"))
    ends = nodes.join(edges.select(F.col(near).alias("id"), F.col(far).alias("far")).join(side("far"), "far"), "id", "left").select("part", "local", "far_part", "far_local")

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        n = pa.compute.max(table["local"]).as_py() + 1
        own = table.filter(table["far_part"].is_valid()).sort_by("local")
        at = np.stack([own[c].to_numpy() for c in ("local", "far_part", "far_local")], axis=1)
        return _table([(key[0].as_py(), 0, "ends", *_packed(at.ravel(), np.array([n])))])

    return cut(ends.groupBy("part").applyInArrow(pack, FIELDS).drop("block"))


def _behind(first: np.ndarray, target: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """What lies behind each node on the ways from some sources: ``first`` has where a node's edges begin in ``target``, and their number last.

    A pair's place is its source's number times the nodes, plus its node.
    """
    n = len(first) - 1
    degree, start = np.diff(first), np.arange(len(sources)) * n + sources
    ways, seen, slot = np.zeros(len(sources) * n), np.zeros(len(sources) * n, bool), np.empty(len(sources) * n, np.int32)
    ways[start], seen[start] = 1.0, True
    at, node, levels = start, sources, []
    while len(at):
        k = degree[node]
        entry = np.repeat(np.arange(len(at)), k)
        to = target[np.arange(len(entry)) + np.repeat(first[node] - np.cumsum(k) + k, k)]
        key = to + (at - node)[entry]
        new = np.flatnonzero(~seen[key])
        entry, to, key = entry[new], to[new], key[new]
        levels.append((at, entry, key))
        # one of the edges that reach a pair at once stands for it
        every = np.arange(len(key), dtype=np.int32)
        slot[key] = every
        stands = slot[key]
        total = np.bincount(stands, ways[at][entry], minlength=len(key))
        own = np.flatnonzero(stands == every)
        at, node = key[own], to[own]
        ways[at], seen[at] = total[own], True
    share, behind = np.zeros(len(ways)), ways  # in place
    for at, entry, key in reversed(levels):
        own = ways[at]
        new = own * np.bincount(entry, share[key], minlength=len(at))
        share[at] = (1 + new) / own
        behind[at] = new
    behind[start] = 0.0
    return behind.reshape(len(sources), n).sum(axis=0)


def _walked(ahead: DataFrame, parts: int, n: int, m: int) -> DataFrame:
    """(part, local, behind) of a graph whose edges and nodes a task can hold: each task gets them by a shuffle and walks from its own sources, a block of pairs after the other."""
    tasks = int(max(min(PARTS, n), min(WALKS, n * n // WALK)))
    block = max(1, min(SIZE // max(1, n), CHUNK // max(1, m)))

    def walk(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted((part, np.frombuffer(at, np.int32).reshape(-1, 3), int(np.frombuffer(value)[0])) for part, at, value in zip(*(table[c].to_pylist() for c in ("part", "at", "value"))))
        offset = np.zeros(parts + 1, np.int64)
        for part, _, count in rows:
            offset[part + 1] = count
        offset = np.cumsum(offset)
        source, target = (np.concatenate(x) for x in zip(*((ends[:, 0] + offset[part], offset[ends[:, 1]] + ends[:, 2]) for part, ends, _ in rows)))
        first = np.concatenate([[0], np.cumsum(np.bincount(source, minlength=n))])
        total, own = np.zeros(n), np.arange(key[0].as_py(), n, tasks)
        for i in range(0, len(own), block):
            total += _behind(first, target, own[i : i + block])
        return _table([(part, 0, "sum", b"", total[offset[part] : offset[part + 1]].tobytes()) for part, _, _ in rows])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}
        for batch in batches:
            for part, value in zip(*(c.to_pylist() for c in batch.columns)):
                totals[part] = totals.get(part, 0.0) + np.frombuffer(value)
        for part, behind in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(behind), part, np.int32)), pa.array(np.arange(len(behind), dtype=np.int32)), pa.array(behind)], ["part", "local", "behind"])

    each = ahead.select("part", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "at", "value").repartitionByRange(tasks, "task")
    sums = each.groupBy("task").applyInArrow(walk, FIELDS).select("part", "value").repartition(parts, "part")
    return cut(sums.mapInArrow(summed, "part int, local int, behind double"))


def _by_levels(ahead: DataFrame, back: DataFrame, parts: int, n: int, most: int, pairs: int) -> list[DataFrame]:
    """(part, local, behind) of larger graphs, for each batch of sources. ``most``: the nodes of the largest part.

    Sources are dealt into blocks: a group has the pairs of one part and one block, ``SIZE`` at most, which of them were seen, and the edges out
    of the part. A level is one shuffle of messages between groups. Sources go in batches of blocks, so that a level has a bounded number of rows.
    """
    wide = max(1, min(most, SIZE // most))
    per = -(-most // wide)
    size, batches = most * wide, min(parts * per, max(1, -(-n * n // pairs)))

    def go(first: bool):
        def step(key: tuple, table: pa.Table) -> pa.Table:
            part, block = (k.as_py() for k in key)
            ends, [count] = _rows(table, "ends")
            at, value = _rows(table, "message")
            if first and block // per == part:  # the block's sources
                own = np.arange(block % per * wide, min(int(count), (block % per + 1) * wide))
                at, value = own * wide + own % wide, np.ones(len(own))
            before = np.frombuffer(b"".join(table.filter(pa.compute.equal(table["kind"], "seen"))["at"].to_pylist()), np.uint8)
            seen = np.unpackbits(before, count=size) if len(before) else np.zeros(size, np.uint8)
            ways = np.bincount(at, value, minlength=size)
            new = np.flatnonzero((ways > 0) & (seen == 0))
            seen[new] = 1
            rows = [(part, block, "level", *_packed(new, ways[new]))] if len(new) else []
            return _table([*rows, (part, block, "seen", np.packbits(seen).tobytes(), b""), *_sent(block, new, ways[new], ends.reshape(-1, 3), int(count), wide)])

        return step

    def come(key: tuple, table: pa.Table) -> pa.Table:
        part, block = (k.as_py() for k in key)
        ends, [count] = _rows(table, "ends")
        at, ways = _rows(table, "level")
        behind = ways * np.bincount(*_rows(table, "message"), minlength=size)[at]
        node, before = _rows(table, "sum")
        sums = np.bincount(at // wide, behind, minlength=most) + np.bincount(node, before, minlength=most)
        rows = [(part, block, "sum", *_packed(np.flatnonzero(sums), sums[sums != 0]))]
        return _table([*rows, *_sent(block, at, (1 + behind) / ways, ends.reshape(-1, 3), int(count), wide)])

    def opened(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for part, at, value in zip(*(c.to_pylist() for c in batch.columns)):
                local = np.frombuffer(at, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(local), part, np.int32)), pa.array(local), pa.array(np.frombuffer(value, np.float64))], ["part", "local", "behind"])

    sums = []
    for b in range(batches):
        blocks = F.explode(F.sequence(F.lit(b), F.lit(parts * per - 1), F.lit(batches))).alias("block")
        groups = max(PARTS, parts * parts * per * size // batches // TASK)

        def grouped(ends: DataFrame, rows: DataFrame | None, blocks=blocks, groups=groups):
            every = ends.select("part", blocks, "kind", "at", "value")
            return (every if rows is None else every.unionByName(rows)).repartition(groups, "part", "block").groupBy("part", "block")

        rows, steps = grouped(ahead, None), []
        while True:
            told = Observation()
            step = rows.applyInArrow(go(not steps), FIELDS).observe(told, F.count_if(F.col("kind") == "message").alias("n"))
            steps.append(cut(step))
            if not told.get["n"]:
                break
            rows = grouped(ahead, steps[-1].filter("kind <> 'level'"))
        last = None
        for step in reversed(steps[1:]):
            level = step.filter("kind = 'level'")
            new = cut(grouped(back, level if last is None else level.unionByName(last)).applyInArrow(come, FIELDS))
            drop(step, *([] if last is None else [last]))
            last = new
        if last is not None:
            found = last.filter("kind = 'sum'").select("part", "at", "value").mapInArrow(opened, "part int, local int, behind double")
            sums.append(cut(found.groupBy("part", "local").agg(F.sum("behind").alias("behind"))))
            drop(last)
        drop(steps[0])
    return sums


def betweenness(edges: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(id, centrality): the share of shortest directed ways between other nodes that lead through a node, over (n - 1)(n - 2).

    From each source ways are counted level by level, then what lies behind a node is handed back up, each node's in proportion to the ways that
    lead to it. Up to ``SIZE`` nodes and ``CHUNK`` edges each task walks the graph from its own sources; in larger graphs a level is a shuffle, ``pairs`` of them at once.
    """
    edges = cut(edges.select("u", "v").filter("u <> v").distinct())
    m = edges.count()
    parts = max(PARTS, -(-m // ROWS))
    named = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    nodes = cut(named.withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1))
    sizes = nodes.agg(F.count(F.lit(1)).alias("n"), F.max("local").alias("most")).first()
    n, ahead = sizes.n, _dealt(edges, nodes, "u", "v")
    if n <= SIZE and m <= CHUNK:
        sums = [_walked(ahead, parts, n, m)] if n else []
    else:
        sums = _by_levels(ahead, _dealt(edges, nodes, "v", "u"), parts, n, sizes.most + 1, pairs)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    each = nodes.select("part", "local", F.lit(0.0).alias("behind"))
    total = reduce(DataFrame.unionByName, sums, each).groupBy("part", "local").agg((F.sum("behind") * scale).alias("centrality"))
    return nodes.join(total, ["part", "local"]).select("id", "centrality")


def _weight_within(edges: DataFrame, state: DataFrame, total: float) -> float:
    """The modularity of a state (id, k, c) over edges (u, v, w) in both directions; total is the sum of their weights."""
    side = lambda x: state.select(F.col("id").alias(x), F.col("c").alias(f"c_{x}"))
    inside = edges.join(side("u"), "u").join(side("v"), "v").filter("c_u = c_v").agg((F.sum("w") / total).alias("x"))
    squares = state.groupBy("c").agg(F.sum("k").alias("k")).agg((-F.sum(F.col("k") * F.col("k")) / total**2).alias("x"))
    return inside.union(squares).agg(F.sum("x")).first()[0] or 0.0


def _moved(edges: DataFrame, state: DataFrame, total: float, turn: int) -> DataFrame:
    """The state after one round: nodes go where they gain most, ties to the smaller community.

    Communities are of one of two sides, by a hash of name and round: nodes leave those of one side for those of the other, so none loses a node while others join it.
    """
    side = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2))
    weight = state.groupBy("c").agg(F.sum("k").alias("all"))
    movers = state.filter(side("c") == 0).select("id", "k", F.col("c").alias("own"))
    near = edges.filter("u <> v").join(movers.withColumnRenamed("id", "u"), "u").join(state.select(F.col("id").alias("v"), "c"), "v")
    near = near.filter((F.col("c") == F.col("own")) | (side("c") == 1)).groupBy(F.col("u").alias("id"), "k", "own", "c").agg(F.sum("w").alias("to"))
    gain = F.col("to") - F.col("k") * (F.col("all") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / total
    each = near.unionByName(movers.select("id", "k", "own", F.col("own").alias("c"), F.lit(0.0).alias("to"))).groupBy("id", "k", "own", "c").agg(F.sum("to").alias("to"))
    each = each.join(weight, "c").select("id", "own", "c", gain.alias("gain"))
    best = each.groupBy("id", "own").agg(F.max_by("c", F.struct("gain", -F.col("c"))).alias("to"), F.max("gain").alias("gain"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("now"))
    goes = best.filter(F.col("gain") > F.col("now") + 1e-9).select("id", "to")
    return state.join(goes, "id", "left").select("id", "k", F.coalesce("to", "c").alias("c"))


def louvain(edges: DataFrame, weight_col: str | None = None, most_rounds: int = 60) -> DataFrame:
    """(id, community): communities by modularity gain, named by their least node; edges count in both directions, once for each pair of nodes.

    In a round nodes move at once; a round that loses modularity, as nodes that move together may, is taken back, and the next one has other sides.
    After ``IDLE`` rounds without a gain the communities become nodes, and so on until a level has no gain.
    """
    w = F.lit(1.0) if weight_col is None else F.col(weight_col).cast("double")
    one = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), w.alias("w")).groupBy("u", "v").agg((F.max("w") if weight_col is None else F.sum("w")).alias("w"))
    at = cut(one.union(one.select("v", "u", "w")))
    total = at.agg(F.sum("w")).first()[0]
    label = cut(at.select(F.col("u").alias("id")).distinct().withColumn("c", F.col("id")))
    turn = 0
    while total:
        state = cut(at.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k")).withColumn("c", F.col("id")))
        first = best = _weight_within(at, state, total)
        idle = 0
        for _ in range(most_rounds):
            turn += 1
            step = cut(_moved(at, state, total, turn))
            now = _weight_within(at, step, total)
            if now > best + LEAST_GAIN:
                drop(state)
                state, best, idle = step, now, 0
            else:
                drop(step)
                idle += 1
                if idle == IDLE:
                    break
        if best <= first + LEAST_GAIN:
            break
        names = state.groupBy("c").agg(F.min("id").alias("name"))
        named = cut(state.join(names, "c").select("id", "name"))
        new = cut(label.join(named.withColumnRenamed("id", "c"), "c").select("id", F.col("name").alias("c")))
        side = lambda x: named.select(F.col("id").alias(x), F.col("name").alias(f"n_{x}"))  # noqa: E731, B023
        folded = cut(at.join(side("u"), "u").join(side("v"), "v").groupBy(F.col("n_u").alias("u"), F.col("n_v").alias("v")).agg(F.sum("w").alias("w")))
        drop(at, state, label, named)
        at, label = folded, new
    return label.select("id", F.col("c").alias("community"))
