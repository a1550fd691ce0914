"""Registered queries on the structure of graphs, with their SQL.

Parts make a forest: each but every seventh hangs on the one of half its number. Customers of an even nation make a ring, those of an odd one point at the first of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import centrality, relational, structure
from ..sources import frames
from .more import typed_links
from .sql import LINKS


def forest(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    return frames.table(spark, sf, "part").filter((p > 0) & (p % 7 != 0)).select(p.alias("u"), F.floor(p / 2).alias("v"))


def chains(spark: SparkSession, sf: str) -> DataFrame:
    own = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    rows = frames.table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("u"), F.lead("c_custkey").over(own).alias("next"))
    first = rows.groupBy("g").agg(F.min("u").alias("first"))
    return rows.join(first, "g").select("g", "u", F.when(F.col("g") % 2 == 0, F.coalesce("next", "first")).otherwise(F.col("first")).alias("v")).filter("u <> v")


def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    return structure.components(forest(spark, sf))


def graph_levels(spark: SparkSession, sf: str) -> DataFrame:
    return structure.levels(forest(spark, sf))


def graph_breadth(spark: SparkSession, sf: str) -> DataFrame:
    return structure.breadth(structure.levels(forest(spark, sf)))


def cycle_members(spark: SparkSession, sf: str) -> DataFrame:
    return structure.cycles(chains(spark, sf)).select("id")


def graph_topologies(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of each nation in eight groups: chains, closed in even groups."""
    own = Window.partitionBy("g").orderBy("id")
    nodes = frames.table(spark, sf, "supplier").select((F.col("s_nationkey") + 25 * (F.col("s_suppkey") % 8)).alias("g"), F.col("s_suppkey").alias("id"))
    rows = nodes.select("g", F.col("id").alias("u"), F.lead("id").over(own).alias("next"))
    first = rows.groupBy("g").agg(F.min("u").alias("first"))
    edges = rows.join(first, "g").select("g", "u", F.coalesce("next", F.when(F.col("g") % 2 == 0, F.col("first"))).alias("v")).filter("v is not null and u <> v")
    return structure.topologies(nodes, edges)


def graph_bridges(spark: SparkSession, sf: str) -> DataFrame:
    """The forest's edges, but for those that edges from each twentieth part to the one after it go around."""
    p = F.col("p_partkey")
    extra = frames.table(spark, sf, "part").filter(p % 20 == 1).select(p.alias("u"), F.floor(p / 4).alias("v"))
    return structure.bridges(forest(spark, sf).unionByName(extra))


def graph_path(spark: SparkSession, sf: str) -> DataFrame:
    return structure.shortest_path(forest(spark, sf), 190, 5)


def removal_impact(spark: SparkSession, sf: str) -> DataFrame:
    return structure.removal(forest(spark, sf), 3)


def graph_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return structure.boundary(forest(spark, sf), lambda c: F.col(c) % 3 == 0)


def ego_graph(spark: SparkSession, sf: str) -> DataFrame:
    links = typed_links(spark, sf).select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))
    return structure.ego(links, [1, 2], 2, 50)


def cooccurrence_scores(spark: SparkSession, sf: str) -> DataFrame:
    pairs = relational.shared(frames.bipartite(spark, sf), "memory_id", "entity_id").filter("shared >= 2")
    names = frames.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("at"))
    return structure.cooccurrence(pairs, names).select("a", "b", F.round("score", 6).alias("score"))


def label_modularity(spark: SparkSession, sf: str) -> DataFrame:
    labels = frames.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).alias("label"))
    return structure.modularity(forest(spark, sf), labels)


def graph_betweenness(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that pass goods on to those of twice and of three times their number, modulo how many there are."""
    supplier = frames.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("u"))
    n = supplier.agg(F.count(F.lit(1)).alias("n"))
    edges = supplier.join(F.broadcast(n)).select("u", F.explode(F.array(F.col("u") * 2 % F.col("n"), (F.col("u") * 3 + 1) % F.col("n"))).alias("v"))
    return centrality.betweenness(edges).select("id", F.round("centrality", 6).alias("centrality"))


def graph_subsystems(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of the forest, which its trees' branches make up; tests hold their modularity against a plain version."""
    return centrality.louvain(forest(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (graph_components, graph_levels, graph_breadth, cycle_members, graph_topologies, graph_bridges, graph_path, removal_impact, graph_boundary, ego_graph, cooccurrence_scores, label_modularity, graph_betweenness, graph_subsystems)
}

_FOREST = "f AS (SELECT p_partkey AS u, p_partkey // 2 AS v FROM part WHERE p_partkey > 0 AND p_partkey % 7 <> 0), n AS (SELECT u AS id FROM f UNION SELECT v FROM f), up AS (SELECT id AS start, id, 0 AS d FROM n UNION ALL SELECT start, v, d + 1 FROM up JOIN f ON u = id)"
_GRAMS = lambda c: f"list_distinct(list_transform(range(1, length({c})), lambda i: substring(lower({c}), i::INT, 2)))"

SQL: dict[str, str] = {
    "graph_components": f"WITH RECURSIVE {_FOREST}, r AS (SELECT start, arg_max(id, d) AS root FROM up GROUP BY 1), c AS (SELECT root, min(start) AS component FROM r GROUP BY 1) SELECT start AS id, component FROM r JOIN c USING (root)",
    "graph_levels": f"WITH RECURSIVE {_FOREST} SELECT id, CAST(max(d) AS INTEGER) AS level FROM up GROUP BY 1",
    "graph_breadth": f"WITH RECURSIVE {_FOREST}, l AS (SELECT id, max(d) AS level FROM up GROUP BY 1), w AS (SELECT level, count(*) AS n FROM l GROUP BY 1) SELECT count(*) AS levels, max(n) AS widest, 0 AS in_cycles FROM w",
    "cycle_members": "WITH c AS (SELECT c_nationkey AS g, c_custkey AS id, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT id FROM c WHERE g % 2 = 0 AND n >= 2",
    "graph_topologies": "WITH s AS (SELECT s_nationkey + 25 * (s_suppkey % 8) AS g FROM supplier) SELECT g, count(*) AS nodes, CASE WHEN count(*) = 1 THEN 'Single-Node' WHEN g % 2 = 0 THEN 'Cycle' ELSE 'Pipeline' END AS topology FROM s GROUP BY 1",
    "graph_path": f"WITH RECURSIVE {_FOREST} SELECT CAST(d AS INTEGER) AS place, id FROM up WHERE start = 190 AND d <= (SELECT d FROM up WHERE start = 190 AND id = 5)",
    "removal_impact": f"WITH RECURSIVE {_FOREST} SELECT (SELECT count(*) FROM n) - (SELECT count(*) FROM f) AS before, (SELECT count(*) FROM n) - 1 - (SELECT count(*) FROM f WHERE u <> 3 AND v <> 3) AS after",
    "graph_boundary": "WITH RECURSIVE " + _FOREST + " SELECT CASE WHEN u % 3 = 0 AND v % 3 = 0 THEN 'within' WHEN u % 3 = 0 THEN 'out' ELSE 'in' END AS direction, count(*) AS n FROM f WHERE u % 3 = 0 OR v % 3 = 0 GROUP BY 1",
    "ego_graph": f"""WITH {LINKS}, e AS (SELECT DISTINCT source_id AS u, target_id AS v FROM links WHERE source_id <> target_id), h0 AS (SELECT DISTINCT u AS id FROM e WHERE u IN (1, 2)), h1 AS (SELECT DISTINCT v AS id FROM e WHERE u IN (SELECT id FROM h0)),
        h2 AS (SELECT DISTINCT v AS id FROM e WHERE u IN (SELECT id FROM h1)), r AS (SELECT id, min(d) AS d FROM (SELECT id, 0 AS d FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY 1 ORDER BY d, id LIMIT 50)
        SELECT u, v FROM e WHERE u IN (SELECT id FROM r) AND v IN (SELECT id FROM r)""",
    "cooccurrence_scores": f"""WITH b AS (SELECT DISTINCT l_orderkey AS m, l_partkey AS e FROM lineitem), p AS (SELECT x.e AS a, y.e AS b, count(*) AS shared FROM b x JOIN b y ON x.m = y.m AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= 2),
        g AS (SELECT a, b, shared, {_GRAMS('q.p_name')} AS ga, {_GRAMS('r.p_name')} AS gb, abs(q.p_size - r.p_size) AS days FROM p JOIN part q ON q.p_partkey = a JOIN part r ON r.p_partkey = b)
        SELECT a, b, round(0.2::DOUBLE * len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))) + 0.5::DOUBLE * least(shared / 10.0::DOUBLE, 1.0::DOUBLE) + 0.3::DOUBLE * exp(-days / 30.0::DOUBLE), 6) AS score FROM g""",
    "label_modularity": f"""WITH RECURSIVE {_FOREST}, k AS (SELECT id, count(*) AS k FROM (SELECT u AS id FROM f UNION ALL SELECT v FROM f) GROUP BY 1), m AS (SELECT count(*) AS m FROM f), s AS (SELECT sum(1 - a.k * b.k / (2.0::DOUBLE * m)) AS q FROM f JOIN k a ON a.id = u JOIN k b ON b.id = v, m WHERE u % 4 = v % 4)
        SELECT round(q / (2.0::DOUBLE * m), 4) AS q FROM s, m""",
    "graph_betweenness": """WITH RECURSIVE s AS (SELECT s_suppkey AS k, count(*) OVER () AS n FROM supplier), e AS (SELECT DISTINCT u, v FROM (SELECT k AS u, k * 2 % n AS v FROM s UNION ALL SELECT k, (k * 3 + 1) % n FROM s) WHERE u <> v),
        nodes AS (SELECT u AS id FROM e UNION SELECT v FROM e), reach AS (SELECT id AS s, id AS t, 0 AS d FROM nodes UNION SELECT s, v, d + 1 FROM reach JOIN e ON t = u WHERE d < 24),
        far AS (SELECT s, t, min(d) AS d FROM reach GROUP BY ALL),
        ways AS (SELECT id AS s, id AS t, 0 AS d FROM nodes UNION ALL SELECT ways.s, e.v, ways.d + 1 FROM ways JOIN e ON ways.t = e.u JOIN far ON far.s = ways.s AND far.t = e.v AND far.d = ways.d + 1),
        w AS (SELECT s, t, any_value(d) AS d, count(*)::DOUBLE AS n FROM ways GROUP BY s, t),
        got AS (SELECT a.t AS id, sum(a.n * b.n / c.n) AS sum FROM w a JOIN w b ON a.t = b.s JOIN w c ON c.s = a.s AND c.t = b.t AND c.d = a.d + b.d WHERE a.d > 0 AND b.d > 0 AND c.d > 0 GROUP BY 1)
        SELECT id, round(coalesce(sum, 0) / ((SELECT count(*) FROM nodes) - 1) / ((SELECT count(*) FROM nodes) - 2), 6) AS centrality FROM nodes LEFT JOIN got USING (id)""",
}
