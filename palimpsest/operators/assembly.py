"""Contexts for many requests at once: layers of candidates, chosen greedily under budgets of tokens.

Each layer gives a request a bounded number of candidates, cut by rank before they meet: as every text takes a token at least, no more than
the budget can be of use. A request's candidates then meet in one group, which is read in the order of layers and ranks. A layer stops at
its share of the budget; what is closer than ``ALIKE`` to something chosen is passed over, and links are followed from the first rows that the search gave.

Rows without text take no part; rows without a vector are never too close to another. Ties go to the smaller id; a request without candidates has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from .context import truncated

#: Tokens of a context and of one text, likeness from which a text is a repeat, least score of a search hit.
BUDGET, EACH, ALIKE, RELEVANT = 8000, 2500, 0.88, 0.55
#: By strategy the share of the budget up to which static rows and search hits go, and how many hits are asked for.
STATIC = {"precision": 0.2, "balanced": 0.3, "breadth": 0.3}
CEILING = {"precision": 0.82, "balanced": 0.8, "breadth": 0.9}
HITS = {"precision": 30, "balanced": 50, "breadth": 80}
#: The share from which a layer isn't begun, and that up to which it goes.
EVOLUTION, LINKED, RECENT = (0.72, 0.75), (0.85, 0.88), (0.93, 0.93)
#: From how many chosen hits versions and links are followed, and how many of the newest rows are looked at.
EVOLVED_FROM, LINKED_FROM, NEWEST = 8, 5, 5


@dataclass
class Chosen:
    """What a context holds so far."""

    budget: int
    alike: float = ALIKE

    def __post_init__(self) -> None:
        self.used, self.seen, self.vectors, self.rows = 0, set(), [], []

    def over(self, tokens: int, share: float) -> bool:
        return self.used + tokens > self.budget * share

    def repeats(self, vector: np.ndarray | None) -> bool:
        return vector is not None and any(len(v) == len(vector) and v @ vector > self.alike for v in self.vectors)

    def add(self, row: pd.Series, vector: np.ndarray | None) -> None:
        self.rows.append((row.id, row.layer, row.score, row.tokens))
        self.seen.update([row.id] if row.covers is None else row.covers)
        self.used += row.tokens
        if vector is not None:
            self.vectors.append(vector)


def _unit(v: object) -> np.ndarray | None:
    if v is None:
        return None
    a = np.array(v, float)
    norm = np.linalg.norm(a)
    return a / norm if norm > 0 and np.isfinite(norm) else None


def choose(candidates: pd.DataFrame, budget: int, strategy: str, relevant: float, alike: float = ALIKE) -> Chosen:
    """One request's candidates, read layer by layer."""
    out = Chosen(budget, alike)
    rows = {layer: list(part.sort_values(["place", "id"]).itertuples(index=False)) for layer, part in candidates.groupby("layer")}
    for row in rows.get("static", []):
        if out.over(row.tokens, STATIC[strategy]):
            break
        out.add(row, _unit(row.vector))
    hits = []
    for row in rows.get("semantic", []):
        if row.id in out.seen:
            continue
        if out.over(row.tokens, CEILING[strategy]):
            break
        vector = _unit(row.vector)
        if not out.repeats(vector) and row.raw >= relevant:
            out.add(row, vector)
            hits.append(row.id)
    chains = {row.anchor: row for row in rows.get("evolution", [])}
    for hit in hits[:EVOLVED_FROM]:
        if not out.used < budget * EVOLUTION[0]:
            break
        if hit in chains:
            if out.over(chains[hit].tokens, EVOLUTION[1]):
                break
            out.add(chains[hit], None)
    for hit in hits[:LINKED_FROM] if strategy != "precision" else []:
        if not out.used < budget * LINKED[0]:
            break
        for row in rows.get("linked", []):
            if row.anchor != hit or row.id in out.seen:
                continue
            if out.over(row.tokens, LINKED[1]):
                break
            vector = _unit(row.vector)
            if not out.repeats(vector):
                out.add(row, vector)
    for row in rows.get("recent", []) if out.used < budget * RECENT[0] else []:
        if row.id in out.seen:
            continue
        if out.over(row.tokens, RECENT[1]):
            break
        vector = _unit(row.vector)
        if not out.repeats(vector):
            out.add(row, vector)
    return out


def _layer(rows: DataFrame, layer: str, order: list[Column], most: int, score: Column, anchor: Column | None = None, by: tuple[str, ...] = ("request",), raw: Column | None = None) -> DataFrame:
    """Candidates of a layer: of each request (and anchor) the first ``most`` in an order; rows have request, id, content, vector, covers."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    cut_text = truncated(F.col("content"), EACH)
    kept = rows.filter(F.length("content") > 0).withColumn("place", place.cast("long")).filter(F.col("place") <= most)
    return kept.select(
        F.col("request").cast("long").alias("request"), F.lit(layer).alias("layer"), "place", (F.lit(None) if anchor is None else anchor).cast("long").alias("anchor"), F.col("id").cast("long").alias("id"),
        cut_text.alias("content"), text.estimated_tokens(cut_text).alias("tokens"), score.cast("double").alias("score"), (score if raw is None else raw).cast("double").alias("raw"), "vector", "covers",
    )


def candidates(requests: DataFrame, hits: DataFrame, rows: DataFrame, links: DataFrame, as_of: str, budget: int = BUDGET) -> DataFrame:
    """All layers' candidates. requests: (request, user_id, query vector q); hits: (request, id, score) of a search; links: (source_id, target_id, similarity).

    rows: (id, user_id, content, vector, created_at, version, root_memory_id, is_static, is_forgotten, is_archived, is_latest, source_count).
    """
    none = F.lit(None).cast("array<long>")
    active = rows.filter(~F.col("is_forgotten") & ~F.col("is_archived") & F.col("is_latest")).withColumn("covers", none)
    own = requests.join(active, "user_id")
    relevance = F.coalesce(scores.cosine(F.col("q"), F.col("vector")), F.lit(0.5)) + F.least(F.coalesce("source_count", F.lit(1)) / 20, F.lit(0.1))
    static = own.filter("is_static").withColumn("relevance", relevance)
    parts = [_layer(static, "static", [F.desc("relevance"), F.col("id")], budget, 100 * F.col("relevance"))]

    found = hits.join(requests.select("request", "user_id"), "request").join(active, ["id", "user_id"])
    new = F.when(F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("created_at") < 48 * 3_600_000_000, 1.1).otherwise(1.0)
    parts.append(_layer(found, "semantic", [F.desc("score"), F.col("id")], budget, F.col("score") * new, raw=F.col("score")))

    line = F.concat(F.lit("v"), F.col("version"), F.lit(" ("), F.date_format("created_at", "yyyy-MM-dd"), F.lit("): "), F.coalesce("content", F.lit("")))
    roots = found.select("request", "user_id", "root_memory_id", F.col("id").alias("hit"))
    # of a chain no more versions than a text has tokens
    version = F.row_number().over(Window.partitionBy("user_id", "root_memory_id").orderBy("version", "id"))
    chain = rows.withColumn("n", version).filter(F.col("n") <= EACH).groupBy("user_id", "root_memory_id").agg(F.sort_array(F.collect_list(F.struct("version", "id", line.alias("line")))).alias("c")).filter(F.size("c") > 1)
    title = F.concat(F.lit("[Evolution of memory #"), F.col("root_memory_id"), F.lit("]\n"), F.array_join(F.transform("c", lambda x: x["line"]), "\n"))
    chained = roots.join(chain, ["user_id", "root_memory_id"]).select("request", "hit", (-F.col("root_memory_id")).alias("id"), title.alias("content"), F.lit(None).cast("array<double>").alias("vector"), F.transform("c", lambda x: x["id"]).alias("covers"))
    parts.append(_layer(chained, "evolution", [F.col("hit")], budget, F.lit(70.0), F.col("hit")))

    targets = rows.filter(~F.col("is_forgotten")).select(F.col("id").alias("target_id"), "user_id", F.struct("content", "vector").alias("t"))
    linked = roots.join(links, roots.hit == links.source_id).join(targets, ["target_id", "user_id"]).select("request", "hit", F.col("target_id").alias("id"), "t.content", "t.vector", none.alias("covers"), "similarity")
    parts.append(_layer(linked, "linked", [F.desc("similarity"), F.col("id")], budget, 50 * F.coalesce("similarity", F.lit(0.0)), F.col("hit"), ("request", "hit")))

    parts.append(_layer(own.filter("not is_static"), "recent", [F.desc("created_at"), F.desc("id")], NEWEST, F.lit(10.0)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def assembled(found: DataFrame, budget: int = BUDGET, strategy: str = "balanced", relevant: float = RELEVANT, alike: float = ALIKE) -> DataFrame:
    """(request, place, id, layer, score, tokens): each request's context in order; a chain of versions has its root's number below zero."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        chosen = choose(group, budget, strategy, relevant, alike)
        out = pd.DataFrame(chosen.rows, columns=["id", "layer", "score", "tokens"])
        out.insert(0, "place", range(1, len(out) + 1))
        out.insert(0, "request", group["request"].iloc[0])
        out["score"] = (out["score"].astype(float) * 100 + 0.5).apply(np.floor) / 100
        return out

    return found.groupBy("request").applyInPandas(run, "request long, place long, id long, layer string, score double, tokens long")
