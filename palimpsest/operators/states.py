"""State that evolves row by row: review folds, promotion, feedback, corrections, episodes.

A fold reads a key's rows in order after Spark's sort, which spills; one state is held, so a key of any size is read in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reviews, scores

_STATE = ("stability double", "difficulty double", "storage double", "retrieval double", "learning int", "reps int", "lapses int")


def review_states(log: DataFrame) -> DataFrame:
    """(id, stability, .., lapses): each row's state after its reviews (id, at in microseconds, grade), in order of time; rows without an id are left out."""
    names = ["id", *(s.split()[0] for s in _STATE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, last = None, None, 0
        for batch in batches:
            out = []
            for key, at, grade in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key != own:
                    if own is not None:
                        out.append((own, *state))
                    own, state, last = key, None, at
                state, last = reviews.review(state, grade, (at - last) / 86_400_000_000), at
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (own, *state)], names)

    # integers come as 32 bits
    typed = lambda parts: (b.cast(pa.schema([("id", pa.int64()), *[(s.split()[0], pa.float64() if "double" in s else pa.int32()) for s in _STATE]])) for b in run(parts))
    dealt = log.select(F.col("id").cast("long").alias("id"), "at", F.col("grade").cast("int").alias("grade")).dropna().repartition("id").sortWithinPartitions("id", "at", "grade")
    return dealt.mapInArrow(typed, "id long, " + ", ".join(_STATE))


def promoted(rows: DataFrame) -> DataFrame:
    """Rows that become permanent: read eight times, of three sources, and stable for five days."""
    return rows.filter(~F.col("is_static") & (F.col("access_count") >= 8) & (F.col("source_count") >= 3) & (F.col("fsrs_stability") >= 5))


#: What a signal adds to importance; other signals leave it. It stays within 0 and 10 at each signal.
FEEDBACK = {"helpful": 0.5, "irrelevant": -0.3}


def with_feedback(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """(id, importance): moved by each signal (id, at, signal) in order of time, and kept within 0 and 10 each time.

    Some signals in order act as one step: add, then keep within two bounds. Tasks fold runs of a row's signals to such steps, a few for
    each row however many signals it has, and the steps are applied in order.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own, step = ["id", "at", "add", "low", "high"], None, None
        for batch in batches:
            out = []
            for key, at, move in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key != own:
                    if own is not None:
                        out.append((own, *step))
                    own, step = key, (at, 0.0, float("-inf"), float("inf"))
                first, add, low, high = step
                step = (first, add + move, min(10.0, max(0.0, low + move)), min(10.0, max(0.0, high + move)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (own, *step)], names)

    move = F.create_map(*[F.lit(x) for pair in FEEDBACK.items() for x in pair])
    moves = signals.filter(F.col("signal").isin(*FEEDBACK)).select(F.col("id").cast("long").alias("id"), F.col("at").cast("long").alias("at"), F.element_at(move, F.col("signal")).alias("move")).dropna()
    steps = moves.repartitionByRange("id", "at", "move").sortWithinPartitions("id", "at", "move").mapInArrow(fold, "id long, at long, add double, low double, high double")
    each = steps.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "add", "low", "high"))).alias("steps"))
    moved = F.aggregate("steps", F.col("importance").cast("double"), lambda x, s: F.least(s["high"], F.greatest(s["low"], x + s["add"])))
    return rows.join(each, "id", "left").select("id", F.round(F.coalesce(moved, F.col("importance").cast("double")), 6).alias("importance"))


def reconsolidated(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """(id, importance, confidence): halved and two less for each correction, then moved by how often a recall hit."""
    n = corrections.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    k, total = F.coalesce("n", F.lit(0)), F.col("recall_hits") + F.col("recall_misses")
    rate = F.when(total > 3, F.col("recall_hits") / total)
    importance, confidence = F.greatest(F.lit(1.0), F.col("importance") - 2.0 * k), F.when(k > 0, F.greatest(F.lit(0.1), F.pow(F.lit(0.5), k))).otherwise(1.0)
    importance = F.when(rate > 0.7, F.least(F.lit(10.0), importance + 1)).when(rate < 0.3, F.greatest(F.lit(1.0), importance - 1)).otherwise(importance)
    confidence = F.when(rate > 0.7, F.least(F.lit(1.0), confidence + 0.1)).otherwise(confidence)
    return rows.join(n, "id", "left").select("id", importance.alias("importance"), F.round(confidence, 6).alias("confidence"))


def new_versions(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, version, is_latest, content) of the rows and their edits (id, place, content): edits follow in order of place, the last one is the latest."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("place"))
    last = edits.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    old = rows.join(last, "id", "left").select("id", F.col("version").cast("long").alias("version"), F.col("n").isNull().alias("is_latest"), "content")
    new = edits.withColumn("k", place).join(rows.select("id", "version"), "id").join(last, "id")
    return old.unionByName(new.select("id", (F.col("version") + F.col("k")).alias("version"), (F.col("k") == F.col("n")).alias("is_latest"), edits["content"]))


def commanded(rows: DataFrame, commands: DataFrame) -> DataFrame:
    """Rows after their commands (id, at, command): forget; archive, unarchive; approve, reject. Each field follows its own last command.

    A rejected row is archived too, whatever came before. A deleted row is gone, and no later command brings it back.
    """
    order = F.struct("at", "command")
    last = lambda *kinds: F.max_by("command", F.when(F.col("command").isin(*kinds), order))
    per = commands.groupBy("id").agg(
        F.bool_or(F.col("command") == "forget").alias("forgets"), F.bool_or(F.col("command") == "delete").alias("deletes"), last("archive", "unarchive", "reject").alias("place"), last("approve", "reject").alias("verdict")
    )
    status = F.when(F.col("verdict") == "approve", "approved").when(F.col("verdict") == "reject", "rejected").otherwise(F.col("status"))
    archived = F.when(F.col("place").isin("archive", "reject"), True).when(F.col("place") == "unarchive", False).otherwise(F.col("is_archived"))
    kept = rows.join(per, "id", "left").filter(~F.coalesce("deletes", F.lit(False)))
    return kept.select("id", (F.col("is_forgotten") | F.coalesce("forgets", F.lit(False))).alias("is_forgotten"), archived.alias("is_archived"), status.alias("status"))


def stored(rows: DataFrame, quotas: DataFrame, most: int) -> DataFrame:
    """(verdict, n): what becomes of new rows (id, user_id, content): empty, too large, a repeat of an earlier one, over its user's quota, or stored."""
    valid = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "empty").when(F.length("content") > most, "too_large")
    checked = rows.withColumn("verdict", valid)
    fine = checked.filter("verdict is null").withColumn("h", F.sha2(F.trim("content"), 256))
    first = fine.groupBy("user_id", "h").agg(F.min("id").alias("id")).select("user_id", "id")
    # a user's place in line: their ids in blocks, counted and summed block by block, so that no user's rows meet in one task
    block = F.floor(F.col("id") / 4096)
    sums = first.groupBy("user_id", block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("user_id").orderBy("block")) - F.col("n")
    placed = first.withColumn("block", block).withColumn("k", F.row_number().over(Window.partitionBy("user_id", "block").orderBy("id"))).join(sums.withColumn("before", before).drop("n"), ["user_id", "block"])
    within = placed.join(quotas, "user_id", "left").withColumn("over", F.coalesce(F.col("k") + F.col("before") > F.col("quota"), F.lit(False)))
    n = within.agg(F.count_if("over").alias("over_quota"), F.count_if(~F.col("over")).alias("stored")).unpivot([], ["over_quota", "stored"], "verdict", "n")
    repeats = fine.groupBy("user_id", "h").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.lit("repeat").alias("verdict"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return checked.filter("verdict is not null").groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).unionByName(n).unionByName(repeats)


def chained(rows: DataFrame, key: str, time: str, hours: int) -> DataFrame:
    """(key, chain, n, started_at): causal chains: a row follows the one before it of its key if no more than so many hours lie between."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    begun = rows.select(key, F.col(time).alias("at"), F.coalesce(at - before > hours * 3_600_000_000, F.lit(True)).cast("int").alias("new"))
    number = F.sum("new").over(Window.partitionBy(key).orderBy("at"))
    return begun.withColumn("chain", number).groupBy(key, "chain").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("started_at"))


def decay_estimate(rows: DataFrame, as_of: str) -> DataFrame:
    """(id, decay): importance times what is left of it, by the known stability or one guessed from reads and sources."""
    s = reviews.effective_stability(F.col("fsrs_stability"), F.col("access_count"), F.col("source_count"))
    days = scores.days_between(F.col("created_at"), F.lit(as_of).cast("timestamp"))
    return rows.select("id", F.round(scores.decay_score(F.col("importance"), F.col("is_static"), days, s), 6).alias("decay"))
