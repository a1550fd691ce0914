"""Conversations within a length: turns are cut by priority, the first user turn never.

How much is cut of a turn depends on what was cut of those of lower priority before it, turn by turn. Only lengths go through that fold: they are
dealt by conversation, sorted by priority (Spark's sort spills), and read with one number of state, so that a conversation of any length is read in bounded memory; texts stay
where they are and meet their new lengths by conversation and turn.

Null texts are empty, null roles a user's. A conversation's turns are told apart by their number; of rows with the same number the order among them isn't defined.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a conversation, the least of a turn that is cut, and what stands where it was.
MOST, LEAST, MARK = 50_000, 200, "\n... [truncated] ...\n"
SEPARATOR = "\n\n---\n\n"


def priority(role: Column, first: Column, last_two: Column, is_error: Column | None = None) -> Column:
    """0, the first turn if a user's, is never cut; then the higher the sooner: an assistant's last, tool errors, other user turns, an assistant's others, tool results, system."""
    failed = F.lit(False) if is_error is None else F.coalesce(is_error, F.lit(False))
    kind = F.when((role == "user") & first, 0).when((role == "assistant") & last_two, 1).when((role == "tool") & failed, 2).when(role == "tool", 5).when(role == "assistant", 4).when(role == "system", 6)
    return kind.otherwise(3)


def shortened(length: int, excess: int) -> int:
    """The length of a turn's text after the cut: what is over goes, but ``LEAST`` stay, and the mark is added; the same if it isn't longer than that."""
    target = max(LEAST, length - excess)
    return length if length <= target else 2 * (target // 2) + len(MARK)


def within_length(turns: DataFrame, most: int = MOST, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", tool: str | None = None, is_error: str | None = None) -> DataFrame:
    """(conv, turn, priority, truncated, line): each turn under its label, its middle cut out where the conversation has over ``most`` characters."""
    own = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("user")).alias("role"), F.coalesce(content, F.lit("")).alias("content"),
        F.lit(None).cast("string").alias("tool") if tool is None else F.col(tool).alias("tool"), F.lit(False).alias("failed") if is_error is None else F.coalesce(is_error, F.lit(False)).alias("failed"),
    )
    # the first turn and the last two of a conversation, each found by partial aggregates
    ends = own.groupBy("conv").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.sum(F.length("content")).alias("total"))
    before = own.join(ends.select("conv", "last"), "conv").filter("turn < last").groupBy("conv").agg(F.max("turn").alias("before"))
    about = ends.join(before, "conv", "left")
    placed = own.join(about, "conv").withColumn("priority", priority(F.col("role"), F.col("turn") == F.col("first"), F.col("turn") >= F.coalesce("before", "last"), F.col("failed")))
    lengths = placed.filter(F.col("total") > most).filter("priority > 0").select("conv", "turn", "priority", F.length("content").cast("long").alias("length"), (F.col("total") - most).alias("excess"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, excess = None, 0
        for batch in batches:
            out = []
            for key, length, over in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if key != at:
                    at, excess = key, over
                new = shortened(length, excess) if excess > 0 else length
                out.append(new)
                excess -= length - new
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.int64())], ["conv", "turn", "length", "new"])

    schema = lengths.select("conv", "turn", "length", F.col("length").alias("new")).schema
    cuts = lengths.repartition("conv").sortWithinPartitions("conv", F.desc("priority"), "turn").mapInArrow(fold, schema).select("conv", "turn", "new", "length")
    found = placed.join(cuts, ["conv", "turn"], "left")
    half = ((F.col("new") - len(MARK)) / 2).cast("int")
    # in a conversation that is too long, each turn over the least length is cut: with the mark the sum stays over by some characters to the end
    cut_down = F.coalesce(F.col("length") > LEAST, F.lit(False))
    body = F.when(cut_down, F.concat(F.left("content", half), F.lit(MARK), F.right("content", half))).otherwise(F.col("content"))
    label = F.when(F.col("role") == "tool", F.concat(F.lit("[TOOL"), F.coalesce(F.concat(F.lit(": "), F.when(F.col("tool") != "", F.col("tool"))), F.lit("")), F.when(F.col("failed"), " ERROR").otherwise(""), F.lit("]")))
    label = label.otherwise(F.concat(F.lit("["), F.upper("role"), F.lit("]")))
    line = F.concat(label, F.when(cut_down, " (truncated)").otherwise(""), F.lit("\n"), body)
    return found.select("conv", "turn", "priority", cut_down.alias("truncated"), line.alias("line"))


def joined(lines: DataFrame, part: int = 1000) -> DataFrame:
    """(conv, part, text): the lines of ``part`` turn numbers each in one text, so that a long conversation is several."""
    order = F.sort_array(F.collect_list(F.struct("turn", "line")))
    return lines.groupBy("conv", F.floor(F.col("turn") / part).alias("part")).agg(F.array_join(F.transform(order, lambda x: x["line"]), SEPARATOR).alias("text"))


