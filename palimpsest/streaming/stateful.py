"""Streams with several state variables and timers for each key: anchored windows, silence, review state, near copies, fan-out.

A key's rows of one micro-batch are put in order of time, then of a given order; state is a few numbers for a key (near copies: a bucket's fingerprints of the last
window), and timers let go of what the watermark has passed. State needs Spark's RocksDB store, which ``drained`` sets for the query it runs.
Rows without a key or a time take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import reviews
from ..operators import similar
from . import keyed

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# columns that a processor reads have no underscore in front: pandas' tuples would rename them


def _sorted(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable")


def _timer(handle: StatefulProcessorHandle, at_micros: int, timers: Any) -> None:
    """The key's one timer: in milliseconds, after the watermark."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(max(at_micros // 1000, timers.getCurrentWatermarkInMs() + 1))


class _AnchoredWindows(StatefulProcessor):
    """Requests of a key numbered in windows that begin with the first request after the last one's end."""

    def __init__(self, seconds: int, limit: int):
        self.micros, self.limit = seconds * 1_000_000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.window = handle, handle.getValueState("window", "began long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        began, n = self.window.get() if self.window.exists() else (None, 0)
        batch, out = _sorted(rows, "at_us", "nth"), []
        for at in batch["at_us"].tolist():
            if began is None or at - began >= self.micros:
                began, n = at, 0
            n += 1
            out.append(n)
        self.window.update((began, n))
        # a request after two windows begins a new one with or without state
        _timer(self.handle, began + 2 * self.micros, timerValues)
        yield pd.DataFrame({"key": key[0], "at": batch["at_us"].to_numpy(), "n": np.array(out, np.int64), "limited": np.array(out) > self.limit})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.window.clear()
        yield pd.DataFrame({"key": [], "at": [], "n": [], "limited": []}).astype({"key": "int64", "at": "int64", "n": "int64", "limited": "bool"})

    def close(self) -> None:
        pass


class _Silence(StatefulProcessor):
    """online with a key's first sign after a silence, stale once the watermark has passed its last sign by so much."""

    def __init__(self, seconds: int):
        self.micros = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen, self.status = handle.getValueState("seen", "at long"), handle.getValueState("status", "status string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = max(int(part["at_us"].max()) for part in rows)
        last = max(last, self.seen.get()[0]) if self.seen.exists() else last
        self.seen.update((last,))
        self.status.update(("online",))
        _timer(self.handle, last + self.micros, timerValues)
        yield pd.DataFrame([(key[0], last, "online")], columns=["key", "at", "status"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.status.update(("stale",))
        yield pd.DataFrame([(key[0], self.seen.get()[0], "stale")], columns=["key", "at", "status"])

    def close(self) -> None:
        pass


class _Reviews(StatefulProcessor):
    """The review state of a key, which grows by each review and never ends."""

    names = ("stability", "difficulty", "storage", "retrieval", "learning", "reps", "lapses")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "stability double, difficulty double, storage double, retrieval double")
        self.course = handle.getValueState("course", "learning int, reps int, lapses int")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = (*self.memory.get(), *self.course.get()) if self.memory.exists() else None
        last = self.last.get()[0] if self.last.exists() else None
        for at, grade in _sorted(rows, "at_us", "nth")[["at_us", "nth"]].itertuples(index=False):
            state = reviews.review(state, int(grade), (at - (at if last is None else last)) / 86_400_000_000)
            last = int(at)
        self.memory.update(tuple(float(x) for x in state[:4]))
        self.course.update(tuple(int(x) for x in state[4:]))
        self.last.update((last,))
        yield pd.DataFrame([(key[0], last, *state)], columns=["key", "at", *self.names])

    def close(self) -> None:
        pass


class _NearCopies(StatefulProcessor):
    """Rows of one bucket of block keys against the fingerprints that it had in the last window."""

    def __init__(self, most: int, micros: int):
        self.most, self.micros = most, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getListState("seen", "id long, bits long, at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = list(self.seen.get())
        batch = _sorted(rows, "at_us", "nth")
        new = list(zip(batch["nth"].tolist(), batch["bits"].tolist(), batch["at_us"].tolist()))
        # what is held and what comes, in one array each: a row looks at all before it
        ids, bits, ats = np.array([*held, *new], np.int64).T
        bits, out = np.ascontiguousarray(bits).view(np.uint64), []
        for k in range(len(held), len(ids)):
            distance = np.bitwise_count(bits[:k] ^ bits[k])
            near = np.flatnonzero((distance <= self.most) & (ats[:k] >= ats[k] - self.micros) & (ids[:k] != ids[k]))
            if len(near):
                best = near[np.lexsort((ids[near], ats[near], distance[near]))[0]]
                out.append((int(ids[k]), int(ids[best]), int(ats[best]), int(distance[best])))
        self.seen.appendList(new)
        _timer(self.handle, int(ats.min()) + self.micros, timerValues)
        yield pd.DataFrame(out, columns=["id", "original", "original_at", "distance"]).astype("int64")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        gone = timerValues.getCurrentWatermarkInMs() * 1000 - self.micros
        left = [row for row in self.seen.get() if row[2] > gone]
        if left:
            self.seen.put(left)
            self.handle.registerTimer(max((min(row[2] for row in left) + self.micros) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.seen.clear()
        yield pd.DataFrame([], columns=["id", "original", "original_at", "distance"]).astype("int64")

    def close(self) -> None:
        pass


def _timed(stream: DataFrame, key: str, at: str, order: str, late: str) -> DataFrame:
    own = stream.filter(F.col(at).isNotNull() & F.col(key).isNotNull() & F.col(order).isNotNull())
    return own.select(F.col(key).cast("long").alias("key"), F.col(at).alias("event_time"), F.unix_micros(at).alias("at_us"), F.col(order).cast("long").alias("nth")).withWatermark("event_time", late)


def anchored_windows(stream: DataFrame, key: str, at: str, order: str, seconds: int, limit: int, late: str = "10 minutes") -> DataFrame:
    """(key, at, n, limited): each request numbered within its window; at in microseconds."""
    rows = _timed(stream, key, at, order, late)
    return rows.groupBy("key").transformWithStateInPandas(_AnchoredWindows(seconds, limit), "key long, at long, n long, limited boolean", "Append", "EventTime")


def silences(stream: DataFrame, key: str, at: str, order: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Updates (key, at, status): a key is online with a sign, and stale when a timer finds none for so many seconds."""
    return _timed(stream, key, at, order, late).groupBy("key").transformWithStateInPandas(_Silence(seconds), "key long, at long, status string", "Update", "EventTime")


def reviewed(stream: DataFrame, key: str, at: str, grade: str, late: str = "10 minutes") -> DataFrame:
    """Updates (key, at, stability, .., lapses): a key's state after its reviews so far."""
    fields = "key long, at long, stability double, difficulty double, storage double, retrieval double, learning int, reps int, lapses int"
    return _timed(stream, key, at, grade, late).groupBy("key").transformWithStateInPandas(_Reviews(), fields, "Update", "EventTime")


def near_copies(stream: DataFrame, owner: str, at: str, id_col: str, text_col: str, hours: int, most: int = 3, buckets: int = 256, late: str = "1 hour") -> DataFrame:
    """(id, original, original_at, distance): for rows with an owner's earlier row of the last hours at most ``most`` bits away, the nearest such row of each bucket.

    Of ``most + 1`` blocks of bits one is equal in such a pair, so a row goes to one bucket for each block, by that block's bits. ``buckets`` is how many an owner has
    for each block: about as many as keep the rows of one window in a bucket within a task's memory. The least of a row's
    answers by (distance, original_at, original) counts.
    """
    rows = stream.filter(F.col(at).isNotNull() & F.col(owner).isNotNull() & F.col(id_col).isNotNull())
    named = rows.select(F.col(id_col).cast("long").alias("nth"), F.col(text_col).alias("content"), F.col(owner).cast("long").alias("owner"), F.col(at).alias("event_time"))
    prints = similar.simhash(named, "nth", "content", keep=("owner", "event_time"))
    cuts = [similar.BITS * i // (most + 1) for i in range(most + 2)]
    block = [F.shiftrightunsigned("simhash", cuts[i]).bitwiseAND((1 << (cuts[i + 1] - cuts[i])) - 1) for i in range(most + 1)]
    keys = F.array(*[F.lit(i * buckets) + F.pmod(F.xxhash64(block[i]), F.lit(buckets)) for i in range(most + 1)])
    dealt = prints.withWatermark("event_time", late).select("owner", F.explode(keys).alias("bucket"), F.col("id").alias("nth"), F.col("simhash").alias("bits"), "event_time", F.unix_micros("event_time").alias("at_us"))
    micros = hours * 3_600_000_000
    return dealt.groupBy("owner", "bucket").transformWithStateInPandas(_NearCopies(most, micros), "id long, original long, original_at long, distance long", "Append", "EventTime")


def fan_out(stream: DataFrame, subscriptions: DataFrame, channel: str, kind: str) -> DataFrame:
    """The rows of a stream for each subscriber of their channel: subscriptions (agent, channel, filter_type), of which a null filter lets all kinds through. Kinds with a line feed are rejected."""
    fine = stream.filter(~F.coalesce(F.contains(F.col(kind), F.lit("\n")), F.lit(False)))
    subs = subscriptions.select("agent", F.col("channel").alias("_channel"), "filter_type")
    return fine.join(subs, (fine[channel] == subs["_channel"]) & (subs["filter_type"].isNull() | (subs["filter_type"] == fine[kind]))).drop("_channel", "filter_type")


def drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """``keyed.drained`` with the state store that these streams need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return keyed.drained(spark, stream, mode)
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
