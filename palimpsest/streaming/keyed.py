"""Keyed state on streams: entries with a time to live, and texts that count once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import shared_dir

DEFAULT_MINUTES, MOST_MINUTES = 30, 1440
#: Buckets that keys are dealt to, and writes that a bucket folds at once at least.
BUCKETS, FOLD = 512, 1 << 16


def _latest(rows: list[pd.DataFrame], keys: list[str]) -> pd.DataFrame:
    """Of each key the latest row; of equal times the greater order, then the one that came first."""
    return pd.concat(rows, ignore_index=True).sort_values(["_at", "_order"], ascending=False, kind="stable").drop_duplicates(keys)


def _last_writes(keys: list[str]) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Of each key of a bucket the latest write; its end, after the watermark that it was last written at, ends it. The bucket's state is one row: a packed table of its living keys."""
    columns = [*keys, "_at", "_order", "_value", "_until"]

    def step(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else None
        came, waiting, n = [], [], 0
        for rows in batches:
            if len(rows):
                waiting.append(rows[columns])
                n += len(rows)
            if n >= max(FOLD, sum(map(len, came))):
                came, waiting, n = [_latest([*came, *waiting], keys)], [], 0
        came = [_latest([*came, *waiting], keys).assign(_timer=0, _came=True)] if came or waiting else []
        rows = pd.concat([*([] if held is None else [held.assign(_came=False)]), *came], ignore_index=True)
        written = rows["_came"] | rows.duplicated(keys, keep=False)
        rows = _latest([rows.assign(_came=written)], keys)
        watermark = state.getCurrentWatermarkMs()
        # a timer lies after the watermark
        rows["_timer"] = rows["_timer"].where(~rows["_came"], (rows["_until"] // 1000).clip(lower=watermark + 1))
        live = rows["_timer"] >= watermark
        left = rows.loc[live, [*columns, "_timer"]]
        if len(left):
            table, sink = pa.Table.from_pandas(left, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(max(int(left["_timer"].min()), watermark + 1))
        elif state.exists:
            state.remove()
        said = rows.assign(live=live)[rows["_came"] | ~live].rename(columns={"_value": "value", "_at": "updated", "_until": "expires"})
        if len(said):
            yield said[[*keys, "value", "updated", "expires", "live"]]

    return step


def living(stream: DataFrame, keys: list[str], at: str = "ts", order: str = "event_id", value: str = "value", minutes: Column | None = None, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Updates (keys, value, updated, expires, live) of a stream of writes, times as microseconds.

    A write lives ``minutes`` (30 where none are given; 1 to 1440). live is false in the update that a timer sends once the watermark has passed an entry's end; state is let
    go then. Rows without a key, a time or an order take no part. Keys are dealt to ``buckets`` by their hash, as a call of Python for each key takes far longer than its rows do: about as many as keep a bucket's living
    keys within a task's memory, as a batch reads and writes the whole state of each bucket that it has rows for. State grows with the keys that live, whatever the number of writes.
    """
    lives = F.least(F.greatest(F.coalesce(F.lit(DEFAULT_MINUTES) if minutes is None else minutes, F.lit(DEFAULT_MINUTES)), F.lit(1)), F.lit(MOST_MINUTES)).cast("long")
    own = stream.filter(F.col(at).isNotNull() & F.col(order).isNotNull()).dropna(subset=keys)
    own = own.select(*keys, F.col(at).alias("_time"), F.unix_micros(at).alias("_at"), F.col(order).cast("long").alias("_order"), F.col(value).cast("double").alias("_value"), (F.unix_micros(at) + lives * 60_000_000).alias("_until"))
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*keys).schema)
    dealt = own.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    return dealt.withWatermark("_time", late).groupBy("_bucket").applyInPandasWithState(
        _last_writes(keys), f"{named}, value double, updated long, expires long, live boolean", "entries binary", "update", GroupStateTimeout.EventTimeTimeout
    )


def first_texts(stream: DataFrame, text_col: str, time_col: str, window: str) -> DataFrame:
    """Rows of a stream whose text, but for case and blanks, no row of the last ``window`` had; hashes alone are kept as state, and let go after it. Null counts as empty."""
    normal = F.trim(F.regexp_replace(F.lower(F.coalesce(text_col, F.lit(""))), r"\s+", " "))
    return stream.withColumn("fingerprint", F.sha2(normal, 256)).withWatermark(time_col, window).dropDuplicatesWithinWatermark(["fingerprint"])


def drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream sends for all that is at hand, with the number of the batch, from a table in the shared folder."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")
