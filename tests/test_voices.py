"""Nulls, empty tables and arrays of the functions on signs, stems and broken JSON."""

import datetime
import os
import pathlib

from pyspark.sql import functions as F

from palimpsest.functions import repair, signals, stems
from palimpsest.operators import people
from palimpsest.sources import parsers
from palimpsest.streaming import keyed


def test_nulls(spark):
    row = spark.range(1).select(
        signals.signals(F.lit(None).cast("string")).alias("none"), signals.signals(F.lit("I care about peace.")).alias("value"), signals.signals(F.lit("I care about peace."), weighed=False).alias("plain"),
        stems.stems(F.array(F.lit("running"), F.lit(None).cast("string"), F.lit("x2s"), F.lit("hopes"))).alias("stems"), repair.repaired_json(F.lit('x [1,')).alias("json"),
    ).first()
    assert row.none == [] and [s.subject for s in row.value] == ["peace"] and row.plain == []
    assert row.stems == ["run", None, "x2s", "hope"] and row.json == "[1]"


def test_empty_tables(spark):
    found = people.personal_signals(spark.createDataFrame([], "id long, content string")).withColumn("user_id", F.lit(1))
    assert people.profile(found).count() == people.mixed_subjects(found).count() == 0
    rows = spark.createDataFrame([], "id long, content string, created_at timestamp")
    assert people.signal_channel(found, rows, "garden", 3).count() == 0


def test_long_conversation(spark):
    turns = spark.range(25).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    parts = parsers.transcripts(turns.unionByName(turns.limit(1).withColumn("turn", F.lit(None).cast("long"))), 10).orderBy("part").collect()
    assert [(r.part, r.messages) for r in parts] == [(None, 1), (0, 10), (1, 10), (2, 5)]
    assert "\n\n".join(r.transcript for r in parts[1:]) == "\n\n".join(f"User: {i}" for i in range(25))


def test_living_entries_share_buckets(spark, tmp_path):
    """Keys of a bucket are one row of state: of each the latest write counts, and each ends by its own timer, whatever comes for the others."""
    at = lambda minute: datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(minutes=minute)
    batches = [
        [(1, at(0), 1, 5.0), (3, at(0), 1, 7.0), (2, at(0), 1, 6.0), (4, at(1), 2, None), (5, at(50), 3, 1.0), (6, at(0), None, 1.0), (7, None, 4, 1.0)],
        [(8, at(45), 3, 2.0), (9, at(49), 5, 3.0), (10, at(20), 2, 9.0)],
        [(11, at(120), 4, 4.0), (12, at(30), 2, 8.0)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/{i}")
        for file in pathlib.Path(tmp_path, str(i)).glob("*.parquet"):
            os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, value double").option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(tmp_path))
    updates = []
    put = lambda batch, n: updates.extend((n, r.user_id, r.value, r.live) for r in batch.collect())
    query = keyed.living(stream, ["user_id"], buckets=2).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    # the watermark is 12:40 from the second batch on (Spark leaves out what is late from the third on), and 13:50 after the last
    assert sorted(updates, key=str) == sorted(
        [(0, 1, 7.0, True), (0, 2, None, True), (0, 3, 1.0, True), (1, 3, 1.0, True), (1, 5, 3.0, True), (1, 1, 7.0, False), (1, 2, 9.0, True), (2, 4, 4.0, True), (3, 2, 9.0, False), (3, 3, 1.0, False), (3, 5, 3.0, False)], key=str
    )
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 2
