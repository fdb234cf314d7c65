"""Field runs as a stream: equal to the batch, repeats, restart, timers, late events."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sheafline.operators import evidence
from sheafline.streaming import runs

SCHEMA = "run_id string, field_id string, seq long, step string, status string, at long"


def events(n=12, seed=3):
    draw, out = random.Random(seed), []
    for f in range(n):
        steps = [s for s in evidence.STEPS if s not in ("repaired", "reviewed") or draw.random() < 0.5]
        if f % 5 == 0:
            steps = steps[:-1]
        start = 1_700_000_000 + f * 7
        out += [("r", f"f{f}", i, s, "answered" if f % 3 else "not_found", start + i) for i, s in enumerate(steps)]
    return out


def put(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("at")).drop("at").coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema("run_id string, field_id string, seq long, step string, status string, ts timestamp").parquet(f"{folder}/*")


def test_stream_equals_batch(spark, tmp_path):
    rows = events()
    random.Random(1).shuffle(rows)
    nulls = [(None, "f", 1, "s", "t", 1_700_000_000), ("r", "f1", None, "s", "t", 1_700_000_000), ("r", "f1", 3, "s", "t", None)]
    put(spark, tmp_path / "in", rows[:40] + rows[:10] + nulls, "a")
    runs.stored_runs(stream(spark, tmp_path / "in"), str(tmp_path / "out"))
    put(spark, tmp_path / "in", rows[35:], "b")  # a second start goes on; five events are delivered again
    got = runs.stored_runs(stream(spark, tmp_path / "in"), str(tmp_path / "out"))
    batch = spark.createDataFrame(rows, SCHEMA)
    assert tuple(runs.summary(got).first()) == tuple(evidence.trace_summary(batch).first())
    want = {r.field_id: (r.n, r.a * 1000, r.z * 1000, r.status) for r in batch.groupBy("field_id").agg(F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("z"), F.max_by("status", "seq").alias("status")).collect()}
    assert {r.field_id: (r.n_events, r.first_ms, r.last_ms, r.status) for r in got.collect()} == want
    assert got.where("ended").count() == 0


def test_timers_and_late_events(spark, tmp_path):
    day = 1_700_000_000
    put(spark, tmp_path / "in", [("r", "a", 0, "field_started", None, day), ("r", "a", 1, "field_completed", "answered", day + 5)], "a")
    runs.stored_runs(stream(spark, tmp_path / "in"), str(tmp_path / "out"), idle=60, late="10 seconds")
    put(spark, tmp_path / "in", [("r", "b", 0, "field_started", None, day + 10_000)], "b")
    runs.stored_runs(stream(spark, tmp_path / "in"), str(tmp_path / "out"), idle=60, late="10 seconds")
    put(spark, tmp_path / "in", [("r", "a", 2, "reviewed", "answered", day + 6), ("r", "b", 1, "repaired", None, day + 10_001)], "c")
    got = {r.field_id: (r.n_events, r.ended, r.completed, r.answered, r.reviewed, r.repaired) for r in runs.stored_runs(stream(spark, tmp_path / "in"), str(tmp_path / "out"), idle=60, late="10 seconds").collect()}
    assert got == {"a": (2, True, True, True, False, False), "b": (2, False, False, False, False, True)}
