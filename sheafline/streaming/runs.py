"""Field runs as a stateful stream: repeated and late deliveries, runs that end by a timer, restart from a checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Setting and value that transformWithState needs of a session.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
HELD = "n_events long, first_ms long, last_ms long, last_seq long, status string, completed boolean, answered boolean, repaired boolean, reviewed boolean, due_ms long"
ROWS = "run_id string, field_id string, version long, ended boolean, n_events long, first_ms long, last_ms long, status string, completed boolean, answered boolean, repaired boolean, reviewed boolean"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
FLAGS = ("completed", "answered", "repaired", "reviewed")


class FieldRun(StatefulProcessor):
    """State of one field's run. Every batch that adds events gives a row with a higher version; the timer gives the last one.

    What the state holds doesn't depend on the order of events: a count, the least and greatest time, the status of the
    greatest sequence number, and flags that only ever become true. It is a few numbers, however long the run is.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, first, last, last_seq, status, *flags, due = self.run.get() or (0, None, None, None, None, False, False, False, False, None)
        for part in rows:
            for seq, step, told, ms in zip(part["seq"].tolist(), part["step"].tolist(), part["status"].tolist(), part["ms"].tolist(), strict=True):
                n += 1
                first, last = (ms if first is None else min(first, ms)), (ms if last is None else max(last, ms))
                if last_seq is None or seq > last_seq:
                    last_seq, status = seq, told
                done = step == "field_completed"
                flags = [flags[0] or done, flags[1] or (done and told == "answered"), flags[2] or step == "repaired", flags[3] or step == "reviewed"]
        if due is not None:
            self.handle.deleteTimer(due)
        due = last + self.idle_ms
        self.handle.registerTimer(due)
        self.run.update((n, first, last, last_seq, status, *flags, due))
        yield self._row(key, n, False, first, last, status, flags)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, first, last, _, status, *flags, _ = self.run.get()
        self.run.clear()
        yield self._row(key, n, True, first, last, status, flags)

    def _row(self, key, n: int, ended: bool, first: int, last: int, status: str | None, flags: list[bool]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], key[1], n, ended, n, first, last, status, *flags)], columns=NAMES)

    def close(self) -> None:
        pass


def field_runs(events: DataFrame, idle: int = 3600, late: str = "1 hour") -> DataFrame:
    """A stream of rows of ``ROWS`` over the stream ``events(run_id, field_id, seq, step, status, ts)``, for append mode.

    A run ends when the watermark, ``late`` behind the latest event, is ``idle`` seconds past its last event; its state is gone
    then. Events later than the watermark are dropped, those without a run, field, sequence number or time, too; of
    events with the same three the first one counts, repeats are taken out in the JVM before the state is touched. An event
    of a run that has ended, but isn't late, starts the run anew. A run's events go to one task, a batch at a time.
    """
    keyed = events.where("run_id is not null and field_id is not null and seq is not null and ts is not null").withWatermark("ts", late)
    slim = keyed.select(F.col("run_id").cast("string").alias("run_id"), F.col("field_id").cast("string").alias("field_id"), F.col("seq").cast("long").alias("seq"), "step", "status", F.unix_millis("ts").alias("ms"), "ts")
    slim = slim.dropDuplicatesWithinWatermark(["run_id", "field_id", "seq"])
    return slim.groupBy("run_id", "field_id").transformWithStateInPandas(statefulProcessor=FieldRun(idle * 1000), outputStructType=ROWS, outputMode="Append", timeMode="EventTime")


def stored_runs(events: DataFrame, folder: str, idle: int = 3600, late: str = "1 hour") -> DataFrame:
    """Reads what the stream holds by now into ``<folder>/rows``, goes on from ``<folder>/progress``, returns the latest row of each run."""
    spark = events.sparkSession
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        rows = field_runs(events, idle, late)
        rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    return latest(spark.read.schema(ROWS).parquet(f"{folder}/rows"))


def latest(rows: DataFrame) -> DataFrame:
    """The row of the highest version of each run, ended if that one has. Of a run that started anew the part with more events counts."""
    rest = [n for n in NAMES if n not in ("run_id", "field_id", "version")]
    return rows.groupBy("run_id", "field_id").agg(F.max_by(F.struct(*rest), F.struct("version", "ended")).alias("r")).select("run_id", "field_id", "r.*")


def summary(runs: DataFrame) -> DataFrame:
    """The counts of ``evidence.trace_summary``, out of the runs instead of their events."""
    n = lambda f: F.count_if(f).alias(f"n_{f}")
    return runs.agg(F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"), F.count_distinct("field_id").alias("n_fields"), *[n(f) for f in FLAGS])
