"""Streams with state: daily windows with late rows kept apart, indicators seen once, and the life cycle of alerts.

State lies in RocksDB under the query's checkpoint; a query that is started again goes on where it stood. What a
batch gives out is written to a folder of its own, which a batch that is repeated replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans import pipeline
from ..shipping import shipped

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A window's rows are dealt to so many keys, so that a hot one is spread.
SALTS = 8
STATUSES = ["open", "acknowledged", "resolved"]
WINDOW = "late boolean, day date, event_type string, n long, event_id long, ts timestamp"
CHANGE = "alert_id string, status string, acknowledged_at timestamp, at timestamp, cause string"


def with_state(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return shipped(spark)


def moment(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class DayCount(StatefulProcessor):
    """Counts the rows of a day and type until the watermark passes the day's end. A row whose day has been given out, or would have been, is late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.n = handle.getValueState("n", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kind, end, _ = key
        if self.n.exists() or end > timerValues.getCurrentWatermarkInMs():
            self.n.update(((self.n.get()[0] if self.n.exists() else 0) + sum(map(len, rows)),))
            self.handle.registerTimer(end)
            return
        for late in rows:
            yield pd.DataFrame({"late": True, "day": moment(end - 1).date(), "event_type": kind, "n": None, "event_id": late["event_id"], "ts": pd.to_datetime(late["ms"], unit="ms")})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        kind, end, _ = key
        if self.n.exists():
            yield pd.DataFrame({"late": [False], "day": [moment(end - 1).date()], "event_type": [kind], "n": [self.n.get()[0]], "event_id": [None], "ts": [pd.NaT]})
            self.n.clear()

    def close(self) -> None:
        pass


def daily_windows(stream: DataFrame, table: str, checkpoint: str, lateness: str = "1 day"):
    """Counts the stream's rows by day and event type; a day is given out once, when the watermark passes its end.

    To `table`/closed go day, event_type and n, several rows a day and type, which add up (see `closed`); to `table`/late the
    rows that came after their day was given out. Rows of days still open are in the state. Rows without a time are left out; a
    null type is a type.
    """
    with_state(stream.sparkSession)
    ts = F.col("ts").cast("timestamp")
    day_ms = 86_400_000
    # the event time goes on as a plain number, so that Spark leaves late rows to the processor
    rows = stream.withColumn("ts", ts).filter("ts is not null").withWatermark("ts", lateness).withColumn("ms", F.unix_millis("ts"))
    rows = rows.select("event_type", ((F.floor(F.col("ms") / day_ms) + 1) * day_ms).alias("end"), F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).cast("int").alias("salt"), "event_id", "ms")
    found = rows.groupBy("event_type", "end", "salt").transformWithStateInPandas(DayCount(), WINDOW, "Append", "EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.filter("not late").select("day", "event_type", "n").write.mode("overwrite").parquet(f"{table}/closed/batch={batch_id}")
        batch.filter("late").select("day", "event_type", "event_id", "ts").write.mode("overwrite").parquet(f"{table}/late/batch={batch_id}")
        batch.unpersist()

    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed(spark: SparkSession, table: str) -> DataFrame:
    """`day`, `event_type`, `n` of the days given out so far."""
    parts = pipeline.read(spark, f"{table}/closed")
    parts = spark.createDataFrame([], "day date, event_type string, n long") if parts is None else parts
    return parts.groupBy("day", "event_type").agg(F.sum("n").alias("n"))


def late(spark: SparkSession, table: str) -> DataFrame:
    """`day`, `event_type`, `event_id`, `ts` of the rows that came too late."""
    found = pipeline.read(spark, f"{table}/late")
    return spark.createDataFrame([], "day date, event_type string, event_id long, ts timestamp") if found is None else found.drop("batch")


def score_new(events: DataFrame, warehouse: str, checkpoint: str, as_of: str, lateness: str = "1 day"):
    """Scores each indicator of a stream of threat events once: repeats within `lateness` are dropped by the state, older ones by the warehouse.

    What the warehouse had already goes to `warehouse`/reused, what can't be scored to `warehouse`/failed.
    """
    spark = with_state(events.sparkSession)
    seen_once = events.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(pipeline.KEY)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        good, bad = pipeline.split_failures(batch)
        known = pipeline.parts(spark, warehouse, before=batch_id)
        fresh = good
        if known is not None:
            keys = known.select(*pipeline.KEY).distinct()
            good.join(keys, pipeline.KEY, "left_semi").select(*pipeline.KEY, "event_id").write.mode("overwrite").parquet(f"{warehouse}/reused/batch={batch_id}")
            fresh = good.join(keys, pipeline.KEY, "left_anti")
        bad.write.mode("overwrite").parquet(f"{warehouse}/failed/batch={batch_id}")
        pipeline.upsert(warehouse, pipeline.warehouse_rows(fresh, as_of), batch_id)
        batch.unpersist()

    return seen_once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class AlertLife(StatefulProcessor):
    """One alert: its furthest status, when it was first acknowledged, and when something last happened. An alert that is not resolved closes itself after `idle_ms`."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "rank int, acknowledged long, last long")

    def changed(self, key: Any, rank: int, acknowledged: int | None, at: int, cause: str) -> pd.DataFrame:
        stamp = pd.NaT if acknowledged is None else moment(acknowledged)
        return pd.DataFrame({"alert_id": [key[0]], "status": [STATUSES[rank]], "acknowledged_at": [stamp], "at": [moment(at)], "cause": [cause]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        rank, acknowledged, last = self.life.get() if self.life.exists() else (-1, None, 0)
        before, steps = (rank, acknowledged), pd.concat(list(rows))
        for at, status in sorted(zip(steps["ms"].tolist(), steps["status"], strict=True)):
            step = STATUSES.index(status)
            if step == 1:  # the earliest counts, in whatever order they come
                acknowledged = at if acknowledged is None else min(acknowledged, at)
            rank, last = max(rank, step), max(last, at)
        self.life.update((rank, acknowledged, last))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if rank < 2:
            self.handle.registerTimer(last + self.idle_ms)
        if (rank, acknowledged) != before:
            yield self.changed(key, rank, acknowledged, last, "log")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        rank, acknowledged, _ = self.life.get()
        if rank < 2:
            at = expiredTimerInfo.getExpiryTimeInMs()
            self.life.update((2, acknowledged, at))
            yield self.changed(key, 2, acknowledged, at, "idle")

    def close(self) -> None:
        pass


def alert_lives(log: DataFrame, table: str, checkpoint: str, idle_days: int | None = None, lateness: str = "1 day"):
    """Follows a stream of (alert_id, at, status): where alerts stand after a batch that touched them goes to `table`. Steps only go forward, and an alert without a step for `idle_days` is resolved.

    Without `idle_days` a life is two extremes, which Spark's own streaming aggregation keeps; timers need the processor,
    which works on one alert at a time. The two keep different state, so each needs a checkpoint of its own.

    Steps of an unknown status, or without an alert or a time, are left out. Late steps count; one that comes after
    its alert was closed as idle changes no more than the time of acknowledgement.
    """
    with_state(log.sparkSession)
    rows = log.filter(F.col("status").isin(STATUSES)).filter("alert_id is not null and at is not null").withColumns({"alert_id": F.col("alert_id").cast("string"), "at": F.col("at").cast("timestamp")})
    # the processor has milliseconds
    ms = F.unix_millis("at")
    if idle_days is None:
        rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
        lives = rows.groupBy("alert_id").agg(F.max(rank).alias("rank"), F.min(F.when(F.col("status") == STATUSES[1], ms)).alias("acknowledged"), F.max(ms).alias("last"))
        status = F.get(F.array(*map(F.lit, STATUSES)), F.col("rank").cast("int") - 1)
        found = lives.select("alert_id", status.alias("status"), F.timestamp_millis("acknowledged").alias("acknowledged_at"), F.timestamp_millis("last").alias("at"), F.lit("log").alias("cause"))
    else:
        rows = rows.withWatermark("at", lateness).select("alert_id", "status", ms.alias("ms"))
        found = rows.groupBy("alert_id").transformWithStateInPandas(AlertLife(idle_days * 86_400_000), CHANGE, "Append", "EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return found.writeStream.outputMode("update" if idle_days is None else "append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alert_states(spark: SparkSession, table: str) -> DataFrame:
    """`alert_id`, `status`, `acknowledged_at`, `cause` of each alert after all its changes."""
    changes = pipeline.read(spark, table)
    changes = spark.createDataFrame([], CHANGE) if changes is None else changes
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    last = F.max_by(F.struct("status", "cause"), F.struct(rank, F.col("cause") == "log")).alias("l")
    return changes.groupBy("alert_id").agg(last, F.min("acknowledged_at").alias("acknowledged_at")).select("alert_id", "l.status", "acknowledged_at", "l.cause")
