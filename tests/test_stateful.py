"""Streams with state against their batch twins: late rows, repeats across batches, alerts, and a restart in the middle."""

import os
from collections import Counter
from datetime import datetime, timedelta

import pytest

from vigil import dims
from vigil.operators import stats
from vigil.plans import pipeline
from vigil.sources import threat_event
from vigil.streaming import stateful

EPOCH = datetime(2024, 1, 1)


class Feed:
    """Files that a stream takes in the order in which they are added."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0
        os.makedirs(self.path, exist_ok=True)

    def add(self, rows):
        part = f"{self.path}-part{self.n}"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(part)
        name = next(x for x in os.listdir(part) if x.endswith(".parquet"))
        target = f"{self.path}/{self.n:03d}.parquet"
        os.rename(f"{part}/{name}", target)
        os.utime(target, (1_700_000_000 + self.n * 60,) * 2)
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def test_windows_with_late_rows_and_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "event_id long, ts timestamp, event_type string")
    at = lambda d, h=0: EPOCH + timedelta(days=d, hours=h)
    batches = [
        [(i, at(0, i % 24), "ab"[i % 2]) for i in range(60)] + [(60, at(1), "a"), (61, None, "a"), (62, at(0), None)],
        [(100 + i, at(1, i % 24), "a") for i in range(30)] + [(140, at(3), "b"), (141, at(0, 3), "a")],  # day 0 still open
        [(200, at(4), "b"), (201, at(2), "b")],
        [(300, at(0, 5), "a"), (301, at(0, 6), "c"), (302, at(4), "a"), (303, at(3, 1), "a")],  # day 0 was closed in the batch before
    ]
    table, checkpoint = f"file://{tmp_path}/days", f"file://{tmp_path}/checkpoint"
    for some in (batches[:2], batches[2:]):
        for rows in some:
            feed.add(rows)
        stateful.daily_windows(feed.stream(), table, checkpoint).awaitTermination()  # the second goes on from the checkpoint
    late = {r.event_id for r in stateful.late(spark, table).collect()}
    assert late == {300, 301}
    closed = {(r.day, r.event_type): r.n for r in stateful.closed(spark, table).collect()}
    last = max(t for b in batches for _, t, _ in b if t) - timedelta(days=1)
    expected = Counter((t.date(), k) for b in batches for i, t, k in b if t and i not in late and datetime(t.year, t.month, t.day) + timedelta(days=1) <= last)
    assert closed == expected and sum(closed.values()) + len(late) < sum(map(len, batches))
    feed.add([(900, at(30), "z")])  # closes all others
    stateful.daily_windows(feed.stream(), table, checkpoint).awaitTermination()
    total = sum(r.n for r in stateful.closed(spark, table).collect()) + stateful.late(spark, table).count()
    assert total == sum(t is not None for b in batches for _, t, _ in b)


def test_indicators_are_scored_once(spark, tmp_path):
    raw = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    rows = [tuple(r) for r in raw.orderBy("ts").limit(300).collect()]
    feed = Feed(spark, tmp_path / "in", raw.schema)
    warehouse, checkpoint = f"file://{tmp_path}/warehouse", f"file://{tmp_path}/checkpoint"
    batches = [rows[:120], rows[100:200], rows[:50] + rows[200:]]  # repeats in the next batch and much later
    seen, expected_reused = set(), 0
    key = {r.event_id: (r.ioc_type, r.ioc_value) for r in threat_event.project(spark.createDataFrame(rows, raw.schema)).select("event_id", *pipeline.KEY).collect()}
    for some in (batches[:1], batches[1:]):
        for b in some:
            feed.add(b)
        stateful.score_new(threat_event.project(feed.stream()), warehouse, checkpoint, dims.AS_OF, lateness="100 days").awaitTermination()
    got = pipeline.current(spark, warehouse)
    assert sorted((r.ioc_type, r.ioc_value) for r in got.collect()) == sorted(set(key.values()))
    # each was written once: nothing was scored again
    assert pipeline.parts(spark, warehouse).count() == len(set(key.values()))


def test_the_warehouse_answers_what_the_state_forgot(spark, tmp_path):
    raw = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    rows = [tuple(r) for r in raw.orderBy("ts").limit(40).collect()]
    feed = Feed(spark, tmp_path / "in", raw.schema)
    warehouse, checkpoint = f"file://{tmp_path}/warehouse", f"file://{tmp_path}/checkpoint"
    moved = lambda some, days, by: [(i + 7 * by, t + timedelta(days=days), u, k, v) for i, t, u, k, v in some]
    for b in (rows, moved(rows[:1], 60, 10**6), moved(rows[:1], 70, 2 * 10**6), moved(rows, 90, 3 * 10**6)):
        feed.add(b)
    stateful.score_new(threat_event.project(feed.stream()), warehouse, checkpoint, dims.AS_OF, lateness="1 day").awaitTermination()
    reused = spark.read.parquet(f"{warehouse}/reused")
    assert reused.count() > 0 and pipeline.parts(spark, warehouse).count() == pipeline.current(spark, warehouse).count()


@pytest.fixture
def log():
    at = lambda h: EPOCH + timedelta(hours=h)
    return [
        [("A", at(0), "open"), ("A", at(2), "acknowledged"), ("B", at(1), "resolved"), ("C", at(1), "acknowledged"), ("D", at(1), "open"), (None, at(1), "open"), ("E", None, "open"), ("F", at(1), "closed")],
        [("A", at(1), "acknowledged"), ("B", at(3), "open"), ("C", at(4), "resolved"), ("C", at(4), "resolved")],
        [("A", at(5), "open"), ("B", at(6), "acknowledged"), ("G", at(6), "open")],
    ]


def test_alerts_equal_the_replay(spark, tmp_path, log):
    feed = Feed(spark, tmp_path / "in", "alert_id string, at timestamp, status string")
    table, checkpoint = f"file://{tmp_path}/alerts", f"file://{tmp_path}/checkpoint"
    for rows in log:
        feed.add(rows)
        stateful.alert_lives(feed.stream(), table, checkpoint).awaitTermination()
    whole = spark.createDataFrame([r for b in log for r in b if r[0] and r[1]], "alert_id string, at timestamp, status string")
    found = spark.createDataFrame([(x, "open") for x in "ABCDG"], "alert_id string, status string")
    expected = {(r.alert_id, r.status, r.acknowledged_at) for r in stats.alert_transitions(found, whole).collect()}
    got = {(r.alert_id, r.status, r.acknowledged_at) for r in stateful.alert_states(spark, table).collect()}
    assert got == expected


def test_idle_alerts_are_resolved(spark, tmp_path, log):
    feed = Feed(spark, tmp_path / "in", "alert_id string, at timestamp, status string")
    table, checkpoint = f"file://{tmp_path}/alerts", f"file://{tmp_path}/checkpoint"
    for rows in [*log, [("Z", EPOCH + timedelta(days=12), "open")]]:
        feed.add(rows)
    stateful.alert_lives(feed.stream(), table, checkpoint, idle_days=7).awaitTermination()
    got = {r.alert_id: (r.status, r.cause) for r in stateful.alert_states(spark, table).collect()}
    assert got["D"] == got["A"] == ("resolved", "idle") and got["C"] == ("resolved", "log") and got["Z"] == ("open", "log")
    feed.add([("D", EPOCH + timedelta(days=13), "acknowledged")])
    stateful.alert_lives(feed.stream(), table, checkpoint, idle_days=7).awaitTermination()
    again = {r.alert_id: r for r in stateful.alert_states(spark, table).collect()}
    assert again["D"].status == "resolved" and again["D"].acknowledged_at == EPOCH + timedelta(days=13)


def test_lives_without_timers_need_no_python(spark, tmp_path, log):
    feed = Feed(spark, tmp_path / "in", "alert_id string, at timestamp, status string")
    feed.add(log[0])
    query = stateful.alert_lives(feed.stream(), f"file://{tmp_path}/alerts", f"file://{tmp_path}/checkpoint")
    query.awaitTermination()
    assert {o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]} == {"stateStoreSave"}


def test_a_stream_scores_one_event_of_each_indicator(spark, monkeypatch):
    """What a later event of the same batch replaces is neither scored nor moved."""
    from vigil import dims
    from vigil.streaming import incremental

    given, scored = [], pipeline.warehouse_rows
    monkeypatch.setattr(pipeline, "warehouse_rows", lambda rows, as_of: given.append(rows.count()) or scored(rows, as_of))
    found = incremental.incremental(spark, "/root/testdata/sf0.001/events.parquet", dims.AS_OF)
    assert given == [found.count()] and given[0] < spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
