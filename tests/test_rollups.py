"""Roll-ups equal a recount, whatever the batches, repeats and merges."""

import pytest
from pyspark.sql import functions as F

from vigil.operators import scoring, stats
from vigil.plans import pipeline, rollups
from vigil.sources import threat_event

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    scored = scoring.service_score(threat_event.threat_events(spark, SF)).select("event_id", "event_time", "ioc_type", "ioc_value", "severity", "source_name", "threat_types", "risk_score")
    odd = [(10**9, None, None, None, None, None, None, None), (10**9 + 1, None, "ip", "", "odd", "", ["", "A"], 7)]
    schema = ", ".join(f"{n} {t}" for n, t in scored.dtypes)  # with nulls anywhere
    return scored.unionByName(spark.createDataFrame(odd, schema)).persist()


@pytest.mark.parametrize(("batches", "merge"), [(1, 16), (5, 16), (7, 2)])
def test_equal_a_recount(spark, events, tmp_path, batches, merge, monkeypatch):
    monkeypatch.setattr(rollups, "MERGE", merge)
    table = f"file://{tmp_path}/rollups"
    for i in range(batches):
        some = events.filter(F.pmod("event_id", F.lit(batches)) == i)
        for _ in range(1 + i % 2):  # a repeated batch changes nothing
            rollups.add(table, some, i)
    state = rollups.current(spark, table)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(rollups.dashboard_counts(state)) == rows(stats.dashboard_counts(events))
    assert {r for r in rows(rollups.average_risk(state)) if r[0] not in (None, "unknown")} == {r for r in rows(stats.average_risk(events)) if r[0]}
    got, expected = rollups.summary(state).first(), stats.report_summary(events.filter("severity is not null")).first()
    assert got.total == events.count() and got.critical_high == expected.critical_high
    distinct = events.select(F.xxhash64("ioc_type", "ioc_value")).distinct().count()
    assert abs(got.indicators - distinct) <= 0.03 * distinct
    assert [r.n for r in rollups.top_items(state, "threat_type", 3).collect()] == [r.n for r in stats.top_items(events, "threat_types", 3).collect()]
    if merge < batches:
        assert len(pipeline.folders(spark, f"{table}/batches")) < batches and len(pipeline.folders(spark, f"{table}/merged")) <= 2


def test_no_batches(spark, tmp_path):
    assert rollups.current(spark, f"file://{tmp_path}/none") is None
    table = f"file://{tmp_path}/empty"
    rollups.add(table, threat_event.threat_events(spark, SF).limit(0), 0)
    assert rollups.summary(rollups.current(spark, table)).first().total == 0
