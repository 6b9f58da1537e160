"""The sectors' feed: a sector is found once an event, after the events are dealt out."""

from vigil.operators import stats
from vigil.sources import threat_event

SF = "/root/testdata/sf0.001"


def test_sectors_are_found_once_after_dealing(spark):
    rows = threat_event.project(spark.read.parquet(f"{SF}/events.parquet").repartition(3))
    feed = stats.sector_feed(rows, spark)
    ranked = stats.sectors_by_count(feed)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan[plan.index("Repartition") :] and plan.count("cobalt group") == 1
    expected = sorted(((r.sector, r.n) for r in feed.collect() if r.sector != "general"), key=lambda x: (-x[1], x[0]))
    assert [(r.sector, r.n) for r in ranked.collect()] == expected
