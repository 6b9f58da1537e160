"""Daily counts of a table whose files are not in order of time."""

from datetime import datetime, timedelta

from vigil.streaming import incremental


def test_daily_counts_do_not_depend_on_the_order_of_files(spark, tmp_path):
    days = [datetime(2025, 1, 1) + timedelta(days=d) for d in (50, 3, 90, 0, 20, 3)]
    path = f"{tmp_path}/events.parquet"
    expected = {}
    for i, at in enumerate(days):  # one file a time, in this order
        rows = [(at + timedelta(hours=h), "ab"[h % 2]) for h in range(i + 5)]
        spark.createDataFrame(rows, "ts timestamp_ntz, event_type string").coalesce(1).write.mode("append").parquet(path)
        for ts, kind in rows:
            expected[ts.date(), kind] = expected.get((ts.date(), kind), 0) + 1
    got = incremental.daily(spark, path).collect()
    assert {(r.day, r.event_type): r.n for r in got} == expected and len(got) == len(expected)
