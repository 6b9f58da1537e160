"""Bucketed tables: what an upsert leaves, and that reads and joins shuffle the batch alone."""

import random

from pyspark.sql import functions as F

from vigil.plans import buckets, pipeline

SCHEMA = "ioc_type string, ioc_value string, event_id long, processed_at timestamp"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "ioc_type string, ioc_value string, event_id long, at long").select("ioc_type", "ioc_value", "event_id", F.timestamp_seconds("at").alias("processed_at"))


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_upserts_equal_the_last_of_each_key(spark, tmp_path):
    rng, folder, every = random.Random(4), f"file://{tmp_path}/table", []
    assert buckets.open_table(spark, folder) is None
    for version in range(5):
        batch = [("ip" if rng.random() < 0.5 else "url", f"v{rng.randrange(60)}", rng.randrange(10**6), rng.randrange(1000)) for _ in range(80)] + [(None, "x", 1, 1), ("ip", None, 1, 1), ("md5", "late", version, 50 - version)]
        every += batch
        for _ in range(1 + version % 2):
            buckets.upsert(rows_of(spark, batch), folder)
    expected = {}
    for t, v, i, at in every:
        if t and v:
            expected[t, v] = max(expected.get((t, v), (-1, -1)), (at, i))
    found = buckets.open_table(spark, folder).select("ioc_type", "ioc_value", F.unix_seconds("processed_at").alias("at"), "event_id").collect()
    assert {(r.ioc_type, r.ioc_value): (r.at, r.event_id) for r in found} == expected and len(found) == len(expected)
    assert len(buckets.generations(spark, folder)) == 2 and sum(x.startswith("rows-") for x in pipeline.folders(spark, folder)) == 2


def test_a_new_session_takes_the_table_up(spark, tmp_path):
    folder = f"file://{tmp_path}/table"
    buckets.upsert(rows_of(spark, [("ip", "a", 1, 1)]), folder)
    spark.sql(f"drop table {buckets._name(folder, 0)}")
    assert buckets.open_table(spark, folder).first().ioc_value == "a"
    buckets.upsert(rows_of(spark, [("ip", "b", 2, 2)]).withColumn("extra", F.lit(7)), folder)
    assert sorted(map(tuple, buckets.open_table(spark, folder).select("ioc_value", "extra").collect())) == [("a", None), ("b", 7)]


def test_the_table_is_not_shuffled(spark, tmp_path):
    folders = [f"file://{tmp_path}/{n}" for n in "ab"]
    for k, folder in enumerate(folders):
        buckets.upsert(rows_of(spark, [("ip", f"v{i}", i, i) for i in range(k, 400, 2 - k)]), folder)
    a, b = (buckets.open_table(spark, f) for f in folders)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(a.join(b, pipeline.KEY)) and "Exchange" not in plan(a.join(b, pipeline.KEY, "left_anti"))
        assert "Exchange" not in plan(a.groupBy(*pipeline.KEY).agg(F.max("event_id")))
        batch = rows_of(spark, [("ip", f"v{i}", i, i) for i in range(500)])
        left = buckets.unknown(batch, folders[0])
        assert left.count() == 300 and plan(left).count("Exchange hashpartitioning") == 1
        merged = buckets._merged(a, pipeline.latest(batch).repartition(buckets.BUCKETS, *pipeline.KEY), pipeline.KEY, ["processed_at", "event_id"])
        text = plan(merged)
        assert not any("Exchange" in line and "FileScan" in following for line, following in zip(text.split("\n"), text.split("\n")[1:]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
