"""The warehouse's tables, layers to fall back on, feeds, whole documents, pluggable models."""

import json

import pytest
from pyspark.sql import functions as F

from vigil.operators import export, scoring, trend
from vigil.plans import pipeline
from vigil.sources import json_events, threat_event

AS_OF = "2024-01-31 00:00:00"


@pytest.fixture(scope="module")
def events(spark):
    return threat_event.threat_events(spark, "/root/testdata/sf0.001")


def rows_of(spark, lo, hi, at):
    return spark.range(lo, hi).select(F.lit("ip").alias("ioc_type"), F.concat(F.lit("10.0.0."), "id").alias("ioc_value"), F.col("id").alias("event_id"), F.lit(at).alias("processed_at"))


def test_upserts_keep_the_last_row_of_a_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline, "COMPACT", 3)
    table = f"file://{tmp_path}/t"
    schema = "ioc_type string, ioc_value string, event_id long, processed_at int"
    assert pipeline.create(spark, table, schema) and not pipeline.create(spark, table, schema)
    assert pipeline.current(spark, table).count() == 0
    want = {}
    for version in range(8):
        batch = rows_of(spark, version * 5, version * 5 + 12, version)
        for _ in range(1 + version % 2):  # a repeated batch changes nothing
            pipeline.upsert(table, batch, version)
        want |= {f"10.0.0.{i}": version for i in range(version * 5, version * 5 + 12)}
        got = pipeline.current(spark, table).collect()
        assert {r.ioc_value: r.processed_at for r in got} == want and len(got) == len(want)
    assert pipeline.generation(spark, table)[0] >= 2
    # a batch writes itself, not the table
    sizes = [sum(f.stat().st_size for f in d.rglob("*.parquet")) for d in sorted(tmp_path.glob("t/batches-*/batch=*")) if d.name != "batch=0"]
    assert max(sizes) < 2 * min(sizes)


def test_a_row_that_can_not_be_scored_stops_no_other(spark, events, tmp_path):
    table = f"file://{tmp_path}/gold"
    bad = events.limit(3).withColumns({"event_id": F.col("event_id") + 1_000_000, "ioc_value": F.lit(None).cast("string")})
    lake = events.unionByName(bad)
    assert pipeline.run(lake, table, AS_OF, 1) == {"processed": events.count(), "failed": 3}
    assert {r.reason for r in pipeline.read(spark, f"{table}/failed").collect()} == {"no indicator"}
    assert pipeline.run(lake, table, AS_OF, 2) == {"processed": 0, "failed": 0}


def test_enrich_marks_rows_without_a_value(events):
    got = pipeline.enrich(events.withColumn("ioc_value", F.when(F.col("event_id") % 2 == 0, F.col("ioc_value"))))
    assert got.filter("event_id % 2 = 1 and severity_ai <> 'unknown'").count() == 0
    assert got.filter("event_id % 2 = 0 and severity_ai = 'unknown'").count() == 0


def test_layers_fall_back(spark, events, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "one.json").write_text(json.dumps({"events": [{"ioc": {"value": "a", "type": "ip"}}]}))
    (tmp_path / "raw" / "skip.json").write_text(json.dumps({"events": [{"ioc": {"value": "x"}}]}))
    silver, gold = tmp_path / "normalised.json", f"file://{tmp_path}/gold"
    assert json_events.read(spark, str(tmp_path / "raw"), exclude=["skip.json"]).select("ioc_value").collect()[0][0] == "a"
    name, rows = json_events.load_events(spark, gold, str(silver), str(tmp_path / "raw"))
    assert (name, rows.count()) == ("bronze", 2)
    silver.write_text(json.dumps({"meta": {}, "events": [{"ioc": {"value": v}} for v in "pqr"]}))
    name, rows = json_events.load_events(spark, gold, str(silver), str(tmp_path / "raw"), limit=2)
    assert (name, rows.count()) == ("silver", 2)
    pipeline.run(events, gold, AS_OF, 1)
    name, rows = json_events.load_events(spark, gold, str(silver), str(tmp_path / "raw"))
    assert name == "gold" and rows.count() == pipeline.current(spark, gold).count()
    assert json_events.load_events(spark, None, str(tmp_path / "no"), str(tmp_path / "none"))[0] == "none"


def test_feeds_of_sectors_predictions_and_actors(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"sectors": [{"id": "finance", "name": "F", "criticalLevel": 5}, {"id": "retail", "name": "R", "criticalLevel": 1}]}))
    (tmp_path / "l.json").write_text(json.dumps([{"id": "finance", "name": "F", "criticalLevel": 5}]))
    (tmp_path / "p.json").write_text(json.dumps({"predictions": [{"threat_type": "APT", "slope": 1.5, "direction": "increasing", "change_percent": 30.0, "alert_level": "warning"}]}))
    (tmp_path / "a.json").write_text(json.dumps({"threat_actors": [{"name": "N", "aliases": ["M"]}]}))
    assert [tuple(r) for r in json_events.sectors_feed(spark, str(tmp_path / "s.json")).collect()] == [("finance", "F", 5, 0), ("retail", "R", 1, 1)]
    assert json_events.sectors_feed(spark, str(tmp_path / "l.json")).count() == 1
    assert json_events.predictions_feed(spark, str(tmp_path / "p.json")).first().alert_level == "warning"
    assert json_events.actor_file(spark, str(tmp_path / "a.json")).first().aliases == ["M"]


def lines_of(document):
    return [r.line for r in document.orderBy("no").collect()]


def test_documents_are_whole(spark, events, tmp_path):
    rows = export.json_documents(events).join(events.select("event_id", "event_time"), "event_id")
    doc = json.loads("\n".join(lines_of(export.json_document(rows, ["event_time", "event_id"], {"source": "x"}))))
    assert doc["meta"] == {"source": "x", "total": events.count()} and len(doc["events"]) == events.count()
    doc = json.loads("\n".join(lines_of(export.stats_document(events, ["event_time", "event_id"]))))
    assert doc["stats"]["totalEvents"] == len(doc["events"]) == events.count()
    assert lines_of(export.csv_document(events))[0] == export.CSV_HEADER
    export.write_lines(export.csv_lines(events), str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).count() == events.count()
    found = export.tickets(scoring.service_score(events))
    export.write_tickets(found, str(tmp_path / "log"))
    export.write_tickets(found.limit(5), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == events.count() + 5


def test_predictions_document(events):
    found = trend.predictions(events)
    rows = export.predictions_document(found, trend.forecast(events), ("2024-01-01", "2024-01-31"), k=3).collect()
    doc = json.loads(rows[0].document)
    best = found.orderBy(F.desc(F.abs("slope")), "threat_type").limit(3).collect()
    assert len(rows) == 1 and [p["threat_type"] for p in doc["predictions"]] == [r.threat_type for r in best]
    assert doc["summary"]["total"] == found.count() and doc["meta"]["date_range"] == {"from": "2024-01-01", "to": "2024-01-31"}
    assert len(doc["forecast_chart"]) == trend.forecast(events).count()


def test_numbers_of_rows_without_a_time(spark):
    from vigil.operators.stats import number_rows

    rows = spark.range(9000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp")).when(F.col("id") % 3 == 1, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))).alias("event_time"))
    got = [r.no for r in number_rows(rows, ["event_time", "event_id"]).orderBy("event_time", "event_id").collect()]
    assert got == list(range(1, 9001))
    by_day = number_rows(rows, ["event_time", "event_id"], F.to_date("event_time"))
    worst = by_day.groupBy(F.to_date("event_time").alias("d")).agg(F.min("no").alias("a"), F.max("no").alias("b"), F.count("*").alias("n"), F.count_distinct("no").alias("k")).collect()
    assert all(r.a == 1 and r.b == r.n == r.k for r in worst)


def test_pluggable_models(spark, tmp_path):
    classify = scoring.neural_classifier(lambda texts: [[("Phishing", 0.4), ("Malware", len(t) / 10)] for t in texts], batch_size=2)
    rows = spark.createDataFrame([(i, "x" * i) for i in range(6)], "i int, t string")
    got = {r.i: r.c[0].label for r in rows.select("i", classify("t").alias("c")).collect()}
    assert got == dict.fromkeys(range(5), "Phishing") | {5: "Malware"}
    (tmp_path / "prophet.py").write_text(
        "import pandas as pd\nclass Prophet:\n    def __init__(self, **k): pass\n    def fit(self, d): self.d = d; return self\n    def make_future_dataframe(self, periods): return periods\n"
        "    def predict(self, n): m = self.d.y.iloc[-1]; return pd.DataFrame({'yhat': [m], 'yhat_lower': [m - 1], 'yhat_upper': [m + 1]})\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "prophet.py"))
    series = spark.createDataFrame([("A", "2024-01-01", 1), ("A", "2024-01-02", 9), ("B", "2024-01-01", 4), ("B", "2024-01-02", 4)], "threat_type string, day string, n long")
    assert {r.threat_type: r.direction for r in trend.prophet_forecast(series).collect()} == {"A": "increasing", "B": "stable"}
