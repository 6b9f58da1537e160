"""Values published with the feeds: trends, forecasts, sectors."""

from pyspark.sql import functions as F

from vigil.functions import scores as S
from vigil.functions import text as T
from vigil.operators import stats, trend

DAYS = ["2025-11-13", "2025-11-14", "2025-11-15", "2025-11-16", "2026-01-05", "2026-01-23"]
# Threat type -> counts by day; slope, confidence, average, prediction, change.
SERIES = {
    "Vulnerability": ([4, 151, 37, 6, 171, 241], (34.686, 0.425, 101.7, 431.2, 238.8)), "Data Breach": ([4, 44, 22, 0, 108, 131], (23.0, 0.603, 51.5, 270.0, 312.6)),
    "Other": ([3, 35, 12, 6, 0, 170], (20.686, 0.343, 37.7, 234.2, 384.4)), "APT": ([0, 1, 3, 0, 0, 79], (11.114, 0.424, 13.8, 119.4, 562.4)),
    "Defacement": ([3, 86, 27, 6, 139, 26], (7.229, 0.063, 47.8, 116.5, 105.8)),
}
# Threat type -> counts by day; the seven days after.
FORECASTS = {
    "Vulnerability": ([4, 151, 37, 6, 171, 241], [310, 345, 379, 414, 449, 483, 518]), "Data Breach": ([4, 44, 22, 0, 108, 131], [190, 212, 236, 258, 282, 304, 328]),
    "Defacement": ([3, 86, 27, 6, 139, 26], [91, 98, 106, 113, 120, 127, 135]), "Other": ([3, 35, 12, 6, 0, 170], [162, 183, 203, 224, 245, 265, 286]), "Malware": ([1, 53, 30, 3, 28, 60], [62, 68, 73, 79, 84, 90, 95]),
}
# Sector feed, id and level.
SECTORS = [("finance", 5), ("government", 4), ("healthcare", 3), ("energy", 4), ("telecom", 3), ("education", 2), ("retail", 2), ("transportation", 1)]


def events_of(spark, series):
    rows = [(f"{d} 08:00:00", [name]) for name, counts in series.items() for d, n in zip(DAYS, counts, strict=True) for _ in range(n)]
    return spark.createDataFrame(rows, "event_time string, threat_types array<string>").withColumn("event_time", F.col("event_time").cast("timestamp"))


def test_trends(spark):
    got = {r.threat_type: (r.slope, r.confidence, r.current_avg, r.prediction_7d, r.change_percent) for r in trend.predictions(events_of(spark, {k: v[0] for k, v in SERIES.items()})).collect()}
    assert got == {k: v[1] for k, v in SERIES.items()}


def test_forecasts(spark):
    found = trend.forecast(events_of(spark, {k: v[0] for k, v in FORECASTS.items()}), from_last=True)
    got = {}
    for r in found.orderBy("threat_type", "day").collect():
        if r.segment == "forecast":
            got.setdefault(r.threat_type, []).append(int(r.value))
            assert r.lower <= r.value <= r.upper
    assert got == {k: v[1] for k, v in FORECASTS.items()}


def test_one_day_is_no_trend(spark):
    series = spark.createDataFrame([("Phishing", "2024-01-01", 0, 7)], "threat_type string, day string, x int, n long")
    r = trend.regression(series).first()
    assert (r.direction, r.slope, r.confidence, r.prediction_7d, r.prediction_lower, r.prediction_upper, r.confidence_interval, r.sufficient) == ("stable", 0.0, 0.0, 7.0, 7.0, 7.0, 0.0, False)


def test_sector_feed(spark):
    feed = spark.createDataFrame([(i, x, i, level) for i, (x, level) in enumerate(SECTORS)], "n int, id string, ordinal int, criticalLevel int")
    r = stats.national_level(feed).first()
    assert (r.score, r.affected, r.total, r.top_sector, r.level) == (400, 5, 8, "finance", "critical")
    assert stats.sector_feed(None, spark).count() == 0


def test_sector_cases(spark):
    rows = [
        ("Ransomware attack targeting Thai banks and financial institutions", "Lazarus Group targets SWIFT networks", "malware.payment-gateway.com", "domain", ["Lazarus"], ["banking", "cryptocurrency"]),
        ("APT28 targets government ministry email servers", "Russian hackers breach Thai government", "update.go.th.malicious.com", "domain", ["APT28"], ["government", "espionage"]),
        ("Generic phishing campaign", "Phishing emails detected", "192.168.1.1", "ip", [], ["phishing"]),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d string, t string, v string, k string, a array<string>, g array<string>")
    best = S.sector_match(F.col("d"), F.col("v"), F.col("k"), F.col("a"), F.col("t"), F.col("g"))
    got = [r.sector for r in df.withColumn("b", best).select("i", S.sector_result(F.col("b")).alias("r")).select("i", "r.sector").orderBy("i").collect()]
    assert got == ["financial", "government", "general"]


def test_instants_with_offsets(spark):
    rows = [("2024-01-05T10:00:00Z",), ("2024-01-05T12:00:00+02:00",), ("2024-01-05 10:00:00",), ("2024-01-05",)]
    got = [str(r.t) for r in spark.createDataFrame(rows, "x string").select(F.date_format(T.timestamp(F.col("x")), "yyyy-MM-dd HH:mm").alias("t")).collect()]
    assert got == ["2024-01-05 10:00"] * 3 + ["2024-01-05 00:00"]
