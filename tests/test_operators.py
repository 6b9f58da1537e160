"""Rules at their boundaries on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from vigil.functions import scores as S
from vigil.functions import text as T
from vigil.operators import export, graph, scoring, stats, trend
from vigil.plans import pipeline
from vigil.sources import json_events, pages, threat_event


def values(spark, column, rows, schema="x int"):
    return [r.y for r in spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}").select("i", column.alias("y")).orderBy("i").collect()]


def test_points_at_their_thresholds(spark):
    x = F.col("x")
    assert values(spark, S.domain_age(x, F.lit("domain")), [29, 30, 89, 90, 179, 180, 364, 365, None]) == [20, 15, 15, 10, 10, 5, 5, 0, 0]
    assert values(spark, S.domain_age(x, F.lit("ip")), [1]) == [0]
    assert values(spark, S.normalized(x), [99, 100, 101, 150, 199, 200, 201]) == [99, 100, 70, 85, 99, 100, 100]
    assert values(spark, S.decayed(F.lit(100), x), [7, 8, 30, 31, 90, 91, 180, 181, None]) == [100, 90, 90, 75, 75, 60, 60, 50, 100]
    assert values(spark, S.confidence_bonus(x), [0.59, 0.6, 0.79, 0.8, 0.89, 0.9, None], "x double") == [0, 3, 3, 7, 7, 10, 0]
    assert values(spark, T.service_band(x), [75, 74, 50, 49, 25, 24, 1, 0]) == ["critical", "high", "high", "medium", "medium", "low", "low", "clean"]
    assert values(spark, T.dashboard_band(x), [45, 44, 30, 29, 15, 14, 6, 5]) == ["critical", "high", "high", "medium", "medium", "low", "low", "clean"]


def test_sources_types_actors_and_tactics(spark):
    x, arrays = F.col("x"), "x array<string>"
    names = [[f"s{i}" for i in range(n)] for n in range(7)]
    assert values(spark, S.cross_source(x), [*names, None], arrays) == [0, 5, 15, 25, 35, 40, 40, 0]
    assert values(spark, S.source_quality(x), [["VirusTotal", "virustotal", "Dark", "DarkReading"], ["AbuseIPDB"] * 3, []], arrays) == [40, 40, 0]
    assert values(spark, S.threat_type(x), [["APT", "Botnet", "Spam"], ["Strange"], ["Phishing", "Spam", "Other"], [], None], arrays) == [35, 3, 25, 0, 0]
    assert values(spark, S.threat_type_level(x), [["Spam", "APT"], ["Strange"], []], arrays) == [1, 5, 5]
    assert values(spark, S.actor(x), [["Play", "Winnti"], ["Nobody"], [], ["GhostSec"]], arrays) == [30, 15, 0, 14]
    tactics = S.tactics_of(x)
    assert values(spark, S.mitre(tactics), [["Impact via T1486", "TA0040", "T1190"], ["T1", "T2"], ["Impact", "TA0008", "Discovery", "TA0001"], []], arrays) == [11, 6, 20, 0]
    assert values(spark, S.sophistication(tactics), [["Impact", "TA0008", "Discovery"], ["T1"], ["TA0001"]], arrays) == ["intermediate", "none", "basic"]


def test_sector_ties_and_float_sums(spark):
    rows = [("bank payment credit", ""), ("hospital bank", ""), ("nothing here", "x.gov.example"), ("plain", "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, v string").withColumn("b", S.sector_match(F.col("t"), F.col("v"), F.lit("domain"), F.array(F.lit("Nobody"))))
    got = [tuple(r.r) for r in df.select("i", S.sector_result(F.col("b")).alias("r")).orderBy("i").collect()]
    assert got == [("financial", 0.3, 10), ("financial", 0.1, 10), ("government", 0.15, 12), ("general", 0.0, 0)]


def test_text_functions(spark):
    x = F.col("x")
    assert values(spark, T.ioc_type(x), ["CVE-2024-1", "a" * 64, "b" * 40, "c" * 32, "1.2.3.4", "https://x", "x.org"], "x string") == ["cve", "sha256", "sha1", "md5", "ip", "url", "domain"]
    assert values(spark, T.severity(x), [" Very High", "INFO", "", None, "odd", "High "], "x string") == ["critical", "clean", "low", "low", "low", "high"]
    assert values(spark, T.mitre_techniques(x), ["t1566.001 T1566 xT1234 T12345", None], "x string") == [["T1566.001", "T1566"], []]
    assert values(spark, T.threat_actors(x), ["ALPHV and fancy bear", "", None], "x string") == [["APT28", "BlackCat"], [], []]
    assert values(spark, T.title_from_url(x), ["https://a.org/x/big_news-now.html", "https://a.org/x/index.php", "https://a.org", None], "x string") == ["Big News Now", "X", "Untitled Article", "Untitled Article"]
    assert values(spark, T.clean_text(x, 10), [" a  b ", "aaaa bbbb cccc", "aaaaaaaaaaaa", None], "x string") == ["a b", "aaaa bbbb...", "aaaaaaaaaa...", None]
    assert values(spark, T.entropy_service(x), ["aabb.org", "", None, "a-b.c"], "x string") == [1.0, 0.0, 0.0, 1.0]
    assert values(spark, T.date_or_raw(x), ["05/01/2024", "soon", ""], "x string") == ["2024-01-05T00:00:00", "soon", "2024-01-31T00:00:00"]


def test_trends_match_a_known_series(spark):
    days = [(f"2024-01-{d:02}", n) for d, n in enumerate([4, 151, 37, 6, 171, 241], 1)]
    series = spark.createDataFrame([("Vulnerability", d, i, n) for i, (d, n) in enumerate(days)] + [("Flat", d, i, 5) for i, (d, _) in enumerate(days)], "threat_type string, day string, x int, n long")
    got = {r.threat_type: r for r in trend.regression(series).collect()}
    v = got["Vulnerability"]
    assert (v.slope, v.confidence, v.current_avg, v.prediction_7d, v.change_percent, v.direction) == (34.686, 0.425, 101.7, 431.2, 238.8, "increasing")
    assert (got["Flat"].confidence, got["Flat"].direction) == (0.0, "stable")


def test_rising_days_increase(spark):
    rows = [(f"2024-01-{d:02} 10:00:00", ["Malware"]) for d in range(1, 15) for _ in range(d + 4)]
    events = spark.createDataFrame(rows, "event_time string, threat_types array<string>").withColumn("event_time", F.col("event_time").cast("timestamp"))
    assert trend.predictions(events).first().direction == "increasing"
    assert trend.forecast(events, k=1).filter("segment = 'forecast'").count() == 7


SHAPES = {
    "a.json": {"hits": {"hits": [{"_source": {"ioc": {"value": "a", "type": "ip", "related_hash": ""}, "confidence": ""}}]}},
    "b.json": {"hits": [{"_source": {"ioc": {"value": "b"}}}, {"ioc": {"value": "b2", "related_domain": "one.org"}}]},
    "c.json": {"events": [{"ioc": {"value": "c"}, "severity": "", "confidence": 250}]},
    "d.json": {"data": [{"ioc": {"value": "d"}}, {"ioc": {}}]},
    "e.json": {"ioc": {"value": "e"}},
    "f.json": [{"ioc": {"value": "f"}, "enrichment": {"file": {"size": "2 MB (2097152 bytes)"}, "whois": {"country": "DE"}}}],
    "g.json": {"hits": {"hits": [{"fields": {"ioc.value": ["g"], "ioc.type": ["md5"], "source_name": ["S"]}}]}},
}


def test_json_shapes_and_quarantine(spark, tmp_path):
    for name, doc in SHAPES.items():
        (tmp_path / name).write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{nope")
    split = json_events.split_events(json_events.raw_files(spark, str(tmp_path)))
    got = {r.ioc_value: r for r in json_events.threat_events(split).collect()}
    assert set(got) == {"a", "b", "b2", "c", "d", "e", "f", "g"}
    assert (got["a"].related_hashes, got["a"].confidence, got["b2"].related_domains) == ([], 0, ["one.org"])
    assert (got["c"].confidence, got["c"].severity, got["f"].file_bytes, got["g"].ioc_type) == (100, "low", 2097152, "md5")
    assert {r.file for r in json_events.quarantine(split).collect()} == {"bad.json", "d.json"}


def test_page_summaries(spark):
    html = [("<title>T &amp; x</title><meta name='description' content='A long enough description'>",), ("<h1>Head <b>line</b></h1><p>First para</p>",), (None,)]
    got = pages.summaries(spark.createDataFrame([(i, "u", *h) for i, h in enumerate(html)], "page_id int, url string, html string")).orderBy("page_id").collect()
    assert [(r.description, r.success) for r in got] == [("A long enough description", True), ("Head line - First para", True), (None, False)]


def test_articles_of_pages(spark):
    html = ["<title>T</title><body><div class='x post-content y'>Text <script>no</script>here &amp; there</div>rest</body>", "<main><nav>menu</nav>In main</main><article>  </article>", "<body><p>Only</p> body<footer>f</footer></body>", None, "bare"]
    got = pages.articles(spark.createDataFrame(list(enumerate(html)), "page_id int, html string")).orderBy("page_id").collect()
    assert [r.content for r in got] == ["Text here & there", "In main", "Only body", "", "bare"] and got[0].title == "T"


@pytest.fixture(scope="module")
def events(spark):
    return threat_event.threat_events(spark, "/root/testdata/sf0.001")


def test_properties_of_scores(events):
    scored = scoring.service_score(events).agg(F.min("risk_score").alias("a"), F.max("risk_score").alias("b"), F.count_if(F.col("severity_ai") != T.service_band(F.col("risk_score"))).alias("odd")).first()
    assert 0 <= scored.a and scored.b <= 100 and scored.odd == 0
    d = stats.severity_distribution(events).first()
    assert sum(d) == events.count()


def test_graph_links_have_nodes(events):
    nodes, links = graph.nodes(events), graph.links(events)
    ends = links.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    assert ends.join(nodes, "id", "left_anti").count() == 0
    assert nodes.count() == nodes.select("id").distinct().count()


def test_numbers_have_no_gaps(events):
    nos = [r.no for r in stats.number_rows(events.select("event_id", "event_time"), ["event_time", "event_id"]).orderBy("event_time", "event_id").collect()]
    assert nos == list(range(1, len(nos) + 1))
    assert export.suricata(events).filter("rule is null").count() == 0


def test_pipeline_runs_once_over_each_event(spark, events, tmp_path):
    table = f"file://{tmp_path}/gold"
    assert pipeline.run(events, table, "2024-01-31 00:00:00", 1, limit=400)["processed"] == 400
    assert pipeline.run(events, table, "2024-01-31 00:00:00", 2)["processed"] == events.count() - 400
    assert pipeline.run(events, table, "2024-01-31 00:00:00", 3)["processed"] == 0
    assert pipeline.status(spark, events, table)["warehouse"] == events.select("ioc_type", "ioc_value").distinct().count()


def test_analyzed_verdicts(spark):
    rows = spark.createDataFrame([(1, '{"aiScore": 140, "severity": " HIGH", "confidence": -5, "threatCategory": "", "recommendedActions": ["block"]}'), (2, "{}"), (3, "no json"), (4, None)], "i int, j string")
    got = {r.i: r.verdict for r in scoring.analyzed(rows, "j").collect()}
    assert (got[1].score, got[1].severity, got[1].confidence, got[1].category, got[1].actions) == (100.0, "high", 0.0, "other", ["block"])
    assert (got[2].score, got[2].severity, got[2].confidence, got[2].actors, got[2].summary) == (0.0, "clean", 50.0, [], "")
    assert got[3] is None and got[4] is None


@pytest.mark.parametrize("column", [
    lambda x: S.sector_match(x, F.lit("v"), F.lit("ip"), T.literals([]), F.lit("title"), T.literals([])), lambda x: S.keywords(x), lambda x: T.keyword_hits(x), lambda x: T.threat_actors(x),
    lambda x: T.threat_actors_simple(x), lambda x: T.contains_any(x, ["a", "b", "c", "d"]), lambda x: T.entropy(x),
])
def test_a_text_is_computed_once_for_all_words(spark, column):
    """What stands inside a lambda is computed for each of its elements."""
    said = str(column(F.upper(F.lit("the marker"))))
    assert said.count("the marker") == 1 and "array(" in said[: said.index("the marker")]


def test_events_are_dealt_evenly(spark, tmp_path, monkeypatch):
    """One row group lies in one task, however many splits the file has; a large table makes more tasks, not longer ones."""
    spark.range(4000).coalesce(1).write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(threat_event, "TASK_ROWS", 100)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        rows = spark.read.parquet(f"{tmp_path}/t")
        parts = threat_event.dealt(rows).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sum(r["count"] for r in parts) == 4000 and max(r["count"] for r in parts) <= 200
