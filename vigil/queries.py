"""Registry of the engine's queries: each takes (spark, sf_dir). Their oracles are in `oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims
from .functions import scores as S
from .functions import text as T
from .operators import bayes, breakdown, dictionary, export, forecast, graph, scoring, search, stats, textindex, trend
from .oracles import ORACLES  # noqa: F401
from .sources import json_events, pages, threat_event
from .plans import buckets, pipeline, rollups
from .storage import shared_dir
from .streaming import incremental, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Dictionary of words that occur in the synthetic documents.
WORDS = ["the", "tion", "er", "und", "que", "los", "heit", "zzz"]

#: Words for the ranked searches, and a phrase for the search by trigrams.
RANKED = ["ransomware portal bank", "APT"]
DOCUMENT_QUERY = "The worthless; entre la thention und"
PHRASE = "GNU general"


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


events = threat_event.threat_events


def joined(c: str, sep: str = ","):
    return F.array_join(F.col(c), sep).alias(c)


def at(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def day(c: str = "day"):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


# Scorers


@query
def risk_score_flagship(spark, sf_dir):
    out = scoring.service_score(events(spark, sf_dir))
    top = F.array_join(F.transform("top_factors", lambda x: F.concat_ws(":", x["factor"], x["score"].cast("string"))), ",")
    return out.select("event_id", *S.FACTORS, "traditional_score", "ai_score", "original_score", "decayed_score", "sector", "sector_confidence", "sector_bonus", "risk_score", F.col("severity_ai").alias("severity"), top.alias("top_factors"), "has_actor", "has_mitre", "primary_threat")


@query
def risk_score_grouped(spark, sf_dir):
    out = scoring.grouped_score(events(spark, sf_dir))
    return out.select("ioc_type", "ioc_value", "n_events", joined("sources"), at("first_seen"), at("last_seen"), "cross_source", "threat_type", "type_specific", "entropy", "keywords", "source_severity", "risk_score", "severity")


@query
def risk_score_typed(spark, sf_dir):
    return scoring.typed_score(events(spark, sf_dir))


@query
def risk_score_legacy(spark, sf_dir):
    return scoring.legacy_score(events(spark, sf_dir))


@query
def confidence_calc(spark, sf_dir):
    out = scoring.indicator_profile(events(spark, sf_dir))
    return out.select("ioc_type", "ioc_value", "n_events", "n_sources", "max_severity", "confidence")


@query
def first_last_seen(spark, sf_dir):
    return scoring.indicator_profile(events(spark, sf_dir)).select("ioc_type", "ioc_value", at("first_seen"), at("last_seen"), "n_sources")


@query
def cross_source_boost(spark, sf_dir):
    scored = scoring.service_score(events(spark, sf_dir)).select("event_id", *scoring.KEY, "source_name", "risk_score")
    return scoring.cross_source_boost(scored).select("event_id", "seen_in", "boosted")


@query
def cross_source(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", S.cross_source(F.col("sources")).alias("points"))


@query
def source_quality(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", S.source_quality(F.col("sources")).alias("points"), T.source_tier(F.col("source_name")).alias("tier"), T.source_class(F.col("source_name")).alias("class"))


@query
def threat_type_score(spark, sf_dir):
    types = F.col("threat_types")
    return events(spark, sf_dir).select("event_id", S.threat_type(types).alias("points"), S.threat_type_level(types).alias("level"))


@query
def actor_score(spark, sf_dir):
    points = S.actor(F.col("actors"))
    return events(spark, sf_dir).select("event_id", points.alias("points"), S.attribution(points).alias("attribution"))


@query
def mitre_score(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("tactics", S.tactics_of(F.col("techniques")))
    return e.select("event_id", S.mitre(F.col("tactics")).alias("points"), S.sophistication(F.col("tactics")).alias("sophistication"))


@query
def confidence_bonus(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", S.confidence_bonus(F.col("ai_confidence")).alias("points"))


@query
def domain_age_score(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", S.domain_age(F.col("domain_age_days"), F.col("ioc_type")).alias("points"))


@query
def decay(spark, sf_dir):
    days = F.col("ioc_age_days")
    return events(spark, sf_dir).select("event_id", S.decay_factor(days).alias("factor"), S.decayed(F.lit(100), days).alias("points"))


@query
def classify_lexicon(spark, sf_dir):
    out = scoring.classify_lexicon(events(spark, sf_dir))
    return out.select("event_id", joined("predicted_types"), "predicted_confidence")


@query
def classify_trained(spark, sf_dir):
    """Naive Bayes over the descriptions, learned from three quarters of the events by their first type."""
    e = events(spark, sf_dir).select("event_id", "description", F.get("threat_types", F.lit(0)).alias("label"))
    model = bayes.train(e.filter("event_id % 4 <> 2"), "description", "label")
    return bayes.classify(e, model, "event_id", "description")


@query
def documents_classified(spark, sf_dir):
    """Naive Bayes over whole documents, learned from the languages of three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return bayes.classify(docs, bayes.train(docs.filter("doc_id % 4 <> 2"), "text", "lang"), "doc_id", "text")


@query
def classify_activity(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "cyberint-feeds-1").otherwise("other").alias("source_index"), threat_event.pick([*dims.ACTIVITIES, "Strange Thing", "Credential Theft", ""], F.col("event_id") % 20).alias("detected_activity"))
    return scoring.classify_activity(e).select("event_id", joined("rule_types"), "rule_confidence")


@query
def analysis_verdicts(spark, sf_dir):
    """Analyses as a language model gives them, made from the events' own values."""
    said = F.to_json(F.struct(F.col("severity_raw").alias("severity"), (F.col("confidence_raw") * 2 - 50).alias("confidence"), F.col("actors").alias("threatActors"), F.when(F.col("event_id") % 2 == 0, "phishing").alias("threatCategory"), (F.col("confidence_raw") + 40).alias("aiScore")))
    e = scoring.analyzed(events(spark, sf_dir).withColumn("said", F.when(F.col("event_id") % 7 == 0, "no answer").otherwise(said)), "said")
    return e.select("event_id", "verdict.severity", "verdict.confidence", F.size("verdict.actors").alias("n_actors"), "verdict.category", "verdict.score")


# Sectors


@query
def sector_best(spark, sf_dir):
    best = S.sector_match(F.col("description"), F.col("ioc_value"), F.col("ioc_type"), F.col("actors"))
    return events(spark, sf_dir).withColumn("best", best).select("event_id", S.sector_result(F.col("best")).alias("r")).select("event_id", "r.sector", "r.confidence", "r.bonus")


@query
def sector_first(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", S.sector_first(F.col("description"), F.col("actors")).alias("sector"))


@query
def sector_summary(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("sector", S.sector_first(F.col("description"), F.col("actors")))
    types = F.array_join(F.transform("top_types", lambda x: F.concat_ws(":", x["threat_type"], x["n"].cast("string"))), ",")
    return stats.sector_summary(e).select("sector", "n", *stats.LEVELS, "threat_level", F.coalesce(types, F.lit("")).alias("top_types"), F.coalesce(F.array_join(F.slice("actors", 1, 5), ","), F.lit("")).alias("actors"))


@query
def sector_api(spark, sf_dir):
    """As the service gives the sectors: at most five actors, in order of first sight."""
    e = events(spark, sf_dir).withColumn("sector", S.sector_first(F.col("description"), F.col("actors")))
    types = F.array_join(F.transform("top_types", lambda x: F.concat_ws(":", x["threat_type"], x["n"].cast("string"))), ",")
    return stats.sector_summary(e, first_seen=5).select("sector", "n", *stats.LEVELS, "threat_level", F.coalesce(types, F.lit("")).alias("top_types"), F.array_join("actors", ",").alias("actors"))


@query
def national_level(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select(threat_event.pick(["finance", "transport", "energy", "retail", "healthcare"], F.col("r_regionkey")).alias("id"), F.col("r_regionkey").alias("ordinal"), (1 + F.col("r_regionkey") * 3 % 5).alias("criticalLevel"))
    return stats.national_level(rows)


# Text


@query
def entropy_service(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.entropy_service(F.col("p_name")).alias("entropy"))


@query
def entropy_full(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.entropy_full(F.col("p_name")).alias("entropy"))


@query
def keyword_hits(spark, sf_dir):
    hits = T.keyword_hits(F.col("text"), WORDS)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(hits, ",").alias("hits"), F.least(F.size(hits) * 5, F.lit(25)).alias("points"))


@query
def keyword_join(spark, sf_dir):
    """How many documents have each word of a dictionary that is a table: joined on q-grams."""
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    found = dictionary.matches(table(spark, sf_dir, "documents"), words, "doc_id", "text")
    return found.groupBy("word").agg(F.count("*").alias("n"))


@query
def part_names_in_documents(spark, sf_dir):
    """The documents that hold a word, of any length, of the parts' or nations' names: a dictionary from tables."""
    cut = lambda t, c: table(spark, sf_dir, t).select(F.explode(F.split(F.lower(c), "[^a-z]+")).alias("word"))
    words = cut("part", "p_name").unionByName(cut("nation", "n_name"))
    return dictionary.matches(table(spark, sf_dir, "documents"), words, "doc_id", "text")


@query
def actor_join(spark, sf_dir):
    """Actors from a table of names and aliases, in place of the fixed list."""
    rows = [(i, n, a) for i, (n, al) in enumerate(dims.TEXT_ACTORS.items()) for a in (n, *al)]
    names = spark.createDataFrame(rows, "rank int, name string, alias string")
    e = events(spark, sf_dir).select("event_id", "description")
    return dictionary.aliases(e, names, "event_id", "description", rank_col="rank").select("event_id", joined("actors"))


@query
def keyword_points(spark, sf_dir):
    """The rule's own list over the events' descriptions."""
    text = F.col("description")
    return events(spark, sf_dir).select("event_id", F.array_join(T.keyword_hits(text), ",").alias("hits"), S.keywords(text).alias("points"))


@query
def actor_extract(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", joined("actors"), F.array_join(T.threat_actors_simple(F.col("description")), ",").alias("simple"))


@query
def mitre_extract(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", joined("techniques"))


@query
def ioc_type_detect(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", T.ioc_type(F.col("ioc_value")).alias("detected"))


@query
def severity_norm(spark, sf_dir):
    raw = F.col("severity_raw")
    return events(spark, sf_dir).select("event_id", T.severity(raw).alias("severity"), T.severity_analyzed(raw).alias("analyzed"))


@query
def confidence_norm(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "confidence")


@query
def date_cascade(spark, sf_dir):
    raw = F.when(F.col("event_id") % 4 == 0, F.date_format("event_time", "dd/MM/yyyy")).when(F.col("event_id") % 4 == 1, F.date_format("event_time", "yyyy-MM-dd")).when(F.col("event_id") % 4 == 2, "soon").otherwise("")
    e = events(spark, sf_dir).withColumn("raw", raw)
    return e.select("event_id", T.date_or_raw(F.col("raw")).alias("iso"), T.age_days(T.timestamp(F.col("raw"))).cast("long").alias("age"))


@query
def bands(spark, sf_dir):
    c = F.col("confidence")
    return events(spark, sf_dir).select("event_id", T.service_band(c).alias("service"), T.dashboard_band(c).alias("dashboard"), T.score_color(c).alias("color"), T.score_text(c).alias("text"))


@query
def title_from_url(spark, sf_dir):
    url = F.col("reference")
    return events(spark, sf_dir).select("event_id", T.title_from_url(url).alias("title"), T.news_source(url, F.col("source_name")).alias("source"), T.netloc(url).alias("netloc"), T.url_host(F.col("ioc_value")).alias("host"))


@query
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text(F.regexp_replace("text", "[^ -~]", " "))).alias("clean"))


@query
def page_summaries(spark, sf_dir):
    return pages.summaries(table(spark, sf_dir, "pages"))


@query
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query
def page_articles(spark, sf_dir):
    return pages.articles(table(spark, sf_dir, "pages"))


# Search


@query
def search_substring(spark, sf_dir):
    return search.search(events(spark, sf_dir), q="BANK", severities=["high", "critical"]).select("event_id", "ioc_type", "severity")


@query
def search_tokens(spark, sf_dir):
    return search.search(events(spark, sf_dir), q="ransomware portal", tokens=True, types=["ip", "url"]).select("event_id", "ioc_type")


@query
def search_filters(spark, sf_dir):
    out = search.search(events(spark, sf_dir), sources=["VirusTotal", "Sandbox"], threat_type="APT", since="2024-01-05 00:00:00", until="2024-01-20 00:00:00")
    return out.select("event_id", "source_name")


@query
def search_paged(spark, sf_dir):
    scored = scoring.service_score(events(spark, sf_dir)).select("event_id", "event_time", "risk_score")
    return search.page(scored, limit=50, offset=20).select("event_id", "risk_score")


@query
def facets(spark, sf_dir):
    return stats.facets(events(spark, sf_dir))


@query
def related_events(spark, sf_dir):
    return search.related(events(spark, sf_dir), "cve-2024-0042").select("event_id", "ioc_type", "ioc_value")


@query
def focused_ioc(spark, sf_dir):
    scored = scoring.service_score(search.point(events(spark, sf_dir), "cve", "CVE-2024-0042"))
    return search.indicator_detail(scored, "cve", "CVE-2024-0042").select("ioc_type", "ioc_value", "event_id", at("event_time"), "severity", "score", "pending", joined("sources"), "n_events")


@query
def urls_to_classify(spark, sf_dir):
    e = events(spark, sf_dir)
    done = e.filter("user_id % 2 = 1 and event_id % 3 = 0").select(F.col("reference").alias("url"))
    return search.urls_to_classify(e, done).groupBy("reference").agg(F.sum("n").alias("n"), F.count("*").alias("n_iocs"))


@query
def url_indicators(spark, sf_dir):
    e = events(spark, sf_dir)
    return search.urls_to_classify(e, e.filter("user_id % 2 = 1").select(F.col("reference").alias("url")), private=("darkreading",))


@query
def url_classification(spark, sf_dir):
    e = events(spark, sf_dir)
    classes = e.select(F.col("reference").alias("url")).distinct().select("url", T.title_from_url(F.col("url")).alias("title"), T.literals(["Phishing"]).alias("types"), T.literals(["Turla"]).alias("url_actors"))
    return search.with_url_classes(e, classes).select("event_id", joined("threat_types"), joined("actors"), "ai_confidence")


@query
def reuse_split(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", *scoring.KEY)
    cache = events(spark, sf_dir).filter("user_id % 3 = 0").select(*scoring.KEY, (F.col("user_id") % 2 == 0).alias("scraped"), F.when(F.col("user_id") % 9 == 0, F.col("description")).alias("description"))
    reuse, fresh = search.reusable(e, cache, scoring.KEY)
    return reuse.select("event_id", F.lit("reused").alias("branch")).unionByName(fresh.select("event_id", F.lit("new").alias("branch")))


# Statistics


@query
def dashboard_stats(spark, sf_dir):
    return stats.dashboard_counts(events(spark, sf_dir))


@query
def stats_by_threat_type(spark, sf_dir):
    return stats.by_threat_type(events(spark, sf_dir))


@query
def top_items(spark, sf_dir):
    e = events(spark, sf_dir)
    parts = [stats.top_items(e, c, 5).withColumn("field", F.lit(c)) for c in ("ioc_type", "source_name", "threat_types", "severity")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def recent_alerts(spark, sf_dir):
    return stats.recent_alerts(events(spark, sf_dir)).select("event_id", at("event_time"), "ioc_type", "severity")


@query
def avg_risk(spark, sf_dir):
    return stats.average_risk(scoring.service_score(events(spark, sf_dir)).select("ioc_type", "risk_score"))


@query
def severity_distribution(spark, sf_dir):
    return stats.severity_distribution(events(spark, sf_dir))


@query
def home_severity(spark, sf_dir):
    return stats.home_severity(events(spark, sf_dir))


@query
def bucket_map(spark, sf_dir):
    return stats.bucket_map(events(spark, sf_dir)).select(F.to_json("buckets").alias("buckets"))


@query
def events_by_day(spark, sf_dir):
    return stats.events_by_day(events(spark, sf_dir), days=14).select(day(), "n")


@query
def percent_of_total(spark, sf_dir):
    return stats.shares(events(spark, sf_dir))


@query
def report_summary(spark, sf_dir):
    return stats.report_summary(events(spark, sf_dir))


@query
def alerts(spark, sf_dir):
    return stats.alerts(events(spark, sf_dir)).select("alert_id", "event_id", at("event_time"), "severity", "status")


def alert_log(spark, sf_dir):
    """Every third alert is acknowledged after an hour, every second of these resolved after two."""
    steps = [F.struct(F.lit(s).alias("status"), F.make_dt_interval(hours=F.lit(h)).alias("later")) for s, h in (("acknowledged", 1), ("resolved", 2))]
    log = stats.alerts(events(spark, sf_dir)).filter("event_id % 3 = 0").select("alert_id", "event_id", "event_time", F.explode(F.array(*steps)).alias("s")).filter("s.status = 'acknowledged' or event_id % 2 = 0")
    return log.select("alert_id", (F.col("event_time") + F.col("s.later")).alias("at"), "s.status")


@query
def alert_kpis(spark, sf_dir):
    return stats.alert_kpis(stats.alert_transitions(stats.alerts(events(spark, sf_dir)), alert_log(spark, sf_dir)))


@query
def cve_search(spark, sf_dir):
    return stats.cve_kpis(search.search(events(spark, sf_dir), q="2024-00"))


@query
def tickets(spark, sf_dir):
    return export.tickets(scoring.service_score(events(spark, sf_dir))).select("ticket_id", "event_id", "title", "priority", "category", "risk", F.md5("body").alias("body"))


# Trends


@query
def daily_by_type(spark, sf_dir):
    return trend.daily_counts(events(spark, sf_dir)).select(day(), "threat_type", "n")


@query
def trend_regression(spark, sf_dir):
    return trend.regression(trend.dense(trend.daily_counts(events(spark, sf_dir)))).select("threat_type", "total", "days", "slope", "direction", "confidence", "current_avg", "prediction_7d", "change_percent")


@query
def trend_predictions(spark, sf_dir):
    return trend.predictions(events(spark, sf_dir), top=5).select("threat_type", "slope", "prediction_text", "alert_level")


@query
def trend_summary(spark, sf_dir):
    return trend.trend_summary(trend.predictions(events(spark, sf_dir)))


@query
def trend_forecast(spark, sf_dir):
    return trend.forecast(events(spark, sf_dir)).select("threat_type", day(), "segment", "value")


@query
def trend_additive(spark, sf_dir):
    """The seven days after each type's history, by trend, bends and weekly season."""
    paths = forecast.additive(trend.dense(trend.daily_counts(events(spark, sf_dir)), calendar=True))
    return paths.select("threat_type", day(), *[F.round(c, 3).alias(c) for c in ("value", "lower", "upper", "trend", "weekly")])


@query
def trend_outlook(spark, sf_dir):
    return forecast.outlook(forecast.additive(trend.dense(trend.daily_counts(events(spark, sf_dir)), calendar=True)))


# Countries, news, graph


@query
def geo_threats(spark, sf_dir):
    severities = F.array_join(F.transform(F.map_entries("severities"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return stats.geo_rollup(events(spark, sf_dir)).select("code", "name", "lat", "lng", "n", severities.alias("severities"), "primary_severity", "radius", "stroke")


@query
def geo_totals(spark, sf_dir):
    return stats.geo_totals(stats.geo_rollup(events(spark, sf_dir)))


@query
def news_rollup(spark, sf_dir):
    related = F.array_join(F.transform("related", lambda x: F.concat_ws(":", x["type"], x["value"])), ",")
    return stats.news_rollup(events(spark, sf_dir)).select("id", "title", "url", "source", at("date"), related.alias("related"), "ioc_count")


@query
def news_by_source(spark, sf_dir):
    return stats.news_by_source(stats.news_rollup(events(spark, sf_dir)))


def graph_events(spark, sf_dir):
    """Threat events with related entities made from the fixture's own values."""
    u = F.col("user_id")
    return events(spark, sf_dir).withColumns({
        "related_actors": F.when(u % 10 == 0, T.literals(["Night Owl"])).otherwise(T.literals([])), "malware_families": F.when(u % 4 == 0, T.literals(["Dark Rat"])).otherwise(T.literals([])),
        "campaigns": F.when(u % 6 == 0, T.literals(["Winter Op"])).otherwise(T.literals([])), "related_domains": F.when(u % 3 == 0, F.array(F.concat(F.lit("d"), (u % 50).cast("string"), F.lit(".example.com")), F.col("ioc_value"))).otherwise(T.literals([])),
        "related_hashes": F.when(u % 5 == 0, F.array(F.md5((u % 20).cast("string")))).otherwise(T.literals([])),
    })


@query
def graph_nodes(spark, sf_dir):
    return graph.nodes(graph_events(spark, sf_dir)).select("id", "label", "type", F.coalesce("sub_type", F.lit("")).alias("sub_type"), F.coalesce("severity", F.lit("")).alias("severity"), "size")


@query
def graph_edges(spark, sf_dir):
    return graph.links(graph_events(spark, sf_dir))


@query
def graph_stats(spark, sf_dir):
    e = graph.graph_filter(graph_events(spark, sf_dir), "with_actors")
    return graph.graph_stats(graph.nodes(e), graph.links(e))


# Exports


@query
def export_suricata(spark, sf_dir):
    return export.suricata(events(spark, sf_dir))


@query
def export_snort(spark, sf_dir):
    return export.snort(events(spark, sf_dir))


@query
def export_csv(spark, sf_dir):
    return export.csv_lines(events(spark, sf_dir))


@query
def export_json(spark, sf_dir):
    return export.json_documents(events(spark, sf_dir))


@query
def export_blocklist(spark, sf_dir):
    return export.blocklist(events(spark, sf_dir))


@query
def export_text(spark, sf_dir):
    return export.text_list(events(spark, sf_dir))


# Sources and streams


@query
def json_shapes(spark, sf_dir):
    """Each event as a JSON file of one of the shapes, parsed back."""
    e = events(spark, sf_dir)
    one = F.to_json(F.struct(F.struct(F.col("ioc_value").alias("value"), F.col("ioc_type").alias("type")).alias("ioc"), "source_name", "description", F.col("threat_types").alias("threat_type"), F.col("severity_raw").alias("severity"), F.col("confidence_raw").alias("confidence")))
    wrap = [('{"hits":{"hits":[{"_source":', "}]}}"), ('{"hits":[', "]}"), ('{"events":[', "]}"), ('{"data":[', "]}"), ("", ""), ("[", "]")]
    text = F.when(F.lit(False), "")
    for i, (a, b) in enumerate(wrap):
        text = text.when(F.col("event_id") % 6 == i, F.concat(F.lit(a), one, F.lit(b)))
    files = e.select(F.col("event_id").cast("string").alias("file"), F.try_parse_json(text).alias("v"))
    out = json_events.threat_events(json_events.split_events(files))
    return out.select(F.col("file").cast("long").alias("event_id"), "ioc_type", "ioc_value", "source_name", joined("threat_types"), "severity", "confidence")


@query
def incremental_pipeline(spark, sf_dir):
    out = incremental.incremental(spark, f"{sf_dir}/events.parquet", dims.AS_OF)
    return out.select("ioc_type", "ioc_value", "event_id", "risk_score", "ai_severity")


@query
def stream_daily_counts(spark, sf_dir):
    return incremental.daily(spark, f"{sf_dir}/events.parquet").select(day(), "event_type", "n")


@query
def stream_windows(spark, sf_dir):
    """Daily counts by state and watermark: the days that the stream has closed."""
    base = shared_dir(spark)
    stateful.daily_windows(incremental.event_stream(spark, f"{sf_dir}/events.parquet"), f"{base}/days", f"{base}/checkpoint").awaitTermination()
    return stateful.closed(spark, f"{base}/days").select(day(), "event_type", "n")


@query
def stream_new_indicators(spark, sf_dir):
    """The warehouse after a stream whose repeated indicators are dropped by its state and by the warehouse."""
    base = shared_dir(spark)
    stream = threat_event.project(incremental.event_stream(spark, f"{sf_dir}/events.parquet"))
    stateful.score_new(stream, f"{base}/warehouse", f"{base}/checkpoint", dims.AS_OF).awaitTermination()
    return pipeline.current(spark, f"{base}/warehouse").select("ioc_type", "ioc_value")


@query
def stream_alerts(spark, sf_dir):
    """The states of alerts after a stream of their log."""
    base = shared_dir(spark)
    alert_log(spark, sf_dir).select("alert_id", "at", "status").write.parquet(f"{base}/log")
    log = spark.readStream.schema("alert_id string, at timestamp, status string").parquet(f"{base}/log")
    stateful.alert_lives(log, f"{base}/alerts", f"{base}/checkpoint").awaitTermination()
    return stateful.alert_states(spark, f"{base}/alerts").select("alert_id", "status", at("acknowledged_at"))


def rolled(spark, sf_dir, e):
    """The state after the events came in five batches."""
    table = f"{shared_dir(spark)}/rollups"
    for i in range(5):
        rollups.add(table, e.filter(F.col("event_id") % 5 == i), i)
    return rollups.current(spark, table)


@query
def rollup_dashboard(spark, sf_dir):
    """The dashboard's counts, merged from the states of batches."""
    return rollups.dashboard_counts(rolled(spark, sf_dir, events(spark, sf_dir)))


@query
def rollup_risk(spark, sf_dir):
    return rollups.average_risk(rolled(spark, sf_dir, scoring.service_score(events(spark, sf_dir))))


def bucketed(spark, sf_dir):
    """The folder of a bucketed table, after two upserts of two thirds of the events each."""
    folder = f"{shared_dir(spark)}/bucketed"
    e = events(spark, sf_dir).select(*scoring.KEY, "event_id", "source_name", F.col("event_time").alias("processed_at"))
    for i in range(2):
        buckets.upsert(e.filter(F.col("event_id") % 3 != i), folder)
    return folder


@query
def bucketed_upsert(spark, sf_dir):
    """The last event of each indicator, from a table in buckets."""
    return buckets.open_table(spark, bucketed(spark, sf_dir)).select(*scoring.KEY, "event_id", "source_name")


@query
def bucketed_unknown(spark, sf_dir):
    """The events whose indicator a table in buckets lacks."""
    folder = f"{shared_dir(spark)}/bucketed"
    e = events(spark, sf_dir).select(*scoring.KEY, "event_id", F.col("event_time").alias("processed_at"))
    buckets.upsert(e.filter("event_id % 4 = 0"), folder)
    return buckets.unknown(e, folder).select("event_id", *scoring.KEY)


# Rules of the dashboard and the ingest


@query
def search_tags(spark, sf_dir):
    return search.search(events(spark, sf_dir), q="TMPL-1").select("event_id", "ioc_type")


@query
def search_relevance(spark, sf_dir):
    return search.relevant(events(spark, sf_dir), "APT").select("event_id", "relevance")


@query
def search_ranked(spark, sf_dir):
    """The 50 best events for each of two queries, over five fields of an inverted index."""
    path = f"{shared_dir(spark)}/inverted"
    search.index_events(events(spark, sf_dir), path)
    found = [search.ranked(spark, path, q).withColumn("query", F.lit(q)) for q in RANKED]
    return found[0].unionByName(found[1]).select("query", "event_id", "score")


@query
def documents_ranked(spark, sf_dir):
    """The 100 documents that a query of several languages' words fits best."""
    path = f"{shared_dir(spark)}/inverted"
    textindex.index_table(table(spark, sf_dir, "documents"), path, "doc_id", {"text": F.col("text")})
    return textindex.ranked(spark, path, DOCUMENT_QUERY, {"text": 1.0}, k=100).withColumnRenamed("id", "doc_id")


@query
def documents_containing(spark, sf_dir):
    """The documents that contain a phrase, any case; only blocks that have all its trigrams are scanned."""
    path = f"{shared_dir(spark)}/trigrams"
    textindex.write_trigrams(table(spark, sf_dir, "documents"), path, ["text"], "doc_id", blocks=64)
    return textindex.containing(spark, path, PHRASE, ["text"]).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query
def search_scored(spark, sf_dir):
    """Severity of the score where there is one."""
    e = events(spark, sf_dir).withColumn("severity_ai", F.when(F.col("event_id") % 3 == 0, "critical").when(F.col("event_id") % 3 == 1, ""))
    return search.search(e, severities=["critical"], scored_severity=True).select("event_id")


@query
def search_limited(spark, sf_dir):
    return search.limited(search.search(events(spark, sf_dir), types="ip", sources="VirusTotal"), 25).select("event_id", "total")


@query
def search_offset(spark, sf_dir):
    return search.page(events(spark, sf_dir), 40, 15, by=None).select("event_id", "ioc_type")


@query
def warehouse_events(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", *scoring.KEY, F.when(F.col("event_id") % 2 == 0, F.col("source_name")).otherwise("").alias("source_name"), "event_time", F.when(F.col("event_id") % 3 != 0, F.col("event_time")).alias("first_seen"), (F.col("event_time") + F.make_dt_interval(F.lit(1))).alias("processed_at"), F.col("threat_types").alias("ai_threat_types"), F.when(F.col("event_id") % 5 == 0, "").otherwise("high").alias("ai_severity"), "severity")
    out = search.from_warehouse(rows.drop("event_id"))
    return out.select("ioc_type", "ioc_value", "source_type", "source_name", at("event_time"), at("collect_time"), joined("threat_types"), "severity", "confidence", "description", "status")


@query
def score_write_back(spark, sf_dir):
    e = events(spark, sf_dir)
    return scoring.write_back(e, scoring.grouped_score(e)).select("event_id", "risk_score", "severity_ai", "breakdown.type_specific")


def parsed_breakdowns(spark, sf_dir):
    """Scored events with their stored breakdown parsed as `v`: flat for even ids, else nested."""
    scored = breakdown.stored(scoring.service_score(events(spark, sf_dir)))
    flat = F.to_json(F.struct(F.col("cross_source").alias("crossSource"), F.col("domain_age").alias("typeSpecific"), "entropy", "keywords"))
    return scored.withColumn("v", F.try_parse_json(F.when(F.col("event_id") % 2 == 0, flat).otherwise(F.col("breakdown"))))


def listed(c, *names):
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[names[0]], *[x[n].cast("int").cast("string") for n in names[1:]])), ",")


@query
def breakdown_categories(spark, sf_dir):
    return parsed_breakdowns(spark, sf_dir).select("event_id", listed(breakdown.categories(F.col("v")), "category", "score", "max_score").alias("categories"))


@query
def breakdown_summary(spark, sf_dir):
    e = parsed_breakdowns(spark, sf_dir).filter("event_id % 2 = 1")
    return e.select("event_id", breakdown.summary(F.col("v"), F.col("threat_types"), F.col("actors"), F.col("techniques")).alias("s")).select("event_id", "s.*")


@query
def breakdown_factors(spark, sf_dir):
    e = parsed_breakdowns(spark, sf_dir).filter("event_id % 2 = 1")
    return e.select("event_id", listed(breakdown.fallback_factors(F.col("v")), "factor", "score", "max_score").alias("factors"))


@query
def breakdown_enhanced(spark, sf_dir):
    e = scoring.service_score(events(spark, sf_dir))
    e = e.withColumns({"severity_ai": F.when(F.col("event_id") % 3 != 0, F.col("severity_ai")), "risk_score": F.when(F.col("event_id") % 5 != 0, F.col("risk_score"))})
    x = breakdown.enhanced(e.drop("summary")).select("event_id", "enhanced.*")
    return x.select("event_id", "total_score", "severity", F.coalesce("severity_th", F.lit("")).alias("severity_th"), "breakdown", F.size("top_factors").alias("n_factors"), "summary.has_mitre")


@query
def keyword_severity_terms(spark, sf_dir):
    """As many values as each field's search bucket holds."""
    e = events(spark, sf_dir)
    return stats.terms(e, "threat_types").withColumn("field", F.lit("threat_types")).unionByName(stats.terms(e, "ioc_type").withColumn("field", F.lit("ioc_type")))


@query
def sectors_ranked(spark, sf_dir):
    return stats.sectors_by_count(stats.sector_feed(events(spark, sf_dir), spark)).select("sector", "n", "threat_level")


@query
def sector_tagged(spark, sf_dir):
    """Keywords of the title and the tags count as well."""
    tags = F.when(F.col("user_id") % 5 == 0, T.literals(["bank", "hospital"])).otherwise(F.col("tags"))
    best = S.sector_match(F.col("description"), F.col("ioc_value"), F.col("ioc_type"), F.col("actors"), T.title_from_url(F.col("reference")), tags)
    return events(spark, sf_dir).withColumn("best", best).select("event_id", S.sector_result(F.col("best")).alias("r")).select("event_id", "r.sector", "r.confidence", "r.bonus")


@query
def daily_by_collect(spark, sf_dir):
    """Events without a time count on the day they were collected."""
    e = events(spark, sf_dir).withColumn("collect_time", F.col("event_time") + F.make_dt_interval(F.lit(1)))
    return trend.daily_counts(e.withColumn("event_time", F.when(F.col("event_id") % 13 != 0, F.col("event_time")))).select(day(), "threat_type", "n")


@query
def trend_steepest(spark, sf_dir):
    return trend.top_increasing(trend.predictions(events(spark, sf_dir)), 3).select("threat_type", "change_percent")


@query
def geo_paths(spark, sf_dir):
    """The country from the places where enrichment may name it, in their order; the ten with the most events."""
    u = F.col("user_id")
    paths = F.array(F.when(u % 3 == 0, "XX"), F.when(u % 3 == 1, "redacted for privacy"), F.lower("country_code"), F.lit("us"))
    return stats.top_countries(stats.geo_rollup(events(spark, sf_dir).withColumn("country_paths", paths)), 5).select("code", "n", "primary_severity", "stroke")


@query
def country_ingest(spark, sf_dir):
    u, code = F.col("user_id"), F.col("country_code")
    found = stats.country_code_ingest(F.when(u % 4 == 0, code), F.when(u % 4 == 1, ""), F.when(u % 3 == 0, "DE"), code)
    return events(spark, sf_dir).select("event_id", found.alias("country"))


@query
def news_search(spark, sf_dir):
    return stats.news_search(stats.news_rollup(events(spark, sf_dir)), "DarkReading", "BREACH").select("id", "title", at("date"), "ioc_count")


@query
def alert_search(spark, sf_dir):
    return stats.alert_filter(stats.alerts(events(spark, sf_dir)), "open", "high", "ip").select("alert_id", "event_id")


@query
def focused_graph(spark, sf_dir):
    return graph.nodes(graph.focused(graph_events(spark, sf_dir), "cve", "CVE-2024-0042")).select("id", "label", "type")


@query
def entity_graph(spark, sf_dir):
    e = graph.graph_filter(graph_events(spark, sf_dir), "with_entities")
    return graph.graph_stats(graph.nodes(e), graph.links(e))


@query
def ingest_gates(spark, sf_dir):
    """What is fetched and what is analysed; the description that a page's title gives."""
    text, title = F.substring("description", F.lit(1), (F.col("event_id") % 40).cast("int")), T.title_from_url(F.col("reference"))
    return events(spark, sf_dir).select("event_id", search.needs_scrape(F.col("source_name"), text).alias("scrape"), search.needs_analysis(text, title).alias("analyse"), T.enriched_description(title, text).alias("description"))


@query
def domain_ages(spark, sf_dir):
    """From the creation date in one of several forms, else from the registration."""
    k = F.col("event_id") % 4
    created = F.when(k == 0, F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, "unknown")
    registered = F.when(F.col("event_id") % 3 == 0, F.date_format("event_time", "yyyy-MM-dd"))
    return events(spark, sf_dir).select("event_id", T.domain_age_days(created, registered).alias("age"))


@query
def shown_labels(spark, sf_dir):
    terms = [*dims.TERMS, "Zero Day"]
    e = events(spark, sf_dir).withColumn("term", threat_event.pick(terms, F.col("event_id") % len(terms)))
    prepared = T.prepared_for_translation(F.substring("description", F.lit(1), (F.col("event_id") % 12).cast("int")))
    return e.select("event_id", T.prettified(F.replace("term", F.lit(" "), F.lit("_"))).alias("label"), export.translated_term(F.upper("term")).alias("thai"), prepared.alias("prepared"))


@query
def csv_document(spark, sf_dir):
    return export.csv_document(events(spark, sf_dir))


@query
def json_document(spark, sf_dir):
    e = events(spark, sf_dir)
    return export.json_document(export.json_documents(e, ("event_id", "event_time")), ["event_time", "event_id"], {"source": "feed"}, name="iocs")


@query
def stats_document(spark, sf_dir):
    return export.stats_document(events(spark, sf_dir), ["event_time", "event_id"])


@query
def suricata_document(spark, sf_dir):
    return export.rule_document(export.suricata(events(spark, sf_dir)), "Suricata")


@query
def text_document(spark, sf_dir):
    return export.text_document(events(spark, sf_dir))


@query
def blocklist_document(spark, sf_dir):
    return export.blocklist_document(events(spark, sf_dir))


@query
def ticket_log(spark, sf_dir):
    return export.audited(export.tickets(scoring.service_score(events(spark, sf_dir))).select("ticket_id", "event_id", F.lit("t").alias("title"), "priority", "category", "risk"))


@query
def url_master(spark, sf_dir):
    """Classifications of URLs in their master table, saved in two batches of which the later wins."""
    base = f"{shared_dir(spark)}/urls"
    urls = events(spark, sf_dir).groupBy(F.col("reference").alias("url")).agg(F.max("event_id").alias("last"))
    for version in (0, 1):
        rows = urls.filter(f"{version} = 0 or last % 2 = 0").select("url", F.lit(f"class {version}").alias("class"), F.lit(version).alias("classified_at"))
        pipeline.save_classes(base, rows, version)
    return pipeline.classes(spark, base).select("url", "class")
