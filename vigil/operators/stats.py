"""Dashboard statistics: counts, top lists, facets, sectors, countries, news, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import scores as S
from ..functions import text as T

LEVELS = ["critical", "high", "medium", "low"]


def dashboard_counts(events: DataFrame) -> DataFrame:
    """`dimension`, `key`, `n` by type, severity and source, in one pass; nulls are `unknown` (severity: `low`)."""
    rows = events.select(F.coalesce("ioc_type", F.lit("unknown")).alias("type"), F.coalesce("severity", F.lit("low")).alias("severity"), F.coalesce("source_name", F.lit("unknown")).alias("source"))
    names = ["type", "severity", "source"]
    sets = rows.groupingSets([[F.col(c)] for c in names], *[F.col(c) for c in names]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("type").isNotNull(), "type").when(F.col("severity").isNotNull(), "severity").otherwise("source")
    return sets.select(dimension.alias("dimension"), F.coalesce(*names).alias("key"), "n")


def by_threat_type(events: DataFrame) -> DataFrame:
    return events.select(F.explode("threat_types").alias("threat_type")).filter("threat_type <> ''").groupBy("threat_type").agg(F.count("*").alias("n"))


#: Buckets of the search engine's counts: 20 of threat types, else 10.
BUCKETS = {"threat_types": 20}


def terms(events: DataFrame, field: str) -> DataFrame:
    """The most frequent values of a field, as many as its search bucket holds."""
    return top_items(events, field, BUCKETS.get(field, 10))


def top_items(events: DataFrame, field: str, k: int = 10) -> DataFrame:
    """`rank`, `key`, `n`: the k most frequent values of a column (or of an array column's elements), ties by key."""
    value = F.explode(field) if dict(events.dtypes)[field].startswith("array") else F.col(field)
    counts = events.select(value.alias("key")).filter("key is not null and key <> ''").groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(k)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "key"))).select("rank", "key", "n")


def recent_alerts(events: DataFrame, k: int = 10) -> DataFrame:
    return events.filter("event_time is not null").orderBy(F.desc("event_time"), "event_id").limit(k).select("event_id", "event_time", "ioc_type", "ioc_value", "severity")


def facets(events: DataFrame) -> DataFrame:
    """`facet`, `value`: the distinct sources, threat types and actors."""
    one = lambda name, value: F.struct(F.lit(name).alias("facet"), value.alias("value"))
    many = lambda name, col: F.transform(F.coalesce(F.col(col), T.literals([])), lambda x: one(name, x))
    rows = events.select(F.explode(F.concat(F.array(one("source", F.col("source_name"))), many("threat_type", "threat_types"), many("actor", "actors"))).alias("f"))
    return rows.select("f.*").filter("value is not null and value <> ''").distinct()


def severity_distribution(events: DataFrame) -> DataFrame:
    """Counts of five levels; info counts as clean."""
    return events.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in LEVELS], F.count_if(F.col("severity").isin("clean", "info")).alias("clean"))


def home_severity(events: DataFrame) -> DataFrame:
    """Counts of four levels with clean folded into low."""
    s = F.col("severity")
    return events.agg(*[F.count_if(s == x).alias(x) for x in LEVELS[:3]], F.count_if(s.isin("low", "clean", "info") | s.isNull()).alias("low"))


def average_risk(scored: DataFrame) -> DataFrame:
    """Average risk by indicator type and over all (type null)."""
    return scored.rollup("ioc_type").agg(F.round(F.avg("risk_score"), 6).alias("avg_risk"), F.count("*").alias("n"))


def bucket_map(events: DataFrame, field: str = "severity") -> DataFrame:
    """All counts of a column as one map, keys sorted."""
    counts = events.groupBy(F.col(field).alias("key")).agg(F.count("*").alias("n")).filter("key is not null")
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "n")))).alias("buckets"))


def events_by_day(events: DataFrame, days: int | None = None, as_of: str = dims.AS_OF) -> DataFrame:
    rows = events if days is None else events.filter(F.col("event_time") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    return rows.filter("event_time is not null").groupBy(F.to_date("event_time").alias("day")).agg(F.count("*").alias("n"))


def shares(events: DataFrame, field: str = "severity") -> DataFrame:
    """`key`, `n`, percent of the total and of the largest, and the running percentages of a ring chart, by descending count."""
    counts = events.groupBy(F.col(field).alias("key")).agg(F.count("*").alias("n"))
    every, order = Window.partitionBy(), Window.orderBy(F.desc("n"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_total = F.col("n") * 100.0 / F.sum("n").over(every)
    end = F.sum("n").over(order) * 100.0 / F.sum("n").over(every)
    return counts.select("key", "n", F.round(of_total, 4).alias("percent"), F.round(F.col("n") * 100.0 / F.max("n").over(every), 4).alias("percent_of_max"), F.round(end - of_total, 4).alias("start"), F.round(end, 4).alias("end"))


# Sectors


def sector_summary(events: DataFrame, k_types: int = 5, first_seen: int | None = None) -> DataFrame:
    """Per sector: events, four severity counts, threat level, the k most frequent types and the actors, sorted; with `first_seen` so many actors, in the order in which events (by id) name them.

    One pass: each event gives its severity, types and actors as (kind, value) pairs, whose counts, few beside the
    events, are put together per sector.
    """
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    many = lambda kind, c: F.transform(F.coalesce(F.col(c), T.literals([])), lambda x: pair(kind, x))
    said = F.concat(F.array(pair("severity", F.col("severity"))), many("type", "threat_types"), many("actor", "actors"))
    sight = F.min(F.struct("event_id", "pos")) if first_seen else F.lit(0)
    counts = events.select("sector", *["event_id"] * bool(first_seen), F.posexplode(said).alias("pos", "p")).groupBy("sector", "p.kind", "p.value").agg(F.count("*").alias("m"), sight.alias("sight"))
    of = lambda kind, x: F.when((F.col("kind") == kind) & F.col("value").isNotNull(), x)
    n = F.sum(F.when(F.col("kind") == "severity", F.col("m")))
    levels = [F.coalesce(F.sum(F.when((F.col("kind") == "severity") & (F.col("value") == s), F.col("m"))), F.lit(0)).alias(s) for s in LEVELS]
    types = F.slice(F.sort_array(F.collect_list(of("type", F.struct((-F.col("m")).alias("key"), F.col("value").alias("t"))))), 1, k_types)
    seen = F.sort_array(F.collect_list(of("actor", F.struct("sight", F.col("value").alias("a")))))
    actors = F.transform(F.slice(seen, 1, first_seen), lambda x: x["a"]) if first_seen else F.sort_array(F.collect_list(of("actor", F.col("value"))))
    out = counts.groupBy("sector").agg(n.alias("n"), *levels, types.alias("types"), actors.alias("actors"))
    level = S.threat_level(*[F.col(x) for x in LEVELS], F.col("n"))
    return out.select("sector", "n", *LEVELS, level.alias("threat_level"), F.transform("types", lambda x: F.struct(x["t"].alias("threat_type"), (-x["key"]).alias("n"))).alias("top_types"), "actors")


def sectors_by_count(summary: DataFrame) -> DataFrame:
    # with the count in the condition it stays above the summary; below, each event's sector would be found twice, the first time before the events are dealt out
    return summary.filter(F.when(F.col("n").isNotNull(), F.col("sector") != "general")).orderBy(F.desc("n"), "sector")


def sector_feed(events: DataFrame | None, spark: SparkSession) -> DataFrame:
    """The sectors' summary of loaded events, `sector_first` applied; empty where there is no feed."""
    if events is None:
        return spark.createDataFrame([], "sector string, n long, critical long, high long, medium long, low long, threat_level string, top_types array<struct<threat_type:string,n:long>>, actors array<string>")
    return sector_summary(events.withColumn("sector", S.sector_first(F.col("description"), F.col("actors"))))


def national_level(sectors: DataFrame) -> DataFrame:
    """One row from a sector feed (id, name, criticalLevel, ordinal): score, affected sectors, level and the worst sector, the first on ties."""
    vital = F.col("id").isin(dims.CRITICAL_SECTORS)
    level = F.col("criticalLevel")
    agg = sectors.agg(
        F.sum(level * 10 * F.when(vital, 2).otherwise(1)).alias("score"), F.count_if(level >= 3).alias("affected"), F.count("*").alias("total"),
        F.max_by("id", F.struct(level, -F.col("ordinal"))).alias("top_sector"), F.coalesce(F.bool_or(vital & (level >= 4)), F.lit(False)).alias("vital_hit"),
    )
    s, n = F.col("score"), F.col("affected")
    named = F.when(F.col("vital_hit") | (s >= 200), "critical").when((n >= 4) | (s >= 120), "high").when((n >= 2) | (s >= 60), "medium").otherwise("low")
    return agg.select("score", "affected", "total", "top_sector", named.alias("level"))


# Countries


def countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, *v) for c, v in dims.COUNTRIES.items()], "code string, name string, lat double, lng double")


def country_code(paths: Column) -> Column:
    """The first two-letter code of a known country other than TH, in the order given."""
    known = [c for c in dims.COUNTRIES if c != "TH"]
    ups = F.filter(F.transform(paths, F.upper), lambda c: c.isin(known))
    return F.try_element_at(ups, F.lit(1))


def country_code_ingest(*paths: Column) -> Column:
    """The first non-empty value, as the ingest reads it."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in paths])


def geo_rollup(events: DataFrame) -> DataFrame:
    """Per known country: name, place, events, counts by severity, the worst severity present, marker radius and arc width.

    The country is the first valid one of `country_paths`, the places where enrichment may name it, or `country_code`
    where there is no such column.
    """
    spark = events.sparkSession
    code = country_code(F.col("country_paths") if "country_paths" in events.columns else F.array("country_code"))
    rows = events.withColumn("code", code).filter("code is not null")
    by = rows.groupBy("code", "severity").agg(F.count("*").alias("n"))
    rank = F.array_position(T.literals(dims.SEVERITIES), F.col("severity"))
    grouped = by.groupBy("code").agg(F.sum("n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("severities"), F.max_by("severity", rank).alias("primary_severity"))
    # 73 constant rows
    placed = grouped.join(F.broadcast(countries(spark)), "code")
    width = T.arc_width(F.col("n"), F.max("n").over(Window.partitionBy()))  # over at most 73 rows
    return placed.select("code", "name", "lat", "lng", "n", "severities", "primary_severity", F.round(T.marker_radius(F.col("n")), 6).alias("radius"), F.round(width, 6).alias("stroke"))


def top_countries(rollup: DataFrame, k: int = 10) -> DataFrame:
    """The k countries with the most events (the map draws 15 arcs), ties by code."""
    return rollup.orderBy(F.desc("n"), "code").limit(k)


def geo_totals(rollup: DataFrame) -> DataFrame:
    return rollup.agg(F.sum("n").alias("events"), F.count("*").alias("countries"))


# News


def news_rollup(events: DataFrame, k_iocs: int = 5) -> DataFrame:
    """Per article: title, source, earliest date, distinct indicators (number and the first k), and its place in order of appearance.

    The first indicators of an article are chosen in two steps, so that a hot one is not ranked in one task.
    """
    rows = events.filter(T.is_news_url(F.col("reference"))).select(F.col("reference").alias("url"), "source_name", "event_time", "event_id", "ioc_type", "ioc_value")
    iocs = rows.groupBy("url", "ioc_type", "ioc_value").agg(F.min("event_id").alias("at")).withColumn("salt", F.pmod(F.xxhash64("ioc_type", "ioc_value"), F.lit(16)))
    first = iocs.withColumn("r", F.row_number().over(Window.partitionBy("url", "salt").orderBy("at"))).filter(F.col("r") <= k_iocs)
    first = first.groupBy("url").agg(F.slice(F.sort_array(F.collect_list(F.struct("at", "ioc_type", "ioc_value"))), 1, k_iocs).alias("iocs"))
    number = iocs.groupBy("url").agg(F.count("*").alias("ioc_count"))
    base = rows.groupBy("url").agg(F.min("event_time").alias("date"), F.min_by("source_name", "event_id").alias("source_name"), F.min("event_id").alias("at"))
    # numbered before the joins, as numbering reads its input more than once
    out = number_rows(base, ["at"]).join(number, "url").join(first, "url")
    related = F.transform("iocs", lambda x: F.struct(x["ioc_type"].alias("type"), x["ioc_value"].alias("value"))).alias("related")
    return out.select(F.concat(F.lit("news-"), F.col("no") - 1).alias("id"), T.title_from_url(F.col("url")).alias("title"), "url", T.news_source(F.col("url"), F.col("source_name")).alias("source"), "date", related, "ioc_count")


def news_search(articles: DataFrame, source: str | None = None, q: str | None = None) -> DataFrame:
    """Articles of a source with `q` in the title (any case), newest first, ties by id."""
    found = articles if source is None else articles.filter(F.col("source") == source)
    found = found if not q else found.filter(F.contains(F.lower("title"), F.lit(q.lower())))
    return found.orderBy(F.desc("date"), "id")


def news_by_source(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source").agg(F.count("*").alias("n"))


# Reports, alerts


def report_summary(events: DataFrame) -> DataFrame:
    serious = F.col("severity").isin("critical", "high")
    return events.agg(F.count("*").alias("total"), F.count_if(serious).alias("critical_high"), F.count_distinct("source_name").alias("sources"), F.count_distinct("ioc_type").alias("types"))


def alerts(events: DataFrame) -> DataFrame:
    """Events of medium severity or worse as open alerts, numbered in order of time."""
    rows = events.filter(F.col("severity").isin("critical", "high", "medium")).select("event_id", "event_time", "ioc_type", "ioc_value", "severity", "threat_types")
    numbered = number_rows(rows, ["event_time", "event_id"])
    return numbered.select(F.format_string("ALERT-%05d", F.col("no")).alias("alert_id"), "event_id", "event_time", "ioc_type", "ioc_value", "severity", F.lit("open").alias("status"))


#: Values of a whole number that share a cell when rows are numbered.
CELL = 4096


def number_rows(rows: DataFrame, order: list[str], per: Column | None = None) -> DataFrame:
    """`rows` with `no`, 1, 2, ... in the order of one or two columns, of which the last is a whole number and unique; anew for each value of `per`.

    Rows are counted by cells: an instant (nulls first) and CELL values of the last column. The cells' counts
    are summed up by minute, or by CELL cells, the minutes' over all, and rows are ranked within their cell. So no task
    ranks all rows, nor those of one minute or without a time.
    """
    timed = len(order) > 1
    instant = F.coalesce(F.unix_micros(F.col(order[0]).cast("timestamp")), F.lit(-(1 << 62))) if timed else F.lit(0).cast("long")
    block = F.floor(F.col(order[-1]) / CELL)
    coarse = F.floor(F.col("_f") / 60_000_000) if timed else F.floor(F.col("_b") / CELL)
    placed = rows.withColumns({"_p": F.lit("") if per is None else F.coalesce(per.cast("string"), F.lit("")), "_f": instant, "_b": block}).withColumn("_c", coarse)
    cells = placed.groupBy("_p", "_c", "_f", "_b").agg(F.count("*").alias("_n"))
    so_far = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    minutes = cells.groupBy("_p", "_c").agg(F.sum("_n").alias("_n")).withColumn("_whole", so_far(Window.partitionBy("_p").orderBy("_c"))).drop("_n")
    before = cells.withColumn("_part", so_far(Window.partitionBy("_p", "_c").orderBy("_f", "_b"))).join(minutes, ["_p", "_c"])
    ranked = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_p", "_c", "_f", "_b").orderBy(*order)))
    joined = ranked.join(before.drop("_n"), ["_p", "_c", "_f", "_b"])
    return joined.select(*rows.columns, (F.col("_r") + F.col("_part") + F.col("_whole")).alias("no"))


def alert_kpis(found: DataFrame) -> DataFrame:
    status, s = F.col("status"), F.col("severity")
    return found.agg(F.count("*").alias("total"), *[F.count_if(status == x).alias(x) for x in ("open", "acknowledged", "resolved")], F.count_if(s == "critical").alias("critical"), F.count_if(s == "high").alias("high"))


def alert_filter(found: DataFrame, status: str | None = None, severity: str | None = None, kind: str | None = None) -> DataFrame:
    for name, value in (("status", status), ("severity", severity), ("ioc_type", kind)):
        found = found if value is None else found.filter(F.col(name) == value)
    return found


def alert_transitions(found: DataFrame, log: DataFrame) -> DataFrame:
    """`found` after a log of (alert_id, at, status): steps open, acknowledged, resolved only go forward; acknowledged_at is stamped."""
    rank = F.array_position(T.literals(["open", "acknowledged", "resolved"]), F.col("status"))
    last = log.withColumn("rank", rank).filter("rank > 0").groupBy("alert_id").agg(F.max("rank").alias("rank"), F.min(F.when(F.col("status") == "acknowledged", F.col("at"))).alias("acknowledged_at"))
    named = F.get(T.literals(["open", "acknowledged", "resolved"]), (F.col("rank") - 1).cast("int"))
    return found.join(last, "alert_id", "left").withColumn("status", F.coalesce(named, "status")).drop("rank")


def cve_kpis(events: DataFrame) -> DataFrame:
    return events.filter("ioc_type = 'cve'").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in LEVELS])
