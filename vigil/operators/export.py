"""Exports: detection rules, CSV, JSON, text lists, blocklists, tickets. Each gives lines or documents, one a row."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T
from .stats import number_rows

CSV_HEADER = "IOC Type,IOC Value,Severity,Confidence,Source,Threat Type,Event Time,Description"
FIRST_SID = 9_000_000


def _said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _rules(events: DataFrame, kinds: list[str], body) -> DataFrame:
    rows = number_rows(events.filter(F.col("ioc_type").isin(kinds)), ["event_time", "event_id"]).withColumn("sid", F.col("no") + (FIRST_SID - 1))
    said = _said("CTI ", F.upper("ioc_type"), ": ", F.col("source_name"))
    return rows.select("sid", "event_id", body(said, _said("; sid:", F.col("sid").cast("string"), "; rev:1;)")).alias("rule"))


def suricata(events: DataFrame) -> DataFrame:
    """`sid`, `event_id`, `rule` of every ip, domain and url, numbered in order of time."""
    v, kind = F.col("ioc_value"), F.col("ioc_type")

    def body(said: Column, tail: Column) -> Column:
        head = _said(' any -> any any (msg:"', said, '"')
        return (
            F.when(kind == "ip", _said("alert ip ", v, head, tail))
            .when(kind == "domain", _said("alert dns any", head, '; dns.query; content:"', v, '"; nocase', tail))
            .otherwise(_said("alert http any", head, '; http.host; content:"', T.url_host(v), '"; nocase', tail))
        )

    return _rules(events, ["ip", "domain", "url"], body)


def snort(events: DataFrame) -> DataFrame:
    """`sid`, `event_id`, `rule` of every ip and domain; a domain has its length as at least two hex digits."""
    v, kind = F.col("ioc_value"), F.col("ioc_type")

    def body(said: Column, tail: Column) -> Column:
        size = F.lower(F.hex(F.length(v)))
        size = F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size)
        return F.when(kind == "ip", _said("alert ip ", v, ' any <> any any (msg:"', said, '"', tail)).otherwise(_said('alert udp any any -> any 53 (msg:"', said, '"; content:"|', size, "|", v, '"; nocase', tail))

    return _rules(events, ["ip", "domain"], body)


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(events: DataFrame, keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    line = F.concat_ws(
        ",", "ioc_type", quoted(F.col("ioc_value")), F.coalesce("severity", F.lit("low")), F.coalesce("confidence", F.lit(0)).cast("string"), "source_name",
        F.array_join(F.coalesce("threat_types", T.literals([])), ";"), F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), quoted(F.col("description")),
    )
    return events.select(*keep, line.alias("line"))


def json_documents(events: DataFrame, keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    doc = F.struct(F.col("ioc_type").alias("type"), F.col("ioc_value").alias("value"), "severity", "confidence", F.col("source_name").alias("source"), F.col("threat_types").alias("threat_type"), F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss").alias("event_time"), "description")
    return events.select(*keep, F.to_json(doc).alias("document"))


def text_list(events: DataFrame) -> DataFrame:
    """`ioc_type`, `n`, `ioc_value`: one row a value with its type's count, so that no list is gathered into one row."""
    counts = events.groupBy("ioc_type").agg(F.count("*").alias("n"))
    return events.select("ioc_type", "ioc_value", "event_id").join(counts, "ioc_type")


def blocklist(events: DataFrame) -> DataFrame:
    """The distinct ip and domain values of high or critical severity."""
    return events.filter(F.col("ioc_type").isin("ip", "domain") & F.col("severity").isin("high", "critical")).select("ioc_type", "ioc_value").distinct()


def document(lines: DataFrame, order: list[str], header: list[str], column: str = "line", sep: str = "", footer: list[str] = ()) -> DataFrame:
    """`no`, `line` of a whole text file: the header's lines (from no 0 down), the rows in order, the footer.

    `sep` is put before each row but the first. No line is gathered: the file is the lines in order of `no`.
    """
    spark = lines.sparkSession
    numbered = number_rows(lines, order)
    body = numbered.select("no", F.concat(F.when(F.col("no") > 1, sep).otherwise(""), F.col(column)).alias("line"))
    ends = [(i - len(header) + 1, x) for i, x in enumerate(header)] + [((1 << 62) + i, x) for i, x in enumerate(footer)]
    return spark.createDataFrame(ends, "no long, line string").unionByName(body)


def csv_document(events: DataFrame) -> DataFrame:
    return document(csv_lines(events, ("event_id", "event_time")), ["event_time", "event_id"], [CSV_HEADER])


def json_document(rows: DataFrame, order: list[str], meta: dict, column: str = "document", name: str = "events") -> DataFrame:
    """One JSON object: `meta`, then an array of the rows' documents, one a line. `total` is counted."""
    meta = json.dumps(meta | {"total": rows.count()}, ensure_ascii=False)
    return document(rows, order, ["{", f'"meta": {meta},', f'"{name}": ['], column, ",", ["]", "}"])


def stats_document(events: DataFrame, order: list[str]) -> DataFrame:
    """The normalised feed: `stats` (all, and by severity) and the events' documents."""
    counts = events.groupBy("severity").agg(F.count("*").alias("n")).collect()  # at most a row a level
    by = {s: 0 for s in ("critical", "high", "medium", "low", "clean")} | {r.severity: r.n for r in counts}
    stats = json.dumps({"totalEvents": sum(by.values()), "bySeverity": by})
    rows = json_documents(events, ("event_id", "event_time"))
    return document(rows, order, ["{", f'"stats": {stats},', '"events": ['], "document", ",", ["]", "}"])


def predictions_document(found: DataFrame, chart: DataFrame, date_range: tuple[str, str], k: int = 5) -> DataFrame:
    """One row: the predictions, the steepest increases, their summary and the forecast chart as JSON. Types and days bound its size."""
    item = F.struct(*[c for c in found.columns if c != "total"])
    steep = F.filter(F.sort_array(F.collect_list(F.struct((-F.abs("slope")).alias("key"), "threat_type", item.alias("item")))), lambda x: F.lit(True))
    up = F.sort_array(F.collect_list(F.when(F.col("direction") == "increasing", F.struct((-F.col("change_percent")).alias("key"), "threat_type", item.alias("item")))))
    counts = F.struct(F.count("*").alias("total"), *[F.count_if(F.col("direction") == d).alias(d) for d in ("increasing", "decreasing", "stable")])
    items = lambda c, n: F.transform(F.slice(c, 1, n), lambda x: x["item"])
    one = found.agg(items(steep, k).alias("predictions"), items(up, 3).alias("top_increasing"), counts.alias("summary"), F.lit(1).alias("one"))
    lines = chart.agg(F.sort_array(F.collect_list(F.struct("threat_type", "day", "segment", "value"))).alias("forecast_chart"), F.lit(1).alias("one"))
    meta = F.struct(F.struct(F.lit(date_range[0]).alias("from"), F.lit(date_range[1]).alias("to")).alias("date_range")).alias("meta")
    return one.join(lines, "one").select(F.to_json(F.struct(meta, "predictions", "top_increasing", "summary", "forecast_chart")).alias("document"))


def rule_document(rules: DataFrame, name: str) -> DataFrame:
    """A rule file: name and number of rules, then the rules by sid."""
    return document(rules, ["sid"], [f"# {name} Rules Export", f"# Total Rules: {rules.count()}", ""], "rule")


def text_document(events: DataFrame) -> DataFrame:
    """`part`, `no`, `line`: the values by type under a line with the type and its number, all under one with their total."""
    rows = events.select("ioc_type", "ioc_value", "event_id")
    counts = rows.groupBy("ioc_type").agg(F.count("*").alias("n"))
    heads = counts.select(F.col("ioc_type").alias("part"), F.lit(0).cast("long").alias("no"), _said("## ", F.upper("ioc_type"), " (", F.col("n").cast("string"), ")").alias("line"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("").alias("part"), F.lit(0).cast("long").alias("no"), _said("# Total IOCs: ", F.col("n").cast("string")).alias("line"))
    numbered = number_rows(rows, ["event_id"], F.col("ioc_type")).select(F.col("ioc_type").alias("part"), "no", F.col("ioc_value").alias("line"))
    return total.unionByName(heads).unionByName(numbered)


def blocklist_document(events: DataFrame) -> DataFrame:
    """`part`, `line`: the distinct values under their headers, which count what they came from."""
    listed = events.filter(F.col("ioc_type").isin("ip", "domain") & F.col("severity").isin("high", "critical"))
    name = F.when(F.col("ioc_type") == "ip", "# IP Addresses (").otherwise("# Domains (")
    heads = listed.groupBy("ioc_type").agg(F.count("*").alias("n")).select(F.concat("ioc_type", F.lit("-0")).alias("part"), F.concat(name, F.col("n").cast("string"), F.lit(")")).alias("line"))
    return heads.unionByName(blocklist(events).select(F.concat("ioc_type", F.lit("-1")).alias("part"), F.col("ioc_value").alias("line")))


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def tickets(scored: DataFrame, prefix: str = "TKT") -> DataFrame:
    """A ticket for every row: number by day, title, priority, category and body."""
    risk = F.coalesce(F.nullif(F.col("risk_score"), F.lit(0)), F.lit(50))
    severity = F.coalesce(F.nullif(F.col("severity_ai"), F.lit("")), F.lit("medium"))
    types, actors = F.coalesce("threat_types", T.literals([])), F.coalesce("actors", T.literals([]))
    joined = lambda c, k, empty: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, k) if k else c, ", ")).otherwise(empty)
    title = F.format_string("[%s] %s - %s: %s", F.upper(severity), joined(types, 2, "Unknown Threat"), "ioc_type", F.substring("ioc_value", 1, 50))
    body = F.concat_ws(
        "\n", F.lit("## Threat Intelligence Alert"), F.lit(""), _said("**IOC Value:** `", F.col("ioc_value"), "`"), _said("**IOC Type:** ", F.col("ioc_type")), _said("**Risk Score:** ", risk.cast("string"), "/100"),
        _said("**Severity:** ", F.upper(severity)), F.lit(""), _said("**Threat Types:** ", joined(types, 0, "Not classified")), _said("**Threat Actors:** ", joined(actors, 0, "Unknown")), F.lit(""),
        F.lit("## Description"), F.coalesce("description", F.lit("")),
    )
    day = F.date_format("event_time", "yyyyMMdd")
    scored = number_rows(scored, ["event_time", "event_id"], F.to_date("event_time"))
    priority = F.when(F.lower(severity).isin("critical", "high", "medium", "low"), F.lower(severity)).otherwise("medium")
    return scored.select(F.format_string("%s-%s-%04d", F.lit(prefix), day, F.col("no")).alias("ticket_id"), "event_id", title.alias("title"), priority.alias("priority"), F.when(F.size(types) > 0, "threat").otherwise("incident").alias("category"), risk.alias("risk"), body.alias("body"))


def write_tickets(found: DataFrame, path: str) -> None:
    audited(found).write.mode("append").text(path)


def translated_term(label: Column) -> Column:
    """A label's Thai term from the small dictionary; itself where it has none."""
    return F.coalesce(T.lookup(dims.TERMS, F.lower(label)), label)


def audited(found: DataFrame) -> DataFrame:
    """The tickets' log lines: id, event and what was asked for, as JSON."""
    return found.select(F.to_json(F.struct("ticket_id", "event_id", "title", "priority", "category", "risk")).alias("value"))


def factor_max(name: Column) -> Column:
    return F.coalesce(T.lookup(dims.FACTOR_MAX, name), F.lit(25))
