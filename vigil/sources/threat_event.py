"""Threat events as a deterministic projection of the `events` table.

The synthetic tables have no threat vocabulary; this gives every event an indicator, sources, a description
from fixed templates and ages, with expressions that mean the same in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T

#: Rows of events that one task scores, some ten seconds' work.
TASK_ROWS = 100_000


def pick(values: list, index: Column) -> Column:
    return F.get(T.literals(values), index.cast("int"))


def threat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(dealt(spark.read.parquet(f"{sf_dir}/events.parquet")))


def partition_counts(rows: DataFrame) -> list[int]:
    """The rows of each partition that has any. Counting reads no column."""
    return [r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


def dealt(rows: DataFrame) -> DataFrame:
    """`rows`, dealt out evenly if one partition has over twice its share, as of a file of few row groups or of a small file.

    A partition's share is at most TASK_ROWS, so that a table's growth makes more tasks, not longer ones.
    """
    counts = partition_counts(rows)
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-sum(counts) // TASK_ROWS))
    return rows.repartition(parts) if max(counts, default=0) * parts > 2 * sum(counts) else rows


def project(events: DataFrame) -> DataFrame:
    """One threat event for each row of `events` (event_id, ts, user_id, event_type, value)."""
    user, event = F.col("user_id"), F.col("event_id")
    h = F.md5(user.cast("string"))
    kinds = ["domain", "ip", "url", "sha256", "sha1", "md5", "cve"]
    values = [
        F.concat(F.substring(h, F.lit(1), (4 + user % 12).cast("int")), F.lit(".example.com")),
        F.concat_ws(".", F.lit("10"), (user % 256).cast("string"), (user % 7).cast("string"), (user % 250).cast("string")),
        F.concat(F.lit("https://"), F.substring(h, 1, 8), F.lit(".example.net/p/"), user.cast("string")),
        F.concat(h, h), F.concat(h, F.substring(h, 1, 8)), h,
        F.concat(F.lit("CVE-2024-"), F.lpad(user.cast("string"), 4, "0")),
    ]
    value = F.when(F.lit(False), "")
    for i, v in enumerate(values):
        value = value.when(event % 7 == i, v)
    first = event + user
    names = F.transform(F.sequence(F.lit(0), (event % 4).cast("int")), lambda i: F.get(T.literals(dims.EVENT_SOURCES), ((first + i) % 12).cast("int")))
    severities = {"error": "Very High", "purchase": "high", "click": " Medium ", "view": "low"}
    no = (event * 7 + user) % 16
    types = F.get(F.array(*[T.literals(t) for _, t, _ in dims.TEMPLATES]), no.cast("int"))
    out = events.select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("event_time"), pick(kinds, event % 7).alias("ioc_type"), value.alias("ioc_value"),
        pick(dims.EVENT_SOURCES, first % 12).alias("source_name"), names.alias("sources"), F.coalesce(T.lookup(severities, F.col("event_type")), F.lit("")).alias("severity_raw"),
        F.floor("value").cast("int").alias("confidence_raw"), no.cast("int").alias("tmpl"), pick([t for t, _, _ in dims.TEMPLATES], no).alias("description"), types.alias("threat_types"),
        pick([c for _, _, c in dims.TEMPLATES], no).alias("ai_confidence"), F.when(user % 5 != 0, (user * 13) % 500).cast("int").alias("domain_age_days"),
        F.when(event % 11 != 0, event % 250).cast("int").alias("ioc_age_days"), pick(dims.EVENT_COUNTRIES, user % 9).alias("country_code"),
        F.array(F.col("event_type"), F.concat(F.lit("tmpl-"), no.cast("string"))).alias("tags"), pick(dims.EVENT_REGISTRANTS, user % 4).alias("registrant"), pick(dims.EVENT_NETWORKS, user % 5).alias("network"),
        F.concat(F.lit("https://www."), pick(list(dims.NEWS_SITES), event % 3), F.lit("/2024/"), pick(["big-breach", "zero_day-patch", "index"], user % 3), F.when(user % 2 == 0, ".html").otherwise("")).alias("reference"),
    )
    out = out.withColumns({"severity": T.severity(F.col("severity_raw")), "confidence": T.confidence(F.col("confidence_raw"))})
    return out.withColumns({"actors": T.threat_actors(F.col("description")), "techniques": T.mitre_techniques(F.col("description"))})
