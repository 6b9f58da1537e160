"""JSON event files of several shapes, read as variants and projected to a fixed schema.

Shapes: `hits.hits[]._source`, `hits[]` (`_source` or the element), `events[]`, `data[]`, a single object with
`ioc`, a top-level array, and search results flattened to `fields` (each value in an array). Files that are
not JSON or have no events go to quarantine; a missing folder is the caller's to check.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search
from ..plans import pipeline


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def raw_files(spark: SparkSession, path, glob: str = "*.json", exclude: list[str] = ()) -> DataFrame:
    """`file`, `v` (the parsed file, null if it isn't JSON) of every file, one a row; `file` is what gives them an order."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"))
    return files.filter(~F.col("file").isin(list(exclude))) if exclude else files


def split_events(files: DataFrame) -> DataFrame:
    """`file`, `pos`, `event` (variant) of every event, and one row with a null event for a file without any."""
    v = F.col("v")
    arrays = [_get(v, p, "array<variant>") for p in ("$.hits.hits", "$.hits", "$.events", "$.data", "$")]
    single = F.when(_get(v, "$.ioc", "variant").isNotNull(), F.array(v))
    rows = files.select("file", F.posexplode_outer(F.coalesce(*arrays, single)).alias("pos", "e"))
    return rows.select("file", "pos", F.coalesce(_get(F.col("e"), "$._source", "variant"), _get(F.col("e"), "$.fields", "variant"), "e").alias("event"))


def quarantine(events: DataFrame) -> DataFrame:
    """The files without events, and the events without an indicator's value."""
    return events.filter(F.coalesce(_value(F.col("event"), "$.ioc.value", "$['ioc.value'][0]"), F.lit("")) == "").select("file", "pos")


def _value(e: Column, *paths: str) -> Column:
    return F.coalesce(*[_get(e, p) for p in paths])


def _list(e: Column, path: str, flat: str) -> Column:
    """An array of strings; a non-empty string becomes an array of one."""
    text = F.nullif(_get(e, path), F.lit(""))
    text = F.when(~F.startswith(text, F.lit("[")) & ~F.startswith(text, F.lit("{")), F.array(text))
    return F.coalesce(_get(e, path, "array<string>"), _get(e, flat, "array<string>"), text, T.literals([]))


def threat_events(events: DataFrame) -> DataFrame:
    """The silver table: one fixed row for every event that has an indicator's value."""
    e = F.col("event")
    both = lambda name: _value(e, f"$.{name}", f"$['{name}'][0]")
    text = lambda c, default="": F.coalesce(c, F.lit(default))
    who = "$.enrichment.whois"
    country = [
        _get(e, "$.enrichment.ip_info.country"), _get(e, "$.enrichment.ip_info.asn_data.country"), _get(e, "$.enrichment.ip_info.asn_data.country_code"),
        _get(e, f"{who}.country"), _get(e, f"{who}.registrant_country"), _get(e, f"{who}.admin_country"), _get(e, f"{who}.tech_country"),
    ]
    related = "$.enrichment.related_entities"
    size = F.regexp_extract(F.coalesce(_get(e, "$.enrichment.file.size"), F.lit("")), r"\((\d+) bytes", 1)
    ioc = _value(e, "$.ioc.value", "$['ioc.value'][0]")
    out = events.select(
        "file", "pos", ioc.alias("ioc_value"), text(_value(e, "$.ioc.type", "$['ioc.type'][0]"), "unknown").alias("ioc_type"),
        text(both("source_name"), "unknown").alias("source_name"), text(both("source_type"), "unknown").alias("source_type"), text(both("description")).alias("description"),
        F.filter(_list(e, "$.threat_type", "$['threat_type']"), lambda x: x != "").alias("threat_types"), T.severity(both("severity")).alias("severity"),
        T.confidence(F.coalesce(_get(e, "$.confidence", "int"), _get(e, "$['confidence'][0]", "int"))).alias("confidence"), _list(e, "$.tags", "$['tags']").alias("tags"), text(both("reference")).alias("reference"), text(both("source_url")).alias("source_url"),
        T.timestamp(both("event_time")).alias("event_time"), T.timestamp(both("collect_time")).alias("collect_time"), both("event_time").alias("event_time_raw"),
        text(_get(e, "$.geo_info.country")).alias("geo_country"), F.array(*country).alias("country_paths"), _list(e, "$.ioc.related_domain", "$['ioc.related_domain']").alias("related_domains"), _list(e, "$.ioc.related_hash", "$['ioc.related_hash']").alias("related_hashes"),
        _list(e, f"{related}.threat_actor", "$['none']").alias("related_actors"), _list(e, f"{related}.malware_family", "$['none']").alias("malware_families"), _list(e, f"{related}.campaign", "$['none']").alias("campaigns"),
        T.domain_age_days(_get(e, f"{who}.creation_date"), _get(e, "$.enrichment.events.registration")).alias("domain_age_days"), _get(e, f"{who}.registrant_name").alias("registrant"),
        F.coalesce(_get(e, "$.enrichment.asn.org"), _get(e, "$.enrichment.ip_info.asn_data.org"), _get(e, "$.enrichment.ip_info.asn_data.name")).alias("network"), F.nullif(size, F.lit("")).cast("long").alias("file_bytes"),
        _get(e, "$.enrichment.categories", "map<string,string>").alias("categories"), _get(e, "$.enrichment", "variant").alias("enrichment"), F.lit(False).alias("ai_processed"),
    )
    return out.filter(F.coalesce("ioc_value", F.lit("")) != "")


def read(spark: SparkSession, path, glob: str = "*.json", exclude: list[str] = ()) -> DataFrame:
    return threat_events(split_events(raw_files(spark, path, glob, exclude)))


def available(spark: SparkSession, path, glob: str = "*.json", exclude: list[str] = ()) -> DataFrame | None:
    """The events of a folder or file; null if it doesn't exist."""
    try:
        return read(spark, path, glob, exclude)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_events(spark: SparkSession, gold: str | None, silver, bronze, limit: int | None = None) -> tuple[str, DataFrame]:
    """The name of the best layer that has events, and they: the warehouse table, else the normalised file, else the raw files."""
    warehouse = None if gold is None else pipeline.current(spark, gold)
    for name, found in (("gold", lambda: None if warehouse is None else search.from_warehouse(warehouse)), ("silver", lambda: available(spark, silver)), ("bronze", lambda: available(spark, bronze))):
        rows = found()
        if rows is not None and not rows.isEmpty():
            return name, rows if limit is None else rows.limit(limit)
    return "none", threat_events(split_events(spark.createDataFrame([], "file string, v variant")))


def predictions_feed(spark: SparkSession, path) -> DataFrame:
    """`threat_type`, `slope`, `direction`, `change_percent`, `alert_level` of a predictions document."""
    item = "threat_type string, slope double, direction string, change_percent double, prediction_7d double, alert_level string"
    rows = spark.read.json(path, multiLine=True, schema=f"predictions array<struct<{item}>>")
    return rows.select(F.inline("predictions"))


def sectors_feed(spark: SparkSession, path) -> DataFrame:
    """`id`, `name`, `criticalLevel`, `ordinal` of a document of sectors, or a list of them."""
    item = "array<struct<id:string,name:string,criticalLevel:int>>"
    v = F.try_parse_json("value")
    rows = spark.read.text(path, wholetext=True).select(F.coalesce(_get(v, "$.sectors", item), _get(v, "$", item)).alias("s"))
    return rows.select(F.posexplode("s").alias("ordinal", "x")).select("x.*", "ordinal")


def actor_file(spark: SparkSession, path) -> DataFrame:
    """`name`, `aliases` of an actor dictionary file."""
    rows = spark.read.json(path, multiLine=True, schema="threat_actors array<struct<name:string,aliases:array<string>>>")
    return rows.select(F.explode("threat_actors").alias("a")).select("a.*")
