"""Search over the gold table: filters, token match, paging, point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T
from . import textindex


def substring_match(query: str, columns: list[str], arrays: list[str] = ()) -> Column:
    q = query.lower()
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q))
    for c in arrays:
        out = out | F.exists(F.coalesce(F.col(c), T.literals([])), lambda x: F.contains(F.lower(x), F.lit(q)))
    return out


def token_match(query: str, columns: list[str], exact: list[str] = ()) -> Column:
    """Any token of the query among a column's tokens, or a column in `exact` equal to the query."""
    cut = r"[^\p{L}\p{N}]+"
    wanted = F.filter(F.split(F.lit(query.lower()), cut), lambda t: t != "")
    out = F.lit(False)
    for c in columns:
        out = out | F.arrays_overlap(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), cut), wanted)
    for c in exact:
        out = out | (F.coalesce(F.col(c), F.lit("")) == F.lit(query))
    return out


def relevance(query: str, fields: dict[str, float]) -> Column:
    """The sum of the fields' boosts over which the query matches: a token in a text field, or the whole query in `ioc_value` or as an element of an array."""
    cut = r"[^\p{L}\p{N}]+"
    wanted = F.filter(F.split(F.lit(query.lower()), cut), lambda t: t != "")
    out = F.lit(0.0)
    for name, boost in fields.items():
        if name == "description":
            hit = F.arrays_overlap(F.split(F.lower(F.coalesce(F.col(name), F.lit(""))), cut), wanted)
        elif name == "ioc_value":
            hit = F.coalesce(F.col(name), F.lit("")) == F.lit(query)
        else:
            hit = F.array_contains(F.coalesce(F.col(name), T.literals([])), query)
        out = out + F.when(hit, boost).otherwise(0.0)
    return out


#: Fields of the relevance search and their boosts.
FIELDS = {"ioc_value": 3.0, "description": 1.0, "tags": 1.0, "threat_types": 1.0, "actors": 1.0}


def relevant(events: DataFrame, query: str, fields: dict[str, float] = FIELDS) -> DataFrame:
    """The events that the query meets in any field, with their `relevance`."""
    return events.withColumn("relevance", relevance(query, fields)).filter("relevance > 0")


def index_events(events: DataFrame, path: str) -> None:
    """Writes the inverted index of the fields of the relevance search."""
    keywords = {c: F.coalesce(F.array(F.nullif(F.col(c), F.lit(""))) if c == "ioc_value" else F.col(c), T.literals([])) for c in FIELDS if c != "description"}
    textindex.index_table(events, path, "event_id", {"description": F.col("description")}, keywords)


def ranked(spark: SparkSession, path: str, query: str, k: int | None = 50, fields: dict[str, float] = FIELDS) -> DataFrame:
    """`event_id` and `score` of the k best events of an index: BM25, of the best field; the description by words, the others by the whole query."""
    found = textindex.ranked(spark, path, query, fields, keywords={c for c in fields if c != "description"}, k=k)
    return found.withColumnRenamed("id", "event_id")


def search(
    events: DataFrame, q: str | None = None, types=None, severities=None, sources=None, threat_type: str | None = None, actor: str | None = None,
    since: str | None = None, until: str | None = None, tokens: bool = False, scored_severity: bool = False,
) -> DataFrame:
    """The events that meet all given conditions; equality, lists and ranges reach the scan.

    With `scored_severity` the severity is that of the score where there is one (`severity_ai`), else the event's.
    """
    out, level = events, F.col("severity")
    if scored_severity:
        level = F.coalesce(F.nullif(F.col("severity_ai"), F.lit("")), level)
    for column, values in ((F.col("ioc_type"), types), (level, severities), (F.col("source_name"), sources)):
        if values:
            out = out.filter(column.isin([values] if isinstance(values, str) else list(values)))
    for column, value in (("threat_types", threat_type), ("actors", actor)):
        out = out if value is None else out.filter(F.array_contains(column, value))
    out = out if since is None else out.filter(F.col("event_time") >= F.lit(since).cast("timestamp"))
    out = out if until is None else out.filter(F.col("event_time") <= F.lit(until).cast("timestamp"))
    if q:
        match = token_match(q, ["description"], ["ioc_value"]) if tokens else substring_match(q, ["ioc_value", "description"], ["tags"])
        out = out.filter(match)
    return out


def page(events: DataFrame, limit: int = 50, offset: int = 0, by: str | None = "risk_score") -> DataFrame:
    """A page in descending order, newer first on ties, then by id; with `by` None in order of ids."""
    order = ["event_id"] if by is None else [F.desc(by), F.desc("event_time"), "event_id"]
    return events.orderBy(*order).offset(offset).limit(limit)


def limited(found: DataFrame, limit: int = 100) -> DataFrame:
    """The first `limit` of the events found, by id, with the `total` before the limit."""
    return page(found, limit, by=None).withColumn("total", F.lit(found.count()))


def from_warehouse(rows: DataFrame) -> DataFrame:
    """Warehouse rows as events: what is missing or empty is taken from the next column that may hold it, or from a default."""
    has = lambda c, kind="string": F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    text = lambda *cs: F.coalesce(*[F.nullif(has(c), F.lit("")) for c in cs])
    time = lambda *cs: F.coalesce(*[has(c, "timestamp") for c in cs])
    some = lambda *cs: F.coalesce(*[has(c, "array<string>") for c in cs], T.literals([]))
    return rows.select(
        F.coalesce(text("source_type"), F.lit("unknown")).alias("source_type"), F.coalesce(text("source_name"), F.lit("unknown")).alias("source_name"),
        time("last_seen", "processed_at").alias("collect_time"), time("first_seen", "event_time").alias("event_time"), some("threat_type", "ai_threat_types").alias("threat_types"),
        F.coalesce(text("ai_severity", "severity"), F.lit("low")).alias("severity"), F.coalesce(has("ai_confidence", "double"), F.lit(0.0)).alias("confidence"), "ioc_type", "ioc_value",
        F.coalesce(text("description"), F.lit("")).alias("description"), some("tags").alias("tags"), F.lit("active").alias("status"), has("risk_score", "int").alias("risk_score"), has("ai_severity").alias("severity_ai"),
        some("ai_threat_actors").alias("actors"), some("ai_mitre_techniques").alias("techniques"),
    )


def related(events: DataFrame, value: str) -> DataFrame:
    """Events whose value, related domain or related hash is `value`, any case."""
    v = value.lower()
    match = F.lower("ioc_value") == v
    for c in ("related_domains", "related_hashes"):
        if c in events.columns:
            match = match | F.exists(F.coalesce(F.col(c), T.literals([])), lambda x: F.lower(x) == v)
    return events.filter(match)


def point(events: DataFrame, kind: str, value: str) -> DataFrame:
    return events.filter((F.col("ioc_type") == kind) & (F.col("ioc_value") == value))


def indicator_detail(events: DataFrame, kind: str, value: str, score_col: str = "risk_score") -> DataFrame:
    """One row: the first event's fields, whether a score is pending, the distinct sources."""
    rows = point(events, kind, value)
    first = F.min_by(F.struct("event_id", "event_time", "severity", "description", F.col(score_col).alias("score")), F.struct("event_time", "event_id"))
    out = rows.groupBy("ioc_type", "ioc_value").agg(first.alias("f"), F.sort_array(F.collect_set("source_name")).alias("sources"), F.count("*").alias("n_events"))
    return out.select("ioc_type", "ioc_value", "f.*", F.col("f.score").isNull().alias("pending"), "sources", "n_events")


def needs_scrape(source_name: Column, description: Column) -> Column:
    """News of a site that can be fetched, with a description of fewer than 20 characters."""
    site = T.contains_any(F.lower(F.coalesce(source_name, F.lit(""))), [s.lower() for s in dims.SCRAPABLE_SOURCES])
    return site & (F.length(F.trim(F.coalesce(description, F.lit("")))) < 20)


def needs_analysis(description: Column, title: Column) -> Column:
    return (F.length(F.coalesce(description, F.lit(""))) > 20) | (F.length(F.coalesce(title, F.lit(""))) > 20)


def unprocessed(rows: DataFrame, flag: str = "ai_processed") -> DataFrame:
    return rows.filter(~F.coalesce(F.col(flag), F.lit(False)))


def reusable(records: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The records that the cache already answers (scraped, or described in 20 characters or more), and the rest."""
    usable = cache.filter(F.col("scraped") | (F.length(F.coalesce("description", F.lit(""))) >= 20)).select(*keys).distinct()
    return records.join(usable, keys, "left_semi"), records.join(usable, keys, "left_anti")


def urls_to_classify(events: DataFrame, done: DataFrame, private=("internal", "localhost")) -> DataFrame:
    """`reference`, `ioc_value`, `source_name`, `n`: the indicators of URLs neither classified nor on private domains, one row each, however many a URL has."""
    rows = events.filter("reference <> '' and ioc_value <> ''").filter(~T.contains_any(F.lower("reference"), private))
    found = rows.groupBy("reference", "ioc_value", "source_name").agg(F.count("*").alias("n"))
    return found.join(done.select(F.col("url").alias("reference")).distinct(), "reference", "left_anti")


def with_url_classes(events: DataFrame, classes: DataFrame) -> DataFrame:
    """Events with their URL's classification (url, title, types, actors, confidence) where they lack their own types."""
    joined = events.join(classes.select(F.col("url").alias("reference"), "title", F.col("types").alias("_types"), F.col("url_actors").alias("_actors")), "reference", "left")
    lacks = F.size(F.coalesce("threat_types", T.literals([]))) == 0
    return joined.withColumns({
        "description": F.when(F.coalesce("description", F.lit("")) == "", F.col("title")).otherwise(F.col("description")),
        "ai_confidence": F.when(lacks & F.col("_types").isNotNull(), 0.7).otherwise(F.col("ai_confidence")),
        "threat_types": F.when(lacks, F.coalesce("_types", "threat_types")).otherwise(F.col("threat_types")),
        "actors": F.when(F.size("actors") == 0, F.coalesce("_actors", "actors")).otherwise(F.col("actors")),
    }).drop("title", "_types", "_actors")
