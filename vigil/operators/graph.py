"""The relationship graph of indicators, actors, malware, campaigns, domains and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

OPTIONAL = ["related_actors", "malware_families", "campaigns", "related_domains", "related_hashes"]


def _entries(events: DataFrame) -> DataFrame:
    """One row for every node an event names: its order, the indicator's id, the node, and the link's type and label (null for the indicator itself)."""
    for c in OPTIONAL:
        if c not in events.columns:
            events = events.withColumn(c, F.array().cast("array<string>"))
    ioc = F.concat_ws(":", F.lit("ioc"), "ioc_type", "ioc_value")

    def node(step: int, id: Column, label: Column, kind: str, sub: Column, size: int, link: str | None, said: str | None) -> Column:
        return F.struct(
            F.lit(step).alias("step"), id.alias("id"), label.alias("label"), F.lit(kind).alias("type"), sub.alias("sub_type"), F.lit(size).alias("size"),
            F.lit(link).cast("string").alias("link"), F.lit(said).cast("string").alias("said"),
        )

    none = F.lit(None).cast("string")
    each = lambda c, f: F.transform(F.filter(F.coalesce(F.col(c), T.literals([])), lambda x: x != ""), f)
    actor = lambda step: lambda a: node(step, F.concat(F.lit("actor:"), T.node_id(a)), a, "threat_actor", none, 15, "attributed_to", "attributed to")
    thing = lambda step, p, sub, said: lambda x: node(step, F.concat(F.lit(f"entity:{p}:"), T.node_id(x)), x, "entity", F.lit(sub), 10, "related_to", said)
    domain = lambda d: node(6, F.concat(F.lit("ioc:domain:"), d), T.truncated(d, 25), "domain", F.lit("domain"), 8, "related_to", "related domain")
    hashed = lambda h: node(7, F.concat(F.lit("ioc:hash:"), F.substring(h, 1, 16)), F.concat(F.substring(h, 1, 12), F.lit("...")), "ioc", F.lit("hash"), 8, "contains", "contains hash")
    own = F.array(node(1, ioc, T.truncated(F.col("ioc_value"), 30), "ioc", F.col("ioc_type"), 12, None, None))
    other = F.filter(F.col("related_domains"), lambda d: d != F.col("ioc_value"))
    rows = events.withColumn("related_domains", other)
    entries = F.concat(own, each("actors", actor(2)), each("related_actors", actor(3)), each("malware_families", thing(4, "malware", "malware_family", "uses malware")), each("campaigns", thing(5, "campaign", "campaign", "part of campaign")), each("related_domains", domain), each("related_hashes", hashed))
    severity = F.nullif(F.trim(F.coalesce("severity", F.lit(""))), F.lit(""))
    return rows.select("event_id", ioc.alias("ioc"), severity.alias("severity"), F.explode(entries).alias("e")).select("event_id", "ioc", "severity", "e.*")


def nodes(events: DataFrame) -> DataFrame:
    """`id`, `label`, `type`, `sub_type`, `severity`, `size`: each node as the first event that names it has it."""
    rows = _entries(events)
    order = F.struct("event_id", "step", "label")
    shown = F.struct("label", "type", "sub_type", F.when(F.col("step") == 1, F.col("severity")).alias("severity"), "size")
    return rows.groupBy("id").agg(F.min_by(shown, order).alias("n")).select("id", "n.*")


def links(events: DataFrame) -> DataFrame:
    """`source`, `target`, `type`, `label`: one link for each pair and type whichever way it runs, as first named."""
    rows = _entries(events).filter("link is not null")
    pair = [F.least("ioc", "id").alias("a"), F.greatest("ioc", "id").alias("b"), F.col("link").alias("type")]
    first = F.min_by(F.struct(F.col("ioc").alias("source"), F.col("id").alias("target"), F.col("said").alias("label")), F.struct("event_id", "step", "said", "ioc"))
    return rows.groupBy(*pair).agg(first.alias("l")).select("l.source", "l.target", "type", "l.label")


def focused(events: DataFrame, kind: str, value: str) -> DataFrame:
    return events.filter((F.col("ioc_type") == kind) & (F.col("ioc_value") == value))


def graph_filter(events: DataFrame, mode: str = "all") -> DataFrame:
    """Events for the modes all, with_actors and with_entities."""
    some = lambda c: F.size(F.coalesce(F.col(c), T.literals([]))) > 0 if c in events.columns else F.lit(False)
    conditions = {"all": F.lit(True), "with_actors": some("actors") | some("related_actors"), "with_entities": some("malware_families") | some("campaigns")}
    return events.filter(conditions[mode])


def graph_stats(node_rows: DataFrame, link_rows: DataFrame) -> DataFrame:
    """`metric`, `n`: actors, indicators, entities and links."""
    counts = node_rows.groupBy(F.col("type").alias("metric")).agg(F.count("*").alias("n"))
    return counts.unionByName(link_rows.groupBy(F.lit("links").alias("metric")).agg(F.count("*").alias("n")))
