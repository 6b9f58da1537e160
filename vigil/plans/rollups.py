"""Dashboard figures kept up to date: partial states a batch, merged when they are read.

A batch of events becomes a small table of (dimension, key) with a count, a sum of risk and a sketch of the distinct indicators.
Counts and sums add up, sketches unite, so states of any batches in any order give what a recount of all events gives;
distinct indicators are estimated, with an error that LG_K sets. A repeated batch replaces its state. What a figure costs
follows the number of keys, not of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import pipeline

#: Sketches have 2 ** LG_K cells: a relative standard error of 1.04 / 2 ** (LG_K / 2), here 0.8 %.
LG_K = 14
#: Batches after which their states are merged into one.
MERGE = 16
ALL = "all"


def states(events: DataFrame) -> DataFrame:
    """`dimension`, `key`, `n`, `risk_n`, `risk`, `indicators`: the state of a batch, by type, severity, source, threat type, day, and of all.

    Null types and sources count as unknown, null severities as low, as the dashboard has them; empty threat types and
    rows without a time have no key there. `risk` sums `risk_score` where there is one.
    """
    one = lambda name, key: F.struct(F.lit(name).alias("dimension"), key.alias("key"))
    types = F.filter(F.coalesce("threat_types", T.literals([])), lambda t: t != "")
    keys = [
        one(ALL, F.lit("")), one("type", F.coalesce("ioc_type", F.lit("unknown"))), one("severity", F.coalesce("severity", F.lit("low"))), one("source", F.coalesce("source_name", F.lit("unknown"))),
        one("day", F.date_format("event_time", "yyyy-MM-dd")),
    ]
    risk = F.col("risk_score").cast("long") if "risk_score" in events.columns else F.lit(None).cast("long")
    indicator = F.xxhash64("ioc_type", "ioc_value")
    rows = events.select(indicator.alias("indicator"), risk.alias("risk"), F.explode(F.concat(F.array(*keys), F.transform(types, lambda t: one("threat_type", t)))).alias("k")).filter("k.key is not null")
    return rows.groupBy("k.dimension", "k.key").agg(F.count("*").alias("n"), F.count("risk").alias("risk_n"), F.coalesce(F.sum("risk"), F.lit(0)).cast("long").alias("risk"), F.hll_sketch_agg("indicator", F.lit(LG_K)).alias("indicators"))


def merged(parts: DataFrame) -> DataFrame:
    """States of several batches as one."""
    return parts.groupBy("dimension", "key").agg(*[F.sum(c).alias(c) for c in ("n", "risk_n", "risk")], F.hll_union_agg("indicators").alias("indicators"))


def add(table: str, events: DataFrame, version: int) -> None:
    """Adds the state of a batch; the same version again replaces it. Every MERGE batches they are merged into the state of the last.

    A version that has been merged already is left out, so a batch that is repeated after that changes nothing.
    """
    spark = events.sparkSession
    base = max((int(x.removeprefix("upto=")) for x in pipeline.folders(spark, f"{table}/merged")), default=-1)
    if version <= base:
        return
    states(events).write.mode("overwrite").parquet(f"{table}/batches/batch={version}")
    waiting = [v for x in pipeline.folders(spark, f"{table}/batches") if (v := int(x.removeprefix("batch="))) > base]
    if len(waiting) >= MERGE:
        current(spark, table).write.mode("overwrite").parquet(f"{table}/merged/upto={max(waiting)}")
        # the merge before stays for those who still read it
        for old in sorted(int(x.removeprefix("upto=")) for x in pipeline.folders(spark, f"{table}/merged"))[:-2]:
            pipeline.remove(spark, f"{table}/merged/upto={old}")
        for old in (v for x in pipeline.folders(spark, f"{table}/batches") if (v := int(x.removeprefix("batch="))) <= base):
            pipeline.remove(spark, f"{table}/batches/batch={old}")


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The state of all batches so far; None if there are none."""
    base = max((int(x.removeprefix("upto=")) for x in pipeline.folders(spark, f"{table}/merged")), default=-1)
    parts = pipeline.read(spark, f"{table}/batches")
    parts = None if parts is None else parts.filter(F.col("batch") > base).drop("batch")
    whole = pipeline.read(spark, f"{table}/merged/upto={base}") if base >= 0 else None
    both = parts if whole is None else whole if parts is None else whole.unionByName(parts)
    return None if both is None else merged(both)


def roll(stream: DataFrame, table: str, checkpoint: str):
    """Keeps the states of a stream of events."""

    def write(batch: DataFrame, batch_id: int) -> None:
        add(table, batch, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dashboard_counts(state: DataFrame) -> DataFrame:
    """As stats.dashboard_counts."""
    return state.filter(F.col("dimension").isin("type", "severity", "source")).select("dimension", "key", "n")


def average_risk(state: DataFrame) -> DataFrame:
    """As stats.average_risk: by type, and over all (type null)."""
    rows = state.filter(F.col("dimension").isin(ALL, "type"))
    return rows.select(F.when(F.col("dimension") == "type", F.col("key")).alias("ioc_type"), F.round(F.try_divide("risk", "risk_n"), 6).alias("avg_risk"), "n")


def top_items(state: DataFrame, dimension: str, k: int = 10) -> DataFrame:
    """`key`, `n`: the k most frequent, ties by key."""
    return state.filter(F.col("dimension") == dimension).orderBy(F.desc("n"), "key").limit(k).select("key", "n")


def summary(state: DataFrame) -> DataFrame:
    """One row: events, those of critical or high severity, sources, types, and the estimated number of distinct indicators."""
    d = F.col("dimension")
    some = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0))
    indicators = F.coalesce(F.max(F.when(d == ALL, F.hll_sketch_estimate("indicators"))), F.lit(0))
    return state.agg(some(d == ALL).alias("total"), some((d == "severity") & F.col("key").isin("critical", "high")).alias("critical_high"), F.count_if(d == "source").alias("sources"), F.count_if(d == "type").alias("types"), indicators.alias("indicators"))
