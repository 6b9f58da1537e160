"""Lake to warehouse: keyed tables, scoring of what is new, status, and the same over a stream.

A table is a folder of Parquet in generations. An upsert writes its batch, one row a key, to a folder of its own,
which a repeated batch replaces; a reader keeps the last row of each key over the generation's base and its
batches. Every COMPACT batches the next generation's base is written from both, and a line added to the
table's list of generations, so a lost job leaves the old one whole, and a batch's cost does not grow
with the table but for its share of the compaction. The generation before the last stays for those who
still read it; older ones are removed.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring, search

KEY = ["ioc_type", "ioc_value"]
COMPACT = 16


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at `path`; null if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def generation(spark: SparkSession, table: str) -> tuple[int, str]:
    """The table's last generation and the folder of its base; 0 and no folder before the first compaction."""
    found = read(spark, f"{table}/generations")
    row = None if found is None else found.orderBy(F.desc("generation"), F.desc("folder")).first()
    return (0, "") if row is None else (row.generation, row.folder)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in `path`; none where there is no such path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in store.listStatus(at) if x.isDirectory()] if store.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def parts(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The rows of the base and of the batches after it (without batch `before`, for one that is repeated); null if there are none."""
    no, base = generation(spark, table)
    batches = read(spark, f"{table}/batches-{no}")
    batches = batches if batches is None or before is None else batches.filter(F.col("batch") != before)
    whole = read(spark, f"{table}/{base}") if base else None
    batches = None if batches is None else batches.drop("batch")
    return batches if whole is None else whole if batches is None else whole.unionByName(batches, allowMissingColumns=True)


def create(spark: SparkSession, table: str, schema: str, version: int = 0) -> bool:
    """Creates an empty table of a fixed schema; false if there is one already."""
    if parts(spark, table) is not None:
        return False
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{table}/batches-0/batch={version}")
    return True


def current(spark: SparkSession, table: str, keys: list[str] = KEY, order: list[str] = ("processed_at", "event_id")) -> DataFrame | None:
    """The table: one row a key; null if it was never written."""
    rows = parts(spark, table)
    return None if rows is None else latest(rows, keys, order)


def latest(rows: DataFrame, keys: list[str] = KEY, order: list[str] = ("processed_at",)) -> DataFrame:
    """One row a key: the greatest by `order` (max_by combines before the shuffle, so hot keys stay cheap)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def upsert(table: str, rows: DataFrame, version: int, keys: list[str] = KEY, order: list[str] = ("processed_at", "event_id")) -> None:
    """Merges `rows` into the table; of rows with one key the greatest by `order` stays. Doing it twice changes nothing."""
    spark = rows.sparkSession
    no, _ = generation(spark, table)
    latest(rows, keys, order).write.mode("overwrite").parquet(f"{table}/batches-{no}/batch={version}")
    if len(folders(spark, f"{table}/batches-{no}")) >= COMPACT:
        compact(spark, table, keys, order)


def compact(spark: SparkSession, table: str, keys: list[str] = KEY, order: list[str] = ("processed_at", "event_id")) -> None:
    """Writes the base of the next generation, and removes what lies before the last one."""
    whole = current(spark, table, keys, order)
    if whole is not None:
        (last, base), folder = generation(spark, table), f"base-{uuid.uuid4()}"
        whole.write.parquet(f"{table}/{folder}")
        spark.createDataFrame([(last + 1, folder)], "generation long, folder string").coalesce(1).write.mode("append").parquet(f"{table}/generations")
        for name in folders(spark, table):
            if name.startswith("base-") and name not in (base, folder) or name.startswith("batches-") and int(name[8:]) < last:
                remove(spark, f"{table}/{name}")


def warehouse_rows(events: DataFrame, as_of: str) -> DataFrame:
    """Scored events as warehouse rows."""
    scored = scoring.service_score(events)
    return scored.select(
        *KEY, "event_id", "source_name", "sources", "description", "event_time", "risk_score", F.col("severity_ai").alias("ai_severity"), F.col("threat_types").alias("ai_threat_types"), F.col("actors").alias("ai_threat_actors"),
        F.col("techniques").alias("ai_mitre_techniques"), "ai_confidence", "sector", "top_factors", F.lit(as_of).cast("timestamp").alias("processed_at"),
    )


def split_failures(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events that can be scored, and the others with a `reason`: no id, no indicator, no kind."""
    reason = F.when(F.col("event_id").isNull(), "no event id").when(F.coalesce("ioc_value", F.lit("")) == "", "no indicator").when(F.coalesce("ioc_type", F.lit("")) == "", "no kind of indicator")
    marked = events.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null").select("event_id", "ioc_type", "ioc_value", "reason")


def run(lake: DataFrame, warehouse: str, as_of: str, version: int, limit: int | None = None) -> dict:
    """Scores what no earlier run has scored and upserts it; the counts of rows processed and failed.

    Rows that the lake marks as processed are left out as well. With `limit`, so many events in order of
    time. A row that can't be scored goes to `warehouse`/failed with its reason and stops no other. Ids are
    marked after the upsert, so a run that dies in between is repeated, to the same end.
    """
    spark, marks = lake.sparkSession, f"{warehouse}/processed"
    todo = search.unprocessed(lake) if "ai_processed" in lake.columns else lake
    known = read(spark, marks)
    if known is not None:
        todo = todo.join(known.select("event_id"), "event_id", "left_anti")
    todo = todo if limit is None else todo.orderBy("event_time", "event_id").limit(limit)
    good, bad = split_failures(todo)
    processed, failed = Observation(), Observation()
    batch = f"{warehouse}/batch-{version:012d}-{uuid.uuid4()}"
    warehouse_rows(good, as_of).observe(processed, F.count("*").alias("processed")).write.parquet(batch)
    bad.observe(failed, F.count("*").alias("failed")).write.mode("overwrite").parquet(f"{warehouse}/failed/batch={version}")
    done = spark.read.parquet(batch)
    upsert(warehouse, done, version)
    marked = done.select("event_id").unionByName(bad.filter("event_id is not null").select("event_id"))
    marked.write.mode("overwrite").parquet(f"{marks}/batch={version}")
    return processed.get | failed.get


def save_classes(table: str, classes: DataFrame, version: int) -> None:
    """Adds classifications of URLs to their master table; the later one of a URL stays."""
    upsert(table, classes, version, ["url"], ["classified_at"])


def classes(spark: SparkSession, table: str) -> DataFrame | None:
    return current(spark, table, ["url"], ["classified_at"])


def status(spark: SparkSession, lake: DataFrame, warehouse: str) -> dict:
    gold = current(spark, warehouse)
    return {"lake": lake.count(), "warehouse": 0 if gold is None else gold.count()}


def enrich(events: DataFrame) -> DataFrame:
    """Lexicon classification, then the service score; rows with a null value have severity `unknown`."""
    typed = scoring.classify_lexicon(events)
    typed = typed.withColumns({"threat_types": F.col("predicted_types"), "ai_confidence": F.col("predicted_confidence")})
    return scoring.service_score(typed).withColumn("severity_ai", F.when(F.col("ioc_value").isNull(), "unknown").otherwise(F.col("severity_ai")))
