"""The incremental pipeline and daily counts as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import pipeline
from ..sources.threat_event import dealt, project
from ..storage import shared_dir


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The files of a Parquet table as a stream; a table of one file is watched for in its folder."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    first = table.select("_metadata.file_name").first()
    if first is not None and first.file_name == name:  # one file, not a folder of others
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def score_stream(stream: DataFrame, warehouse: str, checkpoint: str, as_of: str):
    """Scores each batch once and upserts it by key; a batch that is repeated after a failure changes nothing. Rows that can't be scored go to `warehouse`/failed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = dealt(batch)
        good, bad = pipeline.split_failures(project(rows))
        bad.write.mode("overwrite").parquet(f"{warehouse}/failed/batch={batch_id}")
        # of a key only the last event is kept, so no other is scored or moved: narrow rows find it
        newest = good.groupBy(*pipeline.KEY).agg(F.max("event_id").alias("event_id")).select("event_id").distinct()
        good, _ = pipeline.split_failures(project(rows.join(newest, "event_id", "left_semi")))
        pipeline.upsert(warehouse, pipeline.warehouse_rows(good, as_of), batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """The warehouse after all files of `path`."""
    base = shared_dir(spark)
    score_stream(event_stream(spark, path), f"{base}/warehouse", f"{base}/checkpoint", as_of).awaitTermination()
    return pipeline.current(spark, f"{base}/warehouse")


def daily_counts(stream: DataFrame, table: str, checkpoint: str):
    """Writes the daily counts of each batch to its own folder, which a batch that is repeated after a failure replaces; no event is late."""

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily(spark: SparkSession, path: str) -> DataFrame:
    """The daily counts of all files of `path`, in whatever order: counted by a stream batch by batch, then added up."""
    base = shared_dir(spark)
    events = event_stream(spark, path)
    daily_counts(events, f"{base}/daily", f"{base}/checkpoint").awaitTermination()
    kind = events.schema["event_type"].dataType.simpleString()
    parts = pipeline.read(spark, f"{base}/daily")
    if parts is None:
        return spark.createDataFrame([], f"day date, event_type {kind}, n long")
    return parts.groupBy("day", "event_type").agg(F.sum("n").alias("n"))
