"""Keyed tables in buckets: rows of a key lie in the same bucket of every table made alike, so joins on the key need no shuffle.

A generation is a folder of Parquet files bucketed and sorted by the key, one row a key. An upsert shuffles its batch alone: the
batch is dealt to the buckets and joined with the generation where that lies. Another session takes the folders up
again with `open_table`. Generations are numbered; the one before the last stays for those who still read it.
"""

from __future__ import annotations

from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pipeline

BUCKETS = 16


def _name(folder: str, generation: int) -> str:
    return f"keyed_{sha1(folder.encode()).hexdigest()[:12]}_{generation}"


def generations(spark: SparkSession, folder: str) -> list[int]:
    """The generations that are whole."""
    return sorted(int(x.removeprefix("done-")) for x in pipeline.folders(spark, folder) if x.startswith("done-"))


def open_table(spark: SparkSession, folder: str, keys: list[str] = pipeline.KEY, buckets: int = BUCKETS, generation: int | None = None) -> DataFrame | None:
    """The table in `folder`, its last generation if none is named; None if there is none. Spark knows it as bucketed by `keys`."""
    found = generations(spark, folder)
    if not found:
        return None
    no = found[-1] if generation is None else generation
    name = _name(folder, no)
    if not spark.catalog.tableExists(name):
        path = f"{folder}/rows-{no}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        key = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"create table {name} ({columns}) using parquet clustered by ({key}) sorted by ({key}) into {buckets} buckets location '{path}'")
    return spark.table(name)


def _save(rows: DataFrame, folder: str, generation: int, keys: list[str], buckets: int) -> None:
    spark, name = rows.sparkSession, _name(folder, generation)
    spark.sql(f"drop table if exists {name}")
    rows.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{folder}/rows-{generation}").saveAsTable(name)
    # a generation counts once this is there, so that a lost job leaves the one before
    spark.createDataFrame([(generation,)], "generation long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/done-{generation}")
    for old in generations(spark, folder)[:-2]:
        spark.sql(f"drop table if exists {_name(folder, old)}")
        pipeline.remove(spark, f"{folder}/done-{old}")
        pipeline.remove(spark, f"{folder}/rows-{old}")


def upsert(rows: DataFrame, folder: str, keys: list[str] = pipeline.KEY, order: list[str] = ("processed_at", "event_id"), buckets: int = BUCKETS) -> None:
    """Merges `rows` into the table: of rows with one key the greatest by `order` stays, the table's on ties, so that doing it twice changes nothing.

    Rows with a null in a key are left out, a null in `order` is least. Columns that the table lacks, or the rows, are null there.
    """
    spark = rows.sparkSession
    new = pipeline.latest(rows.dropna(subset=keys), keys, order).repartition(buckets, *keys)
    last = generations(spark, folder)
    old = open_table(spark, folder, keys, buckets)
    _save(new if old is None else _merged(old, new, keys, order), folder, last[-1] + 1 if last else 0, keys, buckets)


def _merged(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    both = old.withColumn("_there", F.lit(True)).alias("o").join(new.withColumn("_there", F.lit(True)).alias("n"), keys, "full_outer")
    of = lambda side, c: F.col(f"{side}.{c}") if c in (old if side == "o" else new).columns else F.lit(None)
    stamp = lambda side: F.struct(*[of(side, c).alias(c) for c in order])
    newer = F.col("o._there").isNull() | (F.col("n._there").isNotNull() & (stamp("n") > stamp("o")))
    return both.select(*keys, *[F.when(newer, of("n", c)).otherwise(of("o", c)).alias(c) for c in rest])


def unknown(rows: DataFrame, folder: str, keys: list[str] = pipeline.KEY, buckets: int = BUCKETS) -> DataFrame:
    """The rows whose key the table lacks; only `rows` are shuffled."""
    table = open_table(rows.sparkSession, folder, keys, buckets)
    return rows if table is None else rows.repartition(buckets, *keys).join(table.select(*keys), keys, "left_anti")
