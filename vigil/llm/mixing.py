"""Mixing sources to target weights by Poisson replication.

Each source's repetition rate is its target share of the mixture over its share of the corpus. A document's
count is the Poisson quantile, with that mean, of a number in [0, 1) hashed from the seed and its id:
the same on every run, wherever the row lies. Documents are repeated by their count and dealt out by a
hash of id and copy, in whose order the partitions are written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A mixture is a parameter, not data; its size bounds what is collected and broadcast.
MAX_SOURCES = 10_000


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) of 52 bits, from the MD5 of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_steps(mean: float) -> list[float]:
    """P(X <= 0), P(X <= 1), ... as far as they are below 1 in 52 bits."""
    steps, total, k = [], 0.0, 0
    while k <= mean or 1 - total > 2.0**-53 and math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) > 2.0**-60:
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        steps.append(min(1.0, total))
        k += 1
    return steps


def rates(docs: DataFrame, weights: dict[str, float], source_col: str = "source", size: float | None = None) -> dict[str, float]:
    """The mean repetitions of each source in `weights` that has rows; `size` is the mixture's expected size, by default that of the corpus."""
    if len(weights) > MAX_SOURCES:
        raise ValueError(f"a mixture has at most {MAX_SOURCES} sources")
    counts = docs.filter(F.col(source_col).isin(list(weights))).groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    found = {r.source: r.n for r in counts.collect()}
    size, total = sum(found.values()) if size is None else size, sum(weights[s] for s in found)
    return {s: weights[s] / total * size / n for s, n in found.items() if total}


def mix(docs: DataFrame, weights: dict[str, float], seed: int = 0, size: float | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """`docs`, each row as often as its count, with its number `copy` from 1 (in place of any column of that name).

    Sources with weight 0 go. Rows whose source is null or not in `weights` stay once. Rows that share an id
    have the same count; a null id counts as the text "null". Text takes no part, so null, empty and long ones are
    repeated like any other; an empty table gives an empty result. The rows come in hash order.
    """
    means = rates(docs, weights, source_col, size)
    steps = docs.sparkSession.createDataFrame([(s, poisson_steps(m) if m > 0 else [1.0]) for s, m in means.items()], "name string, steps array<double>")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), uniform(seed, F.col(id_col)).alias("u"))
    found = rows.join(F.broadcast(steps), F.col("source") == F.col("name"), "left")
    count = F.when(F.col("steps").isNull(), 1).otherwise(F.size(F.filter("steps", lambda c: c <= F.col("u"))))
    repeated = found.withColumn("n", count.cast("long")).filter("n > 0").select("row", "id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    ordered = repeated.select("row", "copy", F.xxhash64(F.lit(seed), "id", "copy").alias("order")).repartition("order").sortWithinPartitions("order")
    return ordered.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "copy"], "copy")
