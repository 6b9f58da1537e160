"""Importance resampling of documents towards a target text, over hashed runs of words.

A partition's words become ids; a block of them gets a suffix array, sorted as deep as the longest run that counts.
Where neighbouring suffixes share fewer than n words (their LCP), another run of n words begins: each
repeated run is spelled and hashed once, and its bucket is scattered back to all places where it occurs. A
document's log ratio of target to corpus is the mean gain of its places' buckets; Gumbel noise from a hash of its id
turns the highest scores into a draw without replacement.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, stored

#: Words of a block, unless one document has more.
BLOCK = 500_000
#: ASCII digits and lower-case letters, and all beyond ASCII, of lower-cased UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
TWO_32 = 4294967296.0


def suffix_array(ids: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """The places of `ids` (from 1) in order of the words from there, up to `depth` of them and to the end of the document (`ends`, of each place); prefix doubling."""
    rank, known, places = ids, 1, np.arange(len(ids))
    order = np.argsort(rank, kind="stable")
    while known < depth:
        later = np.where(places + known < ends, rank[np.minimum(places + known, len(ids) - 1)], 0)
        order = np.lexsort((later, rank))
        fresh = (np.diff(rank[order], prepend=0) != 0) | (np.diff(later[order], prepend=-1) != 0)
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.cumsum(fresh)
        known *= 2
    return order


def common_words(ids: np.ndarray, ends: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many words, at most `depth`, each suffix of the array shares with the one before it."""
    lcp = np.zeros(len(order), np.int64)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in range(depth):
        a, b = order[:-1] + k, order[1:] + k
        inside = (a < ends[order[:-1]]) & (b < ends[order[1:]])
        last = len(ids) - 1
        same &= inside & (ids[np.minimum(a, last)] == ids[np.minimum(b, last)])
        lcp[1:] += same
    return lcp


def run_buckets(spelled: list[bytes], ids: np.ndarray, ends: np.ndarray, depth: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to `depth`: the places at which a run of n words begins, and its bucket there."""
    order = suffix_array(ids, ends, depth)
    lcp = common_words(ids, ends, order, depth)
    for n in range(1, depth + 1):
        whole = ends[order] - order >= n
        at, shared = order[whole], lcp[whole]
        # a suffix too short for the run sorts before all that begin with its words, so none lies inside a run
        first = np.flatnonzero(shared < n)
        run_of = np.cumsum(shared < n) - 1
        hashed = [crc32(b" ".join([spelled[i] for i in ids[p : p + n]])) % buckets for p in at[first].tolist()] if n > 1 else [crc32(spelled[i]) % buckets for i in ids[at[first]].tolist()]
        yield at, np.array(hashed, np.int64)[run_of] if len(hashed) else run_of


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """The rows (all columns but the text) and words of the texts, in blocks of about BLOCK words."""
    rows, texts, room = [], [], 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            words = WORD.findall(row.t.encode().lower())
            if texts and room + len(words) > BLOCK:
                yield rows, texts
                rows, texts, room = [], [], 0
            rows.append(row)
            texts.append(words)
            room += len(words)
    if texts:
        yield rows, texts


def features(docs: DataFrame, depth: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (`doc_id`, `row`, `n_words`, `n_features`, and `held`: `bucket << 32 | times`), and for each block rows of buckets (`bucket`, `n`) with what they hold; either has null in the columns of the other."""
    none_of_docs = dict.fromkeys(("doc_id", "row", "n_words", "n_features", "held"))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, texts in blocks(batches):
            known: defaultdict[bytes, int] = defaultdict(count(1).__next__)
            flat = [known[w] for words in texts for w in words]
            spelled = [b"", *known]
            n_words = np.array([len(w) for w in texts], np.int64)
            upto = np.cumsum(n_words)
            ids, ends, doc = np.array(flat, np.int64), np.repeat(upto, n_words), np.repeat(np.arange(len(texts)), n_words)
            keys, total, n_features = [], np.zeros(buckets, np.int64), np.zeros(len(texts), np.int64)
            for at, bucket in run_buckets(spelled, ids, ends, depth, buckets) if flat else ():
                keys.append(doc[at] * buckets + bucket)
                total += np.bincount(bucket, minlength=buckets)
                n_features += np.bincount(doc[at], minlength=len(texts))
            key, times = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64),) * 2
            held = (key % buckets << 32 | times).tolist()
            cuts = np.searchsorted(key, np.arange(len(texts) + 1) * buckets).tolist()
            yield pd.DataFrame({
                "doc_id": pd.Series([r.doc_id for r in rows], dtype=object), "row": [r.row for r in rows], "n_words": n_words, "n_features": n_features,
                "held": pd.Series([held[i:j] for i, j in zip(cuts, cuts[1:], strict=False)], dtype=object), "bucket": None, "n": None,
            })
            some = np.flatnonzero(total)
            if len(some):
                yield pd.DataFrame({**none_of_docs, "bucket": some.astype(np.int32), "n": total[some]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    out = rows.mapInPandas(found, "doc_id string, row long, n_words long, n_features long, held array<long>, bucket int, n long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def bucket_counts(found: DataFrame) -> DataFrame:
    return found.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(spark: SparkSession, corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket in thousandths: one number a bucket, so many whatever the corpus's size."""
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    sums = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = ((F.col("t") + 1) * F.lit(sums[0] + buckets)) / ((F.col("s") + 1) * F.lit(sums[1] + buckets))
    told = both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[told["bucket"]] = told["gain"]
    return out


def ranked(scored: DataFrame, by: list, name: str) -> DataFrame:
    """`scored` with its place (from 1) in the order `by` in the column `name`: sorted by ranges, numbered in each and moved by the sizes of those before.

    `by` should have no ties of many rows. The table of sizes has one row a range.
    """
    spark = scored.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = stored(scored.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = order.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).toPandas().sort_values("_part")
    before = spark.createDataFrame(pd.DataFrame({"_part": sizes["_part"], "_before": sizes["n"].cumsum() - sizes["n"]}).astype("int64"), "_part long, _before long")
    return order.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, at + F.col("_before") + 1).drop("_part", "_at", "_before")


def resample(
    docs: DataFrame, target: DataFrame, depth: int = 2, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """`doc_id`, `n_words`, `n_features`, `weight`, `score` and `rank` of every row of `docs`.

    Features are all runs of 1 to `depth` words; `weight` is the floored mean of their buckets' gains, in thousandths of the log
    ratio of `target` to `docs`, each with one added to every bucket; without features 0. `score` adds Gumbel
    noise from SHA-256 of `seed:id` (a null id: `seed:null`). Of the N rows with at least `least_words` words the floor(percent N / 100)
    highest scores are drawn, ties to the smaller id, null last, then to the earlier row; `rank` counts them, null if
    not drawn. Null text has no words. Repeated rows count and have a row each; of the drawn copies of one id all have ranks of
    their own. An empty target gives every bucket its smoothing, an empty table an empty result.
    """
    spark = docs.sparkSession
    found = stored(features(docs, depth, buckets, id_col, text_col), "features")
    gain = gains(spark, bucket_counts(found), bucket_counts(features(target.select(F.lit(0).alias("doc_id"), F.col(target_text_col).alias("text")), depth, buckets, "doc_id", "text")), buckets)

    @F.pandas_udf("long")
    def gained(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for held in batches:
            sizes = np.array([len(h) for h in held], np.int64)
            flat = np.concatenate([np.asarray(h, np.int64) for h in held]) if len(held) else np.zeros(0, np.int64)
            sums = np.concatenate([[0], np.cumsum(gain[flat >> 32] * (flat & 0xFFFFFFFF))])
            ends = np.cumsum(sizes)
            yield pd.Series(sums[ends] - sums[ends - sizes])

    rows = found.filter("row is not null").withColumn("_gained", gained("held"))
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("_gained") / F.col("n_features"))).otherwise(0).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / TWO_32))).cast("long")
    scored = stored(rows.select("doc_id", "row", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise), "scored")
    discard(found)
    enough = F.col("n_words") >= least_words
    n = scored.filter(enough).count()
    places = ranked(scored.filter(enough).select("doc_id", "row", "score"), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], "rank")
    out = scored.join(places.filter(F.col("rank") <= percent * n // 100).select("row", "rank"), "row", "left")
    return out.select("doc_id", "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
