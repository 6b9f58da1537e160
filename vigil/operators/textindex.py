"""Indexes over text: an inverted one for ranked search, a trigram one for substrings. Both are Parquet folders.

The inverted index has one posting for each field, term and document, in folders by a hash of the term, so that a query
reads those of its terms only. It is made of segments, one a partition of the rows: a segment's postings are sorted by term,
and it has one file in each folder, so no task writes or reads all those of a frequent term. An index is made in one pass: a row's words
are counted within the row, a task sorts and writes the postings of its own rows, and none of them moves. Rows and lengths
are counted on the way.

The trigram index has the rows of a table in blocks, and for each trigram the blocks in which it occurs. A query reads the
posting lists of its own trigrams, counts which blocks have them all, and scans only those; each row there is verified.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.threat_event import partition_counts

SHARDS = 64
#: Rows of a table whose postings go to one segment.
FILE_ROWS = 100_000
#: Arrays of up to so many elements are looked at for repeats before they are sorted.
SHORT = 64
K1, B = 1.2, 0.75
#: Blocks beyond so many are joined instead of listed in the plan.
LISTED = 1000

TOKEN = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """The lower-case words of a text, in order; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN), lambda t: t != "")


def query_tokens(query: str, spark: SparkSession) -> list[str]:
    """The query's distinct words, cut as the texts are."""
    return sorted(set(spark.range(1).select(tokens(F.lit(query)).alias("t")).first().t))


def shard(term: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def counted(values: Column, made) -> Column:
    """`made` of each distinct element of an array and its count, from its sorted elements' runs; a short array without repeats is not sorted."""
    at = lambda xs, i: F.get(xs, i)

    def runs(xs: Column) -> Column:
        first = F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | (x != at(xs, i - 1)), i)), lambda i: i.isNotNull())
        return let(F.struct(xs.alias("xs"), first.alias("first")), lambda s: F.transform(s["first"], lambda i, k: made(at(s["xs"], i), (F.coalesce(at(s["first"], k + 1), F.size(s["xs"])) - i).cast("long"))))

    n = F.size(values)
    single = (n < 2) | ((n <= SHORT) & (F.size(F.array_distinct(values)) == n))
    return F.when(single, F.transform(values, lambda x: made(x, F.lit(1).cast("long")))).otherwise(let(F.sort_array(values), runs))


def segments(rows: DataFrame) -> DataFrame:
    """`rows` in partitions of FILE_ROWS rows at most or near it, as many as there are cores where the rows are not few.

    Rows move only if a partition has over twice its share; many small partitions, each of which would write a file a folder, are put together.
    """
    counts, cores = partition_counts(rows), rows.sparkSession.sparkContext.defaultParallelism
    n = sum(counts)
    parts = max(1, -(-n // FILE_ROWS), min(cores, -(-n // max(1, FILE_ROWS // 400))))
    if max(counts, default=0) * parts > 2 * n:
        return rows.repartition(parts)
    return rows.coalesce(2 * parts) if len(counts) > 2 * parts else rows


def index_table(rows: DataFrame, path: str, id_col: str, texts: dict[str, Column] | None = None, keywords: dict[str, Column] | None = None, shards: int = SHARDS) -> None:
    """Indexes the given fields of `rows`; `keywords` are arrays of exact values. `id_col` should be unique: rows with one id count as one document a field and length.

    Writes the postings, and the number of rows that have each field and the mean length of its texts (`field`, `n`, `mean`).
    """
    spark, texts, keywords = rows.sparkSession, texts or {}, keywords or {}
    # a field's values are in a column v0, v1, ...
    fields = [(f, f"v{i}", f in texts) for i, f in enumerate([*texts, *keywords])]
    values = [tokens(c) for c in texts.values()] + [F.coalesce(c, F.array().cast("array<string>")) for c in keywords.values()]
    seen = Observation()
    n = [F.count_if(F.size(v) > 0).alias(f"n_{v}") for _, v, _ in fields]
    words = [F.sum(F.size(v)).alias(f"words_{v}") for _, v, is_text in fields if is_text]
    cut = segments(rows).select(F.col(id_col).alias("id"), *[x.alias(v) for x, (_, v, _) in zip(values, fields)]).observe(seen, *n, *words)
    cut = cut.withColumns({v: F.filter(v, lambda t: t != "") for _, v, is_text in fields if not is_text})

    def terms(field: str, v: str, is_text: bool) -> Column:
        # lengths of exact values don't count
        length = F.size(v) if is_text else F.lit(None).cast("int")
        return counted(F.col(v), lambda t, tf: F.struct(F.lit(field).alias("field"), t.alias("term"), length.alias("length"), tf.alias("tf")))

    # made in a column of their own, so that generated code takes them apart; a plain explode would have them made once more to see whether there are any
    made = cut.select("id", F.concat(*[terms(*x) for x in fields]).alias("ts")).select("id", F.explode_outer("ts").alias("t")).filter("t is not null")
    found = made.select("t.field", "t.term", "id", "t.length", "t.tf")
    found.withColumn("shard", shard(F.col("term"), shards)).sortWithinPartitions("shard", "term").write.option("parquet.enable.dictionary#id", "false").partitionBy("shard").parquet(f"{path}/postings")
    got = seen.get
    every = [(f, got[f"n_{v}"], got[f"words_{v}"] / got[f"n_{v}"] if is_text and got[f"n_{v}"] else None) for f, v, is_text in fields]
    spark.createDataFrame(every, "field string, n long, mean double").coalesce(1).write.parquet(f"{path}/fields")


def postings(spark: SparkSession, path: str, wanted: dict[str, list[str]], shards: int = SHARDS) -> DataFrame:
    """The postings of the wanted terms of each field; only the folders of their hashes are read."""
    terms = sorted({t for ts in wanted.values() for t in ts})
    if not terms:
        return spark.read.parquet(f"{path}/postings").filter("false")
    here = sorted(r.s for r in spark.createDataFrame([(t,) for t in terms], "t string").select(shard(F.col("t"), shards).alias("s")).distinct().collect())
    match = reduce(lambda a, b: a | b, [(F.col("field") == f) & F.col("term").isin(ts) for f, ts in wanted.items() if ts])
    return spark.read.parquet(f"{path}/postings").filter(F.col("shard").isin(here) & F.col("term").isin(terms) & match)


def ranked(spark: SparkSession, path: str, query: str, boosts: dict[str, float], keywords: set[str] = frozenset(), k: int | None = 10, shards: int = SHARDS) -> DataFrame:
    """`id` and `score` of the k best documents (all with None), ties to the smaller id.

    A field's score is its boost times the sum over the query's terms of BM25: ln(1 + (n - df + 0.5) / (df + 0.5)) times
    tf / (tf + K1 (1 - B + B length / mean)); a field of exact values has the whole query as its only term, and no
    lengths. A document's score is that of its best field. An empty query finds nothing.
    """
    words = query_tokens(query, spark)
    found = postings(spark, path, {f: [query] if f in keywords else words for f in boosts if query}, shards)
    # dealt by id once, which serves all that follows
    found = found.repartition("id").groupBy("field", "term", "id", "length").agg(F.sum("tf").alias("tf"))
    # as many rows as fields, and as fields and terms of the query
    fields = F.broadcast(spark.read.parquet(f"{path}/fields"))
    frequent = F.broadcast(found.groupBy("field", "term").agg(F.count("*").alias("df")).join(fields, "field"))
    boost = reduce(lambda c, x: c.when(F.col("field") == x[0], x[1]), boosts.items(), F.when(F.lit(False), 0.0))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    long = F.when(F.col("mean").isNull(), 1.0).otherwise(1 - B + B * F.col("length") / F.col("mean"))
    scored = found.join(frequent, ["field", "term"]).select("id", "field", (boost * idf * F.col("tf") / (F.col("tf") + K1 * long)).alias("s"))
    # thousand millionths add up alike in any order
    of = [F.sum(F.when(F.col("field") == f, F.round(F.col("s") * 1e9).cast("long"))) / 1e9 for f in boosts]
    best = scored.groupBy("id").agg(F.round(F.greatest(*of, *of[:1]), 6).alias("score"))
    return best if k is None else best.orderBy(F.desc("score"), "id").limit(k)


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a lower-case text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def write_trigrams(rows: DataFrame, path: str, text_cols: list[str], order_by: str, blocks: int, shards: int = SHARDS) -> None:
    """Writes `rows` in `blocks` blocks by ranges of a column, and the blocks of every trigram of the lower-case texts.

    A pair of trigram and block is made once a row and combined before the shuffle. A text array counts element by element.
    """
    spark = rows.sparkSession
    rows.repartitionByRange(blocks, order_by).withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(f"{path}/rows")
    table = spark.read.parquet(f"{path}/rows")
    grams = F.array_distinct(F.flatten(F.array(*[trigrams(x) for x in lowered(table, text_cols)])))
    found = table.select("block", F.explode(grams).alias("gram")).distinct().withColumn("shard", shard(F.col("gram"), shards))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found.repartitionByRange(parts, "shard", "gram", "block").sortWithinPartitions("shard", "gram", "block").write.partitionBy("shard").parquet(f"{path}/grams")


def lowered(table: DataFrame, columns: list[str]) -> list[Column]:
    """The columns in lower case, null as empty; the elements of an array parted by line feeds, which no query has."""
    kinds = dict(table.dtypes)
    return [F.lower(F.coalesce(F.array_join(c, "\n") if kinds[c].startswith("array") else F.col(c), F.lit(""))) for c in columns]


def candidate_blocks(spark: SparkSession, path: str, query: str, shards: int = SHARDS) -> DataFrame | None:
    """The blocks that have every trigram of the query; None if it has none, being shorter than three characters."""
    low = query.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not grams:
        return None
    here = sorted(r.s for r in spark.createDataFrame([(g,) for g in grams], "g string").select(shard(F.col("g"), shards).alias("s")).distinct().collect())
    found = spark.read.parquet(f"{path}/grams").filter(F.col("shard").isin(here) & F.col("gram").isin(grams))
    return found.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("block")


def containing(spark: SparkSession, path: str, query: str, text_cols: list[str], shards: int = SHARDS) -> DataFrame:
    """The rows any of whose text columns contains the query, any case; only blocks with all its trigrams are read.

    Few blocks are named in the scan's partition filter, many prune it by a join with their list, which has one number
    a block. A query of fewer than three characters, or with a line feed, reads all blocks.
    """
    table = spark.read.parquet(f"{path}/rows")
    blocks = None if "\n" in query else candidate_blocks(spark, path, query, shards)
    if blocks is not None:
        some = [r.block for r in blocks.limit(LISTED + 1).collect()]
        table = table.filter(F.col("block").isin(some)) if len(some) <= LISTED else table.join(F.broadcast(blocks), "block", "left_semi")
    hit = reduce(lambda a, b: a | b, [F.contains(x, F.lit(query.lower())) for x in lowered(table, text_cols)])
    return table.filter(hit).drop("block")
