"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. For radius r every bit position gets a nonzero vector of r + 1 bits; each
of the 2**(r + 1) - 1 nonzero vectors v gives a table whose mask holds the positions with an odd inner
product with v. At most r differing positions span at most r dimensions, so some v is orthogonal to all
of them: its mask holds none, and the pair agrees on that table's key. No pair within the radius is
missed; what meets in a table is checked by the real distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, skew_join, stored

BITS = 64
#: Buckets up to this size are compared pair by pair, larger ones through shared neighbours.
SMALL_BUCKET = 32


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text, unsigned; 0 for null or blank text.

    A-Z are lower-cased, words are runs without ASCII white space, shingles count as often as they
    occur, and a text with fewer words than a shingle has one shingle of all its words.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - shingle + 1)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1 :] if len(parts) >= shingle else ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        spans = zip(starts[at : min(n, at + 65536)].tolist(), last[at : at + 65536].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], seed) for s, e in spans], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def word_fingerprints(parts: list[bytes], families: int) -> np.ndarray:
    """SimHashes of the distinct words, one for each of `families` independent hashes; none without words."""
    each = np.fromiter(map(xxhash.xxh64_intdigest, set(parts)), np.uint64)
    if not len(each):
        return np.array([], np.int64)
    salts = np.arange(1, families + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros((families, BITS), np.int64)
    for at in range(0, len(each), 4096):
        x = each[None, at : at + 4096] + salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8).reshape(families, -1, 8), axis=2).sum(axis=1, dtype=np.uint16)
    return np.packbits(counts * 2 > len(each), axis=1).view(np.int64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """`doc_id`, `fp` (the fingerprint's bits as a signed long) of every row."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            yield pd.Series(values.view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("fp"))


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The tables' bit masks, as unsigned integers."""
    tables = 2 ** (radius + 1) - 1
    vectors = [i % tables + 1 for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, tables + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Pairs `a`, `b` of distinct fingerprints within the radius, enough to connect all that are linked.

    `fps` has a column `fp` without repeats. Members of a large bucket are not compared pair by pair:
    each is dealt to its ball of half the radius, where any two that meet are within the radius, and is
    linked with the smallest there. Two fingerprints meet in a ball exactly if they are within the
    (even) radius, so this loses no connection.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    cover = covering_masks(radius)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in cover])
    keyed = fps.select("fp", F.posexplode(keys).alias("table", "key"))
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(keyed.join(sizes, ["table", "key"]), "met")
    buckets = met.filter(F.col("n") <= SMALL_BUCKET).groupBy("table", "key").agg(F.collect_list("fp").alias("all"))
    pairs = buckets.select("all", F.explode("all").alias("a")).select(
        "a", F.explode(F.filter("all", lambda x: (x > F.col("a")) & _near(x, F.col("a"), radius))).alias("b")
    )
    flips = [0, *(sum(1 << i for i in c) for k in range(1, radius // 2 + 1) for c in combinations(range(BITS), k))]
    balls = (
        met.filter(F.col("n") > SMALL_BUCKET)
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.array(*[F.lit(_signed(x)) for x in flips])).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("center"))
    )
    least = balls.groupBy("center").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = balls.join(least, "center").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """`node`, `root` (the smallest node it reaches) of every node that has an edge `a`, `b`.

    Alternates large-star and small-star steps until the edges no longer change. Each step is written
    to the shared folder, as is the result.
    """
    edges, before = stored(edges.filter("a <> b"), "edges"), None
    for _ in range(rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, edges = edges, stored(small.unionByName(below.withColumnRenamed("m", "b")).distinct(), "edges")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = stored(edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node"), "roots")
    discard(edges)
    return out


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `fp`, `component_id` of every row of `docs`; rows link at `radius` or fewer differing bits.

    component_id is the smallest id reachable. Null and blank texts have fingerprint 0 and are linked like
    any other. Rows that share an id each appear; a null id stays in its row and is used for no
    component_id unless a component has only null ids. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    linked = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(rooted.join(of_root, "root").select("fp", "n", "component_id"), "classes")
    discard(distinct, linked)
    return skew_join(prints, classes, ["fp"], prints.count()).select("doc_id", "fp", "component_id")
