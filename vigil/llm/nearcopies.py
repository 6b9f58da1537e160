"""SimHash near-dedup of whole documents: sets of five-word shingles with a Jaccard similarity of SIMILARITY or more.

Copies with edits here and there have nearly the same words, and SimHashes of their distinct words that differ
in few of their 64 bits. Each document gets FAMILIES independent ones; a pair is a candidate if it shares a
key in one of the covering tables of some family, which is certain within RADIUS bits and likely a little
beyond. A copy in which a whole passage is another has as many equal shingles but more different words;
such pairs meet in bands of min-hashes of the shingles, of which at a similarity of 0.8 19 in 20 pairs share one.
Every link is then decided by the similarity of the whole texts. Texts of the same words are grouped before.

The documents of a bucket are compared with its smallest. Those that this leaves in another component are
compared with the bucket's other documents outside their own component, but for pairs that can't be near:
their distances from the smallest differ by more than near copies' can (the Jaccard distance is a metric), or
they have too many shingles that no other of these documents has, or their similarity as 512 min-hashes
estimate it is four deviations below. So a large group of near copies costs about one comparison a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blocks_of, discard, own_memory, skew_join, stored
from .simhash import _signed, components, covering_masks, word_fingerprints

SHINGLE, SIMILARITY = 5, 0.8
FAMILIES, RADIUS = 6, 2
BANDS, ROWS = 16, 8
#: Shingles that are min-hashed at a time.
BLOCK = 4096
#: Candidates whose fingerprints differ in more than this share of all their bits only met by chance: their words are too different.
MOST_BITS = 0.3
#: Min-hashes of which four bits estimate a similarity before texts are compared: a near pair is judged by its texts but for 3 in 100,000.
SIGNS = 512
MOST_SIGNS = round(SIGNS * 15 / 16 * (1 - SIMILARITY + 4 * (SIMILARITY * (1 - SIMILARITY) / SIGNS) ** 0.5))
#: Comparisons of one document that share a task; more are dealt to copies of it.
DEALT = 64


def words_of(text: str | None) -> list[bytes]:
    """The words, A-Z in lower case: runs without ASCII white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of the text's shingles; a text of fewer words has one of all, a blank text none."""
    digest, parts = xxhash.xxh64_intdigest, words_of(text)
    if len(parts) <= SHINGLE:
        return np.array([digest(b" ".join(parts), len(parts))] if parts else [], np.uint64)
    each = np.fromiter((digest(w) for w in parts), np.uint64, len(parts))
    n, out = len(parts) - SHINGLE + 1, np.zeros(len(parts) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (out >> np.uint64(29))
        out += each[i : i + n]
    out ^= out >> np.uint64(31)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct hashes; two blank texts are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


@lru_cache(maxsize=2)
def factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(n)
    top = 2**32
    return rng.integers(0, top, n, np.uint64) | np.uint64(1), rng.integers(0, top, n, np.uint64)


def min_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    times, plus = (x.astype(np.uint32)[:, None] for x in factors(n))
    least = np.full(n, 2**32 - 1, np.uint32)
    for at in range(0, len(hashes), BLOCK):
        some = hashes[at : at + BLOCK]
        low, high = some.astype(np.uint32), (some >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, ((low[None] ^ plus) * times + high[None]).min(axis=1), out=least)
    return least


def signature(hashes: np.ndarray) -> np.ndarray:
    """Four bits of each of SIGNS min-hashes, sixteen to a signed long."""
    nibbles = (min_hashes(hashes, SIGNS) & 15).astype(np.uint64).reshape(-1, 16) << np.arange(0, 64, 4, dtype=np.uint64)
    return nibbles.sum(axis=1, dtype=np.uint64).view(np.int64)


def differing(a: str, b: str) -> Column:
    """How many signs differ."""
    ones = F.lit(0x1111111111111111)

    def nibbles(x: Column, y: Column) -> Column:
        t = x.bitwiseXOR(y)
        t = t.bitwiseOR(F.shiftrightunsigned(t, 1))
        return F.bit_count(t.bitwiseOR(F.shiftrightunsigned(t, 2)).bitwiseAND(ones))

    return F.aggregate(F.zip_with(a, b, nibbles), F.lit(0), lambda n, x: n + x)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One signed hash for each band of min-hashes; none without shingles."""
    if not len(hashes):
        return np.array([], np.int64)
    least = min_hashes(hashes, BANDS * ROWS)
    keys = [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64)


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """`a`, `b`, `s` (the similarity) of each pair of ids in `pairs` whose fingerprints don't rule it out; `texts` has `doc_id`, `text`, `fps`."""
    fps = texts.select("doc_id", "fps")
    side = lambda n: fps.withColumnsRenamed({"doc_id": n, "fps": f"{n}_fps"})
    apart = F.aggregate(F.zip_with("a_fps", "b_fps", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    pairs = stored(pairs.join(side("a"), "a").join(side("b"), "b").filter(apart <= MOST_BITS * 64 * FAMILIES).select("a", "b"), "candidates")
    parts = F.floor(F.col("n") / DEALT).cast("int")
    deals = stored(pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", "n", F.explode(F.sequence(F.lit(0), parts)).alias("deal"), (parts + 1).alias("deals")), "deals")
    dealt = pairs.join(deals.filter("deal = 0").select("a", "deals"), "a").withColumn("deal", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int")).select("a", "b", "deal")
    text = lambda n: texts.select(F.col("doc_id").alias(n), F.col("text").alias(f"{n}_text"))

    @F.pandas_udf("double")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = lru_cache(maxsize=256)(shingles)
        for some, others in batches:
            yield pd.Series([similarity(known(x), known(y)) for x, y in zip(some, others, strict=True)], dtype=float)

    left = text("a").join(deals.select("a", "deal"), "a")
    met = dealt.join(text("b"), "b").join(left.hint("merge"), ["a", "deal"])
    out = stored(met.select("a", "b", alike("a_text", "b_text").alias("s")), "compared")
    discard(pairs, deals)
    return out


def unshared(texts: DataFrame) -> DataFrame:
    """`doc_id`, `own`: how many of a text's shingles no other of these texts has; texts without any are left out."""

    @F.pandas_udf("array<long>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            for i, j in blocks_of(some):
                yield pd.Series([shingles(t).view(np.int64) for t in some[i:j]], dtype=object)

    each = texts.select("doc_id", F.explode(hashes("text")).alias("h"))
    alone = each.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).filter("n = 1")
    return alone.groupBy("doc_id").agg(F.count("*").alias("own"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """`doc_id`, `group_id` (the smallest id of its group) of the documents that have a near copy with a smaller id; and `doc_id` and more of all.

    Null and blank texts are copies of each other. Rows with a null id take no part.
    """
    docs = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @F.pandas_udf("words binary, size int, fps array<long>, bands array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own_memory("nearcopies")
        for texts in batches:
            for i, j in blocks_of(texts):
                split, sets = [words_of(t) for t in texts[i:j]], [shingles(t) for t in texts[i:j]]
                yield pd.DataFrame({"size": [len(x) for x in sets], "words": [xxhash.xxh3_128_digest(b" ".join(w)) for w in split], "fps": [word_fingerprints(w, FAMILIES) for w in split], "bands": [bands(x) for x in sets]})

    prints = stored(docs.select("doc_id", hashed("text").alias("h")).select("doc_id", "h.*"), "prints")
    same = stored(prints.groupBy("words").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count("*").alias("n")), "same")
    copies = skew_join(prints.select("doc_id", "words"), same.filter("least <> last"), ["words"], prints.count()).filter("doc_id <> least")
    copies = stored(copies.select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct(), "copies")
    only = prints.join(same.select(F.col("words").alias("w"), "least"), (F.col("words") == F.col("w")) & (F.col("doc_id") == F.col("least"))).select("doc_id", "fps", "bands").dropDuplicates(["doc_id"])
    keys = [F.xxhash64("family", F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(covering_masks(RADIUS))]
    only = stored(only, "only")
    keyed = only.select("doc_id", F.posexplode("fps").alias("family", "fp")).select("doc_id", F.explode(F.array(*keys)).alias("key"))
    keyed = keyed.unionByName(only.select("doc_id", F.explode("bands").alias("key")))
    buckets = keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("a <> last")
    buckets = stored(buckets.select("key", "a", "n"), "buckets")
    met = stored(skew_join(keyed, buckets, ["key"], same.count() * (FAMILIES * len(keys) + BANDS)).select("key", "a", "doc_id"), "met")
    discard(only, buckets, same)
    # whole texts are dealt by document at every size, as they must be at the largest
    wanted = docs.join(met.select("doc_id").distinct().hint("merge"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    inside = stored(wanted.join(prints.select("doc_id", "size", "fps").dropDuplicates(["doc_id"]), "doc_id"), "texts")
    first = compared(met.filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), inside)
    near = lambda found: found.filter(F.col("s") >= SIMILARITY).select("a", "b")
    parts = components(near(first))
    root = lambda n: parts.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root"))
    placed = met.join(root("doc_id"), "doc_id", "left").join(root("a"), "a", "left").withColumns({"doc_id_root": F.coalesce("doc_id_root", "doc_id"), "a_root": F.coalesce("a_root", "a")})
    placed = placed.join(first.withColumnRenamed("b", "doc_id"), ["a", "doc_id"], "left").withColumn("s", F.when(F.col("doc_id") == F.col("a"), 1.0).otherwise(F.col("s")))
    placed = placed.withColumn("apart", F.col("doc_id_root") != F.col("a_root")).select("key", "doc_id", "s", F.col("doc_id_root").alias("root"), "apart")
    open_keys = placed.filter("apart").select("key").distinct()
    placed = stored(placed.join(open_keys, "key", "left_semi"), "placed")
    discard(met)
    some = inside.join(placed.select("doc_id").distinct(), "doc_id")

    @F.pandas_udf("array<long>")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for i, j in blocks_of(texts):
                yield pd.Series([signature(shingles(t)) for t in texts[i:j]], dtype=object)

    known = some.select("doc_id", "size", signed("text").alias("signs")).join(unshared(some), "doc_id", "left")
    shares = stored(known.select("doc_id", "size", "signs", (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared")), "shares")
    placed_ = placed.join(shares, "doc_id")
    apart = placed_.filter("apart").select("key", *[F.col(c).alias(f"c_{c}") for c in ("doc_id", "s", "root", "size", "shared", "signs")])
    most = F.least("shared", "c_shared")  # no more shingles are in both
    could = F.coalesce(F.abs(F.col("s") - F.col("c_s")) <= 1 - SIMILARITY + 1e-9, F.lit(True)) & (most >= (F.col("size") + F.col("c_size") - most) * SIMILARITY - 1e-6)
    could = could & (differing("signs", "c_signs") <= MOST_SIGNS)
    rest = apart.join(placed_, "key").filter((F.col("c_root") != F.col("root")) & could).select(F.least("c_doc_id", "doc_id").alias("a"), F.greatest("c_doc_id", "doc_id").alias("b")).distinct()
    second = compared(rest.join(first.select("a", "b"), ["a", "b"], "left_anti"), inside)
    edges = parts.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(near(second)).unionByName(copies)
    roots = components(edges)
    discard(inside, first, parts, placed, shares, second, copies)
    return roots.filter("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("group_id")), prints


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the smallest of its group of near copies, or that have none.

    Rows with a null id are kept. Rows that share an id stay or go together, but of those that have the same
    text as well, one stays. An empty table gives an empty result.
    """
    found, prints = groups(docs, id_col, text_col)
    gone = stored(found.select(F.col("doc_id").alias("gone")).distinct(), "gone")
    twice = stored(prints.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("twice")), "twice")
    discard(prints)
    kept = docs.join(gone, F.col(id_col) == F.col("gone"), "left_anti")
    once = kept.join(twice, F.col(id_col) == F.col("twice"), "left_anti")
    return once.unionByName(kept.join(twice, F.col(id_col) == F.col("twice"), "left_semi").dropDuplicates([id_col, text_col]))
