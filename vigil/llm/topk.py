"""Exact top-k inner products by the leaves of KD-trees, one tree per shard.

Vectors are dealt to shards of about SHARD rows by a hash. A shard is split at the median of its widest dimension down to leaves of
LEAF rows, each with its tight bounding box. The bound of a box is the largest inner product that any point in it can have with a
query; only the queries whose k-th best score so far is within the bound are multiplied with the leaf, all at once. Queries first
search one shard; the k-th score found there goes with them to all others.

Queries travel in blocks of BLOCK. A block and a shard meet as a pair of groups, and Python gets one pair at a time: what a
task holds doesn't follow from the number of rows. Products are made in floating point where every partial sum is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored

SHARD, BLOCK, LEAF, SLICE = 16384, 4096, 512, 1024
#: Numbers in a shard or block, about, so that those of wide vectors have fewer rows.
NUMBERS = 1 << 20
#: The floor of a query that has none.
NONE = -(1 << 63)


def leaves(points: np.ndarray, leaf: int = LEAF) -> Iterator[np.ndarray]:
    """The rows of each leaf of a tree, in order."""
    stack = [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        if len(rows) <= leaf:
            yield np.sort(rows)
            continue
        mine, half = points[rows], len(rows) // 2
        extent = mine.max(axis=0) - mine.min(axis=0)
        if extent.any():
            rows = rows[np.argpartition(mine[:, np.argmax(extent)], half)]
        stack += [rows[half:], rows[:half]]


def narrowed(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them."""
    return x.astype(next((t for t in (np.int16, np.int32) if np.iinfo(t).min <= x.min(initial=0) and x.max(initial=0) <= np.iinfo(t).max), np.int64))


def magnitude(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest kind of number in which all partial sums of the inner products of the rows of two tables are exact."""
    most = magnitude(a) * magnitude(b) * a.shape[1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def best(row: np.ndarray, score: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k best scores, ties to smaller ids; the last: the rank from 0 on."""
    order = np.lexsort((found, -score, row))
    row, score, found = row[order], score[order], found[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    return row[keep], score[keep], found[keep], rank[keep]


def search(queries: np.ndarray, own: np.ndarray, floors: np.ndarray, parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query its number, the ids and the scores of the k best among the rows of the leaves `parts` (ids in order, points, low, high), but for its own id; scores below `floors` may be left out."""
    need, last, full = floors.astype(np.int64), np.zeros(len(queries), np.int64), np.zeros(len(queries), bool)
    empty = np.zeros(0, np.int64)
    held, more, waiting = (empty, empty, empty), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, score, found, rank = best(*(np.concatenate(x) for x in zip(held, *more, strict=True)), k)
        kth = rank == k - 1
        full[row[kth]] = True
        last[row[kth]] = found[kth]
        need[row[kth]] = np.maximum(need[row[kth]], score[kth])
        return row, score, found

    for ids, points, low, high in sorted(parts, key=lambda p: p[0][0]):
        kind = exact_kind(queries, points)
        q = queries.astype(kind)
        # a score that equals the k-th needs a smaller id
        least = (need + (full & (last <= ids[0]))).astype(kind)
        at = np.flatnonzero(np.maximum(q, 0) @ high.astype(kind) + np.minimum(q, 0) @ low.astype(kind) >= least)
        if not len(at):
            continue
        scores = q[at] @ points.astype(kind).T
        r, c = np.nonzero(scores >= least[at, None])
        other = ids[c] != own[at[r]]
        r, c = r[other], c[other]
        more.append((at[r], scores[r, c].astype(np.int64), ids[c]))
        waiting += len(r)
        if waiting > 8 * len(queries):
            held, more, waiting = merged(), [], 0
    row, score, found = merged()
    return row, found, score


def quantised(x: Column) -> Column:
    return F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("long"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: for the rows where `is_query`, the k best others; ties to smaller ids.

    Components become floor(256 x). Rows whose id or vector is null, or whose vector is empty or holds
    nulls or non-finite components, take no part. All others must have as many components as each other
    to meet: vectors are searched among those of their own length. Rows that share an id do not find
    each other; each is a candidate for other queries.
    """
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), quantised(x).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = stored(rows.withColumn("dim", F.size("v")), "vectors")
    sizes = rows.agg(*[F.coalesce(f(x), F.lit(0)) for x in ("dim", F.when(F.col("q"), F.col("dim"))) for f in (F.count, F.sum)]).first()
    shards, blocks = (max(1, -(-m // most), -(-numbers // NUMBERS)) for m, numbers, most in ((*sizes[:2], shard), (*sizes[2:], block)))

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, points = pdf.id.to_numpy(np.int64), narrowed(np.array(pdf.v.tolist(), np.int64))
        made = [(ids[at].tobytes(), points[at].tobytes(), points[at].min(axis=0).tobytes(), points[at].max(axis=0).tobytes()) for at in leaves(points)]
        out = pd.DataFrame(made, columns=["ids", "points", "low", "high"])
        return out.assign(dim=pdf.dim.iloc[0], shard=pdf.shard.iloc[0], kind=points.dtype.name)[["dim", "shard", "kind", "ids", "points", "low", "high"]]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        points = narrowed(np.array(pdf.v.tolist(), np.int64))
        return pd.DataFrame({"dim": [pdf.dim.iloc[0]], "block": [pdf.block.iloc[0]], "kind": [points.dtype.name], "ids": [pdf.id.to_numpy(np.int64).tobytes()], "floors": [pdf.floor.to_numpy(np.int64).tobytes()], "points": [points.tobytes()]})

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")]
        table = lambda r, name: np.frombuffer(getattr(r, name), r.kind).reshape(-1, r.dim)
        parts = [(np.frombuffer(r.ids, np.int64), table(r, "points"), table(r, "low")[0], table(r, "high")[0]) for r in held.itertuples()]
        for r in asked.itertuples() if parts else ():
            ids, floors, points = np.frombuffer(r.ids, np.int64), np.frombuffer(r.floors, np.int64), table(r, "points")
            for i in range(0, len(ids), SLICE):
                row, found, score = search(points[i : i + SLICE], ids[i : i + SLICE], floors[i : i + SLICE], parts, k)
                out.append(pd.DataFrame({"query_id": ids[i : i + SLICE][row], "vec_id": found, "score": score}))
        return pd.concat(out)

    dealt = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    trees = stored(rows.withColumn("shard", dealt(shards)).groupBy("dim", "shard").applyInPandas(tree, "dim int, shard int, kind string, ids binary, points binary, low binary, high binary"), "trees")
    asked = rows.filter("q").withColumn("block", dealt(blocks))
    result, cell = "query_id long, vec_id long, score long", ["dim", "shard", "block"]

    def met(queries: DataFrame, home: bool) -> DataFrame:
        """The best of each block in the shard where it begins, or in each other."""
        packed = queries.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, kind string, ids binary, floors binary, points binary")
        of = lambda own, other, n: F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: own(x) if home else ~own(x))).alias(other)
        sent = packed.select("*", of(lambda s: s == F.col("block") % shards, "shard", shards))
        held = trees.select("*", of(lambda b: b % shards == F.col("shard"), "block", blocks))
        return sent.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInPandas(run, result)

    home = stored(met(asked.withColumn("floor", F.lit(NONE)), True), "home")
    kth = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floors = kth.filter(F.col("n") >= k).select(F.col("query_id").alias("id"), F.col("least").alias("floor"))
    informed = asked.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE)))
    found = home.unionByName(met(informed, False))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
