"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One or more of space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or one of our own where it is unset.

    A folder of our own is on this machine, so it is taken in local mode only; a cluster must name one.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file:///tmp/checkpoints/{uuid.uuid4()}"
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def shipped(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers of the session, once; they need it to run the operators' functions."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if not getattr(sc, "_vigil_shipped", False):
        target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
        sc._vigil_shipped = True
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back.

    This cuts the lineage in a way that survives lost executors, and tells Spark the table's size, so
    that its own threshold decides whether a later join may broadcast it.
    """
    path = f"{shared_dir(df.sparkSession)}/vigil-{name}-{uuid.uuid4()}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_in = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `stored` wrote, once what was made of them is stored itself."""
    for table in tables:
        delete(table.sparkSession, table._stored_in)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Keys with more than this part of all rows pass by broadcast; there are fewer than so many, whatever the size.
HOT_KEYS = 1024


def skew_join(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, n_col: str = "n", how: str = "inner") -> DataFrame:
    """`rows` joined with `groups`, whose `n_col` says how many of the `total` rows have each key (one value a key).

    Keys that hold over a 1024th of all rows, fewer than HOT_KEYS, are looked up in a broadcast table, so that
    no task gets all rows of one; the others are joined as Spark likes. `groups` should be stored. `how` is inner or left.
    """
    bound = total / HOT_KEYS
    hot = F.broadcast(groups.filter(F.col(n_col) > bound))
    others = rows.join(F.broadcast(groups.filter(F.col(n_col) > bound).select(*keys).distinct()), keys, "left_anti")
    return rows.join(hot, keys).unionByName(others.join(groups.filter(F.col(n_col) <= bound), keys, how))


#: What modules remember in a Python worker between tasks.
MEMOS = (("pieces", "lattices"), ("alignment", "pair_of"), ("tokencount", "remembered"))
_owner = [""]


def own_memory(module: str) -> None:
    """Called by a module's functions in a worker: what other modules remember there is forgotten, so that operators that follow each other don't add up."""
    if _owner[0] == module:
        return
    for other, memo in MEMOS:
        held = sys.modules.get(f"{__package__}.{other}")
        if held and other != module:
            getattr(held, memo).cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can, give free memory back
        ctypes.CDLL(None).malloc_trim(0)
    _owner[0] = module


#: Characters of texts that a function works on at a time.
BLOCK_CHARS = 250_000


def blocks_of(texts: pd.Series) -> Iterator[tuple[int, int]]:
    """Places from and to which a batch's texts have about BLOCK_CHARS characters together, so that a worker holds the results of no more."""
    start, room = 0, 0
    for i, t in enumerate(texts, 1):
        room += len(t or "")
        if room > BLOCK_CHARS or i == len(texts):
            yield start, i
            start, room = i, 0


#: Bits of a sketch of hashes: 8 MB, whatever the number of rows.
SKETCH_BITS = 1 << 26


class Sketch:
    """A test of 64-bit hashes: true for every hash in `column` of `keys`, and for few others while these are fewer than some ten million.

    A bitmap of fixed size with two bits for each hash, put together on the executors. With very many keys it lets
    more and more others pass, so it may only spare work, as a filter before an exact join.
    """

    def __init__(self, keys: DataFrame, column: str):
        mask = SKETCH_BITS - 1
        places = F.explode(F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, 32).bitwiseAND(mask)))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
        table = keys.select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
        bits = np.zeros(SKETCH_BITS >> 6, np.int64)
        bits[table["w"].to_numpy()] = table["bits"].to_numpy()
        self.sent = keys.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """For signed hashes in a task."""
        h, mask, out = hashes.view(np.uint64), np.uint64(SKETCH_BITS - 1), np.ones(len(hashes), bool)
        for at in (h & mask, h >> np.uint64(32) & mask):
            out &= self.sent.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
        return out

    def holds(self, hashes: Column) -> Column:
        """The test of a column without nulls."""

        @F.pandas_udf("boolean")
        def test(values: pd.Series) -> pd.Series:
            return pd.Series(self.has(values.to_numpy(np.int64)))

        return test(hashes)


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")
