"""The corpus pipeline: quality classifier, line dedup, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of
documents; the last adds the ids of the encoded text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import lines, mixing, nearcopies, pieces, quality
from vigil.llm.queries import MIXTURE, SEED, table
from vigil.llm.shared import delete, shared_dir, shipped

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps; of rows that share an id and a text, all or none."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    gone = judged.filter("not kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    same = docs.doc_id.eqNullSafe(F.col("id")) & (quality.text_hash(docs.text) == F.col("hash"))
    return docs.join(gone, same, "left_anti").select(COLUMNS)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated lines, but for what copies of one document share with it; n_chars follows the text."""
    shipped(spark)
    return lines.deduplicate(docs, spare_copies=True).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity of 0.8): that with the smallest id."""
    shipped(spark)
    return nearcopies.one_per_group(docs).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents repeated to the target mixture, in a global random order."""
    return mixing.mix(docs, MIXTURE, seed=SEED).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of a sampled segmentation of their text."""
    shipped(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), seed=SEED).select(*COLUMNS, "ids")


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", fresh_lines),
    ("near-duplicate removal", distinct_documents),
    ("mixing", mixture),
    ("piece encoding", encoded),
]

#: SQL can't express the trained classifier, the edit join or the sampled segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next, whose own writing frees it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/pipeline-{i}-{uuid.uuid4()}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                delete(spark, before)
            before = path
    return docs
