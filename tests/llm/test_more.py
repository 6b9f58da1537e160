"""Line dedup, pieces, mixing and quality on small fixtures."""

import random

import public_tokenizers
from pyspark.sql import functions as F

from vigil.llm import lines, mixing, pieces, quality

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_edit_distance_and_sketch_agree_with_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        a = "".join(rng.choice("abcd é") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.choice("abz")) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        b, d = "".join(b), distance(a, "".join(b))
        assert lines.within(a, b, 2) == (d <= 2)
        if d <= 2:
            x, y = lines.sketches([a, b]).tolist()
            assert ((x ^ y) & (1 << 32) - 1).bit_count() <= 4


def test_near_lines_go_from_later_documents(spark):
    base, own = "a line that is long enough to be compared", "this other line stays where it is, whatever comes"
    rows = [(1, base), (2, base.replace("long", "lonng") + "\n" + own), (3, None), (4, "")]
    got = {r.doc_id: r.text for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: base, 2: own, 3: None, 4: ""}


def test_pieces_round_trip(spark):
    rows = [(1, None), (2, ""), (3, " a  b\t\n\n 漢字 ▁x 😀  "), (None, "null key"), (5, "word " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once, twice = pieces.encode(docs, MODEL, seed=3), pieces.encode(docs.repartition(3), MODEL, seed=3)
    assert pieces.decode(once, MODEL).filter(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    key = lambda df: sorted((str(r.doc_id), r.ids) for r in df.collect())
    assert key(once) == key(twice)


def test_mixing_counts_follow_the_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    n = {r.source: r["count"] for r in mixing.mix(docs, {"a": 0.5, "b": 0.5}, seed=1).groupBy("source").count().collect()}
    assert abs(n["a"] - 2000) < 250 and abs(n["b"] - 2000) < 250


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    right = got.filter(F.col("kept") == (F.col("quality") == 1)).count()
    assert right >= 0.95 * got.count()
    assert quality.classify(docs.limit(0), labels).count() == 0
