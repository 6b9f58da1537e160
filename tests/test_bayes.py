"""Naive Bayes: held-out accuracy, odd rows, and a model whose batches fail."""

import math
import re
from collections import Counter, defaultdict
from hashlib import md5

from pyspark.sql import functions as F

from vigil.operators import bayes, scoring

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = bayes.train(docs.filter("doc_id % 4 <> 2"), "text", "lang")
    held = docs.filter("doc_id % 4 = 2")
    found = bayes.classify(held, model, "doc_id", "text").join(held.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == held.count() and sum(r.label == r.lang for r in found) >= 0.97 * len(found)


def test_equals_a_plain_version(spark):
    rows = [(1, "bad virus here", "x"), (2, "virus virus", "x"), (3, "bank login page", "y"), (4, "page page bank", "y"), (5, None, "y"), (6, "", None), (7, "virus bank", None), (8, "É é page", "z")]
    table = spark.createDataFrame(rows, "id long, text string, label string")
    cut = lambda t: [int(md5(w.encode()).hexdigest()[:4], 16) for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    counts, n = defaultdict(Counter), Counter()
    for _, t, y in rows:
        if y:
            counts[y].update(cut(t))
            n[y] += 1
    log = lambda x: round(math.log(x) * 1e6)

    def score(y, t):
        return log(n[y] / sum(n.values())) + sum(log(counts[y][c] + 1) - log(counts[y].total() + bayes.CLASSES) for c in cut(t))

    model = bayes.train(table, "text", "label")
    odd = table.unionByName(spark.createDataFrame([(9, "unseen words", None), (10, "virus " * 50000, None), (None, "bank", None)], table.schema)).withColumn("class", F.lit(1)).withColumn("best", F.lit(2))
    for r in bayes.classify(odd, model, "id", "text").join(odd.select("id", "text"), "id").collect():
        best = sorted("xyz", key=lambda y: (-score(y, r.text), y))[0]
        mass = sum(math.exp((score(y, r.text) - score(best, r.text)) / 1e6) for y in "xyz")
        assert r.label == best and abs(r.confidence - 1 / mass) < 2e-6
    assert bayes.classify(odd, model, "id", "text").filter("id is null").first().label == "y"


def test_nothing_learned(spark):
    table = spark.createDataFrame([(1, "a b", None)], "id long, text string, label string")
    model = bayes.train(table, "text", "label")
    assert bayes.classify(table, model, "id", "text").first().label is None
    assert bayes.classify(table.limit(0), model, "id", "text").count() == 0


def test_failed_batches_fall_back_to_single_texts(spark):
    def predict(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [] if len(texts) == 3 else [[("Known", 0.9)] for _ in texts]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "c", "d", "e", "f", "g", None])], "id int, text string").coalesce(1)
    classify = scoring.neural_classifier(predict, batch_size=3)
    found = {r.id: [x.label for x in r.found] for r in rows.select("id", classify("text").alias("found")).collect()}
    assert found == {i: [] if i == 1 else ["Known"] for i in range(8)}


def test_words_are_not_grouped_or_joined_by_a_shuffle(spark):
    """Only the texts' sums move: one exchange, whatever the size that Spark broadcasts by itself."""
    rows = spark.createDataFrame([(1, "a b b", "x"), (2, "c", "y"), (3, None, None), (None, "a", None)], "id long, text string, label string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = bayes.classify(rows, bayes.train(rows, "text", "label"), "id", "text")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(id") == 1 == plan.count("Exchange hashpartitioning")
        assert {r.id: r.label for r in found.collect()} == {1: "x", 2: "y", 3: "x", None: "x"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_any_number_of_labels(spark, monkeypatch):
    """Rare labels count too, whether they share a block or not."""
    rows = [(i, f"common w{i % 100} w{i % 7} only{i}", f"l{i % 100:03}") for i in range(300)] + [(300, None, "m"), (301, "zzz common", None), (302, "", None), (303, "w5 w5 only299", None), (None, "w5", None), (None, "w99 only99", None)]
    table = spark.createDataFrame(rows, "id long, text string, label string").withColumn("n", F.lit(1)).withColumn("block", F.lit(2))
    cls = lambda t: [int(md5(w.encode()).hexdigest()[:4], 16) for w in (t or "").split()]
    counts, n, log = defaultdict(Counter), Counter(), lambda x: round(math.log(x) * 1e6)
    for _, t, y in rows:
        if y:
            counts[y].update(cls(t))
            n[y] += 1
    texts, expected = defaultdict(list), {}
    for i, t, _ in rows:
        texts[i] += cls(t)
    for i, words in texts.items():
        scores = {y: log(n[y] / sum(n.values())) + sum(log(counts[y][c] + 1) - log(counts[y].total() + bayes.CLASSES) for c in words) for y in n}
        best = min(scores, key=lambda y: (-scores[y], y))
        expected[i] = best, sum(math.exp((s - scores[best]) / 1e6) for s in scores.values())
    assert len(n) == 101 and expected[300][0] == "l000" and expected[299][0] == "l099"
    for held in ({}, {"WIDTH": 200}, {"WIDTH": 3, "SENT": 500, "SORTED": 40}):
        for name, value in held.items():
            monkeypatch.setattr(bayes, name, value)
        found = bayes.classify(table, bayes.train(table, "text", "label"), "id", "text").collect()
        assert len(found) == len(expected) and all(r.label == expected[r.id][0] and abs(r.confidence - 1 / expected[r.id][1]) < 2e-6 for r in found)
