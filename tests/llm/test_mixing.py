"""Mixing: nulls, weights of zero, repeats, unknown sources, clashing columns, an empty table."""

from collections import Counter

from pyspark.sql import functions as F

from vigil.llm import mixing


def test_mixing_edge_cases(spark):
    rows = [(i, f"t{i}", "a" if i % 2 else "b") for i in range(400)] + [(None, None, "a"), (900, "", None), (901, "x" * 300000, "zero"), (902, "u", "unknown"), (902, "u", "unknown"), (7, "t7", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for clash in ("_source", "_steps", "_u", "_n", "_order", "name", "steps", "u", "n", "id", "row", "order", "copy"):
        docs = docs.withColumn(clash, F.lit("own"))
    weights = {"a": 0.6, "b": 0.3, "zero": 0.0, "absent": 0.1}
    found = mixing.mix(docs, weights, seed=5)
    assert found.columns == docs.columns
    got = found.collect()
    assert all(r.name == r.row == r._source == "own" for r in got)
    n = Counter((r.doc_id, r.source) for r in got)
    assert n[900, None] == 1 and n[902, "unknown"] == 2 and (901, "zero") not in n
    assert n[7, "a"] % 2 == 0
    assert all(sorted(r["copy"] for r in got if r.doc_id == i) == list(range(1, n[i, "a" if i % 2 else "b"] + 1)) for i in range(20) if i != 7)
    means = mixing.rates(docs, weights)
    for source, key in (("a", 1), ("b", 0)):
        steps = mixing.poisson_steps(means[source])
        for r in docs.filter(f"doc_id % 2 = {key} and doc_id < 400").select("doc_id", mixing.uniform(5, F.col("doc_id")).alias("u")).distinct().collect():
            times = 2 if r.doc_id == 7 else 1
            assert n[r.doc_id, source] == times * sum(s <= r.u for s in steps)
    assert mixing.mix(docs.limit(0), weights).count() == 0
