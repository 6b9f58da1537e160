"""The quality classifier: the shrinkage against a plain version, nulls, repeats, labels of one class."""

import math

import pytest
from pyspark.sql import functions as F

from vigil.llm import quality
from vigil.llm.shared import shipped


@pytest.fixture(scope="module")
def docs(spark):
    good = "the council met on tuesday and agreed that the old bridge would be repaired before winter"
    bad = "BUY NOW!!! $$$ 100% FREE || CLICK HERE || !!! WIN 9999 ###"
    rows = [(i, (bad if i % 3 == 0 or i % 7 == 1 and i % 4 == 2 else good) + f" number {i}", f"p{i % 5}", f"host{i % 4}") for i in range(120)]
    rows += [(500, None, None, None), (501, "", "p0", "host0"), (502, good, "p9", "alone.example"), (503, bad, "p9", "alone2.example"), (1, rows[1][1], "p1", "host1"), (None, good, "p1", "host1"), (504, "long " * 50000, "p1", "host1")]
    frame = shipped(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for clash in ("host", "path", "n", "p", "classes", "length", "kept", "y"):
        frame = frame.withColumn(clash, F.lit(1))
    return frame


def labels_of(spark, docs):
    return docs.filter("doc_id < 60").select("doc_id", F.when(F.contains("text", F.lit("!!!")), 0).otherwise(1).alias("quality"))


def test_shrinkage_equals_a_plain_version(spark, docs):
    got = quality.classify(docs, labels_of(spark, docs)).collect()
    assert len(got) == docs.count()
    site = {(r.doc_id, r.h): (r.source or "", r.lang or "") for r in docs.select("doc_id", "lang", "source", quality.text_hash(F.col("text")).alias("h")).collect()}
    p = [r.document_score for r in got]
    where = [site[r.doc_id, r.text_hash] for r in got]
    mean = sum(p) / len(p)
    by_host, by_path = {}, {}
    for x, s in zip(p, where):
        by_host.setdefault(s[0], []).append(x)
        by_path.setdefault(s, []).append(x)

    def pull(groups, prior):
        n = [len(g) for g in groups.values()]
        spread = sum(len(g) * (sum(g) / len(g) - prior(k)) ** 2 for k, g in groups.items())
        return quality.strength(sum(n), len(n), sum(x * x for x in n), spread, mean)

    a = pull(by_host, lambda k: mean)
    host = {k: (mean * a + sum(g)) / (len(g) + a) for k, g in by_host.items()}
    b = pull(by_path, lambda k: host[k[0]])
    logit = lambda x: math.log(min(1 - 1e-6, max(1e-6, x)) / (1 - min(1 - 1e-6, max(1e-6, x))))
    for r, x, s in zip(got, p, where):
        of_host = (mean * a + sum(by_host[s[0]]) - x) / (len(by_host[s[0]]) - 1 + a)
        of_path = (of_host * b + sum(by_path[s]) - x) / (len(by_path[s]) - 1 + b)
        assert r.site_score == pytest.approx(of_path, abs=1e-9)
        odds = logit(x) + logit(of_path) - logit(mean)
        assert r.score == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9) and r.kept == (r.score >= 0.5)
    assert all(r.kept == (x > 0.5) for r, x in zip(got, p) if r.doc_id in (502, 503))  # a site of one row says nothing of it
    right = [r.kept != ("!!!" in (t or "")) for r, t in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), [x.text for x in sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id))]) if r.doc_id is not None and r.doc_id < 120]
    assert sum(right) >= 0.95 * len(right)


def test_labels_of_one_class_say_nothing(spark, docs):
    got = quality.classify(docs, labels_of(spark, docs).filter("quality = 1")).collect()
    assert {r.document_score for r in got} == {0.5} and all(r.kept for r in got)
    assert quality.classify(docs.limit(0), labels_of(spark, docs)).count() == 0


def test_labels_beyond_the_bound_are_thinned(spark, docs, monkeypatch):
    monkeypatch.setattr(quality, "MAX_LABELLED", 30)
    assert quality.classify(docs, labels_of(spark, docs)).filter("kept").count() > 0


def test_fit_on_executors_equals_numpy(spark):
    """Newton's method on the whole matrix; rows in any partitions."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    rows = pd.DataFrame({f: rng.normal(size=300) for f in quality.FEATURES} | {"y": rng.integers(0, 2, 300)})
    rows["classes"] = [rng.integers(0, quality.HASHED, n).tolist() for n in rng.integers(0, 60, 300)]
    x, y = quality.design(rows), rows["y"].to_numpy()
    assert x.shape == (300, len(quality.FEATURES) + quality.HASHED + 1) and abs(x[0, len(quality.FEATURES) : -1].sum() - quality.SCALE * bool(rows["classes"][0])) < 1e-9
    w, keep = np.zeros(x.shape[1]), np.ones(x.shape[1])
    keep[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
    table = shipped(spark).createDataFrame(rows).withColumn("classes", F.col("classes").cast("array<short>"))
    for parts in (1, 7):
        assert np.allclose(quality.fit(table.repartition(parts)), w, atol=1e-6)
