"""Language identification: held-out accuracy, spans of mixed texts, and the search for labels against all labellings."""

from itertools import product
from zlib import crc32

import numpy as np
import pytest

from vigil.llm import langid
from vigil.llm.shared import shipped

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return shipped(spark).read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")


@pytest.fixture(scope="module")
def model(docs):
    return langid.train(docs.filter(~langid.held_out()))


def test_held_out_accuracy(docs):
    rows = {r.doc_id: r for r in docs.collect()}
    found = langid.split_and_identify(docs).collect()
    assert len(found) == len(rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and any(map(str.isalpha, rows[r.doc_id].text))]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, rows[r.doc_id].text or ""))) for r in found)


def test_labels_are_not_read(docs):
    """Other languages of held-out rows, and other sources, change nothing."""
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("one"))
    found = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.split_and_identify(docs).collect()}
    assert found == {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.split_and_identify(other).collect()}


def test_spans_of_mixed_texts(spark, docs, model):
    parts = {lang: [r.text for r in docs.filter(langid.held_out() & (docs.lang == lang)).filter("length(text) between 800 and 4000").orderBy("doc_id").limit(6).collect()] for lang in model.names}
    mixed = [(a, b, parts[a][i][:600], parts[b][i][:600]) for a, b in product(model.names, repeat=2) if a != b for i in range(min(len(parts[a]), len(parts[b])))]
    rows = spark.createDataFrame([(i, x + "\n" + y) for i, (_, _, x, y) in enumerate(mixed)], "doc_id long, text string")
    right = total = 0
    for r in langid.identify(rows, model).collect():
        a, b, x, _ = mixed[r.doc_id]
        assert r.spans[0].start == 0 and r.spans[-1].end == len(r.text) and all(p.end == q.start for p, q in zip(r.spans, r.spans[1:], strict=False))
        for s in r.spans:
            for lo, hi, lang in ((0, len(x), a), (len(x), len(r.text), b)):
                right += max(0, min(hi, s.end) - max(lo, s.start)) * (s.lang == lang)
        total += len(r.text)
    assert total and right >= 0.95 * total


def test_viterbi_matches_all_labellings():
    random = np.random.default_rng(5)
    rows = -random.integers(0, 9, (30, 3)).astype(float)
    texts = [random.integers(0, 30, n) for n in (0, 1, 6, 3, 6, 2)]
    prior = np.array([-1.0, -0.5, -2.0])
    for text, labels in zip(texts, langid.viterbi(rows, texts, prior, 4.0), strict=True):
        value = lambda x, t=text: sum(rows[t[i], s] for i, s in enumerate(x)) + (prior[x[0]] if len(x) else 0) - 4.0 * sum(a != b for a, b in zip(x, x[1:], strict=False))
        assert len(labels) == len(text)
        assert value(tuple(labels)) == max(map(value, product(range(3), repeat=len(text))))


def test_ngrams_by_hand():
    classes, owners = langid.ngrams(["Ab", "c"])
    # of " ab ": 3 + 2 + 1 n-grams and the word; of " c ": 2 + 1 and the word
    assert np.bincount(owners).tolist() == [7, 4]
    again = langid.ngrams(["c", "ab"])
    assert sorted(classes[owners == 0]) == sorted(again[0][again[1] == 1])


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("кошка сидела на коврике", "ru"), ("котка седеше на килима", "bg"), ("η γάτα κάθισε", "el")] * 3)]
    model = langid.train(shipped(spark).createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(0, "γγγ ωωω"), (1, "жжж"), (2, None), (3, ""), (4, "12 ² ½ !"), (5, "日本語"), (6, "The cat"), (6, "The cat"), (None, "кошка"), (7, "the " * 50000), (8, "x" * 100000), (9, "the cat sat on the mat кошка сидела на коврике")]
    table = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as lang_pred", "3 as n")
    found = {r.doc_id: r for r in langid.identify(table, model, switch=4.0).collect()}
    assert [found[i].lang_pred for i in (0, 2, 3, 4, 6, None, 7)] == ["el", "und", "und", "und", "en", "ru", "en"]
    assert found[1].lang_pred in ("ru", "bg") and found[8].lang_pred == "en" and found[5].lang_score == 0
    assert [s.lang for s in found[9].spans] == ["en", "ru"] and found[9].spans[1].start == 23
    assert langid.script("日本") == langid.SCRIPT_NO["Han"] and langid.script("½") == -1


def test_nothing_to_learn_from(spark, docs):
    none = docs.withColumn("lang", docs.lang.cast("string")).filter("false")
    model = langid.train(none)
    assert model.names == [] and {r.lang_pred for r in langid.identify(docs.limit(5), model).collect()} == {"und"}
    assert langid.split_and_identify(none).count() == 0
    one = langid.train(spark.createDataFrame([(1, "12 34", "nn"), (2, None, "nn")], "doc_id long, text string, lang string"))
    assert langid.identify(docs.limit(3), one).count() == 3
