"""The stages of the pipeline on rows with nulls, empty, long and repeated texts, each on what the one before kept."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigil.llm import mixing, pieces, quality
from vigil.llm.queries import MIXTURE, SEED

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS)
    odd = [(9001, None, None, None, None), (9002, "", "en", None, 0), (9003, " \n\t ", None, "src0", 4), (9006, "long words here " * 20000, "en", "src1", 320000), (9006, "long words here " * 20000, "en", "src1", 320000),
           (None, "a null id keeps its line whatever else happens", "en", "src0", 9), (None, None, None, None, None)]
    docs, out = base.unionByName(spark.createDataFrame(odd, base.schema)), []
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF).collect()
        out.append((docs.collect(), found))
        docs = spark.createDataFrame([tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in found], base.schema)
    return out


def test_columns_and_names(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(list(rows[0].asDict()) == corpus_pipeline.COLUMNS for _, rows in stages[:4] if rows)


def test_the_classifier_drops_rows_that_it_rejects(spark, stages):
    before, after = stages[0]
    docs = spark.createDataFrame([tuple(r) for r in before], spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS).schema)
    judged = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).select("doc_id", "text_hash", "kept").distinct().collect()
    gone = {(r.doc_id, r.text_hash) for r in judged if not r.kept}
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", quality.text_hash(F.col("text")).alias("h")).filter("doc_id is not null").collect()}
    assert Counter(r.doc_id for r in after if r.doc_id is not None) == Counter(r.doc_id for r in before if r.doc_id is not None and (r.doc_id, hashes[r.doc_id]) not in gone)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    good = [i for i, y in labels.items() if y == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)


def test_line_dedup_keeps_rows_and_takes_lines_of_the_text_only(stages):
    before, after = stages[1]
    texts = lambda rows: Counter(r.doc_id for r in rows)
    assert texts(before) == texts(after)
    was = {}
    for r in before:
        was.setdefault(r.doc_id, []).append(r.text)
    for r in after:
        assert r.text is None and None in was[r.doc_id] or any(t is not None and not Counter((r.text or "").split("\n")) - Counter([*t.split("\n"), ""]) for t in was[r.doc_id])
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_one_document_of_a_group_stays(stages):
    before, after = stages[2]
    kept = Counter(r.doc_id for r in after)
    assert not kept - Counter(r.doc_id for r in before) and kept[None] == sum(r.doc_id is None for r in before)
    words = {}
    for r in before:
        if r.doc_id is not None:
            words.setdefault(" ".join((r.text or "").lower().split()), set()).add(r.doc_id)
    for ids in words.values():  # of texts of the same words at most one stays, and never another than the first
        assert len(ids & set(kept)) <= 1 and ids & set(kept) <= {min(ids)}
    assert all(n == 1 for i, n in kept.items() if i is not None)


def test_mixing_repeats_by_the_rates(spark, stages):
    before, after = stages[3]
    docs = spark.createDataFrame([tuple(r) for r in before], "doc_id long, text string, lang string, source string, n_chars long")
    means = mixing.rates(docs, MIXTURE)
    u = {r.doc_id: r.u for r in docs.select("doc_id", mixing.uniform(SEED, F.col("doc_id")).alias("u")).collect()}
    want = Counter()
    for r in before:
        want[r.doc_id, r.source] += sum(s <= u[r.doc_id] for s in mixing.poisson_steps(means[r.source])) if r.source in means else 1
    assert Counter((r.doc_id, r.source) for r in after) == +want


def test_pieces_decode_to_the_text(spark, stages):
    before, after = stages[4]
    assert len(before) == len(after)
    path = public_tokenizers.path("piece_bpe_32k.model")
    spelled = pieces.spellings(path)
    assert all(b"".join(spelled[i] for i in r.ids).decode()[1:] == (r.text or "") for r in after)


def test_an_empty_table_passes_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([], stage(spark, docs, SF).select(corpus_pipeline.COLUMNS).schema)
