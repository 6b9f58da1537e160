"""Ranked search and substring search by indexes, against plain versions, and what of them is read."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigil.operators import textindex

SF = "/root/testdata/sf0.001"
ODD = [(9001, None), (9002, ""), (9003, "The the THE"), (9004, "entre-nous"), (9005, "very long " * 20000), (9006, "x" * 50000), (9007, "ÉCLAIR éclair"), (9008, "ab")]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return base.unionByName(spark.createDataFrame(ODD, base.schema))


@pytest.fixture(scope="module")
def inverted(docs, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('inverted')}/index"
    textindex.index_table(docs, path, "doc_id", {"text": F.col("text")}, {"kind": F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("the")))})
    return path


@pytest.fixture(scope="module")
def trigrams(docs, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('trigram')}/index"
    tagged = docs.withColumn("tags", F.array(F.lit("Alpha"), F.concat(F.lit("tag-"), F.col("doc_id").cast("string"))))
    textindex.write_trigrams(tagged, path, ["text", "tags"], "doc_id", 12)
    return path


def bm25(rows, query):
    words = {i: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for i, t in rows}
    n, mean = sum(bool(w) for w in words.values()), 0
    mean = sum(map(len, words.values())) / n
    out = Counter()
    for term in set(re.findall(r"[^\W_]+", query.lower())):
        df = sum(term in w for w in words.values())
        for i, w in words.items():
            if tf := w.count(term):
                out[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return out


@pytest.mark.parametrize("query", ["the", "The of, worthless!", "entre la éclair", "nothinglikethis", "", " - ", "x" * 50000])
def test_ranked_matches_bm25(spark, docs, inverted, query):
    expected = bm25([tuple(r) for r in docs.collect()], query)
    got = {r.id: r.score for r in textindex.ranked(spark, inverted, query, {"text": 1.0}, k=None).collect()}
    assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 2e-6 for i in got)
    best = [(r.id, r.score) for r in textindex.ranked(spark, inverted, query, {"text": 1.0}, k=7).collect()]
    assert best == sorted(got.items(), key=lambda x: (-x[1], x[0]))[:7]


def test_best_field_with_boost_counts(spark, docs, inverted):
    rows = [tuple(r) for r in docs.collect()]
    text, third = bm25(rows, "the"), [i for i, _ in rows if i % 3 == 0]
    exact = 3 * math.log(1 + (len(third) - len(third) + 0.5) / (len(third) + 0.5)) / 2.2
    expected = {i: max(text.get(i, 0), exact if i % 3 == 0 else 0) for i in {*text, *third}}
    got = {r.id: r.score for r in textindex.ranked(spark, inverted, "the", {"text": 1.0, "kind": 3.0}, {"kind"}, k=None).collect()}
    assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 2e-6 for i in got)


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan


def test_only_the_terms_folders_are_read(spark, inverted):
    few = textindex.postings(spark, inverted, {"text": ["the", "entre"]})
    files = {r.f for r in few.select(F.input_file_name().alias("f")).distinct().collect()}
    every = len(spark.read.parquet(f"{inverted}/postings").inputFiles())
    assert len(files) <= 4 < every / 4
    plan = files_read(few)
    assert re.search(r"PartitionFilters: \[[^\]]*shard", plan) and re.search(r"PushedFilters: \[.*In\(term", plan)


@pytest.mark.parametrize("query", ["worthless", "THE", "éclair", "y long v", "tag-9006", "alpha", "ab", "", "zzzzqq", "a\ntag-", "x" * 49999])
def test_containing_matches_a_scan(spark, docs, trigrams, query):
    rows = [(r.doc_id, r.text, ["Alpha", f"tag-{r.doc_id}"]) for r in docs.collect()]
    expected = sorted(i for i, t, tags in rows if query.lower() in (t or "").lower() or query.lower() in "\n".join(tags).lower())
    assert sorted(r.doc_id for r in textindex.containing(spark, trigrams, query, ["text", "tags"]).collect()) == expected


def test_only_blocks_with_all_trigrams_are_read(spark, trigrams, monkeypatch):
    found = textindex.containing(spark, trigrams, "tag-9006", ["text", "tags"])
    plan = files_read(found)
    blocks = [int(x) for x in re.search(r"block#\d+ (?:IN \(|= )([\d,]+)", plan)[1].split(",")]
    assert len(blocks) <= 2 and found.count() == 1
    monkeypatch.setattr(textindex, "LISTED", 0)
    joined = textindex.containing(spark, trigrams, "tag-9006", ["text", "tags"])
    assert joined.count() == 1 and "dynamicpruning" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_an_index_reads_each_text_once(spark, docs, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(t):
        seen.add(1)
        return t

    textindex.index_table(docs, f"file://{tmp_path}/once", "doc_id", {"text": text("text")}, {"kind": F.array(F.lit("the"))})
    assert seen.value == docs.count()
    assert {r.field: r.n for r in spark.read.parquet(f"file://{tmp_path}/once/fields").collect()} == {"text": docs.filter(F.col("text") != "").count(), "kind": docs.count()}


def test_rows_of_one_id_and_files_of_a_frequent_term(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "FILE_ROWS", 10)
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("same word").alias("text"))
    twice = rows.unionByName(rows.filter("doc_id = 7"))
    path = f"file://{tmp_path}/twice"
    textindex.index_table(twice, path, "doc_id", {"text": F.col("text")})
    assert [r.id for r in textindex.ranked(spark, path, "same", {"text": 1.0}, k=2).collect()] == [7, 0]
    files = textindex.postings(spark, path, {"text": ["same"]}).groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(r[1] for r in files) < 60


def test_postings_stay_with_their_rows(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    rows = spark.range(0, 4000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("same word").alias("text"))
    textindex.index_table(rows, path, "doc_id", {"text": F.col("text")})
    files = textindex.postings(spark, path, {"text": ["same"]}).groupBy(F.input_file_name()).agg(F.min("id").alias("a"), F.max("id").alias("b")).collect()
    assert sorted((f.a, f.b) for f in files) == [(i, i + 999) for i in range(0, 4000, 1000)]


def test_found_postings_are_dealt_once(spark, inverted):
    found = textindex.ranked(spark, inverted, "the entre", {"text": 1.0, "kind": 3.0}, {"kind"})
    keys = re.findall(r"hashpartitioning\((.*?), \d+\)", found._jdf.queryExecution().executedPlan().toString())
    assert {re.sub(r"#\d+L?", "", k) for k in keys} == {"id", "field, term"}


def test_exact_values_with_repeats_and_gaps(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "", None]), (2, [""]), (3, []), (4, None), (5, ["a"])], "doc_id long, kind array<string>")
    textindex.index_table(rows, f"file://{tmp_path}/kinds", "doc_id", keywords={"kind": F.col("kind")})
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/kinds/fields").collect()] == [("kind", 3, None)]
    found = textindex.postings(spark, f"file://{tmp_path}/kinds", {"kind": ["a", "b", ""]})
    assert sorted((r.id, r.term, r.tf, r.length) for r in found.collect()) == [(1, "a", 1, None), (1, "b", 2, None), (5, "a", 1, None)]
