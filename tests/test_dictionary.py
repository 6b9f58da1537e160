"""The dictionary join against a test of every entry in every text."""

import pytest
from pyspark.sql import functions as F

from vigil import dims
from vigil.functions import text as T
from vigil.operators import dictionary
from vigil.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = ["the", "THE", "tion", "er", "a", " ", ". T", "worthless", "é", "ouaux", "zzzz", "", None, "x" * 5000, "is a", "\n", "GNU General Public License", "ên", "d, the"]
ODD = [(9001, None), (9002, ""), (9003, "A"), (9004, "x" * 60000), (9005, "the " * 20000), (9006, "THE END"), (9006, "worthless")]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return base.unionByName(spark.createDataFrame(ODD, base.schema)).selectExpr("*", "1 as n", "2 as gram", "3 as low")


@pytest.fixture(scope="module")
def expected(docs):
    words = {w.lower() for w in WORDS if w}
    return {(r.doc_id, w) for r in docs.collect() for w in words if r.text and w in r.text.lower()}


@pytest.mark.parametrize("small", [dictionary.SMALL_CHARS, 0])
def test_matches_equals_every_test(spark, docs, expected, small, monkeypatch):
    monkeypatch.setattr(dictionary, "SMALL_CHARS", small)
    words = spark.createDataFrame([(w, 1) for w in WORDS], "word string, n int")
    got = [tuple(r) for r in dictionary.matches(docs, words, "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_empty_sides(spark, docs):
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    assert dictionary.matches(docs, words.limit(0), "doc_id", "text").count() == 0
    assert dictionary.matches(docs.limit(0), words, "doc_id", "text").count() == 0
    none = dictionary.hits(docs, spark.createDataFrame([("qqqqqq",)], "word string"), "doc_id", "text")
    assert none.count() == docs.count() and none.filter("size(hits) > 0").count() == 0


def test_a_dictionary_of_100_000_names(spark, docs):
    """Names that no text has cost a q-gram each; the few that occur are found."""
    made = spark.range(100_000).select(F.concat(F.lit("name "), F.substring(F.md5(F.col("id").cast("string")), 1, 12)).alias("word"))
    words = made.unionByName(spark.createDataFrame([("worthless",), ("ouaux",)], "word string"))
    got = {tuple(r) for r in dictionary.matches(docs, words, "doc_id", "text").collect()}
    assert got == {(r.doc_id, w) for r in docs.collect() for w in ("worthless", "ouaux") if r.text and w in r.text.lower()} and got


def test_aliases_equal_the_fixed_list(spark):
    texts = [f"seen {a} in {b}" for n, al in dims.TEXT_ACTORS.items() for a in (n, *al) for b in ("Turla", "nothing", "LAZARUS")]
    rows = spark.createDataFrame(list(enumerate([*texts, None, ""])), "id int, text string")
    names = spark.createDataFrame([(i, n, a) for i, (n, al) in enumerate(dims.TEXT_ACTORS.items()) for a in (n, *al)], "rank int, name string, alias string")
    got = dictionary.aliases(rows, names, "id", "text", rank_col="rank")
    expected = rows.select("id", T.threat_actors(F.col("text")).alias("actors"))
    assert sorted(map(str, got.select("id", "actors").collect())) == sorted(map(str, expected.collect()))


@pytest.mark.parametrize("small", [8_000_000, 0])
def test_few_words_need_no_grams(spark, docs, small, monkeypatch):
    """A dictionary of few words is looked for word by word, with the same result as by q-grams."""
    words = spark.createDataFrame([("the",), ("un",), ("a\nb",), ("Que",), ("",), (None,)], "word string")
    few = dictionary.matches(docs, words, "doc_id", "text")
    assert "regexp_extract_all" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(dictionary, "FEW_WORDS", 0)
    monkeypatch.setattr(dictionary, "SMALL_CHARS", small)
    grams = dictionary.matches(docs, words, "doc_id", "text")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, grams.collect()))


def test_short_names_are_looked_for(spark, tmp_path):
    """Words of one and two letters are of the dictionary as well; a digit alone is no word."""
    for name, rows, kind in (("part", [("Ox a",), ("-7 ring",), (None,)], "p_name string"), ("nation", [("NATION_0",)], "n_name string"), ("documents", [(1, "one ox"), (2, "7 rings"), (3, "a"), (4, None)], "doc_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {tuple(r) for r in QUERIES["part_names_in_documents"](spark, str(tmp_path)).collect()}
    assert got == {(1, "ox"), (2, "ring"), (3, "a")}
