"""Line dedup against all pairs of lines: near lines, hot segments, hot lines, copies, nulls, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.llm import lines, shared
from .test_more import distance


def brute(rows, edits=2, least=20):
    """The texts after removal, by comparing every line with every line of the documents with an id."""
    firsts, places = {}, {}
    for doc, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for no, line in enumerate(text.split("\n")):
            if len(line) >= least:
                firsts.setdefault(line, doc)
                places.setdefault(line, (doc, no))
    order = sorted(places, key=places.get)
    near = {b for i, b in enumerate(order) if any(distance(a, b) <= edits for a in order[:i])}
    out = []
    for doc, text in rows:
        if text is None:
            out.append((doc, None))
            continue
        seen, left = set(), []
        for line in text.split("\n"):
            if len(line) >= least:
                if line in seen or doc is not None and (line in near or firsts[line] < doc):
                    continue
                seen.add(line)
            left.append(line)
        out.append((doc, "\n".join(left)))
    return sorted(out, key=str)


def planted(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(rng.randint(4, 8))) for _ in range(60)]
    base += [f"the same beginning of all of these lines, then {word()} {word()}" for _ in range(40)]

    def edited(line):
        x = list(line)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(x))
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "q"])
        return "".join(x)

    rows = [(i, "\n".join(edited(rng.choice(base)) if rng.random() < 0.8 else word() for _ in range(rng.randint(1, 6)))) for i in range(80)]
    rows += [(80 + i, "a common line that a third of all documents have\n" + word()) for i in range(40)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (204, "\n\n"), (None, base[0] + "\n" + base[0]), (None, None), (205, f"{base[1]}\n" * 2000 + base[2])]
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_line_dedup_equals_all_pairs(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(lines, "HOT_SEGMENT", 2)
        monkeypatch.setattr(shared, "HOT_KEYS", 10)
        monkeypatch.setattr(lines, "BLOCK", 50)
    rows = planted(random.Random(11))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for clash in ("doc", "_gone", "row", "gone", "new", "n_lines", "h", "salt", "place", "size"):
        docs = docs.withColumn(clash, F.lit("own"))
    got = lines.deduplicate(docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    found = got.collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == brute(rows)
    assert all(r.row == "own" and r.n_removed == (0 if r.text is None else r.n_lines - r.text.count("\n") - 1 if r.text or not r.n_removed else r.n_lines - bool(r.n_lines > r.n_removed)) for r in found)


def test_line_dedup_of_repeated_ids_and_an_empty_table(spark):
    line = "one line that is certainly long enough"
    rows = [(1, line), (1, line + "\nshort"), (2, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in lines.deduplicate(docs).collect()) == [(1, line), (1, line + "\nshort"), (2, "")]
    assert lines.deduplicate(docs.limit(0)).count() == 0


def test_pipeline_line_dedup_of_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.fresh_lines(spark, docs, "").count() == 0


def test_chains_and_very_long_texts(spark):
    """Along a chain of lines two edits apart each, all but the first go, as the docstring of the module says; long texts and lines stay whole."""
    line = "a line of text that is long enough to be told apart"
    step = lambda s, n: s[: 10 + n] + "##" + s[12 + n :]
    second, third = step(line, 0), step(step(line, 0), 10)
    fresh = [f"line number {i} of the long text, number {i * 7919} of all" for i in range(30000)]
    rows = [(1, line), (2, second), (3, third), (4, "\n".join(fresh)), (5, "x" * 300000), (6, "\n".join([*fresh[:3], "and something of its own in it"]))]
    got = {r.doc_id: r.text for r in lines.deduplicate(shared.shipped(spark).createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == line and got[2] == got[3] == "" and got[5] == "x" * 300000 and got[6] == "and something of its own in it"
    assert got[4].split("\n")[0] == fresh[0]
