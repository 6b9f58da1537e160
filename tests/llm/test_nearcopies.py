"""Near copies against the five-word similarity of all pairs."""

import random
from itertools import combinations

import corpus_pipeline


def test_pipeline_links_what_five_word_similarity_links(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "Few words"), (4, "few  WORDS"), (5, "few other words")]
    for _ in range(40):
        base = [word() for _ in range(rng.randint(40, 400))]
        for share in (0, 0.01, 0.03, 0.06, 0.15, 0.3):
            cut = int(share * len(base))  # another beginning, so that similarity falls with the share
            rows.append((len(rows), " ".join([word() for _ in range(cut)] + base[cut:])))
    rows += [(len(rows) + i, rows[-1][1] + f" end {i}") for i in range(80)]

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    docs = spark.createDataFrame([(*r, "en", "src0", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()}
    assert kept == {i for i in range(len(rows)) if find(i) == i}
    assert corpus_pipeline.distinct_documents(spark, docs.limit(0), "").count() == 0


def test_a_large_group_around_one_text(spark):
    """Copies of one text that are not near each other, and rows that repeat; every comparison spared must be one that can't matter."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(300)]

    def edited(share):
        x = list(base)
        for i in rng.sample(range(len(x)), int(share * len(x))):
            x[i] = word()
        return " ".join(x)

    rows = [(i, edited(rng.choice([0.01, 0.02, 0.03, 0.05]))) for i in range(1, 150)] + [(200, " ".join(base))]
    rows += [(201, rows[0][1]), (201, rows[0][1]), (202, "one text\nof two lines"), (202, "one text\nof two lines"), (None, "x y"), (None, "x y")]
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for i, t in rows if i is not None}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(ids, 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    frame = spark.createDataFrame([(*r, "en", "src0", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in corpus_pipeline.distinct_documents(spark, frame, "").collect()]
    assert sorted(i for i in got if i is not None) == [i for i in ids if find(i) == i] and got.count(None) == 2
