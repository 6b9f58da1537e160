"""Quality rules where groups are too small for an estimate of their own."""

import random

from vigil.llm import outliers


def test_rows_of_small_groups_are_judged(spark):
    rng = random.Random(7)
    text = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 7))) for _ in range(200))
    rows = [(i, text(), "en", f"src{i % 10}") for i in range(100)]  # ten rows a source
    junk = " ".join("#$%&|<>*" + str(i) for i in range(200))
    rows += [(1000, junk, "en", "src0"), (1001, junk, "xx", "rare"), (1002, junk, None, None), (1003, text(), "xx", "rare"), (1004, "too short", "yy", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.quality_rules(docs).collect()}
    assert len(got) == len(rows)
    assert {i for i, r in got.items() if not r.kept} == {1000, 1001, 1002, 1004}
    assert all((r.distance is None) == r.base_failed for r in got.values())
