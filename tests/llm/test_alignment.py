"""Token alignment against a merge written out token by token."""

from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest

from vigil.llm import alignment
from vigil.llm.shared import shipped

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b c", "tab\tand\nline \n x", "▁ mark", "in▁side", "<|endoftext|> <s> </s> <0x41>", "x" * 30000, "long words " * 20000, "naïve 日本語 テスト 😀😀 नमस्ते",
    "a b   c\u180e d", "\x00 \x1c x \x85 y", "don't 's 'll 12 345,6", "ﬁ \u200b é ё",
]


def brute(rows):
    """Whole texts, two pointers."""
    pair = alignment.Pair(A, B)
    found = []
    for doc_id, text in rows:
        x = pair.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        y = pair.b.encode(text) if text else []
        told = b" " + (text or "").encode()
        bytes_a, bytes_b = [pair.bytes_a[t] for t in x], [pair.bytes_b[t] for t in y]
        links, groups = [], []
        if text and b"".join(bytes_a) == told and b"".join(bytes_b) == told:
            i = j = end_a = end_b = 0
            end_a, end_b, p, q = len(bytes_a[0]), len(bytes_b[0]), 0, 0
            while True:
                links.append((x[i], y[j]))
                if end_a == end_b:
                    groups.append((x[p : i + 1], y[q : j + 1]))
                    p, q = i + 1, j + 1
                step_a, step_b = end_a <= end_b, end_b <= end_a
                i, j = i + step_a, j + step_b
                if i == len(x):
                    break
                end_a += step_a and len(bytes_a[i])
                end_b += step_b and len(bytes_b[j])
        else:
            x, y = [], []
        found.append((doc_id, x, y, groups, links))
    counts = Counter(link for r in found for link in set(r[4]))
    most_a, most_b = Counter(), Counter()
    for (a, b), n in counts.items():
        most_a[a], most_b[b] = max(most_a[a], n), max(most_b[b], n)
    for doc_id, x, y, groups, links in found:
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (doc_id, len(x), len(y), len(groups), len(links), sum(counts[k] == most_a[k[0]] for k in links), sum(counts[k] == most_b[k[1]] for k in links), sum(counts[k] for k in links), shown)


@pytest.fixture(scope="module")
def docs(spark):
    shipped(spark)
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(9000 + i, t) for i, t in enumerate(ODD)] + [(9001, ""), (9004, "a"), (9004, "a"), (None, "a null id")]
    return base.unionByName(spark.createDataFrame(odd, base.schema))


def test_align_matches_a_merge_of_whole_texts(docs):
    clashing = docs.selectExpr("*", "1 as block", "2 as no", "3 as a", "4 as t", "5 as n", "6 as held", "7 as groups")
    got = alignment.align(clashing, A, B, write_groups=True)
    expected = Counter(brute([tuple(r) for r in docs.collect()]))
    assert Counter(tuple(r) for r in got.collect()) == expected


def test_blocks_and_forgetting_change_nothing(docs, monkeypatch):
    rows = [tuple(r) for r in docs.collect()]
    expected = list(brute(rows))
    monkeypatch.setattr(alignment, "MEMO", 300)
    pair, told, held = alignment.Pair(A, B), [], Counter()
    for i in range(0, len(rows), 7):
        some, (pairs, by) = pair.block([t or "" for _, t in rows[i : i + 7]])
        told += some
        for p, h in zip(pairs.tolist(), by, strict=True):
            held[divmod(p, pair.n_b)] += len(h)
    assert [(*t[:4], t[4]) for t in told] == [(*e[1:5], e[8]) for e in expected]
    assert all(len(pair.block([])[0]) == 0 for _ in range(2))


def test_digest_and_empty_table(spark, docs):
    one = docs.filter("doc_id = 3")
    text, digest = (alignment.align(one, A, B, write_groups=w).first().groups for w in (True, False))
    assert digest == sha256(text.encode()).hexdigest()
    assert alignment.align(one, A, B).first().n_links > 0
    empty = alignment.align(docs.limit(0), A, B)
    assert empty.columns[0] == "doc_id" and empty.count() == 0
    assert alignment.align(spark.createDataFrame([(1, None), (2, "")], docs.schema), A, B).count() == 2
