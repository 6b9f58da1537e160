"""Sampled segmentations against enumerated paths; odd texts; token counts of other vocabularies."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vigil.llm import pieces, tokencount

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("word", ["the", "cats", "über", "x漢y", "aaaa"])
def test_samples_follow_the_paths_probabilities(word):
    lattices = pieces.Lattices(MODEL, 1.0)
    unit = " " + word

    def paths(at):
        if at == len(unit):
            yield [], 1.0
            return
        for end in range(at + 1, len(unit) + 1):
            known = lattices.weights.get(unit[at:end])
            if known is None and end == at + 1:
                known = (None, lattices.rare)
            if known:
                for rest, weight in paths(end):
                    yield [unit[at:end], *rest], weight * known[1]

    weights = {tuple(p): w for p, w in paths(0)}
    n, total = 6000, sum(weights.values())
    spelled = {i: p for p, (i, _) in lattices.weights.items()}
    byte = {j: b for b, j in enumerate(lattices.byte_ids)}
    found = Counter()
    for ids in lattices.encode([word] * n, list(range(n)), 1):
        out, raw = [], b""
        for i in ids.tolist():
            if i in spelled:
                out.append(spelled[i])
            else:
                raw += bytes([byte[i]])
                try:
                    out.append(raw.decode())
                    raw = b""
                except UnicodeDecodeError:
                    pass
        found[tuple(out)] += 1
    assert set(found) <= set(weights)
    for path, weight in weights.items():
        p = weight / total
        assert abs(found[path] - n * p) <= 5 * (n * p * (1 - p)) ** 0.5 + 3, (path, found[path], n * p)


def test_a_piece_is_found_by_its_spelling():
    lattices = pieces.Lattices(MODEL, 1.0)
    codes = pieces._codes("the")
    right = lattices.index.get_indexer(lattices._hashes(codes)[2][2:])
    assert lattices._same(right.copy(), codes, np.array([2]), 2).tolist() == right.tolist()
    assert lattices._same(right.copy(), pieces._codes("thx"), np.array([2]), 2).tolist() == [-1]


def test_odd_texts_come_back(spark):
    rows = [(1, "x" * 20000), (2, "a"), (2, "a"), (3, None), (4, " "), (5, "\n\n \t"), (6, "word " * 20000), (None, "▁")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("ids", "key", "decoded", "of")})
    got = pieces.decode(pieces.encode(docs, MODEL, seed=9), MODEL)
    assert set(got.columns) == set(docs.columns)
    found = got.collect()
    assert all(r.decoded == (r.text or "") and r.key == "own" for r in found) and len(found) == len(rows)
    same = [r.ids for r in found if r.doc_id == 2]
    assert same[0] == same[1]
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_are_the_librarys_for_any_vocabulary(spark, name):
    path = public_tokenizers.path(name)
    rows = [(1, "  two  spaces and\n\nlines "), (2, None), (3, ""), (4, "word's 12345 " * 400), (None, "x <|endoftext|> y"), (1, "  two  spaces and\n\nlines ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit(1))
    tok = tokencount.tokenizer(path)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(docs, path, chunk=500, overlap=32).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for i, t in rows), key=str)
    assert tokencount.count_tokens(docs.limit(0), path).count() == 0
    assert tokencount.cuts_at_space(path) == (name == "word_bpe_49k.json")
