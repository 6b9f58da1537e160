"""Importance resampling against a version with dictionaries."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from vigil.llm import importance
from vigil.llm.shared import shipped

SF = "/root/testdata/sf0.001"


def brute(docs, target, depth, buckets, percent, least, seed):
    def held(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, depth + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(held(text)[1])
    for text in target:
        t.update(held(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)}
    out = []
    for no, (doc_id, text) in enumerate(docs):
        n, found = held(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), no])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[5]))
    rank = {r[5]: i for i, r in enumerate(enough[: percent * len(enough) // 100], 1)}
    return Counter((*r[:5], rank.get(r[5])) for r in out)


@pytest.fixture(scope="module")
def docs(spark):
    shipped(spark)
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(9000, None), (9001, ""), (9002, " ,.!\n"), (9003, "Émile ÀB_c9 日本語"), (9004, "very long " * 60000), (9005, "x" * 100000), (None, "a null id " * 30), (9006, "twice here " * 20), (9006, "twice here " * 20)]
    return base.unionByName(spark.createDataFrame(odd, base.schema))


@pytest.mark.parametrize(("depth", "block"), [(1, 500_000), (1, 50), (3, 500_000), (4, 900)])
def test_resample_matches_dictionaries(spark, docs, depth, block, monkeypatch):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    monkeypatch.setattr(importance, "BLOCK", block)
    clashing = docs.selectExpr("*", "1 as row", "2 as t", "3 as bucket", "4 as n", "5 as rank", "6 as _part")
    got = importance.resample(clashing, target, depth=depth, buckets=997, percent=30)
    expected = brute([tuple(r) for r in docs.collect()], [r.text for r in target.collect()], depth, 997, 30, 20, 2024)
    assert Counter(tuple(r) for r in got.collect()) == expected


def test_suffix_array_and_runs():
    random = np.random.default_rng(3)
    for depth in (1, 2, 3, 5, 8):
        sizes = random.integers(0, 12, 40)
        ids = random.integers(1, 4, sizes.sum())
        upto = np.cumsum(sizes)
        ends = np.repeat(upto, sizes)
        order = importance.suffix_array(ids, ends, depth)
        words = [tuple(ids[p : min(e, p + depth)]) for p, e in enumerate(ends)]
        assert [words[p] for p in order] == sorted(words)
        spelled = [b"", b"a", b"b", b"c"]
        for n, (at, bucket) in enumerate(importance.run_buckets(spelled, ids, ends, depth, 97), 1):
            expected = {p: crc32(b" ".join(spelled[i] for i in ids[p : p + n])) % 97 for p in range(len(ids)) if p + n <= ends[p]}
            assert dict(zip(at.tolist(), bucket.tolist(), strict=True)) == expected


def test_empty_tables(spark, docs):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert importance.resample(docs.limit(0), target).count() == 0
    out = importance.resample(docs, target.limit(0), depth=1).collect()
    assert len(out) == docs.count() and {r.weight for r in out if not r.n_features} == {0}
