"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import re
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from vigil.llm import htmltext, outliers, simhash, tokencount, topk, warc
from vigil.llm.shared import shipped

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    shipped(spark)
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(9001, None, None, None, None), (9002, "", "en", None, 0), (9003, " \n\t ", None, "src0", 4), (9004, "One", "en", "src0", 3), (9005, "ONE", "en", "src0", 3),
           (9006, "long " * 30000, "en", "src1", 150000), (9006, "long " * 30000, "en", "src1", 150000), (None, "a null id", "en", "src0", 9), (9007, "x" * 100000, "en", "s", 100000)]
    return base.unionByName(spark.createDataFrame(odd, base.schema)).selectExpr("*", *[f"{v} as {k}" for k, v in (("n", 1), ("fp", 2), ("salt", 3), ("n_words", 4), ("key", 5), ("root", 6))])


def test_simhash_matches_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()

    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not w:
            return 0
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [brute(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            parent[find(j)] = find(i)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    expected = Counter((r.doc_id, fps[i], least.get(find(i))) for i, r in enumerate(rows))
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == expected


@pytest.mark.parametrize("radius", [2, 4])
def test_every_pair_within_the_radius_is_connected(spark, radius, monkeypatch):
    rng, values = np.random.default_rng(1), set()
    for _ in range(30):
        center = int(rng.integers(0, 2**63))
        values |= {center ^ sum(1 << int(b) for b in rng.choice(64, size=rng.integers(0, 4), replace=False)) for _ in range(30)}
    values = sorted(v - 2**64 if v >> 63 else v for v in values)
    parent = {v: v for v in values}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(values, 2):
        if ((a ^ b) % 2**64).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    for small in (32, 3):  # the second takes the way of large buckets
        monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
        edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), radius)
        assert all(((r.a ^ r.b) % 2**64).bit_count() <= radius for r in edges.collect())
        roots = {r.node: r.root for r in simhash.components(edges).collect()}
        assert all(roots.get(v, v) == find(v) for v in values)


def test_simhash_of_an_empty_table(docs):
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_masks_cover_the_radius():
    cover = simhash.covering_masks(2)
    assert len(cover) == 7
    assert all(any(not (1 << a | 1 << b) & m for m in cover) for a, b in combinations(range(64), 2))


def test_token_counts(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = tokencount.tokenizer(path)
    got = {(r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(docs, path, chunk=3000, overlap=64).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got == {(r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False))) for r in rows}


@pytest.mark.parametrize("text", ["x" * 5000 + " a b" * 50, "<|endoftext|> Σας ΣΑΣ " * 100, "é́ " * 500, "ab1" * 3000, "　", "don't 's 12 " * 200, "a ́b\x85c" * 99])
def test_spliced_tokens_are_those_of_the_whole(text):
    tok = tokencount.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    whole = tok.encode(text, add_special_tokens=False)
    assert tokencount.encode_long(tok, text, 300, 20) == [(i, *o) for i, o in zip(whole.ids, whole.offsets, strict=True)]
    assert tokencount.count_short(tok, text, {}) == len(whole)


def test_quality_rule_counts_and_verdicts(docs):
    got = outliers.quality_rules(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    for r in docs.select("doc_id", "text").collect():
        text = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = by[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert g.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (g.base_failed and g.kept)


def test_minimum_covariance_determinant(spark):
    """The distributed estimate against the same starts and steps in numpy, for three groups of their own."""
    rng = np.random.default_rng(3)
    data, sizes = [], {"a": (400, 60), "b": (300, 90), "c": (9, 3)}
    for name, (n, bad) in sizes.items():
        data += [(len(data) + i, "=en", name, *map(int, np.maximum(0, rng.multivariate_normal((1700, 100, 50, 20), np.diag((3600, 1600, 900, 100)) + 30)))) for i in range(n)]
        data += [(len(data) + i, "=en", name, 1900 + i % 7, 1500, 900, 300 + i % 3) for i in range(bad)]
    rows = spark.createDataFrame(data, "doc_id long, lang string, source string, x0 long, x1 long, x2 long, x3 long").withColumn("salt", F.pmod("doc_id", F.lit(outliers.SALTS)).cast("int"))
    rows = rows.select("lang", "source", "salt", "x0", "x1", "x2", "x3", "doc_id")
    best = outliers._best(rows)
    final = {r.source: r for r in outliers._reweighted(rows, best).collect()}
    chosen = {r.source: r for r in best.collect()}
    floors = np.diag((np.array(outliers.FLOORS) * outliers.UNIT) ** 2)
    square = lambda x, m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def nearest(x, m, c, share, scale):
        bins = np.floor(outliers.BINS * np.log2(1 + square(x, m, c)))
        inside = bins <= np.sort(bins)[int(np.ceil(share * len(x))) - 1]
        return x[inside].mean(axis=0), np.cov(x[inside].T, bias=True) * scale + floors

    for name in sizes:
        x = np.array([r[3:] for r in data if r[2] == name], float)
        rank = lambda p, n=len(x): int(np.ceil(p * n)) - 1
        tens = np.sort(np.floor(x / 10) * 10 + 5, axis=0)
        median, spread = tens[rank(0.5)], (tens[rank(0.75)] - tens[rank(0.25)]) / 1.349
        first = np.diag(spread**2) + floors
        sd = np.sqrt(np.diag(first))
        y = (x - median) / sd
        unit = y / np.sqrt((y**2).sum(axis=1, keepdims=True))
        starts = {"quartiles": (median, first), "signs": (median, unit.T @ unit / len(x) * 4 * np.outer(sd, sd) + floors), "half": nearest(x, median, first, 0.5, 1.0)}
        found = []
        for start, (m, c) in starts.items():
            m, c = nearest(x, m, c, outliers.SUBSET, outliers.consistency())
            det = np.linalg.slogdet(c)[1]
            while (new := nearest(x, m, c, outliers.SUBSET, outliers.consistency())) and (less := np.linalg.slogdet(new[1])[1]) < det - outliers.FALL:
                (m, c), det = new, less
            if less <= det:
                (m, c), det = new, less
            found.append((det, start, m, c))
        log_det, _, m, c = min(found, key=lambda f: (round(f[0], 6), f[1]))
        got = chosen[name]
        assert np.allclose([got[f"m{i}"] for i in range(4)], m) and np.allclose([got[f"c{i}{j}"] for i, j in outliers.PAIRS], [c[i, j] for i, j in outliers.PAIRS], rtol=1e-6)
        near = x[square(x, m, c) <= outliers.chi2_quantile(outliers.REWEIGHT, 4)]
        scale = outliers.REWEIGHT / outliers.chi2_cdf(outliers.chi2_quantile(outliers.REWEIGHT, 4), 6)
        m, c = near.mean(axis=0), np.cov(near.T, bias=True) * scale + floors
        got = final[name]
        assert np.allclose([got[f"m{i}"] for i in range(4)], m) and np.allclose([got[f"c{i}{j}"] for i, j in outliers.PAIRS], [c[i, j] for i, j in outliers.PAIRS], rtol=1e-6)
        d2, (n, bad) = square(x, m, c), sizes[name]
        assert (d2[:n] < outliers.chi2_quantile(1 - outliers.TAIL, 4)).mean() > 0.97
        assert n < 20 or d2[n:].min() > outliers.chi2_quantile(1 - outliers.TAIL, 4)


def test_small_groups_are_drawn_to_wider_ones(spark):
    state = [("*", "*", 1000, 0.0), ("=en", "*", 60, 10.0), ("=en", "=s", 40, 20.0), ("=en", "=t", 0, 90.0)]
    rows = spark.createDataFrame([(a, b, n, *[m] * 14) for a, b, n, m in state], f"lang string, source string, total long, {', '.join(f'{c} double' for c in [*outliers.MEANS, *outliers.COVS])}")
    got = {r.source: r for r in outliers._shrunk(rows).collect()}
    of_lang = 10 * 0.6 + 0 * 0.4
    assert got["=s"].m0 == 20 * 0.5 + of_lang * 0.5 and got["=t"].c33 == of_lang and set(got) == {"=s", "=t"}


def test_quality_rules_with_clashing_columns(docs):
    clashing = docs.selectExpr("*", "1 as start", "2 as total", "3 as x0", "4 as bin", "5 as kept")
    key = lambda r: (r.doc_id, r.kept, r.distance)
    assert Counter(map(key, outliers.quality_rules(clashing).collect())) == Counter(map(key, outliers.quality_rules(docs).collect()))


def test_quality_rules_of_an_empty_table(docs):
    assert outliers.quality_rules(docs.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="page sidebar-right"><header><h1>Site</h1></header>
<nav><a href=/>Home</a></nav><div id="cookie-notice">We use cookies</div><div><article><h1>Title &amp; more</h1>
<p>Para one   is <b>long</b> and <a href=x>linked</a>, caf&eacute; &#8212; yes.<p>Second<br>line of text, rather long it is.<script>var x="</p>";</script>
<ul><li>item one<li>item two</ul><div class="ad">Buy</div></article><section class="comments"><p>Nice post! Nice post! Nice post! Nice!</p></section></div>
<aside>side</aside><form><input>f</form><footer>&copy; c</footer></body>"""


def test_html_text(spark):
    shipped(spark)
    rows = [(1, PAGE), (2, None), (3, ""), (4, "plain words"), (5, "<p>unclosed <b>bold"), (5, "<p>unclosed <b>bold"), (6, "<div>" * 3000 + "deep" + "</div>" * 3000), (7, "<!-- only --><nav>x</nav>")]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))).collect()}
    assert got[1] == "Title & more\nPara one is long and linked, café — yes.\nSecond line of text, rather long it is.\nitem one\nitem two"
    assert [got[i] for i in range(2, 8)] == ["", "", "plain words", "unclosed bold", "deep", ""]


def test_html_text_is_the_article_of_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in htmltext.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(htmltext.entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (1, "http://c/x\ny", None), (2, "http://d/", ""), (7, "http://e/", "é" * 50000), (None, "http://f/", "same"), (4, "http://g/", "own"), (4, "http://g/", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("first", F.lit(2))
    folder = warc.archive(shipped(spark) and pages, f"file://{tmp_path}/w")
    got = Counter(tuple(r)[:6] for r in warc.read(spark, folder).drop("url", "payload", "record_id").collect())
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    expected = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = i is not None and i > first[h or ""]
        expected[(i, "revisit" if again else "response", first[h or ""] if again else None, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())] += 1
    assert got == expected
    payloads = {r.page_id: r.payload for r in warc.read(spark, folder).filter("record_type = 'response'").collect()}
    assert payloads[7] == ("é" * 50000).encode() and payloads[3] == b"same" and payloads[1] == b""
    assert warc.read(spark, folder).filter("record_type = 'revisit' and url like 'http://a%'").select("page_id").collect()[0][0] == 5
    assert {r.page_id for r in warc.read(spark, folder, payload=False).filter("page_id in (1, 2)").collect()} == {1, 2}
    small = spark.read.format("warc").option("partitionBytes", "100").load(folder)
    assert sorted(r.payload_digest for r in small.collect()) == sorted(r.payload_digest for r in warc.read(spark, folder).collect())


def test_warc_of_an_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(spark, warc.archive(pages, f"file://{tmp_path}/w")).count() == 0


def test_top_k_matches_brute_force(spark):
    shipped(spark)
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(0, 0.3, 6).astype("float32")], 1) for i in range(400)]
    rows += [(400 + i, rows[50][1], 1) for i in range(8)] + [(450, None, 1), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (550, [float("nan")] * 6, 1), (600, [float("inf")] + [0.0] * 5, 1), (None, [1.0] * 6, 1), (650, [], 1), (700, [0.0] * 6, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("shard", F.lit(1)).withColumn("q", F.lit(7))
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0, shard=60, block=3).collect()}
    good = [(i, [int(np.floor(256 * float(np.float32(v)))) for v in e]) for i, e, _ in rows if i is not None and e and all(v is not None and np.isfinite(v) for v in e)]
    expected = set()
    for i, e in good:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), j) for j, f in good if j != i)[:5]
            expected |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    assert got == expected


def test_top_k_hands_python_one_block_and_shard_at_a_time(spark):
    """Joined rows with a shard and a block each gathered in batches, so that workers held more with every shard."""
    rows = shipped(spark).range(500).selectExpr("id as vec_id", "array(float(id % 7), float(id % 3 - 1)) as embedding")
    plan = topk.top_k(rows, F.col("vec_id") % 50 == 0, shard=60, block=3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsIn" in plan and "MapInPandas" not in plan and "MapInArrow" not in plan


def test_top_k_of_vectors_of_different_lengths(spark):
    """One long vector makes no shard of each row; it is searched among those of its own length."""
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=4).round(2)]) for i in range(200)] + [(1000 + 50 * i, [float(i % 7)] * 3000) for i in range(8)]
    got = topk.top_k(shipped(spark).createDataFrame(data, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in data]
    expected = {(q, k, -j, s) for q, v in whole if q % 50 == 0 for k, (s, j) in enumerate(sorted(((int(v @ x), -i) for i, x in whole if i != q and len(x) == len(v)), reverse=True)[:5], 1)}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected) == 60


@pytest.mark.parametrize("scale", [1, 3000, 1 << 28])
def test_top_k_search_of_ties_and_large_numbers(scale):
    """Rows that are all alike, whose ties go to smaller ids, and products that need more bits."""
    rng = np.random.default_rng(3)
    points = np.concatenate([np.full((700, 3), 2), rng.integers(-4, 5, (300, 3)), rng.integers(-4, 5, (1, 3)) * 0]) * scale + rng.integers(0, 2, (1001, 1)) * (scale > 1)
    ids = np.sort(rng.permutation(5000)[:1001])
    parts = [(ids[at], points[at], points[at].min(axis=0), points[at].max(axis=0)) for at in topk.leaves(points, 16)]
    assert sorted(np.concatenate([p[0] for p in parts])) == list(ids) and max(len(p[0]) for p in parts) <= 16
    asked, own = points[::7], ids[::7]
    exact = [sorted((-sum(int(a) * int(b) for a, b in zip(q, p, strict=True)), int(i)) for i, p in zip(ids, points, strict=True) if i != o)[:5] for q, o in zip(asked, own, strict=True)]
    for floors in (np.full(len(own), topk.NONE), np.array([-e[4][0] for e in exact])):
        row, found, score = topk.search(asked, own, floors, parts, 5)
        assert [(int(r), -int(s), int(i)) for r, s, i in zip(row, score, found, strict=True)] == [(n, *x) for n, e in enumerate(exact) for x in e]


def test_top_k_of_an_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_with_repeated_ids(spark):
    """Rows that share an id do not find each other; each is a candidate for others."""
    rng = np.random.default_rng(8)
    data = [(i // 2, [float(x) for x in rng.normal(size=6).round(3)]) for i in range(300)]
    rows = shipped(spark).createDataFrame(data, "vec_id long, embedding array<float>")
    got = topk.top_k(rows, F.col("vec_id") % 50 == 0, k=5, shard=64, block=3).collect()
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in data]
    expected = Counter()
    for q in {i for i, _ in data if i % 50 == 0}:
        scores = sorted(((int(v @ x), -j) for i, x in whole if i == q for j, v in whole if j != q), reverse=True)[:5]
        expected.update((q, k, -j, s) for k, (s, j) in enumerate(scores, 1))
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == expected
