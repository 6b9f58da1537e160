"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic regression on text statistics and hashed words gives each document a probability of being good.
The sums of these over a host and over each path of a host are pooled: a host's rate is shrunk towards the
global rate, a path's towards its host's, with strengths estimated from the spread of the rates (method of
moments of the beta-binomial). The document's odds are then moved by the odds of its path's rate
against the global rate; its own probability takes no part in the rates that judge it.

Tables without addresses have sites all the same: `documents` is judged with source as host and lang as path.

Probabilities are summed as millionths, so sums are exact and do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, own_memory, skew_join, stored, words

#: Labels beyond so many are thinned to about so many, by a hash of the document's id, to fit the classifier.
MAX_LABELLED = 20_000
#: Words are counted in so many classes by hash.
HASHED = 256
#: Rows of a batch that are taken together.
AT_ONCE = 1_000
UNIT = 1_000_000
#: What shares of words are multiplied with beside FEATURES, which are about 1.
SCALE = 4.0
FEATURES = ("length", "symbols", "capitals", "shouts", "bars", "digits", "word_length", "repeated_lines", "variety")
SITE = ["host", "path"]


def features(text: Column) -> list[Column]:
    """Needs the columns `_words` and `_lines` beside the text."""
    chars = F.greatest(F.length(text), F.lit(1))
    n_words, n_lines = F.greatest(F.size("_words"), F.lit(1)), F.greatest(F.size("_lines"), F.lit(1))
    share = lambda pattern: F.sqrt(F.regexp_count(text, F.lit(pattern)) / chars)
    values = [
        F.log(1.0 + F.length(text)) / 5, share(r"[#*$%&<>]"), share(r"\p{Lu}"), share("!"), share(r"\|"), share(r"[0-9]"),
        F.log((chars + 60) / (n_words + 10)), F.sqrt(1 - F.size(F.array_distinct("_lines")) / n_lines), F.size(F.array_distinct("_words")) / n_words,
    ]
    return [v.cast("double").alias(n) for v, n in zip(values, FEATURES, strict=True)]


def text_features(docs: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """`doc_id`, `host`, `path`, `text_hash`, FEATURES and the hash class of each word (`classes`) of every row; null text counts as empty, a null site as the empty string."""
    site = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((host_col, "host"), (path_col, "path"))]
    rows = docs.select(F.col(id_col).alias("doc_id"), *site, text_hash(F.col(text_col)).alias("text_hash"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.select("*", words(F.col("_t")).alias("_words"), F.filter(F.split("_t", "\n"), lambda x: x != "").alias("_lines"))
    return rows.select("doc_id", *SITE, "text_hash", *features(F.col("_t")), F.transform("_words", lambda w: F.pmod(F.xxhash64(w), F.lit(HASHED)).cast("short")).alias("classes"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def design(rows: pd.DataFrame) -> np.ndarray:
    """A row's FEATURES, the shares of its words in each class, and one."""
    sizes = np.array([len(c) for c in rows["classes"]], np.int64)
    flat = np.concatenate([np.asarray(c, np.int64) for c in rows["classes"]]) if sizes.sum() else np.zeros(0, np.int64)
    counts = np.bincount(np.repeat(np.arange(len(rows)), sizes) * HASHED + flat, minlength=len(rows) * HASHED).reshape(-1, HASHED)
    shares = counts / np.maximum(1, sizes)[:, None] * SCALE
    return np.column_stack([rows[list(FEATURES)].to_numpy(float), shares, np.ones(len(rows))])


def fit(rows: DataFrame, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method: weights of FEATURES, word classes and, last, the intercept.

    Each round sums the gradient and the matrix of second derivatives over the rows on the executors; the driver gets
    these sums alone, some 35,000 numbers, however many rows there are.
    """
    size = len(FEATURES) + HASHED + 1
    w, keep = np.zeros(size), np.full(size, ridge)
    keep[-1] = 1e-6
    up = np.triu_indices(size)

    def sums(at: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own_memory("quality")
            second, first = np.zeros((size, size)), np.zeros(size)
            for batch in batches:
                for i in range(0, len(batch), AT_ONCE):
                    some = batch.iloc[i : i + AT_ONCE]
                    x = design(some)
                    p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
                    second += (x * (p * (1 - p))[:, None]).T @ x
                    first += x.T @ (some["y"].to_numpy(float) - p)
            yield pd.DataFrame({"i": np.append(up[0], np.arange(size)), "j": np.append(up[1], np.full(size, -1)), "v": np.append(second[up], first)})

        return run

    for _ in range(rounds):
        told = rows.mapInPandas(sums(w.copy()), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
        i, j, v = (told[c].to_numpy() for c in ("i", "j", "v"))
        second, first = np.zeros((size, size)), np.zeros(size)
        of_first = j < 0
        first[i[of_first]] = v[of_first]
        second[i[~of_first], j[~of_first]] = second[j[~of_first], i[~of_first]] = v[~of_first]
        step = np.linalg.solve(second + np.diag(keep), first - keep * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def trained(table: DataFrame, labels: DataFrame, label_col: str = "quality") -> np.ndarray:
    """The classifier's weights (FEATURES, then word classes, then the intercept) from the rows of `table` that `labels` covers; zeros if those lack either class."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label_col).cast("int").alias("y")).distinct()
    share = min(1.0, MAX_LABELLED / max(1, known.count()))
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = stored(table.join(known, "doc_id").select("doc_id", "text_hash", *FEATURES, "classes", "y").dropDuplicates(["doc_id", "text_hash", "y"]), "labelled")
    both = some.agg(F.count_distinct("y")).first()[0] == 2
    w = fit(some) if both else np.zeros(len(FEATURES) + HASHED + 1)
    discard(some)
    return w


def strength(n_rows: float, n_groups: float, sum_squares: float, spread: float, mean: float) -> float:
    """How many rows the prior of a level is worth: large where its groups differ no more than by chance."""
    within, most = mean * (1 - mean), 1e6
    room = n_rows - sum_squares / max(n_rows, 1)
    between = (spread - max(0, n_groups - 1) * within) / room if room > 0 else 0.0
    return min(most, max(1.0, within / between - 1)) if between > 0 else most


def _spread(groups: DataFrame, rate: Column, mean: Column) -> tuple:
    """Rows, groups, sum of squared sizes and the weighted squared distance of the groups' rates from their means."""
    r = groups.select(F.col("n"), rate.alias("r"), mean.alias("m")).agg(
        F.sum("n"), F.count("*"), F.sum(F.col("n").cast("double") * F.col("n")), F.sum(F.col("n") * (F.col("r") - F.col("m")) * (F.col("r") - F.col("m")))
    )
    return tuple(float(v or 0) for v in r.first())


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """`doc_id`, `text_hash`, `document_score`, `site_score`, `score` and `kept` (score of at least `threshold`) of every row.

    Null text counts as empty, a null host or path as the empty string; repeated rows count as often as they
    occur. With labels of one class only, or none, every document score is one half. An empty table gives
    an empty result.
    """
    table = stored(text_features(docs, id_col, text_col, host_col, path_col), "features")
    w = trained(table, labels)
    z = F.lit(float(w[-1]))
    for f, v in zip(FEATURES, w, strict=False):
        z = z + F.col(f) * float(v)
    by_class = F.split(F.lit(",".join(repr(float(v) * SCALE) for v in w[len(FEATURES) : -1])), ",").cast("array<double>")
    z = z + F.aggregate("classes", F.lit(0.0), lambda total, c: total + F.get(by_class, c.cast("int"))) / F.greatest(F.size("classes"), F.lit(1))
    p = F.round(1 / (1 + F.exp(-z)) * UNIT).cast("long")
    scored = stored(table.select("doc_id", *SITE, "text_hash", p.alias("p")), "scores")
    discard(table)
    paths = stored(scored.groupBy(*SITE).agg(F.count("*").alias("n"), F.sum("p").alias("p")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("p").alias("host_p"))
    n, total = paths.agg(F.sum("n"), F.sum("p")).first()
    mean = min(1 - 1e-6, max(1e-6, (total or 0) / UNIT / n)) if n else 0.5
    rate = F.col("p") / UNIT / F.col("n")
    host_pull = strength(*_spread(hosts.select(F.col("host_n").alias("n"), F.col("host_p").alias("p")), rate, F.lit(mean)), mean)
    shrunk = lambda prior, pull, p, n: (prior * pull + p / UNIT) / (n + pull)
    joined = paths.join(hosts, "host")
    path_pull = strength(*_spread(joined, rate, shrunk(F.lit(mean), host_pull, F.col("host_p"), F.col("host_n"))), mean)
    sites = stored(joined.select(*SITE, F.col("n").alias("path_n"), F.col("p").alias("path_p"), "host_n", "host_p"), "rates")
    discard(paths)
    found = skew_join(scored, sites, SITE, int(n or 0), "path_n")
    host_rate = shrunk(F.lit(mean), host_pull, F.col("host_p") - F.col("p"), F.col("host_n") - 1)
    found = found.withColumn("site_score", shrunk(host_rate, path_pull, F.col("path_p") - F.col("p"), F.col("path_n") - 1))
    odds = logit(F.col("p") / UNIT) + logit(F.col("site_score")) - logit(F.lit(mean))
    found = found.select("doc_id", "text_hash", (F.col("p") / UNIT).alias("document_score"), "site_score", (1 / (1 + F.exp(-odds))).alias("score"))
    return found.withColumn("kept", F.col("score") >= threshold)
