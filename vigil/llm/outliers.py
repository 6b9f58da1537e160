"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Every text gets counts, base rules and a vector of four transformed rates. For each (language, source), each language
and the whole table, a minimum-covariance-determinant estimate is made: from three starts (quartiles; directions from the
medians; the half nearest to the medians) concentration steps keep the SUBSET share of rows with the smallest
Mahalanobis distances and estimate mean and covariance from them, until the determinant no longer falls; the start with
the least one wins, and its estimate is made once more from all rows within the REWEIGHT quantile. A group's mean
and covariance are drawn towards its language's, a language's towards the table's, the more the fewer rows it has.
Rows beyond a chi-square quantile of the distance are rejected.

Vectors are integers (thousandths), so all sums are exact and the result does not depend on partitions. Distances
are ranked in bins of 1/256 of a power of two: an order statistic comes from pre-aggregated rows, at most some
thousands a group, and the subset is all rows up to the end of the bin that reaches it. Groups are dealt out with a
salt, so that a hot source is spread over SALTS tasks; starts that have settled take no part in later steps.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, stored, words

WINDOW = 5
SUBSET, REWEIGHT, SALTS = 0.75, 0.975, 64
#: A concentration step counts if the logarithm of the determinant falls by more; the most steps there are.
FALL, MOST_STEPS = 1e-3, 40
#: How many rows the estimate of the next wider level is worth.
PRIOR_ROWS = 40
#: Distances are ranked in so many bins a power of two.
BINS = 256
#: Chi-square probability beyond which a row is an outlier.
TAIL = 1e-4
VECTOR = ("word_length", "symbols", "repeated_lines", "repeated_words")
#: Standard deviations below which no direction is trusted, in the units of the vector.
FLOORS = (0.10, 0.12, 0.12, 0.12)
UNIT = 1000


def chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return low


def text_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """`keep` and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of every row.

    Null text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, text.alias("_t"))
    rows = rows.select(*keep, "_t", F.transform(words(F.col("_t")), lambda w: F.xxhash64(w)).alias("_h"))
    rows = rows.select(*keep, "_t", "_h", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WINDOW)])

    windows = F.when(F.size("_h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), window)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(*keep, "_t", "_lines", F.size("_h").cast("long").alias("n_words"), windows.alias("_w"))
    some = F.size(F.array_distinct("_w")) < F.size("_w")
    placed = F.when(some, F.sort_array(F.transform("_w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>"))
    rows = rows.select(
        *keep,
        "n_words",
        (F.length("_t") - F.regexp_count("_t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        placed.alias("_s"),
    )

    def again(e: Column, j: Column) -> Column:
        near = lambda k: F.coalesce(F.get(F.col("_s"), j + k)["x"] == e["x"], F.lit(False))
        return near(-1) | near(1)

    rows = rows.withColumn("_p", F.sort_array(F.transform(F.filter("_s", again), lambda e: e["i"])))
    covered = F.transform("_p", lambda p, j: F.coalesce(F.least(F.lit(WINDOW), F.get(F.col("_p"), j + 1) - p), F.lit(WINDOW)))
    rows = rows.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
    return rows.drop("_s", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list[Column]:
    """Rates with pseudo-counts, so that short texts are not thrown about, and variance-stabilising transforms."""
    rates = [
        F.log((F.col("word_chars") + 300) / (F.col("n_words") + 50)),
        F.sqrt(F.col("n_symbols") / (F.col("n_words") + 50)),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 10)),
        F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + 50)),
    ]
    return [F.least(F.round(r * UNIT), F.lit(20 * UNIT)).cast("long").alias(f"x{i}") for i, r in enumerate(rates)]


D = len(VECTOR)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
GROUP = ["lang", "source"]
#: Stands for all languages or sources; names themselves begin with "=".
ANY = "*"


MEANS, COVS, FACTORS = [f"m{i}" for i in range(D)], [f"c{i}{j}" for i, j in PAIRS], [f"l{i}{j}" for i, j in PAIRS]
STARTS = ("quartiles", "signs", "half")
KEY = [*GROUP, "start"]


def _sums() -> list[Column]:
    """Sums of the vector and of its products: whole numbers, so exact."""
    return [F.sum(f"x{i}").alias(f"s{i}") for i in range(D)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS]


SUMS = [f"s{i}" for i in range(D)] + [f"q{i}{j}" for i, j in PAIRS]


def _moments(sums: DataFrame, scale: float) -> DataFrame:
    """KEY, `total`, and from sums over `n` rows the means and the scaled covariance with the floors on its diagonal."""
    n = F.col("n")
    state = sums.select(*KEY, "total", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(D)], *[(F.col(f"q{i}{j}") / n).alias(f"q{i}{j}") for i, j in PAIRS])
    return state.select(*KEY, "total", *MEANS, *[((F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * scale + _floor(i, j)).alias(f"c{i}{j}") for i, j in PAIRS])


def _floor(i: int, j: int) -> float:
    return (FLOORS[i] * UNIT) ** 2 if i == j else 0.0


def _factored(state: DataFrame) -> DataFrame:
    """`state` with the Cholesky factor `l{i}{j}` of its covariance, and the logarithm of its determinant."""
    for j in range(D):
        inner = lambda i, j=j: F.col(f"c{i}{j}") - reduce(lambda a, k: a + F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.lit(0.0))
        state = state.withColumn(f"l{j}{j}", F.sqrt(F.greatest(inner(j), F.lit(1.0))))
        for i in range(j + 1, D):
            state = state.withColumn(f"l{i}{j}", inner(i) / F.col(f"l{j}{j}"))
    return state.withColumn("log_det", reduce(lambda a, i: a + F.log(f"l{i}{i}") * 2, range(D), F.lit(0.0)))


def _distances(rows: DataFrame, state: DataFrame, salted: bool = True) -> DataFrame:
    """Rows with the columns of their group's states, and their squared Mahalanobis distance `d2` under each."""
    state = state if "log_det" in state.columns else _factored(state)
    if salted:
        found = rows.join(state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*GROUP, "salt"])
    else:
        found = rows.join(state, GROUP)
    for i in range(D):
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(f"x{i}") - F.col(f"m{i}"))
        found = found.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return found.withColumn("d2", reduce(lambda a, i: a + F.col(f"y{i}") * F.col(f"y{i}"), range(1, D), F.col("y0") * F.col("y0")))


def _quartiles(rows: DataFrame) -> DataFrame:
    """The first start: medians, and interquartile ranges on the diagonal, exact in steps of ten thousandths."""
    dims = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(f"x{i}") / 10).alias("bin")) for i in range(D)]))
    bins = rows.select(*GROUP, dims.alias("e")).groupBy(*GROUP, "e.dim", "e.bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*GROUP, "dim")
    bins = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("total"), F.col("bin") * 10 + 5))
    parts = bins.groupBy(*GROUP, "dim").agg(at(0.25).alias("a"), at(0.5).alias("m"), at(0.75).alias("b"), F.max("total").alias("total"))
    only = lambda i, c: F.max(F.when(F.col("dim") == i, c))
    spread = lambda i: F.pow(only(i, (F.col("b") - F.col("a")) / 1.349), F.lit(2.0)) + _floor(i, i)
    return parts.groupBy(*GROUP).agg(
        F.lit("quartiles").alias("start"), F.max("total").alias("total"), *[only(i, F.col("m")).cast("double").alias(f"m{i}") for i in range(D)],
        *[(spread(i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS],
    )


def _signs(rows: DataFrame, quartiles: DataFrame) -> DataFrame:
    """The second start: the covariance of directions from the medians, each row's cut to length one, in units of the quartiles."""
    ones = [F.sum(F.when(F.col("d2") > 0, F.round(F.col(f"y{i}") * F.col(f"y{j}") / F.col("d2") * 1e6)).otherwise(0).cast("long")).alias(f"u{i}{j}") for i, j in PAIRS]
    found = _distances(rows, quartiles).groupBy(*GROUP).agg(*ones).join(_factored(quartiles), GROUP)
    share = lambda i, j: F.col(f"u{i}{j}") / 1e6 / F.col("total") * D * F.col(f"l{i}{i}") * F.col(f"l{j}{j}")
    return found.select(*GROUP, F.lit("signs").alias("start"), "total", *MEANS, *[(share(i, j) + _floor(i, j)).alias(f"c{i}{j}") for i, j in PAIRS])


def _nearest(rows: DataFrame, state: DataFrame, share: float, scale: float) -> DataFrame:
    """The moments of the `share` of each group's rows with the smallest distances under each of its states: all rows up to the end of the bin that reaches it."""
    binned = _distances(rows, state).withColumn("bin", F.floor(BINS * F.log2(1 + F.col("d2"))))
    parts = binned.groupBy(*KEY, "bin").agg(F.count("*").alias("n"), F.max("total").alias("total"), *_sums())
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*KEY).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = parts.withColumn("before", before).filter(F.col("before") < F.ceil(share * F.col("total")))
    kept = inside.groupBy(*KEY).agg(F.max("total").alias("total"), F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in SUMS])
    return _moments(kept, scale)


def _best(rows: DataFrame) -> DataFrame:
    """Each group's state of the least determinant, after concentration steps from every start until its determinant no longer falls; ties to the first by name.

    Whoever has settled takes no part in further steps. MOST_STEPS is far more than any start has needed.
    """
    quartiles = stored(_quartiles(rows), "quartiles")
    half = _nearest(rows, quartiles, 0.5, 1.0).withColumn("start", F.lit("half"))
    starts = stored(quartiles.unionByName(_signs(rows, quartiles)).unionByName(half), "starts")
    discard(quartiles)
    columns = [*KEY, "total", *MEANS, *COVS, *FACTORS, "log_det"]
    step = lambda state: _factored(_nearest(rows, state, SUBSET, consistency())).select(*columns)
    state = stored(step(starts), "step")
    settled, tables = [], [starts, state]
    for _ in range(MOST_STEPS):
        both = step(state).join(state.select(*KEY, F.struct(*columns).alias("old")), KEY)
        # each step is one table: what falls on, and the better of the two where it does not
        falls = F.col("log_det") < F.col("old.log_det") - FALL
        least = F.when(F.col("log_det") <= F.col("old.log_det"), F.struct(*columns)).otherwise(F.col("old"))
        table = stored(both.select(falls.alias("falls"), least.alias("s")).select("falls", "s.*"), "step")
        tables.append(table)
        settled.append(table.filter("not falls").select(*columns))
        state = table.filter("falls").select(*columns)
        if state.isEmpty():
            break
    done = reduce(DataFrame.unionByName, settled, state)
    least = F.min_by(F.struct("start", "total", *MEANS, *COVS), F.struct("log_det", "start"))
    out = stored(done.groupBy(*GROUP).agg(least.alias("s")).select(*GROUP, "s.*"), "least")
    discard(*tables)
    return out


def _reweighted(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The moments of the rows within the REWEIGHT quantile of their group's state; where there are none, the state."""
    near = _distances(rows, state).filter(F.col("d2") <= chi2_quantile(REWEIGHT, D))
    sums = near.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("total").alias("total"), *_sums())
    scale = REWEIGHT / chi2_cdf(chi2_quantile(REWEIGHT, D), D + 2)
    new = _moments(sums, scale)
    return new.unionByName(state.join(new.select(*KEY), KEY, "left_anti"))


def _shrunk(state: DataFrame) -> DataFrame:
    """Each language's state drawn towards the table's and each group's towards its language's: of n rows, by PRIOR_ROWS / (n + PRIOR_ROWS)."""
    weight = F.col("total") / (F.col("total") + PRIOR_ROWS)
    names = [*MEANS, *COVS]

    def drawn(fine: DataFrame, wide: DataFrame, on: str) -> DataFrame:
        wide = wide.select(on, *[F.col(c).alias(f"w_{c}") for c in names])
        return fine.join(wide, on).select(*GROUP, "total", *[(F.col(c) * weight + F.col(f"w_{c}") * (1 - weight)).alias(c) for c in names])

    any_lang, any_source = F.col("lang") == ANY, F.col("source") == ANY
    of_table = state.filter(any_lang & any_source).withColumn("one", F.lit(1))
    of_lang = drawn(state.filter(~any_lang & any_source).withColumn("one", F.lit(1)), of_table, "one")
    return drawn(state.filter(~any_source), of_lang, "lang")


def consistency() -> float:
    """What makes the covariance of the central SUBSET share of a normal sample that of the whole."""
    return SUBSET / chi2_cdf(chi2_quantile(SUBSET, D), D + 2)


def _levels(rows: DataFrame) -> DataFrame:
    """The vectors of `rows` once for their group, once for their language and once for the whole table."""
    names = [f"x{i}" for i in range(D)]
    fine = rows.select(*GROUP, "salt", *names)
    any_source = F.struct("lang", F.lit(ANY).alias("source"))
    both = F.struct(F.lit(ANY).alias("lang"), F.lit(ANY).alias("source"))
    return fine.select(F.explode(F.array(F.struct(*GROUP), any_source, both)).alias("g"), "salt", *names).select("g.*", "salt", *names)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """`doc_id`, the counts, `base_failed`, `distance` (squared; null if not measured) and `kept` of every row.

    Rows that fail the base rules are rejected and take no part in the estimates. Null language or source
    counts as the empty string. A small group is judged mostly by the estimate of its language, and of the table where
    that is small too (see `_shrunk`). Repeated rows count as often as they occur; an empty table gives an empty result.
    """
    named = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.concat(F.lit("="), F.coalesce(F.col(lang_col).cast("string"), F.lit(""))).alias("lang"), F.concat(F.lit("="), F.coalesce(F.col(source_col).cast("string"), F.lit(""))).alias("source")
    )
    table = stored(text_statistics(named).withColumn("base_failed", base_failed()), "statistics")
    salted = table.select("*", *vector(), F.pmod(F.xxhash64("doc_id", "n_words", "word_chars", "n_symbols"), F.lit(SALTS)).cast("int").alias("salt"))
    rows = salted.filter("not base_failed")
    levels = stored(_levels(rows), "levels")
    best = _best(levels)
    state = stored(_shrunk(_reweighted(levels, best)), "states")
    discard(levels, best)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = _distances(rows, state).withColumn("kept", F.col("d2") <= chi2_quantile(1 - TAIL, D))
    failed = table.filter("base_failed").select("doc_id", *counts, "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.select("doc_id", *counts, "base_failed", F.col("d2").alias("distance"), "kept").unionByName(failed)
