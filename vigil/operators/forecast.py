"""Forecast of daily counts by an additive model: a trend with change points and a weekly season.

A day's count, as a share of the series' greatest, is the sum of a straight line, a bend at each of CHANGES places spread over the
first four fifths of the history, and three pairs of weekly waves. Bends, waves and line are fitted together by least
squares with a penalty each (the noise's variance over that of a normal prior), so that few bends stay. Spark sums the
normal equations over the days; each series' solution needs only these 34 x 34 sums, however long it is.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import shipped

CHANGES, WAVES = 25, 3
#: Standard deviations of the priors: bends, waves, line.
BEND, WAVE, LINE = 0.05, 10.0, 5.0
N_FEATURES = 2 + CHANGES + 2 * WAVES
#: Half the width of a 95 % band in standard deviations.
Z = 1.96
LEAST_NOISE = 1e-2
SCHEMA = "threat_type string, day date, ahead int, trend double, weekly double, value double, lower double, upper double, slope double, mean double, days long"


def bends() -> list[float]:
    return [0.8 * (j + 1) / CHANGES for j in range(CHANGES)]


def features(at: Column, day: Column) -> list[Column]:
    """The model's columns for a place `at` in the history (0 its first day, 1 its last) and its weekday."""
    turn = F.unix_date(day) % 7 * (2 * math.pi / 7)
    waves = [f(turn * k) for k in range(1, WAVES + 1) for f in (F.sin, F.cos)]
    return [F.lit(1.0), at, *[F.greatest(F.lit(0.0), at - s) for s in bends()], *waves]


def feature_rows(at: np.ndarray, epoch_day: np.ndarray) -> np.ndarray:
    """The same, a row a day."""
    turn = epoch_day % 7 * (2 * math.pi / 7)
    waves = [f(turn * k) for k in range(1, WAVES + 1) for f in (np.sin, np.cos)]
    return np.column_stack([np.ones(len(at)), at, *[np.maximum(0, at - s) for s in bends()], *waves])


def solve(xx: np.ndarray, xy: np.ndarray, yy: float, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The weights, the inverse of the penalised normal matrix, and the noise's standard deviation.

    The noise that sets the penalties is that of the fit without bends.
    """
    kinds = np.array([LINE] * 2 + [BEND] * CHANGES + [WAVE] * 2 * WAVES)

    def fitted(use: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray, float]:
        a = xx[np.ix_(use, use)]
        inverse = np.linalg.inv(a + np.diag(noise**2 / kinds[use] ** 2))
        w = inverse @ xy[use]
        free = max(1.0, n - np.trace(inverse @ a))
        return w, inverse, max(LEAST_NOISE, math.sqrt(max(0.0, yy - 2 * w @ xy[use] + w @ a @ w) / free))

    every = np.arange(N_FEATURES)
    noise = fitted(np.concatenate([every[:2], every[2 + CHANGES :]]), LEAST_NOISE)[2]
    return fitted(every, noise)


def additive(series: DataFrame, ahead: int = 7) -> DataFrame:
    """The `ahead` days after each series (`threat_type`, `day`, `n`: a row a day, every day between its first and last; so trend.dense with `calendar`).

    `value` is trend and season together, at least 0; `lower` and `upper` are the band of 95 %, which
    holds the noise and what is uncertain about the weights, `lower` at least 0. `slope` is the trend's gain a day over the history. A series of
    one day stays at its value, without a band. Days without a count (null) are left out.
    """
    shipped(series.sparkSession)
    rows = series.filter("n is not null and day is not null")
    span = rows.groupBy("threat_type").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.max(F.abs("n")).cast("double").alias("top"), F.avg("n").alias("mean"), F.count("*").alias("days"))
    known = rows.join(span, "threat_type")
    at = F.date_diff("day", "first") / F.greatest(F.lit(1), F.date_diff("last", "first"))
    y = F.when(F.col("top") > 0, F.col("n") / F.col("top")).otherwise(0.0)
    known = known.select("threat_type", F.array(*features(at, F.col("day")), y).alias("f"))
    products = known.select("threat_type", "f", F.posexplode("f").alias("i", "a")).select("threat_type", "i", "a", F.posexplode("f").alias("j", "b")).filter("j >= i")
    sums = products.groupBy("threat_type", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    packed = sums.groupBy("threat_type").agg(F.collect_list(F.struct("i", "j", "s")).alias("sums")).join(span, "threat_type")

    def paths(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                m = np.zeros((N_FEATURES + 1, N_FEATURES + 1))
                for x in r.sums:
                    m[x["i"], x["j"]] = m[x["j"], x["i"]] = x["s"]
                length = max(1, (r.last - r.first).days)
                steps = np.arange(1, ahead + 1)
                days = [r.last + pd.Timedelta(days=int(k)) for k in steps]
                epoch = np.array([(d - pd.Timestamp("1970-01-01").date()).days for d in days])
                if r.days < 2:
                    flat = np.full(ahead, r.top if r.mean >= 0 else -r.top)
                    trend, weekly, spread, slope = flat, np.zeros(ahead), np.zeros(ahead), 0.0
                else:
                    w, inverse, noise = solve(m[:-1, :-1], m[:-1, -1], m[-1, -1], int(r.days))
                    x = feature_rows((length + steps) / length, epoch)
                    line = slice(0, 2 + CHANGES)
                    ends = feature_rows(np.array([0.0, 1.0]), np.zeros(2))[:, line] @ w[line] * r.top
                    trend, weekly, slope = x[:, line] @ w[line] * r.top, x[:, line.stop :] @ w[line.stop :] * r.top, (ends[1] - ends[0]) / r.days
                    spread = Z * noise * np.sqrt(1 + np.einsum("ij,jk,ik->i", x, inverse, x)) * r.top
                value = trend + weekly
                yield pd.DataFrame({
                    "threat_type": r.threat_type, "day": days, "ahead": steps, "trend": trend, "weekly": weekly, "value": np.maximum(0, value), "lower": np.maximum(0, value - spread),
                    "upper": value + spread, "slope": slope, "mean": r.mean, "days": r.days,
                })

    return packed.mapInPandas(paths, SCHEMA)


def outlook(paths: DataFrame) -> DataFrame:
    """Per type, from the last day of `additive`: prediction and band, direction (the slope against a tenth of the mean, or a half where that is 0), change and whether a week of data stands behind it."""
    last = paths.groupBy("threat_type").agg(F.max_by(F.struct(*[c for c in paths.columns if c != "threat_type"]), "ahead").alias("r")).select("threat_type", "r.*")
    limit = F.when(F.col("mean") > 0, F.col("mean") * 0.1).otherwise(0.5)
    direction = F.when(F.col("slope") > limit, "increasing").when(F.col("slope") < -limit, "decreasing").otherwise("stable")
    change = F.when(F.col("mean") > 0, (F.col("value") - F.col("mean")) / F.col("mean") * 100).otherwise(0.0)
    return last.select(
        "threat_type", "days", F.round("slope", 3).alias("slope"), direction.alias("direction"), F.round("mean", 1).alias("current_avg"), F.round("value", 1).alias("prediction_7d"), F.round("lower", 1).alias("prediction_lower"),
        F.round("upper", 1).alias("prediction_upper"), F.round(F.col("upper") - F.col("lower"), 1).alias("confidence_interval"), F.round(change, 1).alias("change_percent"), (F.col("days") >= 7).alias("sufficient"),
    )
