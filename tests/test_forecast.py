"""The additive forecast against numpy over the whole design matrix."""

import datetime as dt
import math

import numpy as np
import pytest

from vigil.operators import forecast, trend

START = dt.date(2024, 1, 1)


def brute(counts, ahead=7):
    """Penalised least squares by a stacked system, with the noise of the fit without bends."""
    y, n = np.array(counts, float), len(counts)
    top = np.abs(y).max()
    y = y / top if top else y
    days = np.array([(START - dt.date(1970, 1, 1)).days + i for i in range(n + ahead)])
    at = np.arange(n + ahead) / (n - 1)

    def columns(bends):
        turn = days % 7 * 2 * math.pi / 7
        cols = [np.ones(n + ahead), at, *[np.clip(at - 0.8 * j / 25, 0, None) for j in range(1, 26) if bends]]
        cols += [f(k * turn) for k in (1, 2, 3) for f in (np.sin, np.cos)]
        return np.column_stack(cols), np.array([5.0, 5.0] + [0.05] * 25 * bends + [10.0] * 6)

    def fit(bends, noise):
        x, kinds = columns(bends)
        past = x[:n]
        w = np.linalg.lstsq(np.vstack([past, np.diag(noise / kinds)]), np.concatenate([y, np.zeros(len(kinds))]), rcond=None)[0]
        inverse = np.linalg.inv(past.T @ past + np.diag((noise / kinds) ** 2))
        free = max(1.0, n - np.trace(past @ inverse @ past.T))
        return x, w, inverse, max(1e-2, math.sqrt(((y - past @ w) ** 2).sum() / free))

    x, w, inverse, noise = fit(True, fit(False, 1e-2)[3])
    future = x[n:]
    spread = 1.96 * noise * np.sqrt(1 + ((future @ inverse) * future).sum(axis=1))
    value = future @ w
    return np.column_stack([np.maximum(0, value), np.maximum(0, value - spread), value + spread]) * top


SERIES = {
    "bent": [20 + 0.5 * i if i < 40 else 40 - 0.8 * (i - 40) for i in range(70)],
    "weekly": [30 + 12 * (i % 7 < 5) + (i * 7919 % 5) for i in range(84)],
    "noisy": [10 + (i * 104729 % 17) for i in range(50)],
    "short": [3, 5, 4], "zero": [0] * 10,
}


@pytest.fixture(scope="module")
def series(spark):
    rows = [(k, START + dt.timedelta(days=i), int(v)) for k, vs in SERIES.items() for i, v in enumerate(vs)]
    return spark.createDataFrame([*rows, ("one", START, 9), ("one", None, 4), ("none", START, None)], "threat_type string, day date, n long")


def test_equals_numpy(series):
    found = {}
    for r in forecast.additive(series).orderBy("threat_type", "ahead").collect():
        found.setdefault(r.threat_type, []).append((r.value, r.lower, r.upper))
        assert r.day == START + dt.timedelta(days=len(SERIES.get(r.threat_type, [0])) - 1 + r.ahead)
    assert sorted(found) == sorted([*SERIES, "one"])
    for k, v in SERIES.items():
        assert np.allclose(found[k], brute([int(x) for x in v]), atol=1e-6), k
    assert found["one"] == [(9.0, 9.0, 9.0)] * 7


def test_season_bend_and_band(series):
    rows = {(r.threat_type, r.ahead): r for r in forecast.additive(series, ahead=14).collect()}
    weekend, monday = rows["weekly", 6], rows["weekly", 8]
    assert monday.value - weekend.value > 8
    assert rows["bent", 1].slope < 0.2 and rows["bent", 14].trend < rows["bent", 1].trend
    widths = [rows["noisy", k].upper - rows["noisy", k].value for k in (1, 14)]
    assert widths[1] > widths[0] > 1.9 * np.std(SERIES["noisy"])
    # of the noise, 95 % lie within
    inside = brute(SERIES["noisy"])[0]
    assert np.mean([inside[1] <= v <= inside[2] for v in SERIES["noisy"]]) >= 0.9


def test_outlook(series):
    found = {r.threat_type: r for r in forecast.outlook(forecast.additive(series)).collect()}
    assert found["bent"].sufficient and not found["short"].sufficient and found["zero"].direction == "stable"
    assert found["one"].prediction_7d == 9.0 and found["one"].confidence_interval == 0
    assert forecast.outlook(forecast.additive(series.limit(0))).count() == 0


def test_from_events(spark):
    events = spark.createDataFrame([(["A"], START + dt.timedelta(days=i)) for i in range(30) for _ in range(i + 1) if i != 12], "threat_types array<string>, event_time date")
    r = forecast.outlook(forecast.additive(trend.dense(trend.daily_counts(events), calendar=True))).first()
    assert r.days == 30 and r.slope > 0.5 and r.prediction_7d > 25


def test_regression_has_no_signed_zero(spark):
    rows = [("A", START + dt.timedelta(days=i), i, n) for i, n in enumerate([5, 7, 7, 5])]
    series = spark.createDataFrame(rows, "threat_type string, day date, x int, n long")
    found = {str(tuple(trend.regression(series.repartition(k)).first())) for k in range(1, 11)}
    assert len(found) == 1 and "-0.0" not in found.pop()
