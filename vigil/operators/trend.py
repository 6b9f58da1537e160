"""Daily trends: a dense matrix over observed days, linear regression, forecasts and chart series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def daily_counts(events: DataFrame, types_col: str = "threat_types", time_col: str = "event_time") -> DataFrame:
    """`day`, `threat_type`, `n`; events without types count as Unknown, those without a time by `collect_time`, if they have that, else not at all."""
    types = F.when(F.size(F.coalesce(F.col(types_col), T.literals([]))) > 0, F.col(types_col)).otherwise(T.literals(["Unknown"]))
    time = F.coalesce(*[F.col(c) for c in (time_col, "collect_time") if c in events.columns])
    rows = events.filter(time.isNotNull()).select(F.to_date(time).alias("day"), F.explode(types).alias("threat_type"))
    return rows.groupBy("day", "threat_type").agg(F.count("*").alias("n"))


def dense(counts: DataFrame, least: int = 3, calendar: bool = False) -> DataFrame:
    """`threat_type`, `day`, `x`, `n`: every type with at least `least` events on every observed day, zero where it has none.

    With `calendar`, on every day from the first to the last. The grid holds types times days, both
    small next to the events they are counted from; each type's list of days is exploded, not cross joined.
    """
    days = counts.select("day").distinct()
    if calendar:
        days = counts.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    days = days.agg(F.sort_array(F.collect_list("day")).alias("days"))
    types = counts.groupBy("threat_type").agg(F.sum("n").alias("total")).filter(F.col("total") >= least)
    # one row: an array of days, 8 bytes each
    grid = types.select("threat_type").withColumn("one", F.lit(1)).join(F.broadcast(days.withColumn("one", F.lit(1))), "one")
    grid = grid.select("threat_type", F.posexplode("days").alias("x", "day"))
    return grid.join(counts, ["threat_type", "day"], "left").select("threat_type", "day", "x", F.coalesce("n", F.lit(0)).alias("n"))


def regression(series: DataFrame, ahead: int = 7) -> DataFrame:
    """Per type: slope, direction, confidence (r squared, 0 for a constant series), mean, prediction with interval, change.

    A series of fewer than two days is stable, with its last value as prediction and both bounds.
    """
    y, x = F.col("n").cast("long"), F.col("x").cast("long")
    g = series.groupBy("threat_type").agg(
        F.count("*").alias("days"), F.sum(y).alias("total"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"), F.max_by(y, x).cast("double").alias("last"),
    )
    # sums of whole numbers are exact, so results do not depend on the order of rows
    days, sx, sy = F.col("days"), F.col("sx"), F.col("total")
    xx, xy, yy = days * F.col("sxx") - sx * sx, days * F.col("sxy") - sx * sy, days * F.col("syy") - sy * sy
    b = F.when(xx > 0, xy / xx).otherwise(0.0)
    g = g.select("threat_type", "days", "total", "last", b.alias("b"), (sy / days).alias("mean"), (sx / days).alias("xm"), (yy / days).alias("syy"), (xy / days).alias("sxy"))
    n, b, mean = F.col("days"), F.col("b"), F.col("mean")
    residual = F.greatest(F.col("syy") - b * F.col("sxy"), F.lit(0.0))
    g = g.withColumn("r2", F.when(F.col("syy") > 0, F.greatest(F.lit(0.0), 1 - residual / F.col("syy"))).otherwise(0.0))
    g = g.withColumn("se", F.when(n > 2, F.sqrt(residual / (n - 2))).otherwise(mean * 0.5)).withColumn("ci", F.col("se") * 1.96)
    g = g.withColumn("p", b * (n + (ahead - 1)) + mean - b * F.col("xm"))
    g = g.withColumns({c: F.when(n < 2, F.col("last") if c == "p" else F.lit(0.0)).otherwise(F.col(c)) for c in ("p", "ci", "se")})
    direction = F.when(n < 2, "stable").when(b > 0.5, "increasing").when(b < -0.5, "decreasing").otherwise("stable")
    change = F.when(mean > 0, F.round(b * ahead / mean * 100, 1) + 0.0).otherwise(0.0)  # no signed zero
    return g.select(
        "threat_type", "total", "days", (F.round(b, 3) + 0.0).alias("slope"), direction.alias("direction"), F.round("r2", 3).alias("confidence"), F.round(mean, 1).alias("current_avg"),
        F.round(F.greatest(F.lit(0.0), F.col("p")), 1).alias("prediction_7d"), F.round(F.greatest(F.lit(0.0), F.col("p") - F.col("ci")), 1).alias("prediction_lower"), F.round(F.col("p") + F.col("ci"), 1).alias("prediction_upper"),
        F.round("ci", 1).alias("confidence_interval"), change.alias("change_percent"), (n >= 7).alias("sufficient"), F.round("se", 2).alias("std_error"),
    )


def predictions(events: DataFrame, top: int | None = None) -> DataFrame:
    """The trend of each type with its sentence and alert level; the `top` steepest, ties by type."""
    r = regression(dense(daily_counts(events)))
    up, down = F.col("direction") == "increasing", F.col("direction") == "decreasing"
    name, change = F.col("threat_type"), F.col("change_percent").cast("string")
    said = F.when(up, F.concat(name, F.lit(" trending up +"), change, F.lit("% next week"))).when(down, F.concat(name, F.lit(" trending down "), change, F.lit("% next week"))).otherwise(F.concat(name, F.lit(" stable trend")))
    level = F.when(up & (F.col("change_percent") > 20), "warning").when(up, "info").when(down, "success").otherwise("neutral")
    out = r.withColumns({"prediction_text": said, "alert_level": level})
    return out if top is None else out.orderBy(F.desc(F.abs("slope")), "threat_type").limit(top)


def top_increasing(found: DataFrame, k: int = 3) -> DataFrame:
    return found.filter("direction = 'increasing'").orderBy(F.desc("change_percent"), "threat_type").limit(k)


def trend_summary(found: DataFrame) -> DataFrame:
    d = F.col("direction")
    return found.agg(F.count("*").alias("total"), *[F.count_if(d == x).alias(x) for x in ("increasing", "decreasing", "stable")])


def forecast(events: DataFrame, k: int = 5, ahead: int = 7, from_last: bool = False) -> DataFrame:
    """`threat_type`, `day`, `segment`, `value`, `lower`, `upper` of the k most frequent types.

    History, the last day again as the transition, and `ahead` days of mean + slope * i with bounds that widen
    by a tenth a day. With `from_last` the path starts where the regression line stands on the last day.
    """
    counts = daily_counts(events)
    top = counts.groupBy("threat_type").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "threat_type").limit(k).select("threat_type")
    series = dense(counts, least=1).join(F.broadcast(top), "threat_type")  # at most k rows
    history = series.select("threat_type", "day", F.lit("history").alias("segment"), F.col("n").cast("double").alias("value"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    last = series.groupBy("threat_type").agg(F.max("day").alias("last"), F.max_by("n", "day").cast("double").alias("at_last"))
    turn = last.select("threat_type", F.col("last").alias("day"), F.lit("transition").alias("segment"), F.col("at_last").alias("value"), F.col("at_last").alias("lower"), F.col("at_last").alias("upper"))
    path = regression(series).join(last, "threat_type").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(ahead))))
    start = F.col("days") - 1 if from_last else F.lit(0)
    value = F.greatest(F.lit(0.0), F.bround(F.col("current_avg") + F.col("slope") * (start + F.col("i")), 0))
    spread = F.col("confidence_interval") * (1 + F.col("i") * 0.1)
    path = path.withColumn("value", value).select("threat_type", F.date_add("last", F.col("i")).alias("day"), F.lit("forecast").alias("segment"), "value", F.bround(F.greatest(F.lit(0.0), F.col("value") - spread), 0).alias("lower"), F.bround(F.col("value") + spread, 0).alias("upper"))
    return history.unionByName(turn).unionByName(path)


def prophet_forecast(series: DataFrame, ahead: int = 7) -> DataFrame:
    """Per type, one Prophet model in its own task where the prophet package is installed; a series has one row a day."""
    import pandas as pd

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        from prophet import Prophet

        data = pd.DataFrame({"ds": pd.to_datetime(rows["day"]), "y": rows["n"]}).sort_values("ds")
        model = Prophet(weekly_seasonality=True, yearly_seasonality=False, daily_seasonality=False, changepoint_prior_scale=0.05, interval_width=0.95).fit(data)
        end = model.predict(model.make_future_dataframe(periods=ahead)).iloc[-1]
        mean = float(data["y"].mean())
        change = (end["yhat"] - mean) / mean * 100 if mean else 0.0
        direction = "increasing" if change > 10 else "decreasing" if change < -10 else "stable"
        return pd.DataFrame([(rows["threat_type"].iloc[0], float(end["yhat"]), float(end["yhat_lower"]), float(end["yhat_upper"]), change, direction)])

    return series.groupBy("threat_type").applyInPandas(fit, "threat_type string, prediction double, lower double, upper double, change_percent double, direction string")


def streaming_daily_counts(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The daily counts of a stream by event type: windows of a day with a watermark. `ts` is cast, as watermarks need an instant.

    For a feed in order of time: what comes later than `lateness` is not counted, and is reported as
    numRowsDroppedByWatermark in the progress of the running query. For files in any order, see
    streaming.incremental.daily.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")
