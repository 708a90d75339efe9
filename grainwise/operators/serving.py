"""Batch scoring: the feature matrix of all stations for a date, predictions, and the calendar of coming weeks."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions.display import calendar_levels
from grainwise.functions.numeric import cyclical
from grainwise.operators.contracts import assert_columns
from grainwise.operators.ordering import last_non_null

TEMPORAL = ("doy", "doy_sin", "doy_cos", "year")


def station_features(visits: DataFrame, station: str, order: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Latest non-null value of every feature per station."""
    return last_non_null(visits, [station], order, features)


def feature_matrix(stations: DataFrame, station: str, features: Sequence[str], day: Column | datetime.date) -> DataFrame:
    """station, features and temporal features of ``day``, in the contract's column order."""
    when = day if isinstance(day, Column) else F.to_date(F.lit(day.isoformat()))
    t = cyclical(when)
    temporal = {"doy": t["doy"].cast("long"), "doy_sin": t["doy_sin"], "doy_cos": t["doy_cos"], "year": t["year"].cast("long")}
    out = stations.select(station, *features, *[temporal[k].alias(k) for k in TEMPORAL])
    return assert_columns(out, [station, *features, *TEMPORAL])


def score_batch(matrix: DataFrame, predict: Callable[[DataFrame], DataFrame], station: str) -> DataFrame:
    """One prediction per row of the matrix."""
    return predict(matrix).select(station, F.col("predicted").alias("prediction"))


def coming_days(end: datetime.date, weeks: int = 14) -> DataFrame | list[datetime.date]:
    """The ``7 * weeks`` days that end with the Saturday on or after ``end``."""
    last = end + datetime.timedelta(days=(5 - end.weekday()) % 7)
    return [last - datetime.timedelta(days=k) for k in range(7 * weeks - 1, -1, -1)]


def calendar_trend(stations: DataFrame, station: str, features: Sequence[str], predict: Callable[[DataFrame], DataFrame], end: datetime.date, weeks: int = 14) -> DataFrame:
    """Mean, least and largest prediction over all stations for each day, with levels 0 to 4 within the span.

    Each station row is exploded to the days (a fixed number) and folded back by one aggregation with map-side combine.
    """
    days = coming_days(end, weeks)
    dated = stations.withColumn("day", F.explode(F.sequence(F.lit(days[0]), F.lit(days[-1]))))
    t = cyclical("day")
    dated = dated.withColumns({"doy": t["doy"].cast("long"), "doy_sin": t["doy_sin"], "doy_cos": t["doy_cos"], "year": t["year"].cast("long")})
    scored = predict(dated)
    daily = scored.groupBy("day").agg(F.count("predicted").alias("n"), F.avg("predicted").alias("mean"), F.min("predicted").alias("low"), F.max("predicted").alias("high"))
    return calendar_levels(daily.withColumn("series", F.lit(1)), ["series"], "mean").drop("series")
