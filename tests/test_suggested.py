"""Features made from their names."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from rowcheck import same_rows

from firn.operators import suggested as S, windows as W
from firn.operators.series import Series


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(n)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(s, day(40 * i), float(i * i % 7) if i % 4 else None, float(i), 5.0 - i)
            for s in ("a", "b") for i in range(12)]
    return spark.createDataFrame(data, "station_id string, date date, swe double, precipitation double, temperature double")


def test_same_as_the_named_operators(rows):
    names = ["swe_lag_2", "temperature_roll_mean_3", "swe_roll_std_3", "precipitation_roll_sum_3", "swe_full_mean_3"]
    made = S.make_features(rows, names)
    assert made.columns == [*rows.columns, *names]
    want = W.add_lags(rows, ["swe"], [2])
    want = W.add_window_columns(want, W.rolling_columns(["temperature"], ["swe"], ["precipitation"], [3]), 3)
    same_rows(made, W.add_strict_rolling(want, ["swe"], [3]))


def test_hot_stations_give_the_same(rows):
    names = ["swe_lag_2", "swe_roll_mean_4", "swe_anomaly", "water_year"]
    same_rows(S.make_features(rows, names, series=Series(hot_rows=3)), S.make_features(rows, names))


def test_one_window_pass(rows):
    names = ["swe_lag_1", "swe_lag_5", "swe_roll_mean_3", "precipitation_roll_sum_7", "temperature_roll_std_3"]
    plan = S.make_features(rows, names, hot=None)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Window \[", plan)) == 1


def test_row_level_names(spark, rows):
    index = spark.createDataFrame([("2020-01-31", 1.0), ("2020-02-29", -1.0)], "d string, oni double").select(
        F.col("d").cast("date").alias("date"), "oni")
    got = S.make_features(rows, ["day_of_year", "is_winter", "water_year", "swe_anomaly", "enso_phase", "enso_cool"], index)
    first, second = got.where("station_id = 'a'").orderBy("date").take(2)
    assert (first.day_of_year, first.is_winter, first.water_year, first.enso_phase, first.enso_cool) == (1, 1, 2019, "El Niño", 0)
    assert (second.enso_phase, second.enso_cool) == ("La Niña", 1) and first.swe_anomaly is None
    assert "month" not in got.columns and "oni" not in got.columns


def test_own_columns_stay(rows):
    df = rows.withColumn("month", F.lit(77)).withColumn("swe_lag_1", F.lit(5.0))
    got = S.make_features(df, ["swe_lag_1", "temperature_anomaly", "temperature_anomaly"])
    assert got.columns == [*df.columns, "temperature_anomaly"]
    assert {(r.month, r.swe_lag_1) for r in got.collect()} == {(77, 5.0)}


def test_unknown_names_are_an_error(rows):
    with pytest.raises(ValueError, match="snow_lag_7.*wind"):
        S.make_features(rows, ["swe_lag_7", "snow_lag_7", "wind"])
    with pytest.raises(ValueError, match="oni"):
        S.make_features(rows, ["enso_phase"])


def test_missing_dates_empty_table_and_suggestions(spark, rows):
    none = rows.limit(1).withColumn("date", F.lit(None).cast("date"))
    r = S.make_features(none, ["day_of_year", "swe_anomaly", "swe_lag_1", "water_year"]).first()
    assert (r.day_of_year, r.swe_anomaly, r.swe_lag_1, r.water_year) == (None,) * 4
    assert S.make_features(rows.where("false"), ["swe_lag_1"]).count() == 0
    got = S.make_suggested(rows.withColumn("monitor", F.lit(1)))
    assert set(got.columns) - set(rows.columns) == {
        "monitor", "day_of_year", "water_year", "swe_lag_7", "swe_lag_30", "precipitation_roll_sum_30", "temperature_anomaly"}


def test_long_frames_from_short_ones(spark):
    """A frame of 6 rows comes from frames of 3 and equals its own, over gaps, short stations, chunks and both ends."""
    values = [None, 1e9, 1e9 + 1, 1e9 + 2.5, None, None, None, 3.0, 4.5, None, 7.0, 1e9, 2.0, 8.0]
    data = [(s, day(i), v) for s, k in (("a", 14), ("b", 1), ("c", 4), (None, 9)) for i, v in enumerate(values[:k])]
    df = spark.createDataFrame(data, "station_id string, date date, swe double").withColumn("whole", F.col("swe").cast("long"))
    for current in (True, False):
        made = W.rolling_columns(["swe", "whole"], ["swe"], ["swe", "whole"], [3, 6], current)
        assert set(W._short_frames(df, made)) == {f"swe_roll_{k}_{n}" for k in ("mean", "std", "sum") for n in (3, 6)}
        want = df
        for name, one in made.items():  # one at a time there is nothing to join
            want = W.add_window_columns(want, {name: one}, 6)
        for series in (Series(), Series(hot_rows=5)):
            got = W.add_window_columns(df, made, 6, series)
            assert got.columns == want.columns and got.schema.simpleString() == want.schema.simpleString()
            same_rows(got, want, 5)
    names = ["swe_roll_sum_90", "swe_roll_mean_90", "swe_roll_mean_30"]
    plan = S.make_features(df, names, hot=None)._jdf.queryExecution().optimizedPlan().toString()
    assert "-89" not in plan and "-29" in plan
