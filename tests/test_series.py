"""The ways around hot keys give what the plain windows give."""

import pytest
from rowcheck import same_rows
from pyspark.sql import functions as F

from firn.functions.scalars import water_year
from firn.operators import cleaning as C, windows as W
from firn.operators.series import Series, hot_keys, positions

HOT = Series(hot_rows=40)
PLAIN = Series(hot_rows=10**9)


@pytest.fixture(scope="module")
def skewed(spark, stations):
    """One station with most of the rows, some of them without a station, next to cold ones."""
    hot = F.when(F.crc32("station_id") % 4 == 0, F.col("station_id")).otherwise(F.lit("HOT"))
    one = stations.withColumn("station_id", hot).dropDuplicates(["station_id", "date"])
    few = one.where("station_id = 'HOT' AND day(date) < 4").withColumn("station_id", F.lit(None).cast("string"))
    return one.unionByName(few).cache()


def test_there_are_hot_and_cold_keys(skewed):
    hot = {r[0] for r in hot_keys(skewed, Series(hot_rows=1000)).collect()}
    assert "HOT" in hot and len(hot) < skewed.select("station_id").distinct().count()
    assert hot_keys(skewed, PLAIN) is None


def test_lags_and_rolling(skewed):
    for series in (HOT, Series(hot_rows=200)):
        a = W.add_rolling(W.add_lags(skewed, periods=(1, 7, 30), series=series), windows=(7, 30), series=series)
        b = W.add_rolling(W.add_lags(skewed, periods=(1, 7, 30), series=PLAIN), windows=(7, 30), series=PLAIN)
        same_rows(a, b)


def test_running_sums(skewed):
    df = skewed.withColumn("water_year", water_year("date"))
    same_rows(W.add_water_year_total(df, series=Series(hot_rows=50)),
              W.add_water_year_total(df, series=PLAIN))


def test_interpolation(skewed):
    cols = ["swe", "precipitation"]
    same_rows(C.fill_interpolate(skewed, cols, HOT), C.fill_interpolate(skewed, cols, PLAIN))


def test_positions(skewed):
    same_rows(positions(skewed, HOT), positions(skewed, PLAIN))


def test_sequences(skewed):
    known = skewed.na.drop()
    a = W.sequence_windows(known, ["swe", "temperature"], "swe", 4, HOT)
    b = W.sequence_windows(known, ["swe", "temperature"], "swe", 4, PLAIN)
    same_rows(a, b)


def test_single_row_deviation_is_null(spark):
    one = spark.createDataFrame([("a", "2020-01-01", 1.0)], "station_id string, date string, swe double")
    row = W.add_rolling(one.withColumn("date", F.to_date("date")), windows=(7,)).first()
    assert row["swe_roll_mean_7"] == 1.0 and row["swe_roll_std_7"] is None


def test_one_shuffle_for_all_window_columns(spark, stations, tmp_path):
    path = str(tmp_path / "s")
    stations.write.parquet(path)
    df = W.add_rolling(W.add_lags(spark.read.parquet(path)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
