import re

import pytest
from rowcheck import same_rows
from pyspark.sql import functions as F

from firn import schemas as K
from firn.operators import joins as J
from firn.sources import readers, sinks


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("obs")
    rows = [(s, d, float(i), float("nan") if i % 3 == 0 else 1.0) for s in ("CAC001", "NAC001", "XX") for i, d in
            enumerate(("1999-12-31", "2004-01-01", "2020-06-30", "2024-06-30", "2024-07-01"))]
    df = spark.createDataFrame(rows, "station_id string, d string, swe double, snow_depth double").select(
        F.to_date("d").alias("date"), "station_id", "swe", "snow_depth", F.lit(1.0).alias("temperature"),
        F.lit(2.0).alias("precipitation"))
    sinks.write_daily(df, str(root / "pq"))
    df.write.option("header", False).csv(str(root / "csv"))
    df.select("date", F.lit("USC0004").alias("station_id"), "temperature", "precipitation",
              F.lit(3.0).alias("humidity"), F.lit(4.0).alias("wind_speed")).write.parquet(str(root / "clim"))
    df.select("date", *[F.lit(0.5).alias(c) for c in ("oni", "mei", "nino34", "soi")]).write.parquet(str(root / "idx"))
    return root


def test_snow_scan(spark, files):
    paths = {"cdec": str(files / "pq"), "usgs": str(files / "csv")}
    got = readers.load_snow(spark, paths, as_of="2024-06-30")
    assert {r.station_id for r in got.collect()} == {"CAC001", "NAC001"}
    assert str(got.agg(F.min("date")).first()[0]) == "2004-01-01" and str(got.agg(F.max("date")).first()[0]) == "2024-06-30"
    assert got.where("snow_depth IS NULL").count() == 2
    assert readers.load_snow(spark, paths, stations="all").count() == 15
    csv = readers.load_snow(spark, paths, "usgs", stations="all", fmt="csv")
    same_rows(csv, readers.load_snow(spark, paths, stations="all").drop("year"))
    with pytest.raises(ValueError):
        readers.load_snow(spark, paths, "moon")
    with pytest.raises(ValueError):
        readers.load_climate(spark, paths, "moon")


def test_filters_reach_the_scan(spark, files):
    df = readers.load_snow(spark, {"cdec": str(files / "pq")}, stations=["CAC001"], start="2020-01-01").select("date", "swe")
    plan = re.sub(r"#\d+", "", df._jdf.queryExecution().executedPlan().toString())
    pushed = plan.split("PushedFilters")[1]
    assert "EqualTo(station_id,CAC001)" in pushed and "GreaterThanOrEqual(date,2020" in pushed
    assert "PartitionFilters: [isnotnull(year" in plan and ">= 2020)]" in plan
    assert "temperature" not in plan.split("ReadSchema")[1]


def test_folders_are_pruned_at_run_time(spark, files):
    """The folders read are those of the period's years, known only when the query runs."""
    periods = spark.createDataFrame([("2020-06-01", "2020-12-31"), ("2020-06-15", "2021-01-31"), ("2024-07-02", "2024-01-01"), (None, "2004-05-05")],
                                    "s string, e string").select(F.col("s").cast("date").alias("start"), F.col("e").cast("date").alias("end"))
    df = readers.during(readers.load_snow(spark, {"cdec": str(files / "pq")}, stations="all"), periods)
    assert {(r.station_id, str(r.date)) for r in df.collect()} == {(s, "2020-06-30") for s in ("CAC001", "NAC001", "XX")}
    assert df.count() == 3
    flat = readers.during(readers.load_snow(spark, {"cdec": str(files / "pq")}, stations="all").drop("year"), periods)
    same_rows(flat, df.drop("year"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_stations_of_a_table(spark, files):
    listed = spark.createDataFrame([("XX",), ("XX",), ("nowhere",), (None,)], "station_id string")
    got = readers.load_snow(spark, {"cdec": str(files / "pq")}, stations=listed)
    assert got.count() == 5 and {r.station_id for r in got.collect()} == {"XX"}
    assert readers.load_snow(spark, {"cdec": str(files / "pq")}, stations=listed.where("false")).count() == 0


def test_bundle(spark, files):
    b = readers.load_bundle(spark, {"cdec": str(files / "pq")}, {"noaa": str(files / "clim")}, str(files / "idx"),
                            "2004-01-01", "2024-06-30", views=True)
    assert {k: v.count() for k, v in b.items()} == {"snowpack": 6, "climate": 9, "enso": 9}
    assert spark.sql("SELECT count(*) FROM enso").first()[0] == 9


def test_history_reader(spark, tmp_path):
    df = spark.createDataFrame([(2000, 11, "north_coast", 0.1, float("nan"), 0.1, 0.1, 0.1, 5.0, 1.0)], K.HISTORY_SCHEMA)
    df.write.parquet(str(tmp_path / "h"))
    assert readers.load_history(spark, str(tmp_path / "h")).first().pdo is None


def test_joins_keep_names_apart(spark):
    left = spark.createDataFrame([("a", 1, 1.0), (None, 1, 2.0)], "station_id string, date int, temperature double")
    right = spark.createDataFrame([("a", 1, 9.0), (None, 1, 8.0)], "station_id string, date int, temperature double")
    got = J.join_sources(left, right).orderBy("temperature_snow").collect()
    assert [r.temperature_clim for r in got] == [9.0, None]
    safe = J.join_sources(left, right, null_safe=True).orderBy("temperature_snow").collect()
    assert [r.temperature_clim for r in safe] == [9.0, 8.0]
    merged = J.merge_shared(J.join_sources(left, right), ["temperature"])
    assert merged.columns == ["date", "station_id", "temperature"]


def test_as_of_join_before_between_and_after(spark):
    days = spark.createDataFrame([("2019-12-31",), ("2020-01-31",), ("2020-02-15",), ("2020-05-01",), (None,)], "d string").select(
        F.to_date("d").alias("date"))
    index = spark.createDataFrame([("2020-01-31", 1.0), ("2020-03-31", 3.0)], "d string, oni double").select(
        F.to_date("d").alias("date"), "oni")
    got = {str(r.date): r.oni for r in J.join_index_as_of(days, index).collect()}
    assert got == {"2019-12-31": None, "2020-01-31": 1.0, "2020-02-15": 1.0, "2020-05-01": 3.0, "None": None}


def test_written_tables_go_to_the_named_folder(spark, monkeypatch, tmp_path):
    from firn import session

    df = spark.range(5).select("id", F.lit("x").alias("t"))
    monkeypatch.setattr(session, "configured_folder", lambda s: str(tmp_path) + "/")
    same_rows(session.materialize(df), df)
    assert len(list(tmp_path.iterdir())) == 1
    monkeypatch.setattr(session, "configured_folder", lambda s: None)
    assert session.shared_folder(spark) == session.shared_folder(spark)
    same_rows(session.materialize(df), df)


def test_repeated_index_dates_give_the_last_row(spark):
    days = spark.createDataFrame([("2020-01-05",), ("2020-01-09",)], "d string").select(F.col("d").cast("date").alias("date"))
    at = F.col("t").cast("timestamp").alias("date")
    index = spark.createDataFrame([("2020-01-05 06:00:00", 1.0), ("2020-01-05 18:00:00", 0.5), ("2020-01-05 18:00:00", 0.7), (None, 9.0)], "t string, oni double").select(at, "oni")
    assert [tuple(r)[1] for r in J.join_index_exact(days, index).orderBy("date").collect()] == [0.7, None]
    assert [tuple(r)[1] for r in J.join_index_as_of(days, index).orderBy("date").collect()] == [0.7, 0.7]
