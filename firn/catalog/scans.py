"""Scans, scalar features and calendar columns over the test views."""

import uuid

from pyspark.sql import functions as F

from firn.catalog.registry import day_text, fixed4, job
from firn.catalog.views import r4, table, view
from firn.functions import scalars as N
from firn.operators import aggregates as A
from firn.session import materialize, shared_folder
from firn.sources import readers
from firn.sources.sinks import write_daily

STATIONS = ("ST1", "ST2", "ST3", "ST5", "ST8")
OBS = ["station_id", "date", "swe", "precipitation", "temperature"]
OBS_SQL = "station_id, CAST(date AS VARCHAR) AS date, swe, precipitation, temperature"


def observations(df):
    return df.withColumn("date", day_text())


def snow_files(spark, sf):
    """The station view as the files of a source: folders by year with all columns of the schema."""
    folder = f"{shared_folder(spark)}/snow-{uuid.uuid4().hex}"
    write_daily(view(spark, sf, "station_daily").withColumn("snow_depth", F.lit(None).cast("double")), folder)
    return {"cdec": folder}


def climate_files(spark, sf):
    folder = f"{shared_folder(spark)}/climate-{uuid.uuid4().hex}"
    write_daily(view(spark, sf, "climate_daily").withColumns({c: F.lit(None).cast("double") for c in ("temperature", "precipitation")}), folder)
    return {"noaa": folder}


def index_files(spark, sf):
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    view(spark, sf, "index_monthly").write.parquet(folder)
    return folder


@job("s1_snow_scan", f"""
SELECT {OBS_SQL} FROM station_daily
WHERE station_id IN ('ST1','ST2','ST3','ST5','ST8') AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def snow_scan(spark, sf):
    df = readers.load_snow(spark, snow_files(spark, sf), "cdec", STATIONS, "1996-01-01", "1999-12-31")
    return observations(df.select(*OBS))


@job("s1_station_table", f"""
SELECT {OBS_SQL} FROM station_daily
WHERE station_id IN (SELECT concat('ST', CAST(s_suppkey AS VARCHAR)) FROM supplier WHERE s_acctbal > 5000) AND date >= DATE '1995-01-01'""")
def station_table_scan(spark, sf):
    """Stations from another table, by a semi-join."""
    listed = table(spark, sf, "supplier").where("s_acctbal > 5000").select(
        F.concat(F.lit("ST"), F.col("s_suppkey").cast("string")).alias("station_id"))
    return observations(readers.load_snow(spark, snow_files(spark, sf), "cdec", listed, "1995-01-01").select(*OBS))


@job("s1_periods", f"""
SELECT {OBS_SQL} FROM station_daily WHERE EXISTS (SELECT 1 FROM index_monthly i
  WHERE oni >= 2 AND station_daily.date BETWEEN date_trunc('month', i.date) AND i.date + 30)""")
def periods_scan(spark, sf):
    """Days of the strongest index months and the thirty after them; folders of other years are not read."""
    strong = readers.load_index(spark, index_files(spark, sf)).where("oni >= 2").select(
        F.trunc("date", "month").alias("start"), F.date_add("date", 30).alias("end"))
    return observations(readers.during(readers.load_snow(spark, snow_files(spark, sf), "cdec", "all"), strong).select(*OBS))


@job("s2_climate_scan", """
SELECT station_id, CAST(date AS VARCHAR) AS date, humidity, wind_speed FROM climate_daily
WHERE station_id IN ('ST1','ST2','ST3','ST5','ST8') AND date >= DATE '1997-06-01'""")
def climate_scan(spark, sf):
    df = readers.load_climate(spark, climate_files(spark, sf), "noaa", STATIONS, "1997-06-01")
    return observations(df.select("station_id", "date", "humidity", "wind_speed"))


@job("s3_index_scan", """
SELECT CAST(date AS VARCHAR) AS date, oni, mei, nino34, soi FROM index_monthly
WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
def index_scan(spark, sf):
    return observations(readers.load_index(spark, index_files(spark, sf), "1996-01-01", "2000-12-31"))


@job("s4_trailing_window", f"""
SELECT {OBS_SQL} FROM station_daily
WHERE date >= DATE '1980-01-01' AND date <= DATE '1998-06-30'""")
def trailing_scan(spark, sf):
    """Without a start the scan goes back twenty years from the given day."""
    df = readers.load_snow(spark, snow_files(spark, sf), "cdec", "all", as_of="1998-06-30")
    return observations(df.select(*OBS))


@job("s5_bundle", """
SELECT 'snowpack' AS name, count(*) AS row_count FROM station_daily
UNION ALL SELECT 'climate', count(*) FROM climate_daily
UNION ALL SELECT 'enso', count(*) FROM index_monthly""")
def bundle(spark, sf):
    named = readers.load_bundle(spark, snow_files(spark, sf), climate_files(spark, sf), index_files(spark, sf), stations="all")
    return A.bundle_counts(named)


@job("n1_number_coercion", """
SELECT station_id, CAST(date AS VARCHAR) AS date, CAST(t AS DOUBLE) AS all_numbers,
       CASE WHEN precipitation > 90 THEN 'heavy' ELSE CAST(precipitation AS VARCHAR) END AS some_words
FROM (SELECT *, CAST(temperature AS VARCHAR) AS t FROM station_daily) x""")
def number_coercion(spark, sf):
    df = view(spark, sf, "station_daily").select(
        "station_id", day_text().alias("date"), F.col("temperature").cast("string").alias("all_numbers"),
        F.when(F.col("precipitation") > 90, "heavy")
        .otherwise(F.col("precipitation").cast("string")).alias("some_words"),
    )
    return N.coerce_numbers(materialize(df), skip=("date",))


@job("n2_date_parsing", """
SELECT station_id, CAST(TRY_CAST(obs_date AS DATE) AS VARCHAR) AS obs_date, temperature
FROM (SELECT station_id, temperature,
             CASE WHEN day(date) = 9 THEN 'unknown' ELSE CAST(date AS VARCHAR) END AS obs_date
      FROM station_daily) x""")
def date_parsing(spark, sf):
    df = view(spark, sf, "station_daily").select(
        "station_id",
        F.when(F.dayofmonth("date") == 9, "unknown").otherwise(day_text()).alias("obs_date"),
        "temperature",
    )
    return N.parse_dates(df).withColumn("obs_date", day_text("obs_date"))


@job("n3_calendar_fields", """
SELECT station_id, CAST(date AS VARCHAR) AS date, CAST(year(date) AS INT) AS year,
       CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day,
       CAST(dayofyear(date) AS INT) AS day_of_year, CAST(weekofyear(date) AS INT) AS week_of_year
FROM station_daily""")
def calendar_fields(spark, sf):
    df = N.add_calendar(view(spark, sf, "station_daily").select("station_id", "date"))
    return observations(df)


@job("n4_season_flags", """
SELECT station_id, CAST(date AS VARCHAR) AS date,
       CAST(month(date) IN (12,1,2) AS INT) AS is_winter, CAST(month(date) IN (3,4,5) AS INT) AS is_spring,
       CAST(month(date) IN (6,7,8) AS INT) AS is_summer, CAST(month(date) IN (9,10,11) AS INT) AS is_fall
FROM station_daily""")
def season_flags(spark, sf):
    df = N.add_season_flags(view(spark, sf, "station_daily").select(
        "station_id", "date", F.month("date").alias("month"))).drop("month")
    return observations(df)


@job("n5_cyclic_encoding", f"""
SELECT station_id, CAST(date AS VARCHAR) AS date,
       {r4('sin(2 * pi() / 12 * month(date))')} AS month_sin, {r4('cos(2 * pi() / 12 * month(date))')} AS month_cos,
       {r4('sin(2 * pi() / 31 * day(date))')} AS day_sin, {r4('cos(2 * pi() / 31 * day(date))')} AS day_cos
FROM station_daily""")
def cyclic_encoding(spark, sf):
    df = N.add_cyclic(view(spark, sf, "station_daily").select(
        "station_id", "date", F.month("date").alias("month"), F.dayofmonth("date").alias("day")))
    waves = ["month_sin", "month_cos", "day_sin", "day_cos"]
    return df.select("station_id", day_text().alias("date"), *[fixed4(c).alias(c) for c in waves])


@job("n6_water_year", """
SELECT station_id, CAST(date AS VARCHAR) AS date, water_year, water_year_end,
       CAST(make_date(water_year, 10, 1) AS VARCHAR) AS water_year_start,
       CAST(date_diff('day', make_date(water_year, 10, 1), date) AS INT) AS days_since_wy_start,
       CAST(date_diff('day', make_date(water_year, 10, 1), date) AS INT) AS days_since_oct1
FROM (SELECT *, CAST(year(date) - CASE WHEN month(date) >= 10 THEN 0 ELSE 1 END AS INT) AS water_year,
             CAST(year(date) + CASE WHEN month(date) >= 10 THEN 1 ELSE 0 END AS INT) AS water_year_end
      FROM station_daily) x""")
def water_years(spark, sf):
    df = N.add_water_year(view(spark, sf, "station_daily").select("station_id", "date"))
    return df.select(
        "station_id", day_text().alias("date"), "water_year",
        N.water_year("date", "end").alias("water_year_end"),
        day_text("water_year_start").alias("water_year_start"), "days_since_wy_start",
        "days_since_oct1")


@job("n7_period_label", """
SELECT water_year, month, region,
       concat(CAST(CASE WHEN month >= 10 THEN water_year - 1 ELSE water_year END AS VARCHAR), '-',
              lpad(CAST(month AS VARCHAR), 2, '0')) AS period
FROM winter_history""")
def period_labels(spark, sf):
    return view(spark, sf, "winter_history").select(
        "water_year", "month", "region", N.period_label("water_year", "month").alias("period"))


@job("n8_index_phase", """
SELECT CAST(date AS VARCHAR) AS date, oni,
       CASE WHEN oni <= -0.5 THEN 'La Niña' WHEN oni <= 0.5 THEN 'Neutral'
            WHEN oni IS NOT NULL THEN 'El Niño' END AS enso_phase
FROM index_monthly""")
def phases(spark, sf):
    return view(spark, sf, "index_monthly").select(
        day_text().alias("date"), "oni", N.index_phase().alias("enso_phase"))


@job("n9_one_hot", """
SELECT CAST(date AS VARCHAR) AS date, CAST(phase = 'El Niño' AS INT) AS enso_warm,
       CAST(phase = 'La Niña' AS INT) AS enso_cool, CAST(phase = 'Neutral' AS INT) AS enso_neutral
FROM (SELECT date, CASE WHEN oni <= -0.5 THEN 'La Niña' WHEN oni <= 0.5 THEN 'Neutral' ELSE 'El Niño' END AS phase
      FROM index_monthly) x""")
def phase_flags(spark, sf):
    df = view(spark, sf, "index_monthly").select("date", N.index_phase().alias("phase"))
    hot = N.one_hot(df, "phase", prefix="enso")
    return hot.select(
        day_text().alias("date"), F.col("`enso_El Niño`").alias("enso_warm"),
        F.col("`enso_La Niña`").alias("enso_cool"), F.col("enso_Neutral").alias("enso_neutral"))


@job("n10_units", f"""
SELECT water_year, month, region, {r4('temperature_anomaly * 9 / 5')} AS f_delta,
       {r4('precipitation_mm / 25.4')} AS precipitation_in, {r4('snowfall_cm / 2.54')} AS snowfall_in
FROM winter_history""")
def unit_conversion(spark, sf):
    pairs = N.unit_pairs("temperature_anomaly", "precipitation_mm", "snowfall_cm")
    return view(spark, sf, "winter_history").withColumns(pairs).select(
        "water_year", "month", "region", fixed4("temperature.f_delta").alias("f_delta"),
        fixed4("precipitation.in").alias("precipitation_in"),
        fixed4("snowfall.in").alias("snowfall_in"))


def _tenths(x):
    n = f"CAST(floor(abs({x}) * 10 + 0.5) AS BIGINT)"
    return (f"concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, CAST({n} // 10 AS VARCHAR), '.', "
            f"CAST({n} % 10 AS VARCHAR))")


def _signed(x):
    return f"concat(CASE WHEN {x} > 0 THEN '+' ELSE '' END, {_tenths(x)})"


@job("n11_display_text", f"""
SELECT water_year, month, region,
       concat({_signed('temperature_anomaly')}, ' C') AS temp_metric,
       concat({_signed('(temperature_anomaly * 9 / 5)')}, ' F') AS temp_imperial,
       CAST(CAST(floor(precipitation_mm + 0.5) AS BIGINT) AS VARCHAR) AS rain_metric,
       {_tenths('(precipitation_mm / 25.4)')} AS rain_imperial,
       CAST(CAST(floor(snowfall_cm + 0.5) AS BIGINT) AS VARCHAR) AS snow_metric,
       {_tenths('(snowfall_cm / 2.54)')} AS snow_imperial
FROM winter_history""")
def display_text(spark, sf):
    return view(spark, sf, "winter_history").select(
        "water_year", "month", "region",
        N.anomaly_text("temperature_anomaly").alias("temp_metric"),
        N.anomaly_text("temperature_anomaly", "imperial").alias("temp_imperial"),
        N.amount_text("precipitation_mm").alias("rain_metric"),
        N.amount_text("precipitation_mm", "imperial").alias("rain_imperial"),
        N.amount_text("snowfall_cm", kind="snowfall").alias("snow_metric"),
        N.amount_text("snowfall_cm", "imperial", "snowfall").alias("snow_imperial"))


@job("n12_season_label", """
SELECT DISTINCT water_year, concat(CAST(water_year - 1 AS VARCHAR), '-',
       lpad(CAST(water_year % 100 AS VARCHAR), 2, '0')) AS season
FROM winter_history""")
def season_labels(spark, sf):
    return view(spark, sf, "winter_history").select("water_year").distinct().select(
        "water_year", N.season_label("water_year").alias("season"))
