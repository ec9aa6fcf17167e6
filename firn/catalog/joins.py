"""Joins over the test views."""

from pyspark.sql import functions as F

from firn import schemas as K
from firn.catalog.registry import day_text, fixed4, job
from firn.catalog.views import r4, view
from firn.functions import scalars as N
from firn.operators import aggregates as A, joins as J
from firn.operators.windows import index_trend

HISTORY = ["water_year", "month", "region", "precipitation_mm", "snowfall_cm"]

# The 7-row region dimension as SQL values, for the checks.
REGION_VALUES = "(VALUES " + ", ".join(
    f"({i}, '{r}', {lat}::DOUBLE, {elev}, {w}::DOUBLE, '{label}')"
    for i, (r, lat, elev, w, label) in enumerate(K.REGIONS)
) + ") AS regions(region_order, region, latitude, elevation_m, area_weight, label)"

# The recency-weighted normal and every winter beside it, for the checks.
NORMAL_SQL = """
weighted AS (SELECT *, pow(2.0, -((SELECT max(water_year) FROM winter_history) - water_year) / 7.0) AS w
             FROM winter_history),
normal AS (SELECT region, month, sum(w * precipitation_mm) / sum(w) AS precipitation_mm_normal,
                  sum(w * snowfall_cm) / sum(w) AS snowfall_cm_normal FROM weighted GROUP BY 1, 2)"""
COMPARED_SQL = f"""{NORMAL_SQL},
compared AS (SELECT h.*, r.area_weight, r.label, precipitation_mm_normal, snowfall_cm_normal,
    concat(CAST(CASE WHEN h.month >= 10 THEN water_year - 1 ELSE water_year END AS VARCHAR), '-',
           lpad(CAST(h.month AS VARCHAR), 2, '0')) AS period
  FROM winter_history h JOIN {REGION_VALUES.replace(' AS regions', ' AS r')} ON h.region = r.region
  LEFT JOIN normal n ON h.region = n.region AND h.month = n.month)"""


def history(spark, sf):
    return view(spark, sf, "winter_history")


def compared(spark, sf, half_life=7.0):
    """Every winter as a forecast, all winters as the climatology."""
    h = history(spark, sf)
    return J.compare_with_normal(J.as_forecast(h), A.recency_normal(h, half_life))


@job("j1_snow_climate", """
SELECT s.station_id, CAST(s.date AS VARCHAR) AS date, swe, humidity, wind_speed
FROM station_daily s LEFT JOIN climate_daily c ON s.station_id = c.station_id AND s.date = c.date""")
def snow_climate(spark, sf):
    df = J.join_sources(view(spark, sf, "station_daily").select("station_id", "date", "swe"),
                        view(spark, sf, "climate_daily"))
    return df.select("station_id", day_text().alias("date"), "swe", "humidity", "wind_speed")


@job("j2_index_exact", """
SELECT s.station_id, CAST(s.date AS VARCHAR) AS date, swe, oni
FROM station_daily s LEFT JOIN index_monthly i ON s.date = i.date""")
def index_exact(spark, sf):
    df = J.join_index_exact(view(spark, sf, "station_daily").select("station_id", "date", "swe"),
                            view(spark, sf, "index_monthly").select("date", "oni"))
    return df.withColumn("date", day_text())


@job("j3_index_month", """
SELECT s.station_id, CAST(s.date AS VARCHAR) AS date, oni, mei
FROM station_daily s LEFT JOIN index_monthly i ON last_day(s.date) = i.date""")
def index_month(spark, sf):
    df = J.join_index_month(view(spark, sf, "station_daily").select("station_id", "date"),
                            view(spark, sf, "index_monthly").select("date", "oni", "mei"))
    return df.withColumn("date", day_text())


@job("j3_index_as_of", """
SELECT s.station_id, CAST(s.date AS VARCHAR) AS date, oni, mei
FROM station_daily s ASOF LEFT JOIN index_monthly i
  ON s.date >= i.date""")
def index_as_of(spark, sf):
    df = J.join_index_as_of(view(spark, sf, "station_daily").select("station_id", "date"),
                            view(spark, sf, "index_monthly").select("date", "oni", "mei"))
    return df.withColumn("date", day_text())


@job("j4_region_lookup", f"""
SELECT water_year, month, h.region, latitude, elevation_m, area_weight, label
FROM winter_history h LEFT JOIN {REGION_VALUES} ON h.region = regions.region""")
def region_lookup(spark, sf):
    return J.add_region(history(spark, sf).select("water_year", "month", "region"))


@job("j5_forecast_vs_normal", f"""WITH {COMPARED_SQL}
SELECT water_year, region, month, precipitation_mm, snowfall_cm, {r4('precipitation_mm_normal')} AS precipitation_mm_normal,
       {r4('snowfall_cm_normal')} AS snowfall_cm_normal FROM compared""")
def forecast_vs_normal(spark, sf):
    return compared(spark, sf).select(
        "water_year", "region", "month", "precipitation_mm", "snowfall_cm",
        fixed4("precipitation_mm_normal").alias("precipitation_mm_normal"),
        fixed4("snowfall_cm_normal").alias("snowfall_cm_normal"))


@job("j6_holdout_split", """
WITH years AS (SELECT DISTINCT water_year FROM winter_history ORDER BY 1 DESC LIMIT 2)
SELECT water_year, month, region, precipitation_mm, snowfall_cm,
       CASE WHEN water_year IN (SELECT water_year FROM years) THEN 'test' ELSE 'train' END AS part
FROM winter_history""")
def holdout_split(spark, sf):
    h = history(spark, sf).select(*HISTORY)
    train, test = J.split_years(h, A.last_years(h, 2))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@job("j7_scenario_grid", f"""
SELECT DISTINCT water_year, enso, pdo, ao, pna, regions.region, m AS month
FROM (SELECT DISTINCT water_year, enso, pdo, ao, pna FROM winter_history) s,
     {REGION_VALUES}, (VALUES (11), (12), (1), (2), (3), (4)) AS months(m)""")
def scenario_grid(spark, sf):
    scenarios = history(spark, sf).select("water_year", *K.CLIMATE_INDICES).distinct()
    return J.scenario_grid(scenarios)


@job("j8_fan_out", "SELECT station_id, CAST(date AS VARCHAR) AS date, temperature, scenario FROM station_daily, "
     "(VALUES " + ", ".join(f"('{s[0]}')" for s in K.DEFAULT_SCENARIOS) + ") AS s(scenario)")
def fan_out(spark, sf):
    df = J.fan_out(view(spark, sf, "station_daily"), K.DEFAULT_SCENARIOS)
    return df.select("station_id", day_text().alias("date"), "temperature",
                     F.col("scenario.name").alias("scenario"))


@job("j3_index_features", f"""
SELECT s.station_id, CAST(s.date AS VARCHAR) AS date, i.oni, {r4('i.trend')} AS oni_3month_avg,
       CASE WHEN i.oni <= -0.5 THEN 'La Niña' WHEN i.oni <= 0.5 THEN 'Neutral'
            WHEN i.oni IS NOT NULL THEN 'El Niño' END AS enso_phase
FROM station_daily s LEFT JOIN (
  SELECT date, oni, avg(oni) OVER (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS trend
  FROM index_monthly) i ON last_day(s.date) = i.date""")
def index_features(spark, sf):
    index = index_trend(view(spark, sf, "index_monthly").select("date", "oni"), windows=(3,))
    df = J.join_index_month(view(spark, sf, "station_daily").select("station_id", "date"), index)
    return df.select("station_id", day_text().alias("date"), "oni",
                     fixed4("oni_3month_avg").alias("oni_3month_avg"),
                     N.index_phase().alias("enso_phase"))
