"""Window features over the station and index views."""

import re

from pyspark.sql import functions as F

from firn.catalog.registry import day_text, fixed4, job
from firn.catalog.views import r4, stored, view
from firn.functions import scalars as N
from firn.operators import aggregates as A, suggested as S, windows as W
from firn.operators.joins import split_years
from firn.operators.series import Series, positions
from firn.session import materialize

OBS = ("swe", "temperature", "precipitation")
KEY = ["station_id", "date"]


def stations(spark, sf, *cols):
    return materialize(view(spark, sf, "station_daily").select(*KEY, *cols))


def shown(df, *cols):
    return df.select("station_id", day_text().alias("date"), *[fixed4(c).alias(c) for c in cols])


def _over(n):
    return f"OVER (PARTITION BY station_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


LAG_NAMES = [f"{c}_lag_{k}" for k in W.LAGS for c in OBS]


@job("w1_lag", "SELECT station_id, CAST(date AS VARCHAR) AS date, " + ", ".join(
    f"lag({c}, {k}) OVER (PARTITION BY station_id ORDER BY date) AS {c}_lag_{k}"
    for k in W.LAGS for c in OBS) + " FROM station_daily")
def lags(spark, sf):
    df = W.add_lags(stations(spark, sf, *OBS))
    return df.select("station_id", day_text().alias("date"), *LAG_NAMES)


@job("w2_rolling_mean", "SELECT station_id, CAST(date AS VARCHAR) AS date, " + ", ".join(
    f"{r4(f'avg({c}) {_over(n)}')} AS {c}_roll_mean_{n}" for n in W.WINDOWS for c in ("swe", "temperature")
) + " FROM station_daily")
def rolling_mean(spark, sf):
    made = W.rolling_columns(mean=("swe", "temperature"))
    df = W.add_window_columns(stations(spark, sf, "swe", "temperature"), made, 90)
    return shown(df, *made)


@job("w3_rolling_std", "SELECT station_id, CAST(date AS VARCHAR) AS date, " + ", ".join(
    f"{r4(f'stddev_samp(swe) {_over(n)}')} AS swe_roll_std_{n}" for n in W.WINDOWS
) + " FROM station_daily")
def rolling_std(spark, sf):
    made = W.rolling_columns(std=("swe",))
    return shown(W.add_window_columns(stations(spark, sf, "swe"), made, 90), *made)


@job("w4_rolling_sum", "SELECT station_id, CAST(date AS VARCHAR) AS date, " + ", ".join(
    f"{r4(f'sum(precipitation) {_over(n)}')} AS precipitation_roll_sum_{n}" for n in W.WINDOWS
) + " FROM station_daily")
def rolling_sum(spark, sf):
    made = W.rolling_columns(total=("precipitation",))
    return shown(W.add_window_columns(stations(spark, sf, "precipitation"), made, 90), *made)


MADE = [*LAG_NAMES, *[f"{c}_roll_mean_{n}" for n in W.WINDOWS for c in ("swe", "temperature")],
        *[f"swe_roll_std_{n}" for n in W.WINDOWS], *[f"precipitation_roll_sum_{n}" for n in W.WINDOWS]]
_FN = {"mean": "avg", "std": "stddev_samp", "sum": "sum"}


def _made_sql(name):
    col, kind, *rest = re.fullmatch(r"([a-z]+)_(?:roll_)?(lag|mean|std|sum)_(\d+)", name).groups()
    if kind == "lag":
        return f"lag({col}, {rest[0]}) OVER (PARTITION BY station_id ORDER BY date) AS {name}"
    return f"{r4(f'{_FN[kind]}({col}) {_over(int(rest[0]))}')} AS {name}"


@job("r14_made_features", "SELECT station_id, CAST(date AS VARCHAR) AS date, " + ", ".join(map(_made_sql, MADE))
     + " FROM station_daily")
def made_features(spark, sf):
    """All lags and windows from their names alone, in one window pass."""
    df = S.make_features(stations(spark, sf, *OBS), MADE)
    return df.select("station_id", day_text().alias("date"), *LAG_NAMES,
                     *[fixed4(c).alias(c) for c in MADE if c not in LAG_NAMES])


@job("r14_suggested_features", f"""
SELECT station_id, CAST(d.date AS VARCHAR) AS date, CAST(dayofyear(d.date) AS INT) AS day_of_year,
  CAST(year(d.date) - CASE WHEN month(d.date) >= 10 THEN 0 ELSE 1 END AS INT) AS water_year, swe_lag_7, swe_lag_30,
  {r4('p30')} AS precipitation_roll_sum_30, {r4('anomaly')} AS temperature_anomaly,
  CASE WHEN oni <= -0.5 THEN 'La Niña' WHEN oni <= 0.5 THEN 'Neutral' WHEN oni IS NOT NULL THEN 'El Niño' END AS enso_phase
FROM (SELECT station_id, date, lag(swe, 7) OVER (PARTITION BY station_id ORDER BY date) AS swe_lag_7,
    lag(swe, 30) OVER (PARTITION BY station_id ORDER BY date) AS swe_lag_30, sum(precipitation) {_over(30)} AS p30,
    temperature - avg(temperature) OVER (PARTITION BY month(date)) AS anomaly FROM station_daily) d
LEFT JOIN index_monthly i ON last_day(d.date) = i.date""")
def suggested_features(spark, sf):
    """Every feature the rules suggest for the station table and the index, made."""
    df = S.make_suggested(stations(spark, sf, *OBS), "swe", view(spark, sf, "index_monthly"))
    return df.select(
        "station_id", day_text().alias("date"), "day_of_year", "water_year", "swe_lag_7", "swe_lag_30",
        fixed4("precipitation_roll_sum_30").alias("precipitation_roll_sum_30"),
        fixed4("temperature_anomaly").alias("temperature_anomaly"), "enso_phase")


@job("w5_index_trend", f"""
SELECT CAST(date AS VARCHAR) AS date, oni,
       {r4('avg(oni) OVER (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS oni_3month_avg,
       {r4('avg(oni) OVER (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)')} AS oni_12month_avg
FROM index_monthly""")
def index_trend(spark, sf):
    df = W.index_trend(view(spark, sf, "index_monthly").select("date", "oni"))
    return df.select(day_text().alias("date"), "oni", fixed4("oni_3month_avg").alias("oni_3month_avg"),
                     fixed4("oni_12month_avg").alias("oni_12month_avg"))


@job("w6_full_window", f"""
SELECT station_id, CAST(date AS VARCHAR) AS date,
       CASE WHEN count(swe) {_over(14)} = 14 THEN {r4(f'avg(swe) {_over(14)}')} END AS swe_full_mean_14,
       CASE WHEN count(precipitation) {_over(30)} = 30 THEN {r4(f'sum(precipitation) {_over(30)}')} END
         AS precipitation_full_sum_30
FROM station_daily""")
def full_window(spark, sf):
    made = W.strict_columns(["swe"], [14]) | W.strict_columns(["precipitation"], [30], "sum")
    df = W.add_window_columns(stations(spark, sf, "swe", "precipitation"), made, 30)
    return shown(df, *made)


_WY = "CAST(year(date) - CASE WHEN month(date) >= 10 THEN 0 ELSE 1 END AS INT)"
_CUM = (f"CASE WHEN precipitation IS NOT NULL THEN sum(precipitation) OVER (PARTITION BY station_id, {_WY} "
        "ORDER BY date ROWS UNBOUNDED PRECEDING) END")


@job("w7_water_year_total", f"""
SELECT station_id, CAST(date AS VARCHAR) AS date, {_WY} AS water_year, {r4(_CUM)} AS precipitation_cum_wy
FROM station_daily""")
def water_year_total(spark, sf):
    df = stations(spark, sf, "precipitation").withColumn("water_year", N.water_year("date"))
    df = W.add_water_year_total(df)
    return df.select("station_id", day_text().alias("date"), "water_year",
                     fixed4("precipitation_cum_wy").alias("precipitation_cum_wy"))


@job("w8_total_since_oct1", f"""
SELECT station_id, CAST(date AS VARCHAR) AS date, {r4(_CUM)} AS precipitation_cum_oct1,
       CAST(date_diff('day', make_date({_WY}, 10, 1), date) AS INT) AS days_since_oct1
FROM station_daily""")
def total_since_oct1(spark, sf):
    df = N.add_water_year(stations(spark, sf, "precipitation"))
    df = W.add_water_year_total(df, name="precipitation_cum_oct1")
    return df.select("station_id", day_text().alias("date"),
                     fixed4("precipitation_cum_oct1").alias("precipitation_cum_oct1"),
                     "days_since_oct1")


@job("w9_sequences", """
SELECT station_id, CAST(date AS VARCHAR) AS date, label,
       CAST(s[1][1] AS BIGINT) AS first_wind, CAST(s[5][2] AS BIGINT) AS last_humidity,
       array_to_string(list_transform(s, lambda x: concat(CAST(CAST(x[1] AS BIGINT) AS VARCHAR), ':',
                                                     CAST(CAST(x[2] AS BIGINT) AS VARCHAR))), '|') AS steps
FROM (SELECT station_id, date, humidity AS label,
             list([wind_speed, humidity]) OVER (PARTITION BY station_id ORDER BY date
                                                ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS s
      FROM climate_daily) x
WHERE len(s) = 5""")
def sequences(spark, sf):
    df = stored(spark, sf, "climate_daily")
    made = W.sequence_windows(df, ["wind_speed", "humidity"], "humidity", 5)
    whole = lambda c: c.cast("bigint")
    text = F.array_join(F.transform("sequence", lambda x: F.concat_ws(
        ":", whole(x[0]).cast("string"), whole(x[1]).cast("string"))), "|")
    return made.select(
        "station_id", day_text().alias("date"), "label",
        whole(F.col("sequence")[0][0]).alias("first_wind"),
        whole(F.col("sequence")[4][1]).alias("last_humidity"), text.alias("steps"))


@job("w10_recency_weight", f"""
SELECT water_year, month, region, {r4('pow(2.0, -((SELECT max(water_year) FROM winter_history) - water_year) / 7.0)')} AS weight,
       1.0::DOUBLE AS flat_weight
FROM winter_history""")
def recency_weight(spark, sf):
    df = A.add_recency_weight(view(spark, sf, "winter_history"))
    df = A.add_recency_weight(df, 0, "flat_weight")
    return df.select("water_year", "month", "region", fixed4("weight").alias("weight"), "flat_weight")


@job("t1_order", """
SELECT station_id, CAST(date AS VARCHAR) AS date, swe,
       CAST(row_number() OVER (PARTITION BY station_id ORDER BY date) AS BIGINT) AS position
FROM station_daily""")
def ordered(spark, sf):
    df = positions(stations(spark, sf, "swe"), Series())
    return df.orderBy("station_id", "date").withColumn("date", day_text())


@job("t2_top_k", """
SELECT model_id, CAST(rank AS INT) AS rank, row_id, y FROM (
  SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY y DESC, row_id) AS rank FROM scored) x
WHERE rank <= 10""")
def top_rows(spark, sf):
    df = A.top_k(view(spark, sf, "scored"), 10, "y", ["model_id"], ["row_id"])
    return df.select("model_id", "rank", "row_id", "y")


@job("t3_last_years", """
SELECT h.water_year, month, region, precipitation_mm FROM winter_history h
WHERE h.water_year IN (SELECT DISTINCT water_year FROM winter_history ORDER BY 1 DESC LIMIT 3)""")
def last_years(spark, sf):
    h = view(spark, sf, "winter_history")
    return split_years(h, A.last_years(h, 3))[1].select(
        "water_year", "month", "region", "precipitation_mm")
