"""Aggregations, roll-ups and set comparisons over the test views."""

from pyspark.sql import functions as F

from firn import schemas as K
from firn.catalog.joins import COMPARED_SQL, NORMAL_SQL, REGION_VALUES, compared, history
from firn.catalog.registry import day_text, fixed4, job
from firn.catalog.views import r4, view
from firn.functions import scalars as N
from firn.operators import aggregates as A

PHASE_VALUES = "(VALUES " + ", ".join(
    f"({m}, '{p}', '{label}', '{text}')" for p, label, text, months in K.SEASON_PHASES for m in months
) + ") AS phases(month, phase_id, phase_label, phase_months)"


def round_columns(df, *keys):
    return df.select(*keys, *[fixed4(c).alias(c) for c in df.columns if c not in keys])


@job("a1_month_anomaly", f"""
SELECT station_id, CAST(date AS VARCHAR) AS date, {r4('temperature - avg(temperature) OVER (PARTITION BY month(date))')}
       AS temperature_anomaly FROM station_daily""")
def month_anomaly(spark, sf):
    df = view(spark, sf, "station_daily").withColumn("month", F.month("date"))
    return A.month_anomaly(df).select("station_id", day_text().alias("date"),
                                      fixed4("temperature_anomaly").alias("temperature_anomaly"))


@job("a2_station_stats", f"""
SELECT station_id, CAST(date AS VARCHAR) AS date, {r4('avg(swe) OVER (PARTITION BY station_id)')} AS station_mean_swe,
       {r4('stddev_samp(swe) OVER (PARTITION BY station_id)')} AS station_std_swe FROM station_daily""")
def station_stats(spark, sf):
    df = A.key_stats(view(spark, sf, "station_daily").select("station_id", "date", "swe"))
    return df.select("station_id", day_text().alias("date"), fixed4("station_mean_swe").alias("station_mean_swe"),
                     fixed4("station_std_swe").alias("station_std_swe"))


@job("a3_recency_normal", f"""WITH {NORMAL_SQL}
SELECT region, month, {r4('precipitation_mm_normal')} AS precipitation_mm,
       {r4('snowfall_cm_normal')} AS snowfall_cm FROM normal""")
def recency_normal(spark, sf):
    return round_columns(A.recency_normal(history(spark, sf)), "region", "month")


@job("a4_trajectory", f"""WITH {COMPARED_SQL}
SELECT water_year, period, month, {r4('sum(precipitation_mm * area_weight)')} AS precipitation_mm,
       {r4('sum(snowfall_cm * area_weight)')} AS snowfall_cm FROM compared GROUP BY 1, 2, 3""")
def trajectory(spark, sf):
    return round_columns(A.trajectory(compared(spark, sf), "water_year"), "water_year", "period", "month")


@job("a5_percent_of_normal", f"""WITH {COMPARED_SQL}
SELECT water_year, region, month, {r4('100 * precipitation_mm / greatest(precipitation_mm_normal, 0.01)')} AS precipitation_mm_pct_normal,
       {r4('100 * snowfall_cm / greatest(snowfall_cm_normal, 0.01)')} AS snowfall_cm_pct_normal FROM compared""")
def percent_of_normal(spark, sf):
    df = A.percent_of_normal(compared(spark, sf))
    return round_columns(df.select("water_year", "region", "month", "precipitation_mm_pct_normal",
                                   "snowfall_cm_pct_normal"), "water_year", "region", "month")


def _pct(top, bottom):
    return f"CASE WHEN sum({bottom}) = 0 THEN 100.0 ELSE 100 * sum({top}) / sum({bottom}) END"


@job("a6_phase_rollup", f"""WITH {COMPARED_SQL}
SELECT water_year, phase_id, phase_label, phase_months,
       {r4('sum(temperature_anomaly * area_weight) / sum(area_weight)')} AS predicted_temp_c,
       {r4('sum(precipitation_mm * area_weight)')} AS precipitation_mm,
       {r4(_pct('precipitation_mm * area_weight', 'precipitation_mm_normal * area_weight'))} AS precipitation_pct_normal,
       {r4('sum(snowfall_cm * area_weight)')} AS snowfall_cm
FROM compared JOIN {PHASE_VALUES} ON compared.month = phases.month GROUP BY 1, 2, 3, 4""")
def phase_rollup(spark, sf):
    df = A.phase_rollup(compared(spark, sf), "water_year").drop("phase_order")
    return round_columns(df, "water_year", "phase_id", "phase_label", "phase_months")


@job("a7_region_rollup", f"""WITH {COMPARED_SQL}
SELECT water_year, region, {r4('sum(precipitation_mm)')} AS precipitation_mm, {r4('sum(precipitation_mm_normal)')} AS normal_mm,
       {r4('sum(snowfall_cm)')} AS snowfall_cm, {r4('sum(snowfall_cm_normal)')} AS normal_snow_cm,
       {r4(_pct('precipitation_mm', 'precipitation_mm_normal'))} AS precipitation_pct_normal,
       {r4(_pct('snowfall_cm', 'snowfall_cm_normal'))} AS snowfall_pct_normal,
       {r4('avg(temperature_anomaly)')} AS temperature_anomaly_c FROM compared GROUP BY 1, 2""")
def region_rollup(spark, sf):
    return round_columns(A.region_rollup(compared(spark, sf), "water_year"), "water_year", "region")


@job("a8_statewide", f"""WITH {COMPARED_SQL}
SELECT water_year, {r4('sum(precipitation_mm * area_weight)')} AS precipitation_mm, {r4('sum(snowfall_cm * area_weight)')} AS snowfall_cm,
       {r4('sum(temperature_anomaly * area_weight) / sum(area_weight)')} AS temperature_anomaly_c,
       {r4('100 * sum(precipitation_mm * area_weight) / sum(precipitation_mm_normal * area_weight)')} AS precipitation_pct_normal,
       {r4('100 * sum(snowfall_cm * area_weight) / sum(snowfall_cm_normal * area_weight)')} AS snowfall_pct_normal
FROM compared GROUP BY 1""")
def statewide(spark, sf):
    return round_columns(A.statewide(compared(spark, sf), "water_year"), "water_year")


@job("a9_forecast_context", f"""
SELECT {r4('avg(swe)')} AS historical_mean, {r4('stddev_samp(swe)')} AS historical_std,
       CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date,
       {r4('(45.0 - avg(swe)) / avg(swe) * 100')} AS pct_vs_mean FROM station_daily""")
def forecast_context(spark, sf):
    df = A.forecast_context(view(spark, sf, "station_daily"), "swe", 45.0)
    return df.select(
        fixed4("historical_mean").alias("historical_mean"), fixed4("historical_std").alias("historical_std"),
        day_text("first_date").alias("first_date"), day_text("last_date").alias("last_date"),
        fixed4("pct_vs_mean").alias("pct_vs_mean"))


def _profile_sql(c):
    corr = f"corr({c}, swe)" if c != "swe" else "corr(swe, swe)"
    return f"""SELECT '{c}' AS column_name, count(*) AS row_count, {r4(f'100.0 * (count(*) - count({c})) / count(*)')} AS missing_percent,
       {r4(f'min({c})')} AS min_value, {r4(f'max({c})')} AS max_value, {r4(f'avg({c})')} AS mean_value,
       {r4(corr)} AS corr_target FROM station_daily"""


@job("a10_profile", " UNION ALL ".join(_profile_sql(c) for c in ("swe", "precipitation", "temperature")))
def profile(spark, sf):
    df = A.profile(view(spark, sf, "station_daily"), "swe")
    return round_columns(df, "column_name", "row_count")


@job("a10_dataset_facts", """
SELECT count(*) AS row_count, 5 AS column_count, count(DISTINCT station_id) AS station_count,
       CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date,
       CAST(floor(date_diff('day', min(date), max(date)) / 365.25) AS INT) AS span_years
FROM station_daily""")
def dataset_facts(spark, sf):
    df = A.dataset_facts(view(spark, sf, "station_daily"))
    return df.withColumns({c: day_text(c) for c in ("first_date", "last_date")})


@job("a11_distinct_counts", """
SELECT 'station_id' AS column_name, count(DISTINCT station_id) AS distinct_values FROM station_daily
UNION ALL SELECT 'date', count(DISTINCT date) FROM station_daily
UNION ALL SELECT 'precipitation', count(DISTINCT precipitation) FROM station_daily""")
def distinct_counts(spark, sf):
    return A.distinct_counts(view(spark, sf, "station_daily"), ["station_id", "date", "precipitation"])


_ORDER = "CASE WHEN month >= 11 THEN month - 11 ELSE month + 1 END"


@job("a12_peak_month", f"""
SELECT water_year, arg_max(month, total * 10 - o) AS peak_month, {r4('greatest(1.0, max(total))')} AS chart_max
FROM (SELECT water_year, month, {_ORDER} AS o, round(sum(precipitation_mm), 0) AS total
      FROM winter_history GROUP BY 1, 2, 3) x GROUP BY 1""")
def peak_month(spark, sf):
    order = F.when(F.col("month") >= 11, F.col("month") - 11).otherwise(F.col("month") + 1)
    months = history(spark, sf).groupBy("water_year", "month", order.alias("month_order")).agg(
        F.round(F.sum("precipitation_mm"), 0).alias("precipitation_mm"))
    return round_columns(A.peak_month(months, ["water_year"]), "water_year", "peak_month")


@job("a13_error_metrics", f"""
SELECT model_id, count(*) AS row_count, {r4('sqrt(avg((y - yhat) * (y - yhat)))')} AS rmse, {r4('avg(abs(y - yhat))')} AS mae,
       {r4('1 - avg((y - yhat) * (y - yhat)) / var_pop(y)')} AS r2, {r4('avg((y - yhat) * (y - yhat))')} AS mse
FROM scored GROUP BY 1""")
def error_metrics(spark, sf):
    return round_columns(A.error_metrics(view(spark, sf, "scored"), "y", "yhat", "model_id"),
                         "model_id", "row_count")


@job("u1_unknown_values", f"""
SELECT DISTINCT region FROM (
  SELECT CASE WHEN month = 4 AND water_year % 2 = 0 THEN concat(region, '_old') ELSE region END AS region
  FROM winter_history) x WHERE region NOT IN (SELECT region FROM {REGION_VALUES})""")
def unknown_values(spark, sf):
    renamed = F.when((F.col("month") == 4) & (F.col("water_year") % 2 == 0),
                     F.concat("region", F.lit("_old"))).otherwise(F.col("region"))
    df = history(spark, sf).withColumn("region", renamed)
    return A.unknown_values(df, "region", K.regions(spark))


_PHASE = "CASE WHEN oni <= -0.5 THEN 'La Niña' WHEN oni <= 0.5 THEN 'Neutral' ELSE 'El Niño' END"


@job("u2_changed_values", f"""
WITH a AS (SELECT DISTINCT {_PHASE} AS v FROM index_monthly),
     b AS (SELECT DISTINCT {_PHASE.replace('oni', '(oni * 0 + 2)')} AS v FROM index_monthly UNION SELECT 'Strong' )
SELECT v AS value, 'removed' AS change FROM a WHERE v NOT IN (SELECT v FROM b)
UNION ALL SELECT v, 'added' FROM b WHERE v NOT IN (SELECT v FROM a)""")
def changed_values(spark, sf):
    before = view(spark, sf, "index_monthly").select(N.index_phase().alias("enso_phase"), "date")
    after = before.withColumn("enso_phase", F.when(F.month("date") == 1, "Strong").otherwise("El Niño"))
    return A.changed_values(before, after, "enso_phase")
