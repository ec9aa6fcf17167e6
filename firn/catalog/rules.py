"""Rule-based scoring over roll-ups, scored rows and profiles of the test views."""

from pyspark.sql import functions as F

from firn.catalog.aggregates import _pct
from firn.catalog.joins import NORMAL_SQL, history
from firn.catalog.registry import fixed4, job
from firn.catalog.views import r4, stored, view
from firn.functions import reports, rules as R
from firn.operators import aggregates as A, joins as J, windows as W

# Every winter against the recency-weighted normal, per region.
REGIONAL = f"""{NORMAL_SQL},
regional AS (SELECT h.water_year, h.region, {_pct('precipitation_mm', 'precipitation_mm_normal')} AS rain_pct,
    {_pct('snowfall_cm', 'snowfall_cm_normal')} AS snow_pct, avg(temperature_anomaly) AS temp
  FROM winter_history h JOIN normal n ON h.region = n.region AND h.month = n.month GROUP BY 1, 2)"""


def regional(spark, sf):
    h = history(spark, sf)
    both = J.compare_with_normal(h, A.recency_normal(h))
    return A.region_rollup(both, "water_year").select(
        "water_year", "region", F.col("precipitation_pct_normal").alias("rain_pct"),
        F.col("snowfall_pct_normal").alias("snow_pct"), F.col("temperature_anomaly_c").alias("temp"))


@job("r1_wetness", f"""WITH {REGIONAL}
SELECT water_year, region, CASE WHEN rain_pct >= 110 THEN 'wet' WHEN rain_pct <= 90 THEN 'dry' ELSE 'near_normal' END AS wetness
FROM regional""")
def wetness(spark, sf):
    return regional(spark, sf).select("water_year", "region", R.wetness("rain_pct").alias("wetness"))


@job("r2_water_risk", f"""WITH {REGIONAL}
SELECT water_year, region, CASE WHEN rain_pct <= 85 OR snow_pct <= 85 THEN 'High' ELSE 'Moderate' END AS level,
  CASE WHEN rain_pct <= 85 OR snow_pct <= 85 THEN '{R.WATER_MESSAGES["short"]}'
       WHEN rain_pct >= 115 THEN '{R.WATER_MESSAGES["ample"]}' ELSE '{R.WATER_MESSAGES["normal"]}' END AS summary
FROM regional""")
def water_risk(spark, sf):
    df = regional(spark, sf).withColumn("risk", R.water_risk("rain_pct", "snow_pct"))
    return df.select("water_year", "region", "risk.level", "risk.summary")


@job("r3_wildfire_risk", f"""WITH {REGIONAL}, leveled AS (SELECT *, CASE WHEN rain_pct <= 85 AND temp >= 0.5 THEN 'High'
    WHEN rain_pct >= 115 THEN 'Low' ELSE 'Moderate' END AS level FROM regional)
SELECT water_year, region, level, CASE level {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in R.FIRE_MESSAGES.items())} END AS summary
FROM leveled""")
def wildfire_risk(spark, sf):
    df = regional(spark, sf).withColumn("risk", R.wildfire_risk("rain_pct", "temp"))
    return df.select("water_year", "region", "risk.level", "risk.summary")


_H = R.HAZARDS
_SOUTH = "region IN ('central_coast_valleys', 'southern_california')"
_NORTH = "region IN ('north_coast', 'shasta_cascades', 'northern_sierra')"


@job("r4_regional_hazards", f"""WITH {REGIONAL}, listed AS (SELECT water_year, region, list_filter([
    CASE WHEN rain_pct >= 115 THEN '{_H["flood"]}' WHEN rain_pct <= 85 THEN '{_H["drought"]}' END,
    CASE WHEN snow_pct <= 85 OR temp >= 0.8 THEN '{_H["snowpack"]}' END,
    CASE WHEN temp >= 1.0 THEN '{_H["melt"]}' END,
    CASE WHEN temp <= -0.8 AND {_SOUTH} THEN '{_H["frost"]}' END,
    CASE WHEN {_NORTH} AND rain_pct >= 110 THEN '{_H["landslide"]}' END,
    CASE WHEN {_SOUTH} AND rain_pct >= 110 THEN '{_H["urban"]}' END], lambda x: x IS NOT NULL) AS h FROM regional),
  joined AS (SELECT water_year, region, CASE WHEN len(h) = 0 THEN '{_H["none"]}' ELSE array_to_string(h[1:3], '; ') END AS t FROM listed)
SELECT water_year, region, concat(upper(substr(t, 1, 1)), lower(substr(t, 2)), '.') AS risks FROM joined""")
def hazards(spark, sf):
    return regional(spark, sf).select(
        "water_year", "region", R.regional_hazards("region", "rain_pct", "snow_pct", "temp").alias("risks"))


# Scored rows as forecasts against the mean truth of their model.
FORECASTS = """forecasts AS (SELECT row_id, s.model_id, CAST(yhat AS DOUBLE) AS predicted, m.baseline,
    (yhat - m.baseline) / m.baseline * 100 AS pct
  FROM scored s JOIN (SELECT model_id, avg(y) AS baseline FROM scored GROUP BY 1) m ON s.model_id = m.model_id)"""


def forecasts(spark, sf):
    """The baseline table has one row per model; adaptive execution decides how it is joined."""
    df = view(spark, sf, "scored")
    base = df.groupBy("model_id").agg(F.avg("y").alias("baseline"))
    return df.select("row_id", "model_id", F.col("yhat").cast("double").alias("predicted")).join(
        base, "model_id")


def explained(spark, sf):
    return R.explain(forecasts(spark, sf), "predicted", "baseline")


_TREND = """CASE WHEN pct > 10 THEN 'significantly above average' WHEN pct > 0 THEN 'above average'
  WHEN pct < -10 THEN 'significantly below average' WHEN pct < 0 THEN 'below average' ELSE 'near average' END"""
_BAND = "CASE WHEN pct > 10 THEN 'high' WHEN pct < -10 THEN 'low' WHEN pct <> 0 THEN 'normal' END"


@job("r5_trend", f"WITH {FORECASTS} SELECT row_id, model_id, {_TREND} AS trend FROM forecasts")
def trend(spark, sf):
    return explained(spark, sf).select("row_id", "model_id", "trend")


def _q(t):
    return "'" + t.replace("'", "''") + "'"


def _cases(texts):
    return f"CASE {_BAND} " + " ".join(f"WHEN '{b}' THEN {_q(t)}" for b, t in texts.items()) + " END"


@job("r6_audience_impact", f"WITH {FORECASTS} " + " UNION ALL ".join(
    f"""SELECT row_id, '{a}' AS audience, {_cases(t)} AS impact,
      CASE {_BAND} WHEN 'high' THEN 'low' WHEN 'low' THEN 'high' ELSE 'normal' END AS risk_level
    FROM forecasts WHERE pct <> 0""" for a, t in R.AUDIENCE_IMPACT.items()))
def audience_impact(spark, sf):
    return explained(spark, sf).select("row_id", "risk_level", F.explode("stakeholder_impact").alias(
        "audience", "impact"))


@job("r7_recommendations", f"WITH {FORECASTS} SELECT row_id, " + _cases(
    {b: " / ".join(t) for b, t in R.RECOMMENDATIONS.items()}) + """ AS recommendations FROM forecasts""")
def recommendations(spark, sf):
    return explained(spark, sf).select(
        "row_id", F.array_join("recommendations", " / ").alias("recommendations"))


def _digit(x):
    n = f"CAST(floor(abs({x}) * 10 + 0.5) AS BIGINT)"
    return (f"concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, CAST({n} // 10 AS VARCHAR), '.', "
            f"CAST({n} % 10 AS VARCHAR))")


def _plus(x):
    return f"concat(CASE WHEN {x} >= 0 THEN '+' ELSE '' END, {_digit(x)})"


@job("r8_forecast_summary", f"""WITH {FORECASTS}
SELECT row_id, {r4('pct')} AS change_percentage, concat('The forecast predicts Snow Water Equivalent of ', {_digit('predicted')},
  ' inches for the 30 days period, which is ', {_TREND}, ' (', {_plus('pct')}, '% from the historical average of ',
  {_digit('baseline')}, ' inches).') AS summary FROM forecasts""")
def forecast_summary(spark, sf):
    return explained(spark, sf).select(
        "row_id", fixed4("change_percentage").alias("change_percentage"), "summary")


def _report_sql(a):
    title, readers = reports.FRAMES[a]
    lines = ", '\n', ".join(
        f"CASE WHEN pct > 10 THEN {_q(f'{n}: {hi}')} WHEN pct < -10 THEN {_q(f'{n}: {lo}')} ELSE {_q(f'{n}: {mid}')} END"
        for n, hi, mid, lo in reports.LINES[a])
    lines += "".join(f", '\n', CASE WHEN pct > 0 THEN {_q(f'{n}: {hi}')} ELSE {_q(f'{n}: {lo}')} END" for n, hi, lo in reports.SIGN_LINES.get(a, ()))
    return f"""SELECT model_id, '{a}' AS audience, concat('{title} for {readers}', '\n', 'Forecast: ', {_digit('predicted')},
      ' inches, ', {_plus('pct')}, '% against the average of ', {_digit('baseline')}, ' inches', '\n',
      'Confidence: medium, risk: ', CASE {_BAND} WHEN 'high' THEN 'low' WHEN 'low' THEN 'high' ELSE 'normal' END, '\n',
      {lines}) AS report FROM means"""


@job("r9_audience_report", """WITH means AS (SELECT *, (predicted - baseline) / baseline * 100 AS pct FROM (
    SELECT model_id, max(yhat) * 0.5 AS predicted, avg(y) AS baseline FROM scored GROUP BY 1) x) """
     + " UNION ALL ".join(_report_sql(a) for a in reports.FRAMES))
def audience_report(spark, sf):
    df = view(spark, sf, "scored").groupBy("model_id").agg(
        (F.max("yhat") * 0.5).alias("predicted_value"), F.avg("y").alias("baseline_value"))
    df = R.explain(df, "predicted_value", "baseline_value")
    return reports.audience_reports(df).select("model_id", "audience", "report")


IMPORTANCE = """lagged AS (SELECT swe, temperature, precipitation, dayofyear(date) AS day_of_year,
    lag(swe, 7) OVER (PARTITION BY station_id ORDER BY date) AS swe_lag_7, CAST(month(date) AS DOUBLE) AS month_of_year
  FROM station_daily),
signed AS (SELECT 'temperature' AS feature, corr(temperature, swe) AS importance FROM lagged
  UNION ALL SELECT 'precipitation', corr(precipitation, swe) FROM lagged
  UNION ALL SELECT 'day_of_year', corr(day_of_year, swe) FROM lagged
  UNION ALL SELECT 'swe_lag_7', corr(swe_lag_7, swe) FROM lagged
  UNION ALL SELECT 'month_of_year', corr(month_of_year, swe) FROM lagged)"""


def importance(spark, sf):
    """Correlation of each feature with the target, taken as its importance."""
    df = stored(spark, sf, "station_daily").withColumns({
        "day_of_year": F.dayofyear("date"), "month_of_year": F.month("date").cast("double")})
    df = W.add_lags(df, ("swe",), (7,))
    features = ["temperature", "precipitation", "day_of_year", "swe_lag_7", "month_of_year"]
    return A.profile(df.select("swe", *features), "swe").where("column_name <> 'swe'").select(
        F.col("column_name").alias("feature"), F.col("corr_target").alias("importance"))


@job("r13_explained_forecasts", f"""WITH means AS (SELECT *, (predicted - baseline) / baseline * 100 AS pct FROM (
    SELECT model_id, max(yhat) * 0.5 AS predicted, avg(y) AS baseline FROM scored GROUP BY 1) x),
  {IMPORTANCE}, ranked AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM signed),
  top AS (SELECT string_agg(concat(feature, ' ', CASE WHEN importance > 0 THEN 'positive' ELSE 'negative' END), ', ' ORDER BY rank) AS drivers
    FROM ranked WHERE rank <= 5)
SELECT model_id, {r4('pct')} AS change_percentage, 'medium' AS confidence,
  CASE {_BAND} WHEN 'high' THEN 'low' WHEN 'low' THEN 'high' ELSE 'normal' END AS risk_level, {_TREND} AS trend, drivers FROM means, top""")
def explained_forecasts(spark, sf):
    """One row per forecast with its change, risk and the five strongest drivers."""
    df = view(spark, sf, "scored").groupBy("model_id").agg(
        (F.max("yhat") * 0.5).alias("predicted_value"), F.avg("y").alias("baseline_value"))
    done = R.with_drivers(R.explain(df, "predicted_value", "baseline_value"), importance(spark, sf))
    drivers = F.array_join(F.transform("key_drivers", lambda d: F.concat_ws(" ", d["feature"], d["direction"])), ", ")
    return done.select("model_id", fixed4("change_percentage").alias("change_percentage"), "confidence", "risk_level", "trend",
                       drivers.alias("drivers"))


@job("r11_feature_glossary", f"""WITH {IMPORTANCE}, top AS (SELECT * FROM signed ORDER BY importance DESC, feature LIMIT 4),
  known(feature, explanation, influence, implications) AS (VALUES {', '.join(
    f"({_q(f)}, {_q(a)}, {_q(b)}, {_q(c)})" for f, (a, b, c) in R.GLOSSARY.items())})
SELECT t.feature, {r4('importance')} AS importance,
  coalesce(explanation, concat(t.feature, ' is an important predictor of swe.')) AS explanation,
  coalesce(influence, concat('Higher ', t.feature, ' values tend to be associated with higher swe.')) AS influence,
  coalesce(implications, 'This feature provides valuable information for swe prediction.') AS implications
FROM top t LEFT JOIN known k ON t.feature = k.feature""")
def glossary(spark, sf):
    df = R.explain_features(importance(spark, sf), "swe", 4)
    return df.withColumn("importance", fixed4("importance"))


_MISSING = "100.0 * (count(*) - count({c})) / count(*)"


def _quality_sql(c):
    pct = f"(SELECT {_MISSING.format(c=c)} FROM gaps)"
    far = (f"(SELECT count(*) FROM gaps, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM gaps) q "
           f"WHERE abs({c} - m) > 3 * s)")
    return f"""SELECT '{c}' AS subject, concat('{c} has ', {_digit(pct)}, '% missing values') AS issue,
    CASE WHEN {pct} > 30 THEN 'high' ELSE 'medium' END AS severity, 'Impute or interpolate missing values in {c}' AS action
  WHERE {pct} > 10
  UNION ALL SELECT '{c}', concat('{c} has ', CAST({far} AS VARCHAR), ' outliers'), 'medium', 'Cap or remove outliers in {c}'
  WHERE {far} > 0"""


@job("r12_data_quality", """WITH gaps AS (SELECT date, swe, precipitation,
    CASE WHEN day(date) <= 12 THEN temperature END AS temperature FROM station_daily) """
     + " UNION ALL ".join(_quality_sql(c) for c in ("swe", "precipitation", "temperature"))
     + """ UNION ALL SELECT 'time span', concat('Dataset only covers ', CAST(span AS VARCHAR), ' years'), 'high',
    'Collect more historical data for better model training'
  FROM (SELECT CAST(floor(date_diff('day', min(date), max(date)) / 365.25) AS INT) AS span FROM gaps) s WHERE span < 5""")
def data_quality(spark, sf):
    df = stored(spark, sf, "station_daily")
    df = df.withColumn("temperature", F.when(F.dayofmonth("date") <= 12, F.col("temperature")))
    cols = ["swe", "precipitation", "temperature"]
    span = A.dataset_facts(df).first()["span_years"]
    return R.quality_findings(A.profile(df.select(*cols)), span, R.outlier_counts(df, cols))


@job("r13_driver_direction", f"""WITH {IMPORTANCE}
SELECT feature, CASE WHEN importance > 0 THEN 'positive' ELSE 'negative' END AS direction FROM signed""")
def direction(spark, sf):
    return importance(spark, sf).select("feature", R.driver_direction("importance").alias("direction"))


@job("r14_applicable_features", """WITH known AS (
    SELECT 'date' AS c FROM station_daily HAVING count(date) > 0 UNION ALL SELECT 'swe' FROM station_daily HAVING count(swe) > 0
    UNION ALL SELECT 'precipitation' FROM station_daily HAVING count(precipitation) > 0
    UNION ALL SELECT 'humidity' FROM climate_daily HAVING count(humidity) > 0)
SELECT feature, description, importance, category FROM (VALUES """ + ", ".join(
    "(" + ", ".join(_q(x.format(t="swe")) for x in f) + ")" for f in R.FEATURES)
     + """) AS f(feature, needs, description, importance, category)
WHERE needs IN (SELECT c FROM known) OR (needs = '*date' AND EXISTS (SELECT 1 FROM known WHERE c LIKE '%date%'))
   OR (needs = '*index' AND EXISTS (SELECT 1 FROM known WHERE c LIKE '%enso%' OR c LIKE '%oni%'))""")
def applicable(spark, sf):
    def known(df, cols):
        wide = df.agg(*[F.count(c).alias(f"{c}__known") for c in cols])
        return A.stack_long(wide, cols, ["known"]).where("known > 0").select("column_name")

    names = known(view(spark, sf, "station_daily"), ["date", "swe", "precipitation"]).unionByName(
        known(view(spark, sf, "climate_daily"), ["humidity"]))
    return R.applicable_features(names)
