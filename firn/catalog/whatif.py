"""What-if jobs over the station and scored views."""

from pyspark.sql import functions as F

from firn import schemas as K
from firn.catalog.registry import day_text, fixed4, job
from firn.catalog.views import r4, view
from firn.functions import rules as R, scalars as N
from firn.operators import whatif as Q
from firn.operators.joins import fan_out, join_index_month

SCENARIOS = K.DEFAULT_SCENARIOS


def _param(s, key, default):
    return s[2].get(key, default)


SCENARIO_VALUES = "(VALUES " + ", ".join(
    f"('{s[0]}', {_param(s, 'temperature_adjustment', 0.0)}::DOUBLE, {_param(s, 'precipitation_multiplier', 1.0)}::DOUBLE, "
    f"{_param(s, 'snow_line_elevation', 0.0)}::DOUBLE, {s[2].get('oni', 'NULL')}::DOUBLE, "
    + (f"'{s[3]}'" if s[3] else "NULL") + ")" for s in SCENARIOS
) + ") AS s(scenario, dt, pm, sl, set_oni, set_phase)"

_SWE = "CASE WHEN sl > 0 THEN swe * greatest(0.5, 1 - sl / 10000) ELSE swe END"
_PHASE = "CASE WHEN oni <= -0.5 THEN 'La Niña' WHEN oni <= 0.5 THEN 'Neutral' WHEN oni IS NOT NULL THEN 'El Niño' END"

INDEXED = f"""indexed AS (SELECT station_id, d.date, swe, precipitation, temperature, oni, {_PHASE} AS enso_phase
  FROM station_daily d LEFT JOIN index_monthly i ON last_day(d.date) = i.date)"""
MOVED = f"""{INDEXED}, moved AS (SELECT scenario, station_id, date, swe, precipitation, temperature, oni, enso_phase,
    {_SWE} AS swe_new, precipitation * pm AS precipitation_new, temperature + dt AS temperature_new,
    coalesce(set_oni, oni) AS oni_new, coalesce(set_phase, enso_phase) AS enso_phase_new
  FROM indexed, {SCENARIO_VALUES})"""


def indexed(spark, sf):
    df = join_index_month(view(spark, sf, "station_daily"),
                          view(spark, sf, "index_monthly").select("date", "oni"))
    return df.withColumn("enso_phase", N.index_phase())


@job("q1_apply_scenario", f"""WITH {MOVED}
SELECT scenario, station_id, CAST(date AS VARCHAR) AS date, {r4('swe_new')} AS swe, {r4('precipitation_new')} AS precipitation,
       {r4('temperature_new')} AS temperature, {r4('oni_new')} AS oni, enso_phase_new AS enso_phase FROM moved""")
def apply_scenario(spark, sf):
    df = Q.apply_scenarios(indexed(spark, sf), SCENARIOS)
    return df.select(
        F.col("scenario.name").alias("scenario"), "station_id", day_text().alias("date"),
        *[fixed4(c).alias(c) for c in ("swe", "precipitation", "temperature", "oni")], "enso_phase")


@job("q3_mean_predictor", f"""
SELECT station_id, CAST(date AS VARCHAR) AS date, {r4('(SELECT avg(swe) FROM station_daily)')} AS prediction FROM station_daily""")
def mean_predictor(spark, sf):
    df = Q.mean_predictor(view(spark, sf, "station_daily"))
    return df.select("station_id", day_text().alias("date"), fixed4("prediction").alias("prediction"))


@job("q4_impact", "SELECT model_id, " + ", ".join(f"{r4(e)} AS {n}" for n, e in {
    "mean_original": "avg(y)", "mean_scenario": "avg(yhat)", "absolute_change": "avg(yhat) - avg(y)",
    "percentage_change": "(avg(yhat) - avg(y)) / avg(y) * 100", "min_original": "min(y)", "min_scenario": "min(yhat)",
    "max_original": "max(y)", "max_scenario": "max(yhat)", "std_original": "stddev_pop(y)",
    "std_scenario": "stddev_pop(yhat)"}.items()) + " FROM scored GROUP BY 1")
def impact(spark, sf):
    df = Q.impact(view(spark, sf, "scored"), "y", "yhat", "model_id")
    return df.select("model_id", *[fixed4(c).alias(c) for c in df.columns if c != "model_id"])


@job("q5_comparison", f"""
SELECT model_id, {r4('sqrt(avg((yhat - y) * (yhat - y)))')} AS rmse, {r4('avg(abs(yhat - y))')} AS mae,
       {r4('1 - sum((yhat - y) * (yhat - y)) / (var_pop(y) * count(*))')} AS r_squared FROM scored GROUP BY 1""")
def comparison(spark, sf):
    df = Q.comparison(view(spark, sf, "scored"), "y", "yhat", "model_id")
    return df.select("model_id", *[fixed4(c).alias(c) for c in df.columns if c != "model_id"])


@job("q6_change_log", f"WITH {MOVED}, logged AS (" + " UNION ALL ".join(
    f"SELECT scenario, '{c}' AS column_name, avg({c}) AS before, avg({c}_new) AS after FROM moved GROUP BY 1"
    for c in ("swe", "precipitation", "temperature", "oni"))
    + f") SELECT scenario, column_name, {r4('before')} AS before, {r4('after')} AS after FROM logged WHERE abs(before - after) > 1e-9")
def change_log(spark, sf):
    df = Q.change_log(fan_out(indexed(spark, sf), SCENARIOS))
    return df.select("scenario", "column_name", fixed4("before").alias("before"), fixed4("after").alias("after"))


@job("q6_text_change_log", f"""WITH {INDEXED}, before AS (SELECT DISTINCT enso_phase AS v FROM indexed),
  pairs AS (SELECT scenario, set_phase FROM {SCENARIO_VALUES})
SELECT scenario, 'enso_phase' AS column_name, v AS value, 'removed' AS change FROM before, pairs
WHERE set_phase IS NOT NULL AND v IS DISTINCT FROM set_phase""")
def text_change_log(spark, sf):
    return Q.text_change_log(indexed(spark, sf), SCENARIOS)


@job("q6_full_change_log", f"""WITH {MOVED}, labelled AS (
    SELECT scenario, 'enso_phase' AS column_name, enso_phase AS old, enso_phase_new AS new FROM moved
    UNION ALL SELECT scenario, 'station_id', station_id, station_id FROM moved),
sides AS (SELECT DISTINCT scenario, column_name, old AS v, true AS is_old FROM labelled
    UNION ALL SELECT DISTINCT scenario, column_name, new, false FROM labelled),
differ AS (SELECT scenario, column_name, v, bool_or(is_old) AS gone FROM sides GROUP BY 1, 2, 3 HAVING bool_or(is_old) <> bool_or(NOT is_old)),
numbers AS (""" + " UNION ALL ".join(
    f"SELECT scenario, '{c}' AS column_name, avg({c}) AS before, avg({c}_new) AS after FROM moved GROUP BY 1"
    for c in ("swe", "precipitation", "temperature", "oni")) + f""")
SELECT scenario, column_name, 'number' AS kind, {r4('before')} AS before, {r4('after')} AS after,
  NULL AS before_values, NULL AS after_values FROM numbers WHERE abs(before - after) > 1e-9
UNION ALL SELECT scenario, column_name, 'text', NULL, NULL,
  coalesce(string_agg(coalesce(v, '(unknown)'), '|' ORDER BY coalesce(v, '(unknown)')) FILTER (gone), ''),
  coalesce(string_agg(coalesce(v, '(unknown)'), '|' ORDER BY coalesce(v, '(unknown)')) FILTER (NOT gone), '') FROM differ GROUP BY 1, 2""")
def full_change_log(spark, sf):
    """Numeric and text changes of every column and scenario in one table."""
    df = Q.full_change_log(indexed(spark, sf), SCENARIOS)
    return df.select(
        "scenario", "column_name", "kind", fixed4("before").alias("before"), fixed4("after").alias("after"),
        *[F.array_join(f"{s}_values", "|").alias(f"{s}_values") for s in ("before", "after")])


_RUN = f"""WITH {MOVED},
o AS (SELECT avg(swe) AS p FROM station_daily),
n AS (SELECT scenario, avg(swe_new) AS p FROM moved GROUP BY 1)"""


@job("q7_compare_scenarios", f"""{_RUN}
SELECT scenario, {r4('o.p')} AS mean_original, {r4('n.p')} AS mean_scenario, {r4('(n.p - o.p) / o.p * 100')} AS percentage_change,
       {r4('abs(n.p - o.p)')} AS rmse, 0.0::DOUBLE AS r_squared FROM n, o""")
def compare_scenarios(spark, sf):
    df = Q.compare_scenarios(view(spark, sf, "station_daily"), SCENARIOS)
    return df.select("scenario", "r_squared", *[fixed4(c).alias(c) for c in (
        "mean_original", "mean_scenario", "percentage_change", "rmse")])


@job("r10_scenario_effect", """
WITH e AS (SELECT model_id, (avg(yhat) - avg(y)) / avg(y) * 100 * 400 AS p FROM scored GROUP BY 1)
SELECT model_id, CASE WHEN p > 10 THEN 'significantly increases' WHEN p > 0 THEN 'increases'
    WHEN p < -10 THEN 'significantly decreases' WHEN p < 0 THEN 'decreases' ELSE 'has little effect on' END AS direction,
  CASE WHEN p > 10 THEN 'substantial increase' WHEN p > 0 THEN 'moderate increase'
    WHEN p < -10 THEN 'substantial decrease' WHEN p < 0 THEN 'moderate decrease' ELSE 'minimal change in' END AS magnitude
FROM e""")
def scenario_effect(spark, sf):
    df = Q.impact(view(spark, sf, "scored"), "y", "yhat", "model_id")
    effect = R.scenario_effect(F.col("percentage_change") * 400)
    return df.withColumn("e", effect).select("model_id", "e.direction", "e.magnitude")
