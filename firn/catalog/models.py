"""Model jobs over the station and winter views; README lists the jobs with fewer trees than the defaults."""

import uuid
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, functions as F

from firn.catalog.aggregates import PHASE_VALUES, _pct
from firn.catalog.joins import COMPARED_SQL, REGION_VALUES, history
from firn.catalog.registry import day_text, fixed2, fixed4, job
from firn.catalog.rules import importance
from firn.catalog.views import r2, r4, stored, view
from firn.catalog.windows import _over
from firn.models import features as M
from firn.models.boosting import BoostedTrees
from firn.models.experiments import DEFAULT_EXPERIMENTS, run_experiments
from firn.models.forecast import forecast_steps
from firn.models.outlook import WinterOutlook, backtest
from firn.models.regression import Boosting, Forecaster, Forest, Linear, normalise
from firn.models.sequence import SequenceForecaster
from firn.models.trend import SeasonalTrend
from firn.models.validation import GRID, Setting, cross_validate, random_folds, ranked, time_blocks
from firn.operators import joins as J, whatif as Q
from firn.operators.aggregates import error_metrics
from firn.plans import daily as D, outlook as O
from firn.plans.requests import answer_requests
from firn.schemas import DEFAULT_SCENARIOS
from firn.session import materialize, shared_folder

OBS = "station_id, CAST(date AS VARCHAR) AS date"
SIMPLE = ["temperature", "precipitation", "swe_lag_1", "swe_prev_mean_7", "season_sin", "season_cos"]


def daily(spark, sf):
    return stored(spark, sf, "station_daily")


def training(spark, sf):
    """Observations with autoregressive features, written once for the rounds of a fit."""
    return materialize(M.autoregressive(daily(spark, sf), "swe", (1,), (7,)))


def _scaled(table, c, method):
    ends = {
        "standard": (f"avg({c})", f"stddev_pop({c})"), "minmax": (f"min({c})", f"max({c}) - min({c})"),
        "robust": (f"median({c})", f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    }[method]
    return f"({c} - (SELECT {ends[0]} FROM {table})) / (SELECT {ends[1]} FROM {table})"


@job("m1_scale", f"SELECT {OBS}, " + ", ".join(
    f"{r4(_scaled('station_daily', c, m))} AS {c}_{m}"
    for c in ("swe", "temperature") for m in ("standard", "minmax", "robust")) + " FROM station_daily")
def scale(spark, sf):
    df = daily(spark, sf)
    cols = ["swe", "temperature"]
    scalers = {m: M.fit_scaler(df, cols, m) for m in ("standard", "minmax", "robust")}
    return df.select("station_id", day_text().alias("date"), *[
        fixed4((F.col(c) - s[c][0]) / s[c][1]).alias(f"{c}_{m}") for m, s in scalers.items() for c in cols])


@job("m2_temporal_split", f"""
WITH numbered AS (SELECT *, row_number() OVER (ORDER BY date, CAST(concat('0x', substr(md5(station_id), 1, 15)) AS BIGINT)) AS n,
  count(*) OVER () AS total FROM station_daily)
SELECT {OBS}, CASE WHEN n <= CAST(floor(total * (1 - 0.2::DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM numbered""")
def temporal_split(spark, sf):
    train, test = M.temporal_split(daily(spark, sf).select("station_id", "date"))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.withColumn("date", day_text())


@job("m3_random_split", f"""
SELECT {OBS}, CASE WHEN CAST(concat('0x', substr(md5(concat(station_id, '|', CAST(date AS VARCHAR), '|42')), 1, 8)) AS BIGINT) % 10000 < 2000
  THEN 'test' ELSE 'train' END AS part FROM station_daily""")
def random_split(spark, sf):
    train, test = M.random_split(daily(spark, sf).select("station_id", "date"))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.withColumn("date", day_text())


# One input, so that every penalty has a closed form: moments of rain and snow water.
MOMENTS = """m AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(y, x) AS c, var_pop(x) AS v, count(*) AS n
  FROM (SELECT precipitation AS x, swe AS y FROM station_daily WHERE swe IS NOT NULL AND precipitation IS NOT NULL) o)"""
SLOPES = {
    "linear": "c / v", "ridge": "c / (v + 1.0 / n)", "lasso": "sign(c) * greatest(abs(c) - 1.0, 0) / v",
    "elasticnet": "sign(c) * greatest(abs(c) - 0.5, 0) / (v + 0.5)",
}


@job("m4_penalties", f"WITH {MOMENTS} " + " UNION ALL ".join(
    f"SELECT '{k}' AS model, {r4(s)} AS slope, {r4(f'my - ({s}) * mx')} AS intercept FROM m" for k, s in SLOPES.items()))
def penalties(spark, sf):
    rows = daily(spark, sf).select("swe", "precipitation").na.drop()
    out = None
    for kind in SLOPES:
        c = Forecaster(Linear(kind), ["precipitation"], "swe").fit(rows).coefficients()
        pick = lambda name: F.max(F.when(F.col("feature") == name, F.col("coefficient")))
        one = c.agg(fixed4(pick("precipitation")).alias("slope"), fixed4(pick("(intercept)")).alias("intercept"))
        one = one.withColumn("model", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@job("m4_linear_models")
def linear_models(spark, sf):
    rows = training(spark, sf)
    train, test = M.temporal_split(rows)
    out = None
    for kind in ("linear", "ridge", "lasso", "elasticnet"):
        f = Forecaster(Linear(kind), SIMPLE, "swe").fit(train)
        m = f.evaluate(test).withColumn("model", F.lit(kind))
        out = m if out is None else out.unionByName(m)
    return out


@job("m5_random_forest")
def random_forest(spark, sf):
    train, test = M.temporal_split(training(spark, sf))
    return Forecaster(Forest(trees=10, max_depth=6), SIMPLE, "swe").fit(train).evaluate(test)


@job("m6_boosting")
def boosting(spark, sf):
    rows = training(spark, sf)
    held = F.pmod(F.xxhash64("station_id", "date"), F.lit(5)) == 0
    train, test = M.temporal_split(rows.withColumn("is_validation", held))
    f = Forecaster(Boosting(rounds=10, max_depth=4, validation="is_validation"), SIMPLE, "swe")
    return f.fit(train).evaluate(test)


@job("m6_gap_split", f"""
WITH base AS (SELECT avg(swe) AS m FROM station_daily),
flags AS (SELECT station_id, date, swe, CASE WHEN precipitation > 25 THEN 1 WHEN precipitation <= 25 THEN 0 END AS f FROM station_daily),
s AS (SELECT coalesce(sum(swe - m) FILTER (f = 0), 0) AS g0, count(*) FILTER (f = 0) AS n0, coalesce(sum(swe - m) FILTER (f = 1), 0) AS g1,
    count(*) FILTER (f = 1) AS n1, coalesce(sum(swe - m) FILTER (f IS NULL), 0) AS g, count(*) FILTER (f IS NULL) AS n FROM flags, base WHERE swe IS NOT NULL),
gains AS (SELECT *, (g0 + g) ** 2 / (n0 + n + 1) + g1 ** 2 / (n1 + 1) >= g0 ** 2 / (n0 + 1) + (g1 + g) ** 2 / (n1 + n + 1) AS gap_low FROM s),
sides AS (SELECT gap_low, CASE WHEN gap_low THEN (g0 + g) / (n0 + n + 1) ELSE g0 / (n0 + 1) END AS low,
    CASE WHEN gap_low THEN g1 / (n1 + 1) ELSE (g1 + g) / (n1 + n + 1) END AS high FROM gains)
SELECT {OBS}, {r4('m + CASE WHEN f = 0 OR (f IS NULL AND gap_low) THEN low ELSE high END')} AS prediction FROM flags, base, sides""")
def gap_split(spark, sf):
    """One boosted tree on a flag: rows that do not know it go the way learned for them."""
    flag = F.when(F.col("precipitation") > 25, 1.0).when(F.col("precipitation") <= 25, 0.0)
    rows = daily(spark, sf).withColumn("flag", flag)
    model = BoostedTrees(["flag"], "swe", rounds=1, max_depth=1, learning_rate=1.0, row_share=1.0, column_share=1.0).fit(rows)
    return model.transform(rows).select("station_id", day_text().alias("date"), fixed4("prediction").alias("prediction"))


@job("m6_boosted_rows", """
SELECT count(*) AS row_count, count(*) AS predicted, true AS better_than_mean FROM station_daily""")
def boosted_rows(spark, sf):
    """Every row is answered, also those with gaps in the inputs, and better than by the mean."""
    rows = daily(spark, sf).withColumn("late", F.pmod(F.xxhash64("station_id", "date"), F.lit(5)) == 0)
    model = BoostedTrees(["precipitation", "temperature"], "swe", rounds=20, max_depth=4, validation="late").fit(rows)
    done = model.transform(rows)
    error = lambda p: F.sum(F.when(F.col("swe").isNotNull(), F.pow(F.col("swe") - p, 2)))
    return done.agg(F.count("*").alias("row_count"), F.count("prediction").alias("predicted"),
                    (error(F.col("prediction")) < error(F.lit(model.base))).alias("better_than_mean"))


@job("m7_trend_only", f"""
WITH line AS (SELECT station_id, regr_slope(swe, date_diff('day', DATE '1970-01-01', date)) AS b,
    regr_intercept(swe, date_diff('day', DATE '1970-01-01', date)) AS a FROM station_daily WHERE swe IS NOT NULL GROUP BY 1)
SELECT d.station_id, CAST(date AS VARCHAR) AS date, {r2("a + b * date_diff('day', DATE '1970-01-01', date)")} AS prediction
FROM station_daily d JOIN line l ON d.station_id = l.station_id""")
def trend_only(spark, sf):
    rows = daily(spark, sf)
    return SeasonalTrend(changepoints=0, waves=0).fit(rows).transform(rows).select(
        "station_id", day_text().alias("date"), fixed2("prediction").alias("prediction"))


@job("m7_seasonal_trend")
def seasonal_trend(spark, sf):
    rows = daily(spark, sf)
    model = SeasonalTrend(regressors=("temperature",)).fit(rows)
    return model.transform(rows).select(
        "station_id", day_text().alias("date"), "swe", "prediction", "lower", "upper")


_DAY = "date_diff('day', DATE '1970-01-01', date)"


@job("m7_components", f"""
WITH o AS (SELECT station_id, date, {_DAY}::DOUBLE AS t, temperature AS x, swe AS y FROM station_daily WHERE swe IS NOT NULL AND temperature IS NOT NULL),
lines AS (SELECT station_id, regr_slope(x, t) AS bx, regr_intercept(x, t) AS ax, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, greatest(avg(y * y), 1) AS scale FROM o GROUP BY 1),
extra AS (SELECT station_id, sum((x - ax - bx * t) * (y - a - b * t)) / (sum((x - ax - bx * t) ** 2) + 0.0001 * any_value(scale)) AS c FROM o JOIN lines USING (station_id) GROUP BY 1),
model AS (SELECT station_id, c, b - c * bx AS b, a - c * ax AS a FROM lines JOIN extra USING (station_id))
SELECT d.station_id, CAST(date AS VARCHAR) AS date, {r2(f'a + b * {_DAY}')} AS trend, {r2('c * temperature')} AS extra,
  {r2(f'a + b * {_DAY} + c * temperature')} AS prediction
FROM station_daily d JOIN model USING (station_id)""")
def trend_components(spark, sf):
    """Trend and regressor parts without waves, where the fit has a closed form."""
    rows = daily(spark, sf)
    model = SeasonalTrend(regressors=("temperature",), changepoints=0, waves=0).fit(rows)
    return model.transform(rows, components=True).select(
        "station_id", day_text().alias("date"), *[fixed2(c).alias(c) for c in ("trend", "extra", "prediction")])


@job("m7_future", """
WITH last AS (SELECT station_id, max(date) AS d FROM station_daily GROUP BY 1)
SELECT station_id, CAST(step AS INT) AS step, CAST(d + CAST(step AS INTEGER) AS VARCHAR) AS date, true AS known, true AS adds_up, true AS inside
FROM last, (SELECT unnest(range(1, 31)) AS step) s""")
def trend_future(spark, sf):
    """Thirty days ahead at full size: every value known, inside its band, and the sum of its parts."""
    rows = daily(spark, sf)
    done = SeasonalTrend().fit(rows).future(rows, 30, components=True)
    parts = F.col("trend") + F.col("season") + F.col("extra")
    return done.select(
        "station_id", "step", day_text().alias("date"), F.col("prediction").isNotNull().alias("known"),
        (F.abs(parts - F.col("prediction")) < 1e-6).alias("adds_up"), F.col("prediction").between(F.col("lower"), F.col("upper")).alias("inside"))


@job("m8_sequence_input", f"""
WITH used AS (SELECT * FROM station_daily WHERE swe IS NOT NULL AND precipitation IS NOT NULL),
scaled AS (SELECT station_id, date, {_scaled('used', 'precipitation', 'minmax')} AS p, {_scaled('used', 'swe', 'minmax')} AS s FROM used),
windows AS (SELECT station_id, date, s AS label, list(p) OVER w AS ps, list(s) OVER w AS ss FROM scaled
  WINDOW w AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT {OBS}, {r4('label')} AS label, {r4('ps[1]')} AS p1, {r4('ss[1]')} AS s1, {r4('ps[3]')} AS p3, {r4('ss[3]')} AS s3
FROM windows WHERE len(ps) = 3""")
def sequence_input(spark, sf):
    made = SequenceForecaster(["precipitation", "swe"], steps=3).prepare(daily(spark, sf))
    at = lambda i, j: fixed4(F.col("sequence")[i][j])
    return made.select("station_id", day_text().alias("date"), fixed4("label").alias("label"),
                       at(0, 0).alias("p1"), at(0, 1).alias("s1"), at(2, 0).alias("p3"), at(2, 1).alias("s3"))


@job("m8_sequence_forecast")
def sequence_forecast(spark, sf):
    rows = daily(spark, sf)
    model = SequenceForecaster(["precipitation", "swe"], settings=Linear("ridge", 0.1)).fit(rows)
    return error_metrics(model.transform(rows), "swe", "prediction")


@job("m10_sequence_steps", f"""
WITH RECURSIVE known AS (SELECT station_id, date, swe, lag(swe) OVER (PARTITION BY station_id ORDER BY date) AS before
    FROM station_daily WHERE swe IS NOT NULL),
line AS (SELECT regr_slope(swe, before) AS b, regr_intercept(swe, before) AS a FROM known),
steps AS (SELECT station_id, 0 AS step, max(date) AS last, arg_max(swe, date) AS p, count(*) AS n FROM known GROUP BY 1
  UNION ALL SELECT station_id, step + 1, last, a + b * p, n FROM steps, line WHERE step < 30)
SELECT station_id, step, CAST(last + CAST(step AS INTEGER) AS VARCHAR) AS date, {r4('p')} AS prediction FROM steps WHERE step > 0""")
def sequence_steps(spark, sf):
    """A linear model on windows of one row, where thirty rolled steps have a closed form."""
    rows = daily(spark, sf)
    model = SequenceForecaster(["swe"], steps=1, settings=Linear()).fit(rows)
    done = model.forecast(rows, 30)
    return done.select("station_id", "step", day_text().alias("date"), fixed4("prediction").alias("prediction"))


@job("m10_sequence_windows", """
SELECT station_id, CAST(step AS INT) AS step, n >= 7 AS known
FROM (SELECT station_id, count(*) AS n FROM station_daily WHERE swe IS NOT NULL AND precipitation IS NOT NULL GROUP BY 1) s,
     (SELECT unnest(range(1, 31)) AS step) t""")
def sequence_steps_ahead(spark, sf):
    """Thirty steps of week-long windows of two inputs; stations with a week of known rows have them all."""
    rows = daily(spark, sf)
    model = SequenceForecaster(["precipitation", "swe"], settings=Linear("ridge", 0.1)).fit(rows)
    done = model.forecast(rows, 30)
    return done.select("station_id", "step", F.col("prediction").isNotNull().alias("known"))


@job("m9_predict", f"""WITH {MOMENTS}
SELECT {OBS}, swe, {r4('my - c / v * mx + c / v * precipitation')} AS prediction
FROM station_daily, m""")
def predict(spark, sf):
    rows = daily(spark, sf).select("station_id", "date", "swe", "precipitation")
    f = Forecaster(Linear(), ["precipitation"], "swe").fit(rows)
    return f.transform(rows).select("station_id", day_text().alias("date"), "swe",
                                    fixed4("prediction").alias("prediction"))


@job("m10_future_steps", f"""
WITH RECURSIVE known AS (SELECT station_id, date, swe, lag(swe) OVER (PARTITION BY station_id ORDER BY date) AS before
    FROM station_daily WHERE swe IS NOT NULL),
line AS (SELECT regr_slope(swe, before) AS b, regr_intercept(swe, before) AS a FROM known),
steps AS (SELECT station_id, 0 AS step, max(date) AS last, arg_max(swe, date) AS p FROM known GROUP BY 1
  UNION ALL SELECT station_id, step + 1, last, a + b * p FROM steps, line WHERE step < 30)
SELECT station_id, step, CAST(last + CAST(step AS INTEGER) AS VARCHAR) AS date, {r4('p')} AS prediction FROM steps WHERE step > 0""")
def future_steps(spark, sf):
    rows = daily(spark, sf)
    f = Forecaster(Linear(), ["swe_lag_1"], "swe").fit(M.autoregressive(rows, "swe", (1,), ()))
    done = forecast_steps(f, rows, "swe", (1,), (), 30)
    return done.select("station_id", "step", day_text().alias("date"), fixed4("prediction").alias("prediction"))


@job("m10_tree_steps")
def tree_steps(spark, sf):
    inputs = M.autoregressive_names("swe", (1,), (7,))
    rows = daily(spark, sf)
    train = materialize(M.autoregressive(rows, "swe", (1,), (7,)))
    f = Forecaster(Forest(trees=5, max_depth=5), inputs, "swe").fit(train)
    return forecast_steps(f, rows, "swe", (1,), (7,), 12).withColumn("date", day_text())


@job("m11_importance_share", f"""
WITH lagged AS (SELECT swe, temperature, precipitation, dayofyear(date) AS day_of_year, CAST(month(date) AS DOUBLE) AS month_of_year,
    lag(swe, 7) OVER (PARTITION BY station_id ORDER BY date) AS swe_lag_7 FROM station_daily),
scores AS (SELECT 'temperature' AS feature, abs(corr(temperature, swe)) AS s FROM lagged
  UNION ALL SELECT 'precipitation', abs(corr(precipitation, swe)) FROM lagged
  UNION ALL SELECT 'day_of_year', abs(corr(day_of_year, swe)) FROM lagged
  UNION ALL SELECT 'swe_lag_7', abs(corr(swe_lag_7, swe)) FROM lagged
  UNION ALL SELECT 'month_of_year', abs(corr(month_of_year, swe)) FROM lagged)
SELECT feature, {r4('s / (SELECT sum(s) FROM scores)')} AS importance FROM scores""")
def importance_share(spark, sf):
    scores = importance(spark, sf).select("feature", F.abs("importance").alias("score"))
    return normalise(scores).withColumn("importance", fixed4("importance"))


@job("m11_model_importance")
def model_importance(spark, sf):
    return Forecaster(Forest(trees=8, max_depth=5), SIMPLE, "swe").fit(training(spark, sf)).importance()


@job("m11_split_counts", """
SELECT count(*) > 0 AS any_split, true AS equal_to_nodes, true AS sums_to_one FROM station_daily""")
def split_counts(spark, sf):
    """Importance by split counts against the model's node table."""
    model = BoostedTrees(SIMPLE, "swe", rounds=5, max_depth=4).fit(training(spark, sf))
    nodes = model.node_table(spark).where("feature IS NOT NULL")
    counted = nodes.groupBy("feature").agg(F.count("*").alias("n"))
    both = model.importance().join(counted, "feature", "full").crossJoin(nodes.agg(F.count("*").alias("total")))
    return both.agg((F.max("total") > 0).alias("any_split"), F.bool_and(F.abs(F.col("importance") - F.col("n") / F.col("total")) < 1e-12).alias("equal_to_nodes"),
                    (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"))


def small_outlook(spark, sf):
    return WinterOutlook(trees=10, max_depth=6).fit(history(spark, sf))


@job("m12_outlook_fit")
def outlook_fit(spark, sf):
    model = small_outlook(spark, sf)
    parts = [f.importance().withColumn("label", F.lit(label)) for label, f in model.chain.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@job("m13_chained_rows")
def chained_rows(spark, sf):
    return small_outlook(spark, sf).predict_rows(history(spark, sf)).select(
        "water_year", "month", "region", "temperature_anomaly", "precipitation_mm", "snowfall_cm")


def observed_scenarios(spark, sf):
    """Index sets of the observed winters, as scenarios for the one after the last."""
    h = history(spark, sf)
    sets = h.groupBy(F.col("water_year").alias("analog_year")).agg(*[
        F.max(c).alias(c) for c in ("enso", "pdo", "ao", "pna")])
    return sets.withColumn("water_year", h.agg(F.max("water_year") + 1).scalar())


@job("m14_outlook_predict")
def outlook_predict(spark, sf):
    """The next winter under the index sets of every observed one."""
    done = small_outlook(spark, sf).predict(observed_scenarios(spark, sf))
    return done.select("analog_year", "water_year", "period", "month", "region", "area_weight", "temperature_anomaly",
                       "precipitation_mm", "snowfall_cm")


@job("m14_outlook_cells", f"""
WITH sets AS (SELECT DISTINCT water_year AS analog_year, (SELECT max(water_year) + 1 FROM winter_history) AS water_year FROM winter_history)
SELECT analog_year, water_year, m AS month, region, area_weight, true AS finite, true AS not_negative
FROM sets, {REGION_VALUES}, (VALUES (11), (12), (1), (2), (3), (4)) AS months(m)""")
def outlook_cells(spark, sf):
    """All 42 cells of every scenario, each a finite number, rain and snow never below zero."""
    done = small_outlook(spark, sf).predict(observed_scenarios(spark, sf))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return done.select(
        "analog_year", "water_year", "month", "region", "area_weight",
        (finite("temperature_anomaly") & finite("precipitation_mm") & finite("snowfall_cm")).alias("finite"),
        ((F.col("precipitation_mm") >= 0) & (F.col("snowfall_cm") >= 0)).alias("not_negative"))


@job("m15_backtest")
def outlook_backtest(spark, sf):
    return backtest(history(spark, sf), 2, trees=10, max_depth=6)


@job("q8_scenario_sweep")
def scenario_sweep(spark, sf):
    done = small_outlook(spark, sf).predict(observed_scenarios(spark, sf))
    return O.summarize(done, history(spark, sf), by=("analog_year",))["statewide"].select(
        "analog_year", "temperature_anomaly_c", "precipitation_mm", "snowfall_cm", "wetness")


@job("flow_outlook", """
WITH n AS (SELECT count(DISTINCT water_year) AS sets FROM winter_history),
parts(part, per_set) AS (VALUES ('statewide', 1), ('trajectory', 6), ('season_phases', 3), ('regional_summary', 7), ('regional_monthly', 42), ('forecast', 42))
SELECT part, CAST(sets * per_set AS BIGINT) AS rows, 0::BIGINT AS rows_without_number FROM parts, n
UNION ALL SELECT 'backtest', 1, 0""")
def outlook_flow(spark, sf):
    """From history to the summary tables of every scenario set, with a backtest of two winters: rows per table."""
    tables = O.run_outlook(materialize(history(spark, sf)), observed_scenarios(spark, sf), years=2, by=("analog_year",), trees=10, max_depth=6)
    numbers = {
        "statewide": ("temperature_anomaly_c", "precipitation_mm", "snowfall_cm", "precipitation_pct_normal"),
        "trajectory": ("precipitation_mm", "snowfall_cm"), "season_phases": ("precipitation_mm", "snowfall_cm"),
        "regional_summary": ("precipitation_pct_normal", "temperature_anomaly_c"), "regional_monthly": ("precipitation_mm",),
        "forecast": ("temperature_anomaly", "precipitation_mm", "snowfall_cm"),
        "backtest": ("temperature_mae_c", "precipitation_mae_mm", "snowfall_mae_cm"),
    }
    missing = lambda cols: reduce(Column.__or__, [F.col(c).isNull() | F.isnan(c) for c in cols])
    parts = [tables[part].agg(F.count("*").alias("rows"), F.count_if(missing(cols)).alias("rows_without_number")).withColumn("part", F.lit(part))
             for part, cols in numbers.items()]
    return reduce(DataFrame.unionByName, parts).select("part", "rows", "rows_without_number")


@job("flow_daily", """
WITH n AS (SELECT count(*) AS total, count(DISTINCT station_id) AS stations FROM (SELECT DISTINCT * FROM station_daily) x)
SELECT total AS rows, CAST(floor(total * (1 - 0.2::DOUBLE)) AS BIGINT) AS train_rows, total - CAST(floor(total * (1 - 0.2::DOUBLE)) AS BIGINT) AS test_rows,
  true AS errors_known, true AS shares_sum_to_one, stations FROM n""")
def daily_flow(spark, sf):
    """From the cleaned sources to a scored model: the sizes of its parts, known errors, importances that sum to one."""
    done = D.run_daily(view(spark, sf, "station_daily"), view(spark, sf, "climate_daily"), view(spark, sf, "index_monthly"), model=Boosting(rounds=3, max_depth=3))
    counted = {f"{p}_rows": done[p].agg(F.count("*")).scalar() for p in ("train", "test")}
    unknown = F.count_if(F.col("rmse").isNull() | F.isnan("rmse") | (F.col("rmse") < 0))
    return done["features"].agg(F.count("*").alias("rows"), F.countDistinct("station_id").alias("stations")).withColumns({
        **counted, "errors_known": done["metrics"].agg(unknown == 0).scalar(),
        "shares_sum_to_one": done["importance"].agg(F.abs(F.sum("importance") - 1) < 1e-6).scalar()})


@job("flow_answer_requests", """
SELECT DISTINCT water_year AS request_id, CASE WHEN water_year % 3 = 0 THEN 'rejected' ELSE 'answered' END AS part,
  water_year % 3 <> 0 AS has_card, water_year % 3 <> 0 AS has_peak FROM winter_history""")
def request_flow(spark, sf):
    """One request per winter, some without a readable year: guard, forecast, cards and peak month."""
    h = history(spark, sf)
    year = F.when(F.col("water_year") % 3 == 0, "unknown").otherwise((F.col("water_year") + 1).cast("string"))
    requests = h.groupBy(F.col("water_year").alias("request_id"), year.alias("year")).agg(
        *[F.max(c).cast("string").alias(c) for c in ("enso", "pdo", "ao", "pna")])
    done = answer_requests(materialize(requests), small_outlook(spark, sf), h)
    texts = [F.col(c).isNotNull() for c in ("temperature", "precipitation", "snowfall", "vs_normal")]
    peaks = done["peaks"].select("request_id", (F.col("chart_max") >= 1).alias("has_peak"))
    cards = done["cards"].join(peaks, "request_id").select(
        "request_id", F.lit("answered").alias("part"), (texts[0] & texts[1] & texts[2] & texts[3]).alias("has_card"), "has_peak")
    return cards.unionByName(done["rejected"].select(
        "request_id", F.lit("rejected").alias("part"), F.lit(False).alias("has_card"), F.lit(False).alias("has_peak")))


@job("q7_model_scenarios")
def model_scenarios(spark, sf):
    rows = training(spark, sf)
    f = Forecaster(Linear("ridge"), SIMPLE, "swe").fit(rows)
    return Q.compare_scenarios(rows, DEFAULT_SCENARIOS, f).drop("parameters")




@job("m16_outlook_summary", f"""WITH {COMPARED_SQL},
state AS (SELECT water_year, sum(precipitation_mm * area_weight) AS rain, sum(snowfall_cm * area_weight) AS snow,
    sum(temperature_anomaly * area_weight) / sum(area_weight) AS temp,
    100 * sum(precipitation_mm * area_weight) / sum(precipitation_mm_normal * area_weight) AS rain_pct,
    100 * sum(snowfall_cm * area_weight) / sum(snowfall_cm_normal * area_weight) AS snow_pct FROM compared GROUP BY 1),
phases2 AS (SELECT water_year, phase_id, sum(temperature_anomaly * area_weight) / sum(area_weight) AS temp, sum(precipitation_mm * area_weight) AS rain,
    {_pct('precipitation_mm * area_weight', 'precipitation_mm_normal * area_weight')} AS rain_pct, sum(snowfall_cm * area_weight) AS snow
  FROM compared JOIN {PHASE_VALUES} ON compared.month = phases.month GROUP BY 1, 2)
SELECT water_year, 'statewide' AS grain, {r4('temp')} AS c, {r4('temp * 9 / 5')} AS f_delta, {r4('rain')} AS mm, {r4('rain / 25.4')} AS rain_in,
  {r4('snow')} AS cm, {r4('snow / 2.54')} AS snow_in, CASE WHEN rain_pct >= 110 THEN 'wet' WHEN rain_pct <= 90 THEN 'dry' ELSE 'near_normal' END AS category,
  CASE WHEN rain_pct <= 85 OR snow_pct <= 85 THEN 'High' ELSE 'Moderate' END AS water_level,
  CASE WHEN rain_pct <= 85 AND temp >= 0.5 THEN 'High' WHEN rain_pct >= 115 THEN 'Low' ELSE 'Moderate' END AS fire_level FROM state
UNION ALL SELECT water_year, phase_id, {r4('temp')}, {r4('temp * 9 / 5')}, {r4('rain')}, {r4('rain / 25.4')}, {r4('snow')}, {r4('snow / 2.54')},
  CASE WHEN rain_pct >= 110 THEN 'wet' WHEN rain_pct <= 90 THEN 'dry' ELSE 'near_normal' END, NULL, NULL FROM phases2""")
def outlook_summary(spark, sf):
    h = history(spark, sf)
    tables = O.summarize(J.as_forecast(h), h, by=("water_year",))
    state, phases = tables["statewide"], tables["season_phases"]
    extra = state.select(
        "water_year", F.lit("statewide").alias("grain"), F.col("wetness").alias("category"),
        F.col("water_allocation.level").alias("water_level"), F.col("wildfire_risk.level").alias("fire_level")
    ).unionByName(phases.select("water_year", F.col("phase_id").alias("grain"), "category"), allowMissingColumns=True)
    return tables["display"].join(extra, ["water_year", "grain"]).select(
        "water_year", "grain", fixed4("temperature.c").alias("c"), fixed4("temperature.f_delta").alias("f_delta"),
        fixed4("precipitation.mm").alias("mm"), fixed4("precipitation.in").alias("rain_in"),
        fixed4("snowfall.cm").alias("cm"), fixed4("snowfall.in").alias("snow_in"), "category",
        "water_level", "fire_level")


@job("s6_nested_outlook", f"""WITH {COMPARED_SQL}
SELECT water_year, count(DISTINCT period) AS months, count(DISTINCT CASE WHEN month IN (11, 12) THEN 1 WHEN month IN (1, 2) THEN 2 ELSE 3 END) AS phases,
  count(DISTINCT region) AS regions, count(*) AS cells,
  {r4('sum(precipitation_mm * area_weight)')} AS precipitation_mm,
  {r4("max(CASE WHEN region = 'central_sierra' THEN s END)")} AS central_sierra_snow
FROM (SELECT *, sum(snowfall_cm) OVER (PARTITION BY water_year, region) AS s FROM compared) x GROUP BY 1""")
def nested_outlook(spark, sf):
    """The nested row of every winter as JSON text and back, as a reader of the file sees it."""
    h = history(spark, sf)
    by = ("water_year",)
    row = O.nested(O.summarize(J.as_forecast(h), h, by=by), by)
    text = row.select(F.to_json(F.struct("*")).alias("outlook"))
    schema = ("water_year int, precipitation_mm double, trajectory array<struct<period:string>>, season_phases array<struct<phase_id:string>>, "
              "regional_summary array<struct<region:string,snowfall_cm:double>>, regional_monthly array<struct<region:string>>")
    doc = text.select(F.from_json("outlook", schema).alias("d"))
    size = lambda c: F.size(f"d.{c}").cast("bigint")
    sierra = F.filter("d.regional_summary", lambda r: r["region"] == "central_sierra")
    return doc.select(
        "d.water_year", size("trajectory").alias("months"), size("season_phases").alias("phases"),
        size("regional_summary").alias("regions"), size("regional_monthly").alias("cells"),
        fixed4("d.precipitation_mm").alias("precipitation_mm"),
        fixed4(F.element_at(sierra, 1)["snowfall_cm"]).alias("central_sierra_snow"))


@job("s7_save_and_load", f"""WITH {MOMENTS}
SELECT {OBS}, {r4('my - c / v * mx + c / v * precipitation')} AS before, {r4('my - c / v * mx + c / v * precipitation')} AS prediction
FROM station_daily, m""")
def save_and_load(spark, sf):
    """A saved and reloaded model predicts what the original did; returns both predictions."""
    rows = daily(spark, sf).select("station_id", "date", "swe", "precipitation")
    f = Forecaster(Linear(), ["precipitation"], "swe").fit(rows)
    folder = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    f.save(folder)
    again = Forecaster.load(spark, folder)
    first = f.transform(rows).withColumnRenamed("prediction", "before")
    return again.transform(first).select(
        "station_id", day_text().alias("date"), fixed4("before").alias("before"),
        fixed4("prediction").alias("prediction"))


@job("m17_experiments")
def experiments(spark, sf):
    s = D.FeatureSettings(lags=(7, 30), windows=(14, 30))
    rows = materialize(D.create_features(daily(spark, sf), view(spark, sf, "index_monthly"), s))
    quick = {"boosting": {"rounds": 5, "max_depth": 4}, "forest": {"trees": 5, "max_depth": 5},
             "sequence": {"steps": 3, "settings": Linear("ridge", 0.1)}}
    return run_experiments(rows, [e | {"settings": quick[e["model"]]} for e in DEFAULT_EXPERIMENTS])


FAMILY = tuple(Setting(k) for k in SLOPES)
_FOLD = "CAST(concat('0x', substr(md5(concat(station_id, '|', CAST(date AS VARCHAR), '|42')), 1, 8)) AS BIGINT) % 5"
_BLOCKS = """days AS (SELECT date, count(*) AS n FROM station_daily GROUP BY 1),
placed AS (SELECT date, CAST(floor((sum(n) OVER (ORDER BY date) - n) * 6 / (SELECT sum(n) FROM days)) AS BIGINT) AS fold FROM days)"""


def _folds_sql(rows, settings, trained):
    """Fold metrics of one input in closed form; `trained` relates rows (o) to the fold (f) they train."""
    values = ", ".join(f"('{s.name}', '{s.kind}', {s.alpha}::DOUBLE, {s.l1_ratio}::DOUBLE)" for s in settings)
    return f"""{rows}, known AS (SELECT * FROM o WHERE x IS NOT NULL AND y IS NOT NULL),
m AS (SELECT f.fold, avg(x) AS mx, avg(y) AS my, covar_pop(y, x) AS c, var_pop(x) AS v, count(*) AS n
  FROM known o JOIN (SELECT DISTINCT fold FROM known) f ON {trained} GROUP BY 1),
models AS (SELECT *, CASE kind WHEN 'linear' THEN c / v WHEN 'ridge' THEN c / (v + alpha / n)
    WHEN 'lasso' THEN sign(c) * greatest(abs(c) - alpha, 0) / v
    ELSE sign(c) * greatest(abs(c) - alpha * l1_ratio, 0) / (v + alpha * (1 - l1_ratio)) END AS b
  FROM m, (VALUES {values}) AS s(name, kind, alpha, l1_ratio)),
errors AS (SELECT name, o.fold, n, y, y - my - b * (x - mx) AS e FROM known o JOIN models ON o.fold = models.fold),
folds AS (SELECT name, CAST(fold AS INT) AS fold, n AS train_rows, count(*) AS row_count, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
  1 - avg(e * e) / var_pop(y) AS r2 FROM errors GROUP BY 1, 2, 3)"""


_SHOWN = ", ".join(f"{r4(c)} AS {c}" for c in ("rmse", "mae", "r2"))
_RANDOM = f"WITH o AS (SELECT precipitation AS x, swe AS y, {_FOLD} AS fold FROM station_daily)"
_ROLLING = f"WITH {_BLOCKS}, o AS (SELECT precipitation AS x, swe AS y, fold FROM station_daily d JOIN placed p ON d.date = p.date)"


def _shown(df, *keys):
    return df.select(*keys, *[fixed4(c).alias(c) for c in ("rmse", "mae", "r2")])


def folded(spark, sf, make, settings, **how):
    rows = materialize(make(daily(spark, sf).select("station_id", "date", "swe", "precipitation")))
    return cross_validate(rows, ["precipitation"], "swe", settings, **how)


@job("m17_fold_metrics", f"""{_folds_sql(_RANDOM, GRID, 'o.fold <> f.fold')}
SELECT name, fold, train_rows, row_count, {_SHOWN} FROM folds""")
def fold_metrics(spark, sf):
    """Every setting of the grid on each of five folds, from sums of products."""
    return _shown(folded(spark, sf, random_folds, GRID), "name", "fold", "train_rows", "row_count")


@job("m17_rolling_folds", f"""{_folds_sql(_ROLLING, FAMILY, 'o.fold < f.fold')}
SELECT name, fold, train_rows, row_count, {_SHOWN} FROM folds""")
def rolling_folds(spark, sf):
    """Each sixth of the time predicted from all time before it."""
    return _shown(folded(spark, sf, time_blocks, FAMILY, rolling=True), "name", "fold", "train_rows", "row_count")


@job("m17_settings_grid", f"""{_folds_sql(_RANDOM, GRID, 'o.fold <> f.fold')}
SELECT name, folds, row_count, {_SHOWN} FROM (
  SELECT name, count(*) AS folds, CAST(sum(row_count) AS BIGINT) AS row_count, avg(rmse) AS rmse, avg(mae) AS mae, avg(r2) AS r2
  FROM folds GROUP BY 1) t""")
def settings_grid(spark, sf):
    """The grid in one ranked table; ranks are left out, as settings of little penalty tie."""
    return _shown(ranked(folded(spark, sf, random_folds, GRID)), "name", "folds", "row_count")


_WY = "CAST(year(date) - CASE WHEN month(date) >= 10 THEN 0 ELSE 1 END AS INT)"
_LAG = "lag({c}, {k}) OVER (PARTITION BY station_id ORDER BY date) AS {c}_lag_{k}"


@job("m18_daily_features", f"""
SELECT d.station_id, CAST(d.date AS VARCHAR) AS date, CAST(year(d.date) AS INT) AS year, CAST(weekofyear(d.date) AS INT) AS week_of_year,
  {_WY.replace('date', 'd.date')} AS water_year, swe_lag_7, temperature_lag_30, {r4('m30')} AS swe_roll_mean_30, {r4('s7')} AS swe_roll_std_7,
  {r4('p90')} AS precipitation_roll_sum_90, {r4('cum')} AS precipitation_cum_wy, {r4('anomaly')} AS temperature_anomaly,
  {r4('cum')} AS precipitation_cum_oct1, {r4('sm')} AS station_mean_swe, {r4('ss')} AS station_std_swe, oni,
  CASE WHEN oni <= -0.5 THEN 'La Niña' WHEN oni <= 0.5 THEN 'Neutral' WHEN oni IS NOT NULL THEN 'El Niño' END AS enso_phase
FROM (SELECT station_id, date, {_LAG.format(c='swe', k=7)}, {_LAG.format(c='temperature', k=30)}, avg(swe) {_over(30)} AS m30,
    stddev_samp(swe) {_over(7)} AS s7, sum(precipitation) {_over(90)} AS p90,
    CASE WHEN precipitation IS NOT NULL THEN sum(precipitation) OVER (PARTITION BY station_id, {_WY} ORDER BY date ROWS UNBOUNDED PRECEDING) END AS cum,
    temperature - avg(temperature) OVER (PARTITION BY month(date)) AS anomaly, avg(swe) OVER (PARTITION BY station_id) AS sm,
    stddev_samp(swe) OVER (PARTITION BY station_id) AS ss FROM station_daily) d
LEFT JOIN index_monthly i ON last_day(d.date) = i.date""")
def daily_features(spark, sf):
    df = D.create_features(daily(spark, sf), view(spark, sf, "index_monthly").select("date", "oni"))
    rounded = ["swe_roll_mean_30", "swe_roll_std_7", "precipitation_roll_sum_90", "precipitation_cum_wy", "precipitation_cum_oct1",
               "temperature_anomaly", "station_mean_swe", "station_std_swe"]
    return df.select(
        "station_id", day_text().alias("date"), "year", "week_of_year", "water_year", "swe_lag_7",
        "temperature_lag_30", *[fixed4(c).alias(c) for c in rounded], "oni", "enso_phase")


@job("m18_training_statistics", f"""
WITH numbered AS (SELECT *, row_number() OVER (ORDER BY date, CAST(concat('0x', substr(md5(station_id), 1, 15)) AS BIGINT)) AS n,
  count(*) OVER () AS total FROM station_daily),
parts AS (SELECT *, n <= CAST(floor(total * (1 - 0.2::DOUBLE)) AS BIGINT) AS trains FROM numbered),
levels AS (SELECT station_id, avg(swe) AS sm, stddev_samp(swe) AS ss FROM parts WHERE trains GROUP BY 1),
months AS (SELECT month(date) AS m, avg(temperature) AS normal FROM parts WHERE trains GROUP BY 1)
SELECT p.station_id, CAST(date AS VARCHAR) AS date, CASE WHEN trains THEN 'train' ELSE 'test' END AS part, {r4('sm')} AS station_mean_swe,
  {r4('ss')} AS station_std_swe, {r4('temperature - normal')} AS temperature_anomaly
FROM parts p LEFT JOIN levels l ON p.station_id = l.station_id LEFT JOIN months ON month(p.date) = m""")
def training_statistics(spark, sf):
    """Station and month statistics of the training rows, on training and test rows."""
    rows = materialize(daily(spark, sf).withColumn("month", F.month("date")))
    train, test, _ = D.split_and_scale(rows, method="none", settings=D.FeatureSettings())
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select("station_id", day_text().alias("date"), "part", *[
        fixed4(c).alias(c) for c in ("station_mean_swe", "station_std_swe", "temperature_anomaly")])


@job("m18_station_encoding", """
SELECT station_id, CAST(date AS VARCHAR) AS date, dense_rank() OVER (ORDER BY station_id) AS slot, 1.0::DOUBLE AS total,
  (SELECT count(DISTINCT station_id) FROM station_daily) AS width FROM station_daily""")
def station_encoding(spark, sf):
    """The station as a sparse 0/1 vector: one slot per station, in sorted order."""
    rows = daily(spark, sf).select("station_id", "date")
    done = Pipeline(stages=M.sparse_one_hot(["station_id"])).fit(rows).transform(rows)
    # The stored entries alone: as an array every row would be as wide as there are stations.
    hot = done.withColumn("hot", F.unwrap_udt("station_id__vector"))
    return hot.select(
        "station_id", day_text().alias("date"), F.coalesce(F.get("hot.indices", F.array_position("hot.values", 1.0) - 1) + 1, F.lit(0)).cast("bigint").alias("slot"),
        F.aggregate("hot.values", F.lit(0.0), lambda a, b: a + b).alias("total"), F.col("hot.size").cast("bigint").alias("width"))
