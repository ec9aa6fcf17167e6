import pytest
from pyspark.sql import functions as F
from rowcheck import same_rows

from firn import schemas as K
from firn.operators import whatif as Q
from firn.operators.joins import fan_out


def base(spark):
    rows = [("a", 10.0, 5.0, -2.0, 6.0, 0.1, 0.2, 1000.0, "Neutral"), ("b", 20.0, None, 4.0, 8.0, -0.3, None, 2000.0, None)]
    return spark.createDataFrame(
        rows, "id string, swe double, precipitation double, temperature double, temperature_lag_1 double, oni double, "
              "nino34 double, snow_line double, enso_phase string")


def run(spark, numbers, phase=None, df=None):
    df = base(spark) if df is None else df
    return Q.apply_scenario(fan_out(df, [("s", "", numbers, phase, "custom")])).orderBy("id").collect()


def test_shift_and_multiplier_reach_all_named_columns(spark):
    a, b = run(spark, {"temperature_adjustment": 1.5, "precipitation_multiplier": 2.0})
    assert (a.temperature, a.temperature_lag_1, a.precipitation, a.swe) == (-0.5, 7.5, 10.0, 10.0)
    assert b.precipitation is None


def test_direct_values(spark):
    a, _ = run(spark, {"temperature": 3.0, "swe": 7.0})
    assert (a.temperature, a.swe) == (1.0, 7.0)


def test_index_and_phase(spark):
    a, b = run(spark, {"oni": 2.0}, "El Niño")
    assert (a.oni, a.nino34, a.enso_phase, b.enso_phase) == (2.0, 0.2, "El Niño", "El Niño")
    a, b = run(spark, {"oni": 2.0}, df=base(spark).drop("oni"))
    assert (a.nino34, b.nino34) == (1.6, 1.6)


def test_snow_line(spark):
    up, _ = run(spark, {"snow_line_elevation": 100.0})
    down, _ = run(spark, {"snow_line_elevation": -100.0})
    far, _ = run(spark, {"snow_line_elevation": 9000.0})
    assert abs(up.swe - 9.9) < 1e-12 and up.snow_line == 1100.0
    assert down.swe == 10.0 and down.snow_line == 900.0 and far.swe == 5.0


def test_catalogue(spark):
    rows = K.default_scenarios(spark).collect()
    assert len(rows) == 6 and {r.category for r in rows} == {"enso", "climate", "weather"}


def test_impact_without_spread_or_mean(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 3.0)], "o double, s double")
    i, c = Q.impact(df, "o", "s").first(), Q.comparison(df, "o", "s").first()
    assert i.percentage_change == 0.0 and i.absolute_change == 2.0 and i.std_scenario == 1.0
    assert c.r_squared == 0.0 and abs(c.rmse - 5 ** 0.5) < 1e-12 and c.mae == 2.0


def test_compare_without_target(spark):
    df = base(spark).drop("swe")
    got = Q.compare_scenarios(df, K.DEFAULT_SCENARIOS).collect()
    assert len(got) == 6 and all(r.mean_original == r.mean_scenario == 0.0 for r in got)


def test_compare_with_model_names_the_effect(spark):
    class Model:
        def transform(self, df):
            return df.withColumn("prediction", F.col("swe") - F.col("temperature"))

    got = {r.scenario: r for r in Q.compare_scenarios(base(spark), K.DEFAULT_SCENARIOS, Model()).collect()}
    assert got["Cold Winter"].absolute_change == pytest.approx(2.0)
    assert "significantly increases" in got["Cold Winter"].summary and "+14.3%" in got["Cold Winter"].summary
    assert got["Wet Winter"].percentage_change == 0.0 and "has little effect on" in got["Wet Winter"].summary


def test_change_log(spark):
    got = {(r.scenario, r.column_name) for r in Q.change_log(fan_out(base(spark), K.DEFAULT_SCENARIOS)).collect()}
    assert ("Wet Winter", "precipitation") in got and ("Wet Winter", "temperature") not in got
    assert ("Warm Winter", "swe") in got and ("Cold Winter", "swe") not in got
    texts = Q.text_change_log(base(spark), K.DEFAULT_SCENARIOS).collect()
    assert {(r.scenario, r.value, r.change) for r in texts} == {
        (s, v, c) for s, p in (("Strong El Niño", "El Niño"), ("Strong La Niña", "La Niña"))
        for v, c in (("Neutral", "removed"), (None, "removed"), (p, "added"))}


def test_text_changes_of_every_column(spark):
    df = base(spark).withColumn("wind.dir", F.lit("N"))
    got = Q.text_change_log(df, K.DEFAULT_SCENARIOS).collect()
    assert {r.column_name for r in got} == {"enso_phase"} and len(got) == 6
    same = df.withColumn("enso_phase", F.lit("El Niño"))
    left = Q.text_change_log(same, K.DEFAULT_SCENARIOS).collect()
    assert {(r.scenario, r.value, r.change) for r in left} == {
        ("Strong La Niña", "El Niño", "removed"), ("Strong La Niña", "La Niña", "added")}
    assert Q.text_change_log(df.where("false"), K.DEFAULT_SCENARIOS).count() == 0
    assert Q.text_change_log(df.select("swe"), K.DEFAULT_SCENARIOS).count() == 0
    assert Q.text_change_log(df, K.DEFAULT_SCENARIOS, "wind.dir").count() == 0


def test_full_change_log(spark):
    got = {(r.scenario, r.column_name): r for r in Q.full_change_log(base(spark), K.DEFAULT_SCENARIOS).collect()}
    r = got["Strong El Niño", "enso_phase"]
    assert (r.kind, r.before, r.before_values, r.after_values) == ("text", None, ["(unknown)", "Neutral"], ["El Niño"])
    r = got["Wet Winter", "precipitation"]
    assert (r.kind, r.before, r.after, r.before_values) == ("number", 5.0, 7.5, None)
    assert ("Wet Winter", "enso_phase") not in got and ("Wet Winter", "id") not in got


def test_text_changes_read_the_rows_once(spark):
    plan = Q.text_change_log(base(spark), K.DEFAULT_SCENARIOS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_untouched_columns_keep_their_type(spark):
    df = base(spark).withColumn("elevation_m", F.lit(2**60 + 1)).withColumn("oni_rank", F.lit(3))
    got = Q.apply_scenarios(df, K.DEFAULT_SCENARIOS)
    old = Q.apply_scenario(fan_out(df, K.DEFAULT_SCENARIOS))
    assert dict(got.dtypes)["elevation_m"] == "bigint" and dict(got.dtypes)["oni_rank"] == "int"
    assert {r.elevation_m for r in got.select("elevation_m").distinct().collect()} == {2**60 + 1}
    keep = [c for c in df.columns if c not in ("elevation_m", "oni_rank")]
    same_rows(got.select("scenario.name", *keep), old.select("scenario.name", *keep))


def test_means_stand_for_all_rows(spark):
    df = base(spark)
    got = Q.compare_scenarios(df, K.DEFAULT_SCENARIOS)
    rows = Q.scenario_predictions(df, K.DEFAULT_SCENARIOS)
    measures = Q.impact_columns("original_prediction", "prediction") | Q.comparison_columns("original_prediction", "prediction")
    want = rows.groupBy(F.col("scenario.name").alias("scenario")).agg(*[c.alias(n) for n, c in measures.items()])
    same_rows(got.select(*want.columns), want)
    assert {r.percentage_change == 0.0 for r in got.where("scenario = 'Warm Winter'").collect()} == {False}
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("LogicalRDD") + text.count("Generate explode") <= 3
