import pytest
from pyspark.sql import functions as F

from firn.functions import reports, rules as R, scalars as N, texts as X


def values(spark, schema, rows, col):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"__i int, {schema}")
    return [r[0] for r in df.orderBy("__i").select(col).collect()]


def test_wetness_edges(spark):
    got = values(spark, "p double", [(110.0,), (109.99,), (90.01,), (90.0,), (None,)], R.wetness("p"))
    assert got == ["wet", "near_normal", "near_normal", "dry", None]


def test_risk_edges(spark):
    rows = [(85.0, 100.0), (100.0, 85.0), (115.0, 100.0), (100.0, 100.0)]
    got = values(spark, "r double, s double", rows, R.water_risk("r", "s"))
    assert [g.level for g in got] == ["High", "High", "Moderate", "Moderate"]
    assert got[2].summary == R.WATER_MESSAGES["ample"] and got[3].summary == R.WATER_MESSAGES["normal"]
    fire = values(spark, "r double, t double", [(85.0, 0.5), (85.0, 0.4), (115.0, 2.0), (100.0, 2.0)],
                  R.wildfire_risk("r", "t"))
    assert [g.level for g in fire] == ["High", "Moderate", "Low", "Moderate"]


def test_hazard_order_and_limit(spark):
    rows = [("southern_california", 120.0, 80.0, 1.0), ("central_sierra", 100.0, 100.0, 0.0),
            ("southern_california", 112.0, 100.0, -0.8), ("north_coast", 110.0, 100.0, 0.0)]
    got = values(spark, "g string, r double, s double, t double", rows, R.regional_hazards("g", "r", "s", "t"))
    h = R.HAZARDS
    expect = lambda *names: "; ".join(h[n] for n in names).capitalize() + "."
    assert got == [expect("flood", "snowpack", "melt"), expect("none"), expect("frost", "urban"),
                   expect("landslide")]


def test_phase_bin_edges(spark):
    got = values(spark, "oni double", [(-0.5,), (-0.49,), (0.5,), (0.51,), (None,)], N.index_phase())
    assert got == ["La Niña", "Neutral", "Neutral", "El Niño", None]


def test_change_bands(spark):
    rows = [(11.0, 10.0), (11.1, 10.0), (10.0, 10.0), (9.5, 10.0), (8.9, 10.0), (5.0, 0.0), (5.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p double, b double")
    got = R.explain(df, "p", "b").orderBy("i").collect()
    assert [g.trend for g in got] == ["above average", "significantly above average", "near average",
                                      "below average", "significantly below average", "near average", "near average"]
    assert [g.risk_level for g in got] == ["normal", "low", "normal", "normal", "high", "normal", "normal"]
    assert [g.stakeholder_impact is None for g in got] == [False, False, True, False, False, True, True]
    assert [len(g.recommendations or []) for g in got] == [3, 4, 0, 3, 4, 0, 0]
    assert got[1].summary == ("The forecast predicts Snow Water Equivalent of 11.1 inches for the 30 days period, which is "
                              "significantly above average (+11.0% from the historical average of 10.0 inches).")
    assert got[6].summary == "The forecast predicts Snow Water Equivalent of 5.0 inches for the 30 days period."
    assert got[5].change_percentage is None


def test_reports_fall_back_to_the_water_audience(spark):
    df = R.explain(spark.createDataFrame([(12.0, 10.0)], "predicted_value double, baseline_value double"),
                   "predicted_value", "baseline_value")
    known = reports.audience_reports(df, ("water_managers", "mayors", "ski_resorts")).collect()
    assert known[0].report == known[1].report != known[2].report
    assert "+20.0%" in known[0].report
    assert "Drought: standard monitoring" in known[0].report and "Snowpack year: above average" in known[0].report
    assert all(len(r.report.split("\n")) >= 12 for r in known)


def test_drivers_of_every_forecast(spark):
    df = spark.createDataFrame([("a", 12.0, 10.0), ("b", 9.0, 10.0), ("c", 1.0, 1.0)], "model string, p double, b double")
    imp = spark.createDataFrame([("a", "x", 0.5), ("a", "z", 0.5), ("a", "y", -0.1), ("b", "y", 2.0)], "model string, feature string, importance double")
    got = {r.model: [(d.feature, d.direction) for d in r.key_drivers] for r in R.with_drivers(R.explain(df, "p", "b"), imp, 2, ("model",)).collect()}
    assert got == {"a": [("x", "positive"), ("z", "positive")], "b": [("y", "positive")], "c": []}


def test_text_formats(spark):
    rows = [(0.25,), (-0.04,), (0.0,), (12.345,), (None,)]
    assert values(spark, "x double", rows, N.fixed_text("x", 1, True)) == ["+0.3", "-0.0", "0.0", "+12.3", None]
    assert values(spark, "x double", [(1.0,), (-2.5,)], N.anomaly_text("x", "imperial")) == ["+1.8 F", "-4.5 F"]
    assert values(spark, "x double", [(25.4,), (2.5,)], N.amount_text("x", "imperial")) == ["1.0", "0.1"]
    assert values(spark, "x double", [(99.4,), (100.4,), (80.0,)], N.vs_normal_text("x")) == [
        "-1% vs normal", "+0% vs normal", "-20% vs normal"]
    with pytest.raises(ValueError):
        N.anomaly_text("x", "kelvin")


def test_scenario_text(spark):
    texts = ["El Niño with 2°C warmer temperatures and 15% more precipitation", "LA NIÑA", "3 F colder",
             "20% decrease rain", "warm and dry", "nothing", "12.5°c warmer"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = X.parse_scenarios(df).orderBy("i").collect()
    assert [g.category for g in got] == ["weather", "enso", "climate", "weather", "weather", "custom", "climate"]
    assert got[0].name == "El Niño 2.0°C warmer 15% more precipitation"
    assert got[0].parameters["oni"] == 1.5 and abs(got[0].parameters["precipitation_multiplier"] - 1.15) < 1e-12
    assert got[1].phase == "La Niña" and got[1].parameters == {"oni": -1.5}
    assert got[2].parameters == {"temperature_adjustment": -3.0}
    assert abs(got[3].parameters["precipitation_multiplier"] - 0.8) < 1e-12
    assert got[4].parameters == {"temperature_adjustment": 1.0, "precipitation_multiplier": 0.8}
    assert got[5].name == "Custom Scenario" and got[5].parameters == {}
    assert got[6].name == "12.5°F warmer"


def test_json_and_pairs(spark):
    rows = [('x {"a": 1, "b": "t"} y',), ("a=1, b = two , c, a=3",), ("{broken",), ("plain",)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string")
    found = [r[0] for r in df.orderBy("i").select(X.outer_json("text")).collect()]
    assert found == ['{"a": 1, "b": "t"}', None, None, None]
    maps = [r[0] for r in df.orderBy("i").select(X.parameters_of(F.coalesce(X.outer_json("text"), "text"))).collect()]
    assert maps == [{"a": "1", "b": "t"}, {"a": "3", "b": "two"}, {}, {}]


def test_labelled_text(spark):
    text = ("Intro\nSUMMARY: first: part\n  Drivers:\nlag|0.5|positive|recent\nx|bad|up\nConfidence: HIGH\nshort|1\n"
            "RISK: Low\nRecommendations:\n do this \n\n: skip\nDrivers:\nlate|1.5.2|down|d|e\nSki Resorts: ok")
    got = X.parse_explanations(spark.createDataFrame([(text,), ("nothing here",)], "text string")).collect()
    assert (got[0].summary, got[0].confidence, got[0].risk, got[0].ski_resorts) == ("first: part", "high", "low", "ok")
    assert [(d.feature, d.importance, d.direction, d.description) for d in got[0].drivers] == [
        ("lag", 0.5, "positive", "recent"), ("x", 0.0, "up", ""), ("late", 0.0, "down", "d")]
    assert got[0].recommendations == ["do this"]
    assert (got[1].confidence, got[1].risk, got[1].drivers) == ("medium", "normal", [])


def test_numbered_sections(spark):
    df = spark.createDataFrame([("pre EXPERIMENT one EXPERIMENT two",), ("none",)], "text string")
    got = X.split_sections(df, "EXPERIMENT").orderBy("part").collect()
    assert [(g.part, g.part_text) for g in got] == [(1, "one"), (2, "two")]


def test_suggestion_records(spark):
    text = ("Intro\nFeature: lag_7\nDescription: a: b\nImportance: HIGH\nFEATURE: roll\nImportance: Low\n"
            "Model: forest\nParameters: trees = 5, depth=3\nModel: gbt\nParameters: {\"rounds\": 7}")
    df = spark.createDataFrame([(text,), ("none",)], "text string")
    got = X.labelled_records(df, *X.FEATURE_RECORDS, lower=("Importance",)).orderBy("part").collect()
    assert [(g.part, g.feature, g.description, g.importance) for g in got] == [
        (1, "lag_7", "a: b", "high"), (2, "roll", None, "low")]
    models = X.labelled_records(df, *X.MODEL_RECORDS).withColumn("parameters", X.parameters_of("parameters"))
    assert [(m.model, m.parameters) for m in models.orderBy("part").collect()] == [
        ("forest", {"trees": "5", "depth": "3"}), ("gbt", {"rounds": "7"})]
    quality = "Issue: 1\nSeverity: high\nDescription: gaps\nSuggestion: 1\nAction: fill\nIssue: 2\nSeverity: low"
    rows = X.labelled_records(spark.createDataFrame([(quality,)], "text string"), *X.QUALITY_RECORDS)
    assert [(r.record, r.severity, r.action) for r in rows.orderBy("part").collect()] == [
        ("Issue", "high", None), ("Suggestion", None, "fill"), ("Issue", "low", None)]
