"""The outlook end to end on a generated, seeded history whose signal is known."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from firn import schemas as K
from firn.functions.scalars import period_label
from firn.models.outlook import WinterOutlook, backtest
from firn.operators.aggregates import last_years, recency_normal
from firn.plans import outlook as O
from firn.plans.requests import answer_requests, check_documents
from firn.sources import sinks


def made_history(spark, first=1981, last=2022, seed=7):
    """Slow index waves drive temperature; rain follows region and month, snow the cold."""
    rng = np.random.default_rng(seed)
    share = dict(zip(K.WINTER_MONTHS, (0.6, 1.1, 1.3, 1.1, 0.9, 0.5)))
    rows = []
    for year in range(first, last + 1):
        enso = float(np.clip(1.2 * np.sin(year * 1.4) + rng.normal(0, 0.2), -2.5, 2.5))
        pdo = float(np.sin(year * 0.5) + rng.normal(0, 0.2))
        ao, pna = (float(v) for v in rng.normal(0, 0.7, 2))
        temp = 0.4 * enso + 0.01 * (year - first) + float(rng.normal(0, 0.2))
        for name, latitude, elevation, _, _ in K.REGIONS:
            for month in K.WINTER_MONTHS:
                wet = (40 + 6 * (latitude - 33)) * share[month] * (1 + 0.1 * enso + 0.05 * pdo)
                rain = float(max(1.0, wet * rng.lognormal(0, 0.1)))
                snow = float(max(0.0, rain * np.clip(elevation / 2600 - 0.08 * temp, 0.02, 0.95) + rng.normal(0, 2)))
                rows.append((year, month, name, enso, pdo, ao, pna, temp, rain, snow))
    return spark.createDataFrame(rows, K.HISTORY_SCHEMA)


def scenario(spark, *sets, year=2023):
    rows = [(i, year, *map(float, s)) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, "sid int, water_year int, enso double, pdo double, ao double, pna double")


@pytest.fixture(scope="module")
def hist(spark):
    return made_history(spark).cache()


@pytest.fixture(scope="module")
def model(hist):
    return WinterOutlook(trees=20, seed=7, max_depth=10).fit(hist)


def test_full_outlook(spark, hist, model, tmp_path):
    forecast = model.predict(scenario(spark, (1.2, 0.5, 0, 0)).drop("sid"))
    rows = forecast.collect()
    assert len(rows) == 42
    assert {r.region for r in rows} == {r[0] for r in K.REGIONS}
    assert {r.month for r in rows} == set(K.WINTER_MONTHS)
    assert all(np.isfinite([r.temperature_anomaly, r.precipitation_mm, r.snowfall_cm]).all() for r in rows)
    assert all(r.precipitation_mm >= 0 and r.snowfall_cm >= 0 for r in rows)
    assert {r.period for r in rows} == {"2022-11", "2022-12", "2023-01", "2023-02", "2023-03", "2023-04"}

    tables = O.summarize(forecast, hist, half_life=6.0)
    state = tables["statewide"].first()
    assert tables["trajectory"].count() == 6
    assert {r.phase_id for r in tables["season_phases"].collect()} == {"early", "mid", "late"}
    regional = tables["regional_summary"].collect()
    assert len(regional) == 7 and all(r.risks.endswith(".") for r in regional)
    shown = tables["display"].where("grain = 'statewide'").first()
    assert shown.temperature.c == state.temperature_anomaly_c
    assert state.wetness in ("dry", "near_normal", "wet") and state.recency_half_life_years == 6.0

    sinks.write_json(O.nested(tables), str(tmp_path / "json"))
    sinks.write_tidy({"trajectory": tables["trajectory"]}, str(tmp_path / "tidy"))
    text = spark.read.text(str(tmp_path / "json")).first()[0]
    doc = json.loads(text)
    assert [len(doc[k]) for k in ("trajectory", "season_phases", "regional_summary", "regional_monthly", "display")] == [6, 3, 7, 42, 4]
    assert [t["period"] for t in doc["trajectory"]] == sorted(t["period"] for t in doc["trajectory"])
    assert spark.read.parquet(str(tmp_path / "tidy/trajectory")).count() == 6


def test_backtest_floors(hist):
    m = backtest(hist, 4, trees=35, seed=7, max_depth=10).first()
    assert m.precipitation_r2 > 0.45 and m.snowfall_r2 > 0.45 and m.temperature_mae_c < 0.65
    with pytest.raises(ValueError):
        last_years(hist, 99)


def test_indices_change_the_forecast_in_one_pass(spark, model):
    both = model.predict(scenario(spark, (-1.5, -1.0, 1, -1), (1.5, 1.0, -1, 1)))
    got = both.groupBy("sid").agg(*[F.sum(c).alias(c) for c in (
        "temperature_anomaly", "precipitation_mm", "snowfall_cm")]).orderBy("sid").collect()
    cold, warm = got
    assert warm.temperature_anomaly > cold.temperature_anomaly
    assert warm.precipitation_mm != cold.precipitation_mm and warm.snowfall_cm != cold.snowfall_cm


def test_recency_weights_matter(spark, hist):
    s = scenario(spark, (1.4, 0.6, -0.3, 0.5))
    total = lambda h: WinterOutlook(trees=10, seed=13, half_life=h, max_depth=8).fit(hist).predict(s).agg(
        F.sum("precipitation_mm")).first()[0]
    assert abs(total(5.0) - total(0.0)) > 1e-6
    flat = recency_normal(hist, 0).where("region = 'north_coast' AND month = 1").first().precipitation_mm
    plain = hist.where("region = 'north_coast' AND month = 1").agg(F.avg("precipitation_mm")).first()[0]
    assert abs(flat - plain) < 1e-9
    assert abs(recency_normal(hist, 5).where("region = 'north_coast' AND month = 1").first().precipitation_mm - plain) > 1e-9


def test_save_and_load(spark, model, tmp_path):
    model.save(str(tmp_path))
    again = WinterOutlook().restore(spark, str(tmp_path))
    s = scenario(spark, (0.3, 0.1, 0, 0))
    key = ["region", "month"]
    assert again.predict(s).orderBy(*key).collect() == model.predict(s).orderBy(*key).collect()


def test_requests(spark, hist, model):
    rows = [("a", "2027", "0.8", "0.35", "0", "0.2"), ("b", "2027", "warm", "0", "0", "0")]
    req = spark.createDataFrame(rows, "request_id string, year string, enso string, pdo string, ao string, pna string")
    out = answer_requests(req, model, hist)
    cards = out["cards"].collect()
    assert [c.request_id for c in cards] == ["a"]
    assert cards[0].temperature.endswith(" C") and cards[0].vs_normal.endswith("% vs normal")
    assert [r.request_id for r in out["rejected"].collect()] == ["b"]
    assert out["peaks"].first().peak_month in K.WINTER_MONTHS


def test_wrong_units(hist):
    forecast = hist.where("water_year = 2000").withColumn("area_weight", F.lit(0.1)).withColumn(
        "period", period_label("water_year", "month"))
    with pytest.raises(ValueError):
        O.summarize(forecast, hist, units="nautical")


def test_contract(spark):
    good = {
        "trajectory": [{"month": m, "precip": 1, "snow": 1} for m in K.MONTH_NAMES],
        "seasonPhases": [{"id": p[0]} for p in K.SEASON_PHASES],
        "details": [{"name": r[4], "risks": "x"} for r in K.REGIONS],
        "waterAllocation": {"riskLevel": "High", "summary": "x"},
        "wildfireRisk": {"riskLevel": "Critical", "summary": "x"},
    }
    def but(**change):
        return json.dumps({**good, **change})

    docs = {
        json.dumps(good): None, "text " + json.dumps(good) + " end": None, "none": "no_json", "{bad": "no_json",
        but(trajectory=good["trajectory"][:5]): "incomplete_forecast", but(details=None): "incomplete_forecast",
        but(seasonPhases=good["seasonPhases"][::-1]): "incomplete_phases",
        but(seasonPhases=good["seasonPhases"][:2]): "incomplete_phases",
        but(details=good["details"][::-1]): "incomplete_regions",
        but(details=[{**d, "risks": " "} for d in good["details"]]): "incomplete_regions",
        but(wildfireRisk={"riskLevel": "Low", "summary": ""}): "incomplete_impacts",
        but(waterAllocation={"riskLevel": "Extreme", "summary": "x"}): "incomplete_impacts",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "id int, body string")
    got = {r.id: r.first_error for r in check_documents(df).collect()}
    assert [got[i] for i in range(len(docs))] == list(docs.values())
