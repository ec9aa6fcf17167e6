import numpy as np
import pytest
from rowcheck import same_rows
from pyspark.sql import functions as F

from firn.models import features as M
from firn.models.forecast import forecast_steps
from firn.models.regression import Boosting, Forecaster, Forest, Linear, normalise
from firn.models.sequence import SequenceForecaster
from firn.models.trend import SeasonalTrend
from firn.plans import daily as D
from firn.session import materialize


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) * [1, 2, 5] + [0, 3, -1]
    y = 4 + x @ [2.0, -1.0, 0.3] + rng.normal(size=400)
    w = rng.uniform(0.5, 3, 400)
    rows = [(i, *map(float, r), float(v), float(u)) for i, (r, v, u) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double, w double").cache(), x, y, w


def coefs(f):
    c = {r.feature: r.coefficient for r in f.coefficients().collect()}
    return np.array([c[n] for n in "abc"]), c["(intercept)"]


@pytest.mark.parametrize("weighted", [False, True])
def test_ridge_closed_form(sample, weighted):
    df, x, y, w = sample
    u = w if weighted else np.ones(len(y))
    xc, yc = x - np.average(x, axis=0, weights=u), y - np.average(y, weights=u)
    want = np.linalg.solve((xc * u[:, None]).T @ xc + 50 * np.eye(3), (xc * u[:, None]).T @ yc)
    f = Forecaster(Linear("ridge", 50.0), list("abc"), "y").fit(df, "w" if weighted else None)
    got, intercept = coefs(f)
    assert np.allclose(got, want, atol=1e-4 if weighted else 1e-6)
    assert np.isclose(intercept, np.average(y, weights=u) - np.average(x, axis=0, weights=u) @ got, atol=1e-5)


@pytest.mark.parametrize("kind,ratio", [("lasso", 1.0), ("elasticnet", 0.5)])
def test_l1_by_coordinate_descent(sample, kind, ratio):
    df, x, y, _ = sample
    xc, yc, n, alpha = x - x.mean(0), y - y.mean(), len(y), 0.7
    b = np.zeros(3)
    for _ in range(2000):
        for j in range(3):
            r = yc - xc @ b + xc[:, j] * b[j]
            rho = xc[:, j] @ r / n
            b[j] = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - ratio))
    got, _ = coefs(Forecaster(Linear(kind, alpha, ratio), list("abc"), "y").fit(df))
    assert np.allclose(got, b, atol=1e-5)


def test_trees_learn_and_importance_sums_to_one(sample):
    df, *_ = sample
    for settings in (Forest(trees=20, max_depth=6), Boosting(rounds=15, max_depth=3)):
        f = Forecaster(settings, list("abc"), "y").fit(df, "w")
        assert f.evaluate(df).first().r2 > 0.6
        assert abs(f.importance().agg(F.sum("importance")).first()[0] - 1) < 1e-9
        assert {r.feature for r in f.importance().collect()} == set("abc")


def test_weights_change_the_forest(sample):
    df, *_ = sample
    heavy = df.withColumn("w", F.when(F.col("id") < 50, 100.0).otherwise(0.01))
    mean = lambda weight: Forecaster(Forest(trees=5, max_depth=4), list("abc"), "y").fit(heavy, weight).transform(
        df).agg(F.avg("prediction")).first()[0]
    assert mean("w") != mean(None)


def test_importance_of_nothing(spark):
    zero = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "feature string, score double")
    assert [r.importance for r in normalise(zero).collect()] == [0.0, 0.0]


def test_unfitted_and_unknown():
    with pytest.raises(RuntimeError):
        Forecaster(Linear(), ["a"], "y").transform(None)
    with pytest.raises(ValueError):
        Linear("cubic").stage(None, "y", None)


def test_sparse_encoding(spark):
    rows = [(s, float(i % 3)) for i, s in enumerate(["x", "y", "z", None] * 20)]
    df = spark.createDataFrame(rows, "station_id string, y double")
    f = Forecaster(Linear("ridge"), ["station_id__vector"], "y", M.sparse_one_hot(["station_id"])).fit(df)
    assert f.transform(df).count() == 80
    assert [r.feature for r in f.importance().collect()] == ["station_id__vector"]
    assert [r.feature for r in f.coefficients().collect()] == [*[f"station_id__vector[{i}]" for i in range(3)], "(intercept)"]


@pytest.mark.parametrize("size", [0.2, 0.37, 0.5])
def test_temporal_split_cuts_exactly(stations, size):
    train, test = M.temporal_split(stations, size)
    n = stations.count()
    assert train.count() == int(n * (1 - size)) and train.count() + test.count() == n
    assert train.agg(F.max("date")).first()[0] <= test.agg(F.min("date")).first()[0]


def test_random_split_is_stable(stations):
    a, b = M.random_split(stations), M.random_split(stations.repartition(7))
    same_rows(a[1].select("station_id", "date"), b[1].select("station_id", "date"))
    assert 0.17 < a[1].count() / stations.count() < 0.23


def test_scaler_uses_training_rows_only(spark, stations):
    train, test, scaler = D.split_and_scale(stations.select("station_id", "date", "swe", "temperature"))
    row = train.agg(F.avg("temperature"), F.stddev_pop("temperature")).first()
    assert abs(row[0]) < 1e-9 and abs(row[1] - 1) < 1e-9 and set(scaler) == {"temperature"}
    flat = M.fit_scaler(spark.createDataFrame([(2.0,), (2.0,)], "x double"), ["x"], "standard")
    assert flat == {"x": (2.0, 1.0)}
    with pytest.raises(ValueError):
        M.fit_scaler(stations, ["swe"], "log")


def test_future_steps_feed_back(spark):
    rows = [("s", f"2020-01-{d:02d}", float(2 ** d)) for d in range(1, 9)] + [("t", "2020-02-01", 3.0)]
    df = spark.createDataFrame(rows, "station_id string, date string, swe double").withColumn("date", F.to_date("date"))

    class Doubler:
        def transform(self, df):
            return df.withColumn("prediction", 2 * F.col("swe_lag_1") + 0 * F.col("swe_prev_mean_3"))

    got = forecast_steps(Doubler(), df, "swe", (1,), (3,), 12).orderBy("station_id", "step").collect()
    assert [r.prediction for r in got if r.station_id == "s"] == [2.0 ** (8 + k) for k in range(1, 13)]
    assert [r.prediction for r in got if r.station_id == "t"] == [3.0 * 2 ** k for k in range(1, 13)]
    assert str(got[0].date) == "2020-01-09" and str(got[11].date) == "2020-01-20"


def test_first_step_is_a_plain_prediction(spark, stations):
    rows = M.autoregressive(stations, "swe", (1, 2), (3,))
    f = Forecaster(Forest(trees=4, max_depth=4), M.autoregressive_names("swe", (1, 2), (3,)), "swe").fit(rows)
    known = stations.where("swe IS NOT NULL")
    last = known.groupBy("station_id").agg(F.max("date").alias("last"))
    step = forecast_steps(f, stations, "swe", (1, 2), (3,), 1)
    ahead = last.select("station_id", F.date_add("last", 1).alias("date"), F.lit(0.0).alias("swe"))
    both = M.autoregressive(known.select("station_id", "date", "swe").unionByName(ahead), "swe", (1, 2), (3,))
    want = f.transform(both).join(ahead.select("station_id", "date"), ["station_id", "date"])
    same_rows(step.select("station_id", "date", "prediction"), want.select("station_id", "date", "prediction"))


def test_seasonal_trend_recovers_a_wave(spark):
    days = spark.range(0, 1500).select(
        F.lit("s").alias("station_id"), F.date_add(F.lit("2010-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        (50 + 0.01 * F.col("id") + 8 * F.sin(F.col("id") * (2 * np.pi / 365.25))).alias("swe"))
    model = SeasonalTrend(changepoints=5, waves=3).fit(days)
    err = model.transform(days).select(F.max(F.abs(F.col("swe") - F.col("prediction")))).first()[0]
    assert err < 0.5
    ahead = model.future(days, 30).orderBy("step").collect()
    assert len(ahead) == 30 and abs(ahead[29].prediction - (50 + 15.29 + 8 * np.sin(1529 * 2 * np.pi / 365.25))) < 1.5
    assert ahead[0].lower <= ahead[0].prediction <= ahead[0].upper
    positive = SeasonalTrend(changepoints=5, waves=3, mode="multiplicative").fit(days).transform(days)
    assert positive.where("prediction <= 0").count() == 0


def test_sequences_come_back_in_target_units(spark, stations, tmp_path):
    model = SequenceForecaster(["swe", "temperature"], steps=3, settings=Linear("ridge", 0.01)).fit(stations)
    row = model.transform(stations).agg(F.avg("prediction").alias("p"), F.avg("swe").alias("y")).first()
    assert abs(row.p - row.y) / row.y < 0.1
    model.save(str(tmp_path))
    again = SequenceForecaster(["swe", "temperature"], steps=3).restore(spark, str(tmp_path))
    same_rows(again.transform(stations), model.transform(stations))


def test_daily_run(spark, stations):
    from conftest import SMALL
    from firn.catalog.views import view

    climate, index = view(spark, SMALL, "climate_daily"), view(spark, SMALL, "index_monthly")
    s = D.FeatureSettings(lags=(1, 7), windows=(7,))
    out = D.run_daily(stations, climate, index, s, Boosting(rounds=5, max_depth=3))
    metrics = out["metrics"].first()
    assert metrics.row_count > 0 and metrics.rmse > 0
    assert out["importance"].count() == len(out["model"].inputs)
    assert {"station_id__vector", "precipitation_cum_oct1", "station_mean_swe"} <= set(out["model"].inputs)


def test_statistics_of_the_training_rows_only(spark):
    rows = [("a", f"2020-01-{d:02d}", float(d), 1, float(d)) for d in range(1, 9)] + [("b", "2020-02-01", 100.0, 2, 7.0), ("a", "2020-02-01", 50.0, 2, 9.0)]
    df = spark.createDataFrame(rows, "station_id string, d string, swe double, month int, temperature double").withColumn("date", F.col("d").cast("date"))
    train, test, _ = D.split_and_scale(df, method="none", settings=D.FeatureSettings())
    assert {r.station_mean_swe for r in train.collect()} == {4.5} and {r.temperature_anomaly for r in train.where("d = '2020-01-08'").collect()} == {3.5}
    got = {r.station_id: r for r in test.collect()}
    assert got["a"].station_mean_swe == 4.5 and got["b"].station_mean_swe is None and got["a"].temperature_anomaly is None


def test_every_row_gets_a_place_in_the_predictions(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)] + [(None, 1.0), (float("nan"), 1.0)], "a double, y double")
    for settings in (Linear(), Forest(trees=2, max_depth=3), Boosting(rounds=2, max_depth=2)):
        out = Forecaster(settings, ["a"], "y").fit(df).transform(df)
        assert out.count() == 22 and out.where("prediction IS NULL").count() == 2
    with pytest.raises(ValueError):
        Forest(max_depth=31).stage(df, "y", None)


def test_trend_parts_of_hot_stations_and_components(spark, monkeypatch):
    from firn.models import trend
    from firn.operators.series import Series, hot_keys

    days = spark.range(0, 900).select(
        F.when(F.col("id") < 800, "hot").otherwise("cold").alias("station_id"), F.date_add(F.lit("2010-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        (5 + F.sin("id") + 0.001 * F.col("id")).alias("swe"), F.cos(F.col("id") * 0.7).alias("x"))
    made = lambda: SeasonalTrend(regressors=("x",), changepoints=2, waves=2).fit(days).transform(days, components=True)
    plain = made()
    monkeypatch.setattr(trend, "hot_keys", lambda df, s: hot_keys(df, Series(s.keys, s.order, 500)))
    same_rows(made(), plain, 6)
    off = F.abs(F.col("trend") + F.col("season") + F.col("extra") - F.col("prediction"))
    assert plain.agg(F.max(off)).first()[0] < 1e-9
    times = SeasonalTrend(changepoints=2, waves=2, mode="multiplicative").fit(days).transform(days, components=True)
    off = F.abs(F.col("trend") * F.col("season") * F.col("extra") - F.col("prediction"))
    assert times.agg(F.max(off)).first()[0] < 1e-9


def test_rolled_steps_of_a_sequence_model(spark):
    days = spark.range(0, 60).select(
        F.lit("s").alias("station_id"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        (10 + 5 * F.sin(F.col("id") * 0.5)).alias("swe"), F.cos(F.col("id") * 0.3).alias("x"))
    few = days.limit(2).withColumn("station_id", F.lit("few"))
    model = SequenceForecaster(["x", "swe"], steps=4, settings=Linear("ridge", 0.001)).fit(days)
    every = model.transform(days.unionByName(few).withColumn("swe", F.when(F.col("date") != "2020-01-20", F.col("swe"))))
    assert every.count() == 62 and every.where("prediction IS NULL").count() == 4 + 2 + 1
    early = days.where("date < '2020-02-20'")
    ahead = {(r.station_id, r.step): r.prediction for r in model.forecast(early.unionByName(few), 6).collect()}
    first = model.transform(days).where("date = '2020-02-20'").first().prediction
    assert np.isclose(ahead["s", 1], first) and ahead["few", 1] is None and len(ahead) == 12
    # with the other input given, later steps follow from the rows before them and the predictions
    given = {r.step: r.prediction for r in model.forecast(early, 6, days.select("station_id", "date", "x")).collect()}
    grown = early
    for step in range(1, 7):
        day = days.where(F.col("date") == F.date_add(F.lit("2020-02-19").cast("date"), step))
        assert np.isclose(given[step], model.transform(grown.unionByName(day)).orderBy(F.desc("date")).first().prediction)
        grown = grown.unionByName(day.withColumn("swe", F.lit(given[step])))


def test_trend_keeps_settings_and_unknown_stations(spark, tmp_path):
    days = spark.range(0, 200).select(
        F.lit("s").alias("station_id"), F.date_add(F.lit("2010-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        (50 + 0.01 * F.col("id")).alias("swe"))
    model = SeasonalTrend(changepoints=3, waves=2, interval=0.8).fit(days)
    both = days.unionByName(days.limit(5).withColumn("station_id", F.lit("t")))
    out = model.transform(both)
    assert out.count() == 205 and out.where("prediction IS NULL").count() == 5
    model.save(str(tmp_path))
    again = SeasonalTrend().restore(spark, str(tmp_path))
    assert (again.changepoints, again.waves, again.interval, again.keys) == (3, 2, 0.8, ("station_id",))
    same_rows(again.transform(both), out)


def test_sequence_boosting_stops_by_the_newest_rows(spark, stations, tmp_path):
    model = SequenceForecaster(["swe"], steps=2, settings=Boosting(rounds=3, max_depth=2)).fit(stations)
    assert model.model.getNumTrees <= 3
    model.save(str(tmp_path))
    again = SequenceForecaster([]).restore(spark, str(tmp_path))
    assert again.inputs == ["swe"] and again.steps == 2 and again.settings == model.settings
    same_rows(again.transform(stations), model.transform(stations))


def test_rows_of_a_fit_are_dealt_to_tasks(spark, monkeypatch):
    """A full task is cut; equal rows, too, and small inputs stay as they are."""
    import firn.models.regression as R

    df = spark.range(4000, numPartitions=1).select((F.col("id") % 2).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("y"))
    assert R.spread(df) is df and R.spread(df.where("false")).count() == 0
    monkeypatch.setattr(R, "TASK_ROWS", 500)
    per_task = [r.n for r in R.spread(df).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(per_task) == 8 and sum(per_task) == 4000 and max(per_task) <= 510
    seen = []
    stage = R.Forest.stage
    monkeypatch.setattr(R.Forest, "stage", lambda self, used, *a: seen.append(used.rdd.getNumPartitions()) or stage(self, used, *a))
    f = Forecaster(Forest(trees=2, max_depth=3, bootstrap=False), ["a"], "y").fit(df)
    assert seen == [8] and f.evaluate(df).first().rmse < 1e-9


def test_training_statistics_are_joined_without_a_shuffle(spark, stations):
    s = D.FeatureSettings()
    rows = materialize(stations.withColumn("month", F.month("date")))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # what is broadcast then, was counted
    try:
        train, test, scaler = D.split_and_scale(rows, settings=s)
        plan = train._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert set(scaler) == {"precipitation", "temperature", "month"}
        one, two = D.split_and_scale(rows)[0], train
        level = one.groupBy("station_id").agg(F.avg("swe").alias("m"))
        off = two.join(level, "station_id").where(F.abs(F.col("station_mean_swe") - F.col("m")) > 1e-9)
        assert off.count() == 0 and two.count() == one.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_counts_per_key_rule_hot_keys_out(spark):
    from firn.operators.series import Series, no_hot_join

    left = spark.createDataFrame([("a", 1)] * 4 + [("b", 1)] * 2 + [(None, 1)] * 5, "station_id string, date int")
    right = spark.createDataFrame([("a", 1)] * 2 + [("b", 1)] + [(None, 1)] * 9, "station_id string, date int")
    assert no_hot_join(left, right, Series(hot_rows=8)) and not no_hot_join(left, right, Series(hot_rows=7))
    assert no_hot_join(left.limit(0), right, Series(hot_rows=1))
