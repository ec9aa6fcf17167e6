"""Cross-validation from sums of products against models fitted on the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from rowcheck import same_rows

from firn.models.regression import Forecaster, Linear
from firn.models.validation import GRID, Setting, cross_validate, random_folds, ranked, solve, time_blocks

INPUTS = ["a", "b.c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 600
    a, b = rng.normal(1e6, 3, n), rng.normal(0, 50, n)
    d = 0.5 * b + rng.normal(0, 10, n)
    y = 2 * a - 0.3 * b + rng.normal(0, 1, n)
    made = pd.DataFrame({"station_id": [f"s{i % 7}" for i in range(n)], "date": pd.date_range("2000-01-01", periods=n).date,
                         "a": a, "b.c": b, "d": d, "y": y, "name": "x", "setting": 1.0, "row_count": 2.0})
    made.loc[::50, "a"] = None
    made.loc[::70, "y"] = None
    return random_folds(spark.createDataFrame(made), 4).cache()


def brute(pdf, setting, train, test):
    """Coordinate-free check: minimise by many steps on the rows themselves."""
    x, y = pdf.loc[train, INPUTS].to_numpy(), pdf.loc[train, "y"].to_numpy()
    xc, yc, n = x - x.mean(0), y - y.mean(), len(y)
    l1 = {"lasso": setting.alpha, "elasticnet": setting.alpha * setting.l1_ratio}.get(setting.kind, 0)
    l2 = {"ridge": setting.alpha / n, "elasticnet": setting.alpha * (1 - setting.l1_ratio)}.get(setting.kind, 0)
    w = np.zeros(len(INPUTS))
    for _ in range(3000):
        for j in range(len(w)):
            left = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / n
            w[j] = np.sign(left) * max(abs(left) - l1, 0) / (xc[:, j] @ xc[:, j] / n + l2)
    e = pdf.loc[test, "y"] - (y.mean() + (pdf.loc[test, INPUTS].to_numpy() - x.mean(0)) @ w)
    return np.sqrt((e**2).mean()), e.abs().mean(), 1 - (e**2).mean() / pdf.loc[test, "y"].var(ddof=0)


@pytest.mark.parametrize("rolling", [False, True])
def test_against_fits_on_the_rows(rows, rolling):
    settings = [Setting(), Setting("ridge", 5.0), Setting("lasso", 0.7), Setting("elasticnet", 0.7, 0.3)]
    got = {(r["name"], r.fold): r for r in cross_validate(rows, INPUTS, "y", settings, rolling=rolling).collect()}
    pdf = rows.toPandas().dropna(subset=[*INPUTS, "y"])
    assert len(got) == 4 * (3 if rolling else 4)
    for s in settings:
        for k in range(1 if rolling else 0, 4):
            train = pdf.fold < k if rolling else pdf.fold != k
            r = got[s.name, k]
            assert (r.train_rows, r.row_count) == (train.sum(), (pdf.fold == k).sum())
            assert (r.rmse, r.mae, r.r2) == pytest.approx(brute(pdf, s, train, pdf.fold == k), rel=1e-5)


def test_same_scale_of_penalties_as_the_fitted_models(rows):
    plain = rows.withColumnRenamed("b.c", "b")
    for kind in ("linear", "ridge", "lasso", "elasticnet"):
        got = cross_validate(plain, ["b", "d"], "y", [Setting(kind)]).where("fold = 0").first()
        f = Forecaster(Linear(kind), ["b", "d"], "y").fit(plain.where("fold <> 0").drop("a"))
        want = f.evaluate(plain.where("fold = 0 AND NOT isnan(y)")).first()
        assert got.rmse == pytest.approx(want.rmse, rel=1e-4)


def test_layout_does_not_matter(rows):
    one, many = (cross_validate(rows.repartition(n), INPUTS, "y", GRID[:4]) for n in (1, 13))
    same_rows(one, many, 5)


def test_hot_fold_and_repeated_rows(spark):
    df = spark.range(400).select((F.col("id") % 10 == 0).cast("int").alias("fold"), (F.col("id") % 3).cast("double").alias("a"),
                                 (F.col("id") % 3 * 2).alias("y"))
    got = cross_validate(df, ["a"], "y", [Setting()]).orderBy("fold").collect()
    assert [(r.fold, r.train_rows, r.row_count) for r in got] == [(0, 40, 360), (1, 360, 40)]
    assert all(abs(r.rmse) < 1e-9 and r.r2 == pytest.approx(1) for r in got)


def test_constant_input_target_and_small_folds(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, 1.0, 5.0), (1, 1.0, 5.0), (1, 2.0, 5.0), (None, 3.0, 9.0)],
                               "fold int, a double, y double")
    got = cross_validate(df, ["a"], "y", [Setting(), Setting("lasso", 0.1)]).collect()
    assert len(got) == 4 and all(r.rmse == 0 and r.r2 is None for r in got)
    single = cross_validate(df.where("fold = 0 OR a = 2"), ["a"], "y", [Setting()]).collect()
    assert [(r.fold, r.train_rows) for r in single] == [(1, 2)]
    assert cross_validate(df.where("false"), ["a"], "y", [Setting()]).count() == 0
    nan = df.withColumn("a", F.lit(float("nan")))
    assert cross_validate(nan, ["a"], "y", [Setting()]).count() == 0
    for bad in ([], [Setting("forest")]):
        with pytest.raises(ValueError):
            cross_validate(df, ["a"], "y", bad)


def test_blocks_follow_time_and_keep_days_whole(spark):
    df = spark.range(1000).select(F.expr("date_add(DATE '2000-01-01', CAST(sqrt(id) AS INT))").alias("date"))
    got = time_blocks(df.union(df.limit(1).select(F.lit(None).cast("date"))), 5).groupBy("date").agg(
        F.min("fold").alias("lo"), F.max("fold").alias("hi"), F.count("*").alias("n")).orderBy("date").collect()
    assert got[0].date is None and got[0].lo is None
    assert all(r.lo == r.hi for r in got) and [r.lo for r in got[1:]] == sorted(r.lo for r in got[1:])
    size = {k: sum(r.n for r in got[1:] if r.lo == k) for k in range(5)}
    assert all(130 < n < 270 for n in size.values())


def test_ranked(spark):
    df = spark.createDataFrame(
        [("p", 0, 1.0, 0.5), ("p", 1, 3.0, 0.7), ("q", 0, 1.0, 0.9), ("q", 1, 2.0, 0.9), ("o", 0, 2.0, None), ("o", 1, 2.0, None)],
        "name string, fold int, rmse double, r2 double").selectExpr("*", "'linear' kind", "1D alpha", "1D l1_ratio", "1L row_count", "rmse mae")
    assert [(r["name"], r["rank"], r.folds) for r in ranked(df).collect()] == [("q", 1, 2), ("o", 2, 2), ("p", 3, 2)]
    assert [r["name"] for r in ranked(df, "r2").collect()] == ["q", "p", "o"]
    with pytest.raises(ValueError):
        ranked(df, "speed")


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = x @ [3, 0, 0, -1, 0.2] + rng.normal(size=200)
    z = np.c_[np.ones(200), x, y]
    w = solve(z.T @ z, Setting("lasso", 0.3), np.ones(5))[1:]
    slope = (x - x.mean(0)).T @ (y - y.mean() - (x - x.mean(0)) @ w) / 200
    assert np.abs(slope).max() <= 0.3 + 1e-9 and np.allclose(slope[w != 0], 0.3 * np.sign(w[w != 0])) and (w[1:3] == 0).all()
