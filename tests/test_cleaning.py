import math
import random

import numpy as np
import pytest
from rowcheck import same_rows
from pyspark.sql import functions as F

from firn.functions.scalars import coerce_numbers, find_date_column, nan_to_null, one_hot
from firn.operators import cleaning as C
from firn.operators.isolation import anomaly_scores, drop_isolated
from firn.operators import neighbours
from firn.operators.kdtree import Nearest
from firn.operators.neighbours import fill_knn
from firn.operators.quantiles import exact_quantiles


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 4.0)], "k int, x double")
    assert [r.x for r in nan_to_null(df).orderBy("k").collect()] == [None, None, 4.0]


def test_coercion_is_all_or_nothing(spark):
    df = spark.createDataFrame([("1", "1"), ("2.5", "x"), (None, "3")], "a string, b string")
    types = dict(coerce_numbers(df).dtypes)
    assert types == {"a": "double", "b": "string"}


def test_date_column(spark):
    df = spark.createDataFrame([(1,)], "obs_Date int")
    assert find_date_column(df) == "obs_Date"
    with pytest.raises(ValueError):
        find_date_column(df.withColumnRenamed("obs_Date", "x"))


@pytest.mark.parametrize("small", [1, 5, 50])
def test_exact_quantiles_with_ties_and_narrowing(spark, small):
    rng = random.Random(3)
    values = [rng.choice([1.0, 2.0, rng.random() * 100]) for _ in range(3000)] + [None] * 50
    df = spark.createDataFrame([(v,) for v in values], "x double").withColumn("e", F.lit(None).cast("double"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = exact_quantiles(df, {"x": probs, "e": [0.5]}, small)
    assert got["e"] == [None]
    assert np.allclose(got["x"], np.quantile([v for v in values if v is not None], probs))


def _brute(rows, target, k):
    """k-nearest means by comparing every pair."""
    out = []
    for r in rows:
        if r[target] is not None:
            out.append(r[target])
            continue
        near = []
        for d in rows:
            if d[target] is None:
                continue
            shared = [i for i in range(len(r)) if r[i] is not None and d[i] is not None]
            if shared:
                total = sum((r[i] - d[i]) ** 2 for i in shared)
                near.append((len(r) / len(shared) * total, d[target]))
        near.sort()
        known = [d[target] for d in rows if d[target] is not None]
        out.append(np.mean([v for _, v in near[:k]]) if near else np.mean(known))
    return out


@pytest.mark.parametrize("seed,n,hot", [(1, 400, 0.0), (2, 600, 0.4)])
def test_knn_equals_brute_force(spark, seed, n, hot):
    rng = random.Random(seed)

    def row():
        if rng.random() < hot:
            base = [5.0, 5.0, float(rng.randrange(3))]
        else:
            base = [rng.gauss(0, 5), round(rng.uniform(0, 9)), rng.choice([0.0, 1.0, 100.0 * rng.random()])]
        return [None if rng.random() < 0.25 else float(v) for v in base]

    rows = [row() for _ in range(n)] + [[None, None, None]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double, c double")
    got = fill_knn(df, ["a", "b", "c"], 5).orderBy("id").collect()
    for i, c in enumerate("abc"):
        assert np.allclose([g[c] for g in got], _brute(rows, i, 5))


def test_knn_over_many_cells_and_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 40)
    monkeypatch.setattr(neighbours, "GAPS", 10)
    test_knn_equals_brute_force(spark, 3, 500, 0.3)


def test_knn_of_columns_without_help(spark):
    rows = [(1, None, None, 2.0), (2, 4.0, None, None), (3, 8.0, None, None), (4, None, None, None)]
    df = spark.createDataFrame(rows, "id int, a double, `b.x` double, c double")
    got = {r[0]: tuple(r)[1:] for r in fill_knn(df, ["a", "b.x", "c"]).collect()}
    assert got == {1: (6.0, None, 2.0), 2: (4.0, None, 2.0), 3: (8.0, None, 2.0), 4: (6.0, None, 2.0)}
    assert fill_knn(df.limit(0), ["a", "c"]).count() == 0


@pytest.mark.parametrize("width", [2, 8])
def test_knn_compares_few_pairs(width):
    """Four times the donors and gaps cost about four times the pairs, not sixteen."""
    rng = np.random.default_rng(1)

    def compared(n):
        base = rng.normal(size=(n, 2)) @ rng.normal(size=(2, width)) + 0.01 * rng.normal(size=(n, width))
        near = Nearest(base, rng.normal(size=n), np.ones(n, np.int64), 5, width)
        q = base[rng.permutation(n)] + 0.01
        q[:: 4, 0] = np.nan
        near.search(q, np.full(n, np.inf))
        return near.compared

    small, large = compared(2_000), compared(8_000)
    assert large < 6 * small and large < 8_000 * 8_000 / 20


def test_isolation_drops_the_far_rows(spark):
    rng = np.random.default_rng(0)
    x = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(1000, 2)))]
    x += [(1000 + i, 20.0 + i, -20.0) for i in range(10)]
    df = spark.createDataFrame(x, "id int, a double, b double")
    kept = {r.id for r in drop_isolated(df, ["a", "b"], trees=40).collect()}
    assert not kept & set(range(1000, 1010))
    assert 0.94 <= len(kept) / len(x) <= 0.96
    again = {r.id for r in drop_isolated(df.repartition(3), ["a", "b"], trees=40).collect()}
    assert kept == again
    thin = drop_isolated(df, ["a", "b"], trees=12, sample=64)
    assert 0.94 <= thin.count() / len(x) <= 0.98 and thin.where("id >= 1000").count() == 0


def test_isolation_does_not_follow_the_layout(spark):
    rng = np.random.default_rng(1)
    x = [(i, float(a), None if i % 50 == 0 else float(b)) for i, (a, b) in enumerate(rng.normal(size=(3000, 2)))]
    df = spark.createDataFrame(x + x[:40], "id int, `a.x` double, b double")
    score = lambda n: sorted((r.id, r.anomaly_score) for r in anomaly_scores(df.repartition(n), ["a.x", "b"], trees=20, sample=64).collect() if r.anomaly_score is not None)
    three, seven = score(3), score(7)
    assert three == seven and len(three) == 3040 - 61 and len({v for _, v in three}) > 100


def test_isolation_of_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, None)], "id int, a double")
    assert anomaly_scores(df, ["a"], trees=5).where("anomaly_score IS NOT NULL").count() == 2
    assert drop_isolated(df.limit(0), ["a"], trees=5).count() == 0


def test_interpolation_edges(spark):
    rows = [("a", 1, None), ("a", 2, 10.0), ("a", 3, None), ("a", 6, 50.0), ("a", 9, None), ("b", 2, None)]
    df = spark.createDataFrame(rows, "station_id string, d int, swe double").select(
        "station_id", F.make_date(F.lit(2020), F.lit(1), "d").alias("date"), "swe")
    got = [r.swe for r in C.fill_interpolate(df, ["swe"]).orderBy("station_id", "date").collect()]
    assert got == [None, 10.0, 20.0, 50.0, 50.0, None]


def test_mode_prefers_the_smaller_value(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), (None,)], "t string")
    assert sorted(r.t for r in C.fill_most_frequent(df).collect()) == ["a", "a", "a", "b", "b"]


def test_capping_leaves_null_and_calm_columns(spark):
    df = spark.createDataFrame([(float(v),) for v in range(20)] + [(None,)], "x double")
    same_rows(C.cap_zscore(df, ["x"]), df)
    spiky = df.unionByName(spark.createDataFrame([(1000.0,)], "x double"))
    capped = [r.x for r in C.cap_zscore(spiky, ["x"]).collect()]
    assert None in capped and max(v for v in capped if v is not None) < 1000


def test_constant_and_all_null_columns(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", None)], "one int, t string, none string")
    assert C.drop_constant_columns(df, ()).columns == ["t", "none"]


def test_wide_text_near_the_limit(spark):
    df = spark.range(51).select(F.concat(F.lit("v"), "id").alias("w"), (F.col("id") % 50).cast("string").alias("n"))
    assert C.wide_text_columns(df, 50, ()) == ["w"]


def test_clean_keeps_keys_and_targets(spark, stations):
    many = stations.withColumn("snow_depth", F.lit(None).cast("double"))
    got = C.clean(many)
    assert {"station_id", "date", "swe", "snow_depth"} <= set(got.columns)
    assert got.where("swe IS NULL").count() == 0


def test_unknown_strategy(stations):
    with pytest.raises(ValueError):
        C.handle_missing(stations, "magic")


def test_history_guard(spark):
    from firn import schemas as K

    good = spark.createDataFrame([(2000, 11, "north_coast", 0.1, 0.1, 0.1, 0.1, 0.1, 5.0, 1.0)], K.HISTORY_SCHEMA)
    assert C.validate_history(good) is good
    with pytest.raises(ValueError, match="unknown_region"):
        C.validate_history(good.withColumn("region", F.lit("x")))
    with pytest.raises(ValueError, match="month_outside"):
        C.validate_history(good.withColumn("month", F.lit(7)))
    with pytest.raises(ValueError, match="required columns"):
        C.validate_history(good.drop("pdo"))
    with pytest.raises(ValueError, match="no_rows"):
        C.validate_history(good.limit(0))


def test_input_guard(spark):
    rows = [("2027", "0.5", "1", "0", "0"), ("2027", "x", "1", "0", "0"), ("2027", "NaN", "1", "0", "0"),
            ("2027", None, "1", "0", "0"), ("2027", "Infinity", "1", "0", "0")]
    good, bad = C.split_inputs(spark.createDataFrame(rows, "year string, enso string, pdo string, ao string, pna string"))
    assert good.count() == 1 and bad.count() == 4


def test_one_hot_limit_and_null(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [tuple(r) for r in one_hot(df, "t").select("t_a").collect()] == [(1,), (0,)]
    with pytest.raises(ValueError):
        one_hot(df.unionByName(spark.createDataFrame([("b",)], "t string")), "t", limit=1)


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (None,), (2.0,)], "x double")
    assert [r.x for r in C.clamp_at_zero(df, ["x"]).collect()] == [0.0, None, 2.0]
    assert math.isclose(C.clamp_at_zero(df, ["x"]).agg(F.sum("x")).first()[0], 2.0)


def test_number_texts(spark):
    df = spark.createDataFrame([("1d", "1", "NaN"), ("2f", " 2.5e1 ", "3"), (None, "-.5", None)], "code string, number string, gap string")
    out = coerce_numbers(df)
    assert dict(out.dtypes) == {"code": "string", "number": "double", "gap": "double"}
    assert sorted(r.number for r in out.collect()) == [-0.5, 1.0, 25.0]
    assert out.where("gap IS NOT NULL").count() == 1


def test_columns_are_judged_after_rows_are_dropped(spark):
    rows = [("s", f"2020-01-{d:02d}", float(d), "a" if d == 1 else "b", None if d == 1 else "x" * (d % 3)) for d in range(1, 11)]
    df = spark.createDataFrame(rows, "station_id string, date string, swe double, kind string, note string")
    out = C.clean(df, ("swe",), "drop")
    assert "kind" not in out.columns and "note" in out.columns and out.count() == 9


def test_medians_are_looked_for_where_there_are_gaps(spark, stations, monkeypatch):
    asked = []
    monkeypatch.setattr(C, "exact_medians", lambda df, cols, *more, find=C.exact_medians: asked.append(list(cols)) or find(df, cols, *more))
    rows = spark.createDataFrame([(1, 2.0, None), (2, None, None), (3, 6.0, None)], "n int, x double, e double")
    got = C.fill_median(rows)
    assert asked == [["x", "e"]] and dict(got.dtypes) == {"n": "double", "x": "double", "e": "double"}
    assert sorted(map(tuple, got.collect())) == [(1.0, 2.0, None), (2.0, 4.0, None), (3.0, 6.0, None)]
    assert C.fill_median(rows, ["n"]).dtypes[0] == ("n", "double") and C.fill_median(rows.limit(0)).dtypes == rows.dtypes
    asked.clear()
    C.clean(stations.where("swe IS NOT NULL AND precipitation IS NOT NULL"), ("swe",))
    assert asked == []


def test_the_key_columns_are_not_measured(spark, monkeypatch):
    """Text and dates that stay anyway are not compared, counted or estimated."""
    seen = []
    monkeypatch.setattr(C, "column_facts", lambda df, wide=False, find=C.column_facts: seen.append(df.columns) or find(df, wide))
    df = spark.createDataFrame([("a", "2020-01-01", 1.0, "k"), ("a", "2020-01-01", 1.0, "k"), ("b", "2020-01-02", None, "m")], "station_id string, date string, swe double, kind string")
    got = C.clean(df, ("swe",), threshold=0.9)
    assert {"swe", "kind"} <= set(seen[0]) and not {"station_id", "date"} & set(seen[0])
    assert sorted((r.station_id, r.swe, r.kind, r.day) for r in got.collect()) == [("a", 1.0, "k", 1.0), ("b", 1.0, "m", 2.0)]
