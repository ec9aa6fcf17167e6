import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from firn.models.boosting import BoostedTrees, CategoryForecaster
from firn.models.regression import Boosting
from rowcheck import same_rows


def slow_split(x, y, l2):
    """The best first split by trying every cut and both directions for unknown values."""
    base = y.mean()
    g = y - base
    score = lambda s: g[s].sum() ** 2 / (s.sum() + l2)
    best = None
    for cut in sorted({v for v in x if not math.isnan(v)})[:-1]:
        for left_gap in (True, False):
            left = np.where(np.isnan(x), left_gap, x <= cut)
            gain = score(left) + score(~left)
            if left.sum() and (~left).sum() and (best is None or gain > best[0] + 1e-9):
                best = (gain, left)
    left = best[1]
    return base + np.where(left, g[left].sum() / (left.sum() + l2), g[~left].sum() / ((~left).sum() + l2))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 12, 600).astype(float), rng.normal(size=600)
    y = np.where(a > 6, 4.0, 1.0) + 2 * np.sin(b) + 0.1 * rng.normal(size=600)
    a[rng.random(600) < 0.2] = np.nan
    y = np.where(np.isnan(a), 6.0, y)
    b[rng.random(600) < 0.1] = np.nan
    data = [(i, None if math.isnan(p) else float(p), float(q), float(v), bool(i % 4 == 0)) for i, (p, q, v) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(data, "id int, a double, `b.x` double, y double, late boolean").repartition(3).cache()


def test_one_split_equals_trying_all(rows):
    local = sorted(rows.collect())
    x, y = np.array([np.nan if r.a is None else r.a for r in local]), np.array([r.y for r in local])
    model = BoostedTrees(["a"], "y", rounds=1, max_depth=1, learning_rate=1.0, row_share=1.0, column_share=1.0).fit(rows)
    got = [r.prediction for r in model.transform(rows).orderBy("id").collect()]
    assert np.allclose(got, slow_split(x, y, 1.0))


def test_every_row_gets_a_number_and_training_helps(spark, rows, tmp_path):
    model = BoostedTrees(["a", "b.x"], "y", rounds=25, max_depth=3, learning_rate=0.3).fit(rows)
    assert len(model.trees) == 25
    done = model.transform(rows)
    assert done.count() == done.where("prediction IS NOT NULL AND NOT isnan(prediction)").count() == 600
    assert model.evaluate(rows).first().r2 > 0.95
    again = BoostedTrees(["a", "b.x"], "y", rounds=25, max_depth=3, learning_rate=0.3).fit(rows)
    assert np.isclose(model.evaluate(rows).first().rmse, again.evaluate(rows).first().rmse)
    model.save(str(tmp_path))
    same_rows(BoostedTrees.load(spark, str(tmp_path)).transform(rows).select("id", "prediction"), done.select("id", "prediction"))
    count = model.importance()
    nodes = model.node_table().where("feature IS NOT NULL")
    total = nodes.count()
    assert {r.feature: r.importance for r in count.collect()} == {r.feature: r["count"] / total for r in nodes.groupBy("feature").count().collect()}
    assert math.isclose(sum(r.importance for r in model.importance("gain").collect()), 1.0)


def test_validation_rows_stop_the_growing(rows):
    model = BoostedTrees(["a", "b.x"], "y", rounds=60, max_depth=4, learning_rate=0.8, l2=0.0, validation="late", patience=3).fit(rows)
    assert len(model.trees) < 60 and len(model.errors) <= len(model.trees) + 4
    assert min(model.errors) == model.errors[len(model.trees)]


def test_nothing_to_fit(rows):
    with pytest.raises(ValueError):
        BoostedTrees(["a"], "y", rounds=1).fit(rows.where("id < 0"))
    with pytest.raises(RuntimeError):
        BoostedTrees(["a"], "y").transform(rows)


def test_rows_are_kept_in_blocks(spark):
    """A pass hands blocks to Python, not rows, and the last rows are in one, too."""
    df = spark.range(1000, numPartitions=1).select(F.col("id").cast("double").alias("x0"), F.lit(1.0).alias("y"), F.lit(1.0).alias("w"), F.lit(False).alias("late"), "id")
    model = BoostedTrees(["x0"], "y")
    blocks = model._binned(df.withColumnRenamed("id", "key"), [np.array([499.0])]).collect()
    assert len(blocks) == 1
    assert np.bincount(np.frombuffer(blocks[0].x, np.uint8)).tolist() == [500, 500]
    assert sorted(np.frombuffer(blocks[0].key, np.int64).tolist()) == list(range(1000))


def test_category_values_equal_one_hot_inputs(spark, tmp_path):
    """Every value of a text column splits as its 0/1 column would, and neither the trees nor the predictions differ."""
    rng = np.random.default_rng(5)
    effect = rng.normal(size=7) * 3
    data = [(i, f"s{c}" if c < 7 else None, float(a), float((effect[c] if c < 7 else 0.0) + a + 0.1 * e))
            for i, (c, a, e) in enumerate(zip(rng.integers(0, 8, 800), rng.normal(size=800), rng.normal(size=800)))]
    df = spark.createDataFrame(data, "id int, s string, a double, y double").repartition(3).withColumns(
        {f"is_{k}": F.coalesce((F.col("s") == f"s{k}").cast("double"), F.lit(0.0)) for k in range(7)}).cache()
    made = dict(rounds=4, max_depth=3, learning_rate=0.5, row_share=1.0, column_share=1.0, l2=0.0, first_rate=1.0)
    wide = BoostedTrees(["a", *[f"is_{k}" for k in range(7)]], "y", **made).fit(df)
    one = BoostedTrees(["a"], "y", categories=["s"], **made).fit(df)
    assert any(c is not None for t in one.trees for c in t.category)
    same_rows(one.transform(df).select("id", "prediction"), wide.transform(df).select("id", "prediction"), 6)
    unseen = df.withColumn("s", F.lit("other"))
    same_rows(one.transform(unseen).select("id", "prediction"), one.transform(df.withColumn("s", F.lit(None).cast("string"))).select("id", "prediction"))
    one.save(str(tmp_path))
    same_rows(BoostedTrees.load(spark, str(tmp_path)).transform(df).select("id", "prediction"), one.transform(df).select("id", "prediction"))


def test_many_stations_do_not_widen_the_rows(spark, tmp_path):
    """3,000 stations with 4 rows each: as a vector every row would be binned 3,000 times."""
    df = spark.range(12_000, numPartitions=2).select(
        F.concat(F.lit("ST"), F.col("id") % 3000).alias("station_id"), (F.col("id") % 10).cast("double").alias("a"),
        F.when(F.col("id") % 3000 == 17, 100.0).otherwise((F.col("id") % 10).cast("double")).alias("y"))
    f = CategoryForecaster(Boosting(rounds=3, max_depth=3, learning_rate=1.0, row_share=1.0, column_share=1.0), ["a", "v"], "y", encoded={"v": "station_id"}).fit(df)
    done = f.transform(df.unionByName(df.limit(1).withColumn("a", F.lit(None).cast("double"))))
    assert done.where("prediction IS NULL").count() == 1
    assert {round(r.prediction, 6) for r in done.where("station_id = 'ST17' AND a IS NOT NULL").collect()} == {100.0}
    shares = {r.feature: r.importance for r in f.importance().collect()}
    assert set(shares) == {"a", "v"} and shares["v"] > 0.1 and math.isclose(sum(shares.values()), 1.0)
    blocks = f.model._binned(df.select(F.col("a").alias("x0"), "y", F.lit(1.0).alias("w"), F.lit(False).alias("late"), F.lit(1).cast("long").alias("key"), F.col("station_id").alias("c0")), [np.array([4.0])]).collect()
    assert all(len(b.x) == len(b.codes[0]) // 4 for b in blocks) and sum(len(b.x) for b in blocks) == 12_000
    f.save(str(tmp_path))
    same_rows(CategoryForecaster.load(spark, str(tmp_path)).transform(df).select("station_id", "a", "prediction"), f.transform(df).select("station_id", "a", "prediction"))


def test_summaries_keep_ranks():
    """Few values are kept with their rows; of many, joined twice over, ranks are off by a few in a thousand rows at most."""
    from firn.models.boosting import _joined, _summary

    rng = np.random.default_rng(7)
    few = [rng.integers(0, 9, 500).astype(float) for _ in range(5)]
    values, counts = _joined([_summary(p, 100) for p in few], 100)
    exact = np.unique(np.concatenate(few), return_counts=True)
    assert values.tolist() == exact[0].tolist() and counts.tolist() == exact[1].tolist()
    many = [np.append(rng.normal(size=5000) * s, np.zeros(2000)) for s in range(1, 10)]
    values, counts = _joined([_joined([_summary(p, 1000) for p in many[i:i + 3]], 1000) for i in (0, 3, 6)], 1000)
    rows = np.sort(np.concatenate(many))
    assert len(values) <= 1000 and math.isclose(counts.sum(), len(rows))
    low, high = np.searchsorted(rows, values, "left") / len(rows), np.searchsorted(rows, values, "right") / len(rows)
    upto = np.cumsum(counts) / len(rows)
    assert np.all(upto >= low - 0.002) and np.all(upto <= high + 0.002)
    assert _joined([_summary(np.empty(0), 10)] * 2, 10)[0].size == 0


def test_cuts_are_quantiles_of_the_training_rows(spark):
    df = spark.range(120_000, numPartitions=3).select(
        (F.col("id") * 7919 % 120_000).cast("double").alias("x0"), F.when(F.col("id") % 3 > 0, F.col("id") % 3 * 5.0).alias("x1"), F.lit(None).cast("double").alias("x2"),
        F.lit(2.0).alias("y"), F.lit(3.0).alias("w"), (F.col("id") % 2 == 1).alias("late"))
    total, weight, cuts = BoostedTrees(["a", "b", "c"], "y", bins=16)._seen(df)
    assert (total, weight) == (60_000 * 6.0, 60_000 * 3.0)
    assert np.abs(cuts[0] / 120_000 - np.arange(1, 16) / 16).max() < 0.005 and cuts[1].tolist() == [5.0, 10.0] and cuts[2].tolist() == []


def test_a_fit_writes_blocks_and_no_rows(spark, rows, monkeypatch):
    """The rows go to Python as one array, twice, and are never written as a table as wide as the inputs."""
    from firn.models import boosting as B

    written = []
    monkeypatch.setattr(B, "materialize", lambda df, make=B.materialize: written.append(df.columns) or make(df))
    model = BoostedTrees(["a", "b.x"], "y", rounds=2, max_depth=2, known_only=True).fit(rows)
    assert [c for c in written if "margin" not in c] == []
    known = rows.where("a IS NOT NULL AND NOT isnan(`b.x`)")
    assert model.trees[0].cover[0] <= known.count() and math.isclose(model.base, known.agg(F.avg("y")).first()[0])
    gaps = rows.withColumn("a", F.when(F.spark_partition_id() == 0, F.col("a")))  # no known row in the other tasks
    fewer = BoostedTrees(["a"], "y", rounds=1, max_depth=1, known_only=True).fit(gaps)
    assert math.isclose(fewer.base, gaps.where("a IS NOT NULL").agg(F.avg("y")).first()[0])
    with pytest.raises(ValueError):
        BoostedTrees(["a"], "y", rounds=1, known_only=True).fit(rows.withColumn("a", F.lit(None).cast("double")))
    wide = model._packed(rows.select(F.col("a").alias("x0"), F.col("`b.x`").alias("x1"), "y"), "y")
    assert wide.columns == ["x", "y"]


def test_the_condition_of_a_prediction_is_worked_out_once(spark):
    """Metrics use a prediction several times; the check for unknown inputs comes before it, not in every use."""
    df = spark.range(300).select((F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, 1.0).alias("b"), (F.col("id") % 7).cast("double").alias("y"), F.lit("s").alias("s"))
    f = CategoryForecaster(Boosting(rounds=1, max_depth=2), ["a", "b", "v"], "y", encoded={"v": "s"}).fit(df)
    assert f.transform(df).where("prediction IS NULL").count() == 60
    assert f.evaluate(df).first().row_count == 240
    plan = f.evaluate(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" not in plan.split("ArrowEvalPython")[0]
