"""Isolation-forest outlier removal: trees from small samples, scores on every row.

Every tree samples by a hash of the rows and grows in a task of its own. The forest is small by
definition (`trees` x `sample` rows) and shipped to the tasks that score the table. The cut is an
exact quantile.
"""

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firn.functions.scalars import numeric_columns
from firn.operators.quantiles import exact_quantiles
from firn.session import materialize

TREES, SAMPLE = 100, 256


def quoted(name):
    return f"`{name}`"


def _path_bonus(n):
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(points, rng, depth, limit):
    """Nested (feature, cut, left, right); a leaf is its expected path length."""
    spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
    usable = np.flatnonzero(spread > 0)
    if depth >= limit or len(points) <= 1 or len(usable) == 0:
        return float(depth + _path_bonus(len(points)))
    f = int(rng.choice(usable))
    cut = float(rng.uniform(points[:, f].min(), points[:, f].max()))
    left = points[:, f] < cut
    return (f, cut, _grow(points[left], rng, depth + 1, limit),
            _grow(points[~left], rng, depth + 1, limit))


def _depths(node, x, rows, out):
    if isinstance(node, float):
        out[rows] += node
        return
    f, cut, left, right = node
    below = x[rows, f] < cut
    _depths(left, x, rows[below], out)
    _depths(right, x, rows[~below], out)


def _numbers(df, cols):
    return [F.col(quoted(c)).cast("double") for c in cols]


def _spread(h, tree):
    """The hash of a row for one tree."""
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _sampled(df: DataFrame, cols, seed, trees, sample) -> DataFrame:
    """(tree, h, x): every tree's rows with the smallest hashes, at most `sample` from each task."""
    rows = df.select(F.xxhash64(F.lit(seed), *[F.col(quoted(c)) for c in df.columns]).alias("h"), F.array(*_numbers(df, cols)).alias("x"))
    rows = rows.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    width = len(cols)

    def run(batches):
        held_h, held_x = [np.zeros(0, np.uint64)] * trees, [np.zeros((0, width))] * trees
        for b in batches:
            if not b.num_rows:
                continue
            base, x = b.column("h").to_numpy().view(np.uint64), b.column("x").flatten().to_numpy().reshape(-1, width)
            for t in range(trees):
                h = np.concatenate([held_h[t], _spread(base, t)])
                every = np.concatenate([held_x[t], x])
                if len(h) > sample:
                    small = np.argpartition(h, sample - 1)[:sample]
                    h, every = h[small], every[small]
                held_h[t], held_x[t] = h, every
        for t in range(trees):
            if len(held_h[t]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(held_h[t]), t, np.int32)), pa.array((held_h[t] ^ np.uint64(1 << 63)).view(np.int64)), pa.array(held_x[t].tolist(), pa.list_(pa.float64()))],
                    names=["tree", "h", "x"])

    return rows.mapInArrow(run, "tree int, h long, x array<double>")


def grow_forest(df: DataFrame, cols, seed=42, trees=TREES, sample=SAMPLE):
    """Each tree grows in its own task from the `sample` rows with the smallest hashes for it.

    A row's hash comes from the seed and all its columns, so the layout of the table does not
    matter, and one rule serves every size; equal rows have equal hashes and are all alike. Only
    the finished trees reach the driver.
    """
    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(text=rows.x.map(lambda v: tuple(v))).sort_values(["h", "text"]).head(sample)
        points = np.array(rows.x.tolist(), float).reshape(len(rows), -1)
        limit = max(1, math.ceil(math.log2(max(len(points), 2))))
        tree = _grow(points, np.random.default_rng([seed, key[0]]), 0, limit)
        return pd.DataFrame({"tree": [key[0]], "size": [len(points)], "body": [json.dumps(tree)]})

    grown = _sampled(df, cols, seed, trees, sample).groupBy("tree").applyInPandas(grow, "tree int, size int, body string").collect()
    grown = sorted(grown, key=lambda r: r.tree)
    return [json.loads(r.body) for r in grown], (grown[0]["size"] if grown else 1)


def anomaly_scores(df: DataFrame, cols=None, seed=42, trees=TREES, sample=SAMPLE,
                   name="anomaly_score") -> DataFrame:
    """Score per row, near 1 for isolated rows; NULL where a feature is unknown."""
    cols = cols or numeric_columns(df)
    forest, size = grow_forest(df, cols, seed, trees, sample)
    scale = _path_bonus(size) or 1.0
    shipped = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*features: pd.Series) -> pd.Series:
        x = np.column_stack([f.to_numpy(dtype=float) for f in features])
        known = ~np.isnan(x).any(axis=1)
        total = np.zeros(len(x))
        rows = np.flatnonzero(known)
        for tree in shipped.value:
            _depths(tree, x, rows, total)
        result = np.exp2(-total / max(len(shipped.value), 1) / scale)
        return pd.Series(np.where(known, result, np.nan))

    scored = df.withColumn(name, score(*_numbers(df, cols)))
    return scored.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def drop_isolated(df: DataFrame, cols=None, contamination=0.05, seed=42, trees=TREES,
                  sample=SAMPLE) -> DataFrame:
    """Drop the `contamination` share of rows with the highest scores.

    Scores are written once: the exact cut and the filter both read them.
    """
    scored = materialize(anomaly_scores(df, cols, seed, trees, sample, "__score"))
    cut = exact_quantiles(scored, {"__score": [1 - contamination]})["__score"][0]
    if cut is None:
        return df
    return scored.where(F.col("__score").isNull() | (F.col("__score") <= cut)).drop("__score")
