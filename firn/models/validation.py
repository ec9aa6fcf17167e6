"""Cross-validation of a settings grid of linear models from sums of products.

The rows are read three times, whatever the number of settings and folds: once for the level
and spread of every input, once for the matrix of products per fold, once to score. A model
that leaves folds out is solved from the total matrix minus theirs, so nothing is fitted on
rows. Tasks add up their batches in numpy and give back one matrix per fold; Spark sums the
cells. What reaches the driver depends on the folds and inputs, never on the rows.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

KINDS = ("linear", "ridge", "lasso", "elasticnet")


@dataclass(frozen=True)
class Setting:
    """One row of the grid, with penalties on the scale of `regression.Linear`."""

    kind: str = "linear"
    alpha: float = 1.0
    l1_ratio: float = 0.5

    @property
    def name(self):
        if self.kind == "linear":
            return "linear"
        mix = f",{self.l1_ratio:g}" if self.kind == "elasticnet" else ""
        return f"{self.kind}({self.alpha:g}{mix})"


GRID = (Setting(), *[Setting(k, a) for k in KINDS[1:] for a in (0.01, 0.1, 1.0, 10.0)])


def random_folds(df: DataFrame, folds=5, seed=42, keys=("station_id", "date"), name="fold") -> DataFrame:
    """A fold from 0 per row, by a hash of its keys: equal keys share a fold, in every run."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    share = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(name, F.pmod(share, F.lit(folds)).cast("int"))


def time_blocks(df: DataFrame, blocks=6, date="date", name="fold") -> DataFrame:
    """A block from 0 per row, in time order and of about equal rows; a day is never cut.

    Only a count per calendar day is ordered (36,525 a century), which is also what is
    broadcast. Rows without a date have no block.
    """
    day = F.col(date).cast("date")
    counts = df.where(day.isNotNull()).groupBy(day.alias("__day")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy("__day")) - F.col("__n")
    total = counts.agg(F.sum("__n")).scalar()
    placed = counts.select("__day", F.floor(before * blocks / total).cast("int").alias(name))
    return df.withColumn("__day", day).join(F.broadcast(placed), "__day", "left").drop("__day")


def cross_validate(df: DataFrame, inputs, target, settings=GRID, fold="fold", rolling=False) -> DataFrame:
    """One row per setting and fold: rows, RMSE, MAE and R2 on the fold, and the training rows.

    A fold is predicted by the model of all other folds, or with `rolling` by the model of the
    folds before it (the first one then only trains). Rows with an unknown input, target or
    fold take no part; folds without rows, and those without two rows to train on, give no
    row. R2 is NULL on a fold without spread. A constant input gets no weight. Names of other
    columns do not matter. The grid and the folds are lists by nature. Pass a materialized
    table, which is read three times.
    """
    inputs, settings = list(dict.fromkeys(inputs)), list(dict.fromkeys(settings))
    for s in settings:
        if s.kind not in KINDS:
            raise ValueError(f"Unknown model type: {s.kind}")
    if not settings:
        raise ValueError("the grid is empty")
    width = len(inputs)
    cols = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate([*inputs, target])]
    rows = df.select(F.col(fold).cast("int").alias("fold"), *cols)
    for i in range(width + 1):
        rows = rows.where(F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}"))
    rows = rows.where("fold IS NOT NULL")
    level = rows.agg(*[x for i in range(width + 1) for x in (F.avg(f"x{i}"), F.stddev_pop(f"x{i}"))]).first()
    centre = np.array([level[2 * i] or 0.0 for i in range(width + 1)])
    scale = np.array([level[2 * i + 1] or 1.0 for i in range(width + 1)])
    scale[-1] = 1.0
    cells = products(rows, centre, scale).collect()  # folds x (inputs + 2)^2 sums
    sums = {}
    for r in cells:
        sums.setdefault(r["fold"], np.zeros((width + 2) ** 2))[r["cell"]] = r["total"]
    sums = {k: v.reshape(width + 2, width + 2) for k, v in sums.items()}
    every = sum(sums.values()) if sums else None
    models = {}
    for k in sums:
        train = sum((m for j, m in sums.items() if j < k), np.zeros((width + 2,) * 2)) if rolling else every - sums[k]
        if round(train[0, 0]) >= 2:
            models[k] = (round(train[0, 0]), np.array([solve(train, s, scale[:width]) for s in settings]))
    errors = scored(rows, centre, scale, {k: m for k, (_, m) in models.items()}, len(settings))
    spark = df.sparkSession
    names = spark.createDataFrame(
        [(i, s.name, s.kind, float(s.alpha), float(s.l1_ratio)) for i, s in enumerate(settings)],
        "setting int, name string, kind string, alpha double, l1_ratio double")
    sizes = spark.createDataFrame([(int(k), int(n)) for k, (n, _) in models.items()], "fold int, train_rows long")
    n = F.col("row_count")
    mse, spread = F.col("squares") / n, F.col("y2") / n - F.pow(F.col("y1") / n, F.lit(2))
    # Below rounding of the sums the fold has one value only.
    flat = spread <= 1e-12 * F.greatest(F.col("y2") / n, F.lit(1e-300))
    return errors.join(F.broadcast(names), "setting").join(F.broadcast(sizes), "fold").select(
        "name", "kind", "alpha", "l1_ratio", "fold", "train_rows", "row_count", F.sqrt(mse).alias("rmse"),
        (F.col("off") / n).alias("mae"), F.when(~flat, 1 - mse / spread).alias("r2"))


def products(rows: DataFrame, centre, scale) -> DataFrame:
    """(fold, cell, total): sums of products of 1, the scaled inputs and the target per fold."""
    width = len(centre) + 1

    def added(batches):
        held = {}
        for b in batches:
            x = (b.iloc[:, 1:].to_numpy(float) - centre) / scale
            x = np.hstack([np.ones((len(x), 1)), x])
            f = b["fold"].to_numpy()
            for k in np.unique(f):
                part = x[f == k]
                held[k] = held.get(k, 0.0) + part.T @ part
        for k, m in held.items():
            yield pd.DataFrame({"fold": int(k), "cell": np.arange(width * width), "total": m.ravel()})

    return rows.mapInPandas(added, "fold int, cell int, total double").groupBy("fold", "cell").agg(
        F.sum("total").alias("total"))


def solve(m, setting: Setting, scale, rounds=10_000, tolerance=1e-12):
    """Intercept and slopes (of scaled inputs) from one matrix of products.

    Penalties weigh the slopes of the unscaled inputs. The intercept is free. L1 goes down one
    coordinate at a time until no slope moves.
    """
    n, width = m[0, 0], len(scale)
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    a, b = cov[:width, :width], cov[:width, width]
    live = np.diag(a) > 1e-12
    l1 = {"lasso": setting.alpha, "elasticnet": setting.alpha * setting.l1_ratio}.get(setting.kind, 0.0)
    l2 = {"ridge": setting.alpha / n, "elasticnet": setting.alpha * (1 - setting.l1_ratio)}.get(setting.kind, 0.0)
    w = np.zeros(width)
    if live.any():
        g, c, s = a[np.ix_(live, live)], b[live], scale[live]
        g = g + np.diag(l2 / s**2)
        if l1 == 0.0:
            w[live] = np.linalg.lstsq(g, c, rcond=1e-12)[0]
        else:
            v = np.zeros(len(c))
            for _ in range(rounds):
                moved = 0.0
                for j in range(len(v)):
                    left = c[j] - g[j] @ v + g[j, j] * v[j]
                    new = np.sign(left) * max(abs(left) - l1 / s[j], 0.0) / g[j, j]
                    moved, v[j] = max(moved, abs(new - v[j])), new
                if moved <= tolerance * max(1.0, np.abs(v).max()):
                    break
            w[live] = v
    return np.r_[mean[width] - w @ mean[:width], w]


def scored(rows: DataFrame, centre, scale, models, count) -> DataFrame:
    """(fold, setting) with rows, sums of errors and of the centred target, all settings at once."""
    fields = "fold int, setting int, row_count long, squares double, off double, y1 double, y2 double"

    def added(batches):
        held = {}
        for b in batches:
            x = (b.iloc[:, 1:].to_numpy(float) - centre) / scale
            f = b["fold"].to_numpy()
            for k in np.unique(f):
                if k not in models:
                    continue
                part, y = x[f == k, :-1], x[f == k, -1:]
                e = y - (models[k][:, 0] + part @ models[k][:, 1:].T)
                flat = np.ones(count)
                held[k] = held.get(k, 0.0) + np.array([
                    len(y) * flat, (e * e).sum(0), np.abs(e).sum(0), y.sum() * flat, (y * y).sum() * flat])
        for k, (n, squares, off, y1, y2) in held.items():
            yield pd.DataFrame({"fold": int(k), "setting": np.arange(count), "row_count": n.astype(int),
                                "squares": squares, "off": off, "y1": y1, "y2": y2})

    return rows.mapInPandas(added, fields).groupBy("fold", "setting").agg(
        *[F.sum(c).alias(c) for c in ("row_count", "squares", "off", "y1", "y2")])


def ranked(results: DataFrame, by="rmse") -> DataFrame:
    """One row per setting, best first: means over the folds, their deviation and the rank.

    Every fold counts the same. R2 is best when large, the other measures when small; ties go
    to the name. The table has one row per setting, so the keyless window is a short list.
    """
    if by not in ("rmse", "mae", "r2"):
        raise ValueError("rank by rmse, mae or r2")
    means = results.groupBy("name", "kind", "alpha", "l1_ratio").agg(
        F.count("*").alias("folds"), F.sum("row_count").alias("row_count"),
        *[F.avg(c).alias(c) for c in ("rmse", "mae", "r2")], F.stddev_samp(by).alias(f"{by}_deviation"))
    order = F.desc_nulls_last(by) if by == "r2" else F.asc_nulls_last(by)
    return means.withColumn("rank", F.row_number().over(W.orderBy(order, "name"))).orderBy("rank")
