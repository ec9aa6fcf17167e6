"""Seasonal-trend regression per station: piecewise trend, yearly waves, extra regressors.

The normal equations are sums of outer products. The rows of a station come to a task sorted by
station, and each Arrow batch adds one matrix product per station to them. Hot stations are dealt to several
tasks; the few partial matrices of a station are summed and solved, many stations at once.
"""

import json
import math
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firn.operators.series import Series, hot_keys, join_same
from firn.session import materialize

#: Tasks that share the rows of a hot station; stations solved at once.
PARTS, AT_ONCE = 64, 64


@dataclass
class SeasonalTrend:
    regressors: tuple = ()
    target: str = "swe"
    date: str = "date"
    keys: tuple = ("station_id",)
    changepoints: int = 25
    changepoint_range: float = 0.8
    changepoint_scale: float = 0.05
    season_scale: float = 10.0
    waves: int = 10
    mode: str = "additive"
    interval: float = 0.95
    noise: float = 0.01
    start: float | None = None
    span: float | None = None
    table: DataFrame | None = None

    def _names(self):
        return 2 + self.changepoints + 2 * self.waves + len(self.regressors)

    def _penalty(self):
        trend = [0.0, 0.0] + [self.noise / self.changepoint_scale ** 2] * self.changepoints
        season = [self.noise / self.season_scale ** 2] * (2 * self.waves + len(self.regressors))
        return trend + season

    def _day(self):
        return F.datediff(self.date, F.lit("1970-01-01").cast("date")).cast("double")

    def _cuts(self):
        return [self.changepoint_range * (i + 1) / self.changepoints for i in range(self.changepoints)]

    def design(self):
        """The row's regressors as one array column."""
        t = (self._day() - self.start) / self.span
        cuts = self._cuts()
        turn = 2 * math.pi / 365.25
        waves = [fn(self._day() * (turn * k)) for k in range(1, self.waves + 1) for fn in (F.sin, F.cos)]
        return F.array(F.lit(1.0), t, *[F.greatest(t - c, F.lit(0.0)) for c in cuts], *waves,
                       *[F.col(r).cast("double") for r in self.regressors])

    def _y(self):
        y = F.col(self.target).cast("double")
        return F.log(y) if self.mode == "multiplicative" else y

    def fit(self, df: DataFrame) -> "SeasonalTrend":
        """One small model row per station."""
        if self.mode not in ("additive", "multiplicative"):
            raise ValueError("mode must be 'additive' or 'multiplicative'")
        used = df.na.drop("any", subset=[self.target, self.date, *self.regressors])
        if self.mode == "multiplicative":
            used = used.where(F.col(self.target) > 0)
        lo, hi = used.agg(F.min(self._day()), F.max(self._day())).first()
        if lo is None:
            raise ValueError("No rows to fit")
        self.start, self.span = lo, max(hi - lo, 1.0)
        part = F.lit(0)
        hot = hot_keys(used, Series(self.keys, (self.date,)))
        if hot is not None:
            used = join_same(used, hot.withColumn("__hot", F.lit(True)), self.keys, "left")
            part = F.when(F.col("__hot"), F.pmod(F.xxhash64(self.date, self.target, *self.regressors), F.lit(PARTS))).otherwise(F.lit(0))
        group = F.struct(*self.keys)
        rows = used.select(group.alias("g"), part.cast("int").alias("part"), self._day().alias("day"), *[
            F.col(r).cast("double").alias(f"r{i}") for i, r in enumerate(self.regressors)], self._y().alias("y"))
        rows = rows.repartition("g", "part").sortWithinPartitions("g", "part")
        kind = rows.schema["g"].dataType.simpleString()
        sums = rows.mapInArrow(self._products(), f"g {kind}, gram array<double>, n long")
        solved = sums.repartition("g").sortWithinPartitions("g").mapInArrow(
            self._solve(), f"g {kind}, row_count long, coef array<double>, sigma double")
        self.table = materialize(solved.select("g.*", "row_count", "coef", "sigma"))
        return self

    def _products(self):
        """Per station and task the upper part of the matrix of all products of its design and target."""
        start, span, cuts, waves, width = self.start, self.span, self._cuts(), self.waves, self._names()
        upper = np.triu_indices(width + 1)

        def run(batches):
            last, total, n = None, None, 0

            def row():
                return pa.RecordBatch.from_arrays([last, pa.array([total[upper].tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=["g", "gram", "n"])

            for b in batches:
                if not b.num_rows:
                    continue
                g = b.column("g").to_pylist()
                day = b.column("day").to_numpy()
                t = (day - start) / span
                turn = 2 * math.pi / 365.25
                x = np.column_stack([
                    np.ones(len(t)), t, *[np.maximum(t - c, 0.0) for c in cuts],
                    *[fn(day * (turn * k)) for k in range(1, waves + 1) for fn in (np.sin, np.cos)],
                    *[b.column(c).to_numpy() for c in b.schema.names if c not in ("g", "part", "day", "y")], b.column("y").to_numpy()])
                starts = [i for i in range(len(g)) if i == 0 or g[i] != g[i - 1]]
                for lo, hi in zip(starts, [*starts[1:], len(g)]):
                    if last is None or g[lo] != last[0].as_py():
                        if last is not None:
                            yield row()
                        last, total, n = b.column("g").slice(lo, 1), np.zeros((width + 1, width + 1)), 0
                    total += x[lo:hi].T @ x[lo:hi]
                    n += hi - lo
            if last is not None:
                yield row()

        return run

    def _solve(self):
        width, penalty = self._names(), np.array(self._penalty())

        def run(batches):
            keys, grams, counts = [], [], []

            def solved(count):
                full = np.zeros((count, width + 1, width + 1))
                up = np.triu_indices(width + 1)
                full[:, up[0], up[1]] = np.array(grams[:count])
                full += np.triu(full, 1).transpose(0, 2, 1)
                n = np.array(counts[:count], float)
                xx, xy, yy = full[:, :width, :width], full[:, :width, width], full[:, width, width]
                scale = np.maximum(yy / n, 1.0)
                ridge = (penalty[None, :] * scale[:, None] + 1e-10)[:, :, None] * np.eye(width)
                coef = np.linalg.solve(xx + ridge, xy[:, :, None])[:, :, 0]
                sse = np.maximum(yy - 2 * (coef * xy).sum(axis=1) + np.einsum("ki,kij,kj->k", coef, xx, coef), 0.0)
                sigma = np.sqrt(sse / np.maximum(n - 1, 1))
                out = pa.RecordBatch.from_arrays(
                    [pa.concat_arrays(keys[:count]), pa.array(counts[:count], pa.int64()), pa.array(coef.tolist(), pa.list_(pa.float64())), pa.array(sigma)],
                    names=["g", "row_count", "coef", "sigma"])
                del keys[:count], grams[:count], counts[:count]
                return out

            for b in batches:
                gram = b.column("gram").flatten().to_numpy().reshape(b.num_rows, -1)
                for i, (g, n) in enumerate(zip(b.column("g").to_pylist(), b.column("n").to_pylist())):
                    if keys and keys[-1][0].as_py() == g:  # another part of the same station
                        grams[-1] = grams[-1] + gram[i]
                        counts[-1] += n
                        continue
                    if len(keys) >= AT_ONCE:
                        yield solved(len(keys))
                    keys.append(b.column("g").slice(i, 1))
                    grams.append(gram[i])
                    counts.append(n)
            if keys:
                yield solved(len(keys))

        return run

    def transform(self, df: DataFrame, components=False) -> DataFrame:
        """Add `prediction`, `lower` and `upper`, NULL for stations without a model.

        With `components` also `trend`, `season` and `extra` (the regressors), which add up to the
        prediction, or multiply to it in multiplicative mode.
        """
        from statistics import NormalDist

        if self.table is None:
            raise RuntimeError("Call fit before predict")
        z = NormalDist().inv_cdf(0.5 + self.interval / 2)
        joined = join_same(df, self.table.drop("row_count"), self.keys, "left")
        terms = F.zip_with("coef", self.design(), lambda a, b: a * b)
        add = lambda part: F.when(F.col("coef").isNotNull(), F.aggregate(part, F.lit(0.0), lambda s, x: s + x))
        ends = [0, 2 + self.changepoints, 2 + self.changepoints + 2 * self.waves, self._names()]
        parts = {name: add(F.slice("__terms", lo + 1, hi - lo)) for name, lo, hi in zip(("trend", "season", "extra"), ends, ends[1:])}
        fitted = add(F.col("__terms"))
        back = F.exp if self.mode == "multiplicative" else (lambda c: c)
        return joined.withColumn("__terms", terms).withColumn("__fit", fitted).withColumns({
            **({name: back(part) for name, part in parts.items()} if components else {}),
            "prediction": back(F.col("__fit")),
            "lower": back(F.col("__fit") - z * F.col("sigma")),
            "upper": back(F.col("__fit") + z * F.col("sigma")),
        }).drop("__fit", "__terms", "coef", "sigma")

    def future(self, history: DataFrame, periods=30, step_days=1, components=False) -> DataFrame:
        """Predictions for the days after the last one of every station (no extra regressors)."""
        if self.regressors:
            raise ValueError("Give future regressor values to transform instead")
        last = history.groupBy(*self.keys).agg(F.max(self.date).alias("__last"))
        steps = F.explode(F.sequence(F.lit(1), F.lit(periods)))
        grid = last.withColumn("step", steps).withColumn(
            self.date, F.date_add("__last", F.col("step") * step_days)).drop("__last")
        return self.transform(grid, components)

    def save(self, folder: str):
        """Model rows and all settings below one folder."""
        self.table.write.mode("overwrite").parquet(f"{folder}/stations")
        config = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "table"}
        spark = self.table.sparkSession
        spark.createDataFrame([(json.dumps(config),)], "config string").coalesce(1).write.mode(
            "overwrite").text(f"{folder}/config")

    def restore(self, spark, folder: str) -> "SeasonalTrend":
        """The saved model; its settings replace the ones of this object."""
        for name, value in json.loads(spark.read.text(f"{folder}/config").first()[0]).items():
            setattr(self, name, tuple(value) if isinstance(value, list) else value)
        self.table = spark.read.parquet(f"{folder}/stations")
        return self
