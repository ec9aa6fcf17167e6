"""Sequence forecasting: scaled windows of earlier rows as one flat feature vector."""

import json
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import (
    GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel,
)
from pyspark.sql import DataFrame, SparkSession, functions as F

from firn.models.features import fit_scaler, temporal_split, unscale
from firn.models.regression import SETTINGS, Boosting
from firn.operators.aggregates import top_k
from firn.operators.series import Series, join_same
from firn.operators.windows import sequence_windows
from firn.session import materialize

#: Steps after which the state is written; every step refers to the window several times, so plans grow fast.
CUT_EVERY = 2

SavedModels = {m.__name__: m for m in (
    GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel)}


@dataclass
class SequenceForecaster:
    """Min-max scaling of inputs and target, `steps` earlier rows, any Spark regressor on top."""

    inputs: list
    target: str = "swe"
    steps: int = 7
    settings: object = field(default_factory=lambda: Boosting(rounds=20, max_depth=4))
    validation_share: float = 0.2
    series: Series = Series()
    scaler: dict | None = None
    model: object = None

    def _known(self, df: DataFrame) -> DataFrame:
        return df.na.drop("any", subset=[*self.inputs, self.target])

    def _fit_scaler(self, rows: DataFrame):
        self.scaler = fit_scaler(rows, list(dict.fromkeys([*self.inputs, self.target])), "minmax")

    def _split(self, df: DataFrame):
        return temporal_split(df, self.validation_share, self.series.order[0], self.series.keys[0])

    def prepare(self, df: DataFrame, short=False) -> DataFrame:
        """Scaled sequences with `features` (flat) and `label` (scaled target); `short` keeps short histories."""
        used = self._known(df)
        if self.scaler is None:
            self._fit_scaler(used)
        scaled = {f"__s_{c}": (F.col(c) - m) / s for c, (m, s) in self.scaler.items()}
        made = sequence_windows(
            used.withColumns(scaled), [f"__s_{c}" for c in self.inputs], f"__s_{self.target}",
            self.steps, self.series, short=short)
        return made.withColumn("features", array_to_vector(F.flatten("sequence"))).drop(*scaled)

    def parts(self, df: DataFrame):
        """(train, validation) in time order."""
        return self._split(self.prepare(df))

    def fit(self, df: DataFrame) -> "SequenceForecaster":
        """Every row trains. Boosting keeps the newest share out of the scaling and the trees and
        stops when the error on it no longer falls."""
        settings = self.settings
        early = isinstance(settings, Boosting) and settings.validation is None and self.validation_share > 0
        if early and self.scaler is None:
            self._fit_scaler(self._split(self._known(df))[0])
        rows = self.prepare(df)
        if early:
            settings = replace(settings, validation="__late")
            train, late = self._split(rows)
            rows = train.withColumn("__late", F.lit(False)).unionByName(late.withColumn("__late", F.lit(True)))
        self.model = settings.stage(rows, "label", None).fit(rows)
        return self

    def _predicted(self, df: DataFrame) -> DataFrame:
        done = self.model.transform(df)
        return done.withColumn("prediction", unscale("prediction", self.scaler[self.target]))

    def _fitted(self):
        if self.model is None:
            raise RuntimeError("Call fit before predict")

    def transform(self, df: DataFrame) -> DataFrame:
        """Predictions in the unit of the target; every row stays.

        NULL where the row's own numbers are unknown or fewer than `steps` known rows come before it.
        """
        self._fitted()
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in dict.fromkeys([*self.inputs, self.target])])
        made = self.prepare(df, short=True)
        full = F.size("sequence") == self.steps
        done = self._predicted(made.where(full)).select(*df.columns, "prediction")
        rest = made.where(~full).select(*df.columns).unionByName(df.where(~known))
        return done.unionByName(rest.withColumn("prediction", F.lit(None).cast("double")))

    def forecast(self, history: DataFrame, horizon=30, given: DataFrame = None) -> DataFrame:
        """(station, step, date, prediction): `horizon` daily steps after each station's last known row.

        The state of a station is its last `steps` scaled feature vectors, oldest first. Every
        step predicts the target, then the window rolls: a new vector with the prediction in the
        target's place comes in and the oldest one goes. The other inputs keep their last value,
        unless `given` (keys, date and inputs, one row per station and day) knows them.
        Stations with fewer than `steps` known rows have NULL predictions. Predicting is row-local,
        so the loop adds projections only; now and then the small state table is written.
        """
        self._fitted()
        keys, date = list(self.series.keys), self.series.order[0]
        scaled = F.array(*[((F.col(c) - self.scaler[c][0]) / self.scaler[c][1]).cast("double") for c in self.inputs])
        last = top_k(self._known(history).select(*keys, date, scaled.alias("__v")), self.steps, date, keys)
        ordered = F.array_sort(F.collect_list(F.struct(F.col(date).alias("at"), F.col("__v").alias("v"))))
        state = last.groupBy(*keys).agg(F.max(date).alias("__last"), F.transform(ordered, lambda e: e["v"]).alias("__window"))
        if given is not None:
            others = [c for c in self.inputs if c != self.target]
            ahead = join_same(given.select(*keys, date, *others), state.select(*keys, "__last"), keys).where(F.col(date) > F.col("__last"))
            vector = F.struct(*[((F.col(c) - self.scaler[c][0]) / self.scaler[c][1]).cast("double").alias(c) for c in others])
            plan = ahead.where(F.datediff(date, "__last") <= horizon).groupBy(*keys).agg(
                F.map_from_entries(F.collect_list(F.struct(F.datediff(date, "__last").alias("k"), vector.alias("v")))).alias("__given"))
            state = join_same(state, plan, keys, "left")
        state = materialize(state.withColumns({"__path": F.array().cast("array<double>"), "__full": F.size("__window") == self.steps}))
        keep, full = state.columns, F.col("__full")
        width = len(self.inputs)
        empty = F.array_repeat(F.lit(0.0), self.steps * width)
        for step in range(1, horizon + 1):
            # assembled for all rows, used for those with a whole window
            ready = state.withColumn("features", array_to_vector(F.when(full, F.flatten("__window")).otherwise(empty)))
            done = self.model.transform(ready).withColumn("__p", F.when(full, F.col("prediction")))
            newest = F.element_at("__window", -1)
            place = []
            for i, c in enumerate(self.inputs):
                if c == self.target:
                    place.append(F.col("__p"))
                elif given is not None:
                    place.append(F.coalesce(F.try_element_at("__given", F.lit(step))[c], newest[i]))
                else:
                    place.append(newest[i])
            rolled = F.when(full, F.concat(F.slice("__window", 2, self.steps - 1), F.array(F.array(*place)))).otherwise(F.col("__window"))
            state = done.withColumns({"__window": rolled, "__path": F.concat("__path", F.array("__p"))}).select(*keep)
            if step % CUT_EVERY == 0:
                state = materialize(state)
        out = state.select(*keys, "__last", F.posexplode("__path").alias("__at", "prediction"))
        return out.select(*keys, (F.col("__at") + 1).alias("step"), F.date_add("__last", F.col("__at") + 1).alias(date),
                          unscale("prediction", self.scaler[self.target]).alias("prediction"))

    def save(self, folder: str):
        """Model, scaling and all settings below one folder."""
        self.model.write().overwrite().save(f"{folder}/model")
        rows = [(c, *pair) for c, pair in self.scaler.items()]
        spark = SparkSession.active()
        spark.createDataFrame(rows, "name string, centre double, scale double").coalesce(1).write.mode(
            "overwrite").json(f"{folder}/scaler")
        kind = next(k for k, v in SETTINGS.items() if isinstance(self.settings, v))
        config = {"inputs": self.inputs, "target": self.target, "steps": self.steps, "kind": kind,
                  "settings": asdict(self.settings), "validation_share": self.validation_share,
                  "series": asdict(self.series)}
        spark.createDataFrame([(json.dumps(config),)], "config string").coalesce(1).write.mode(
            "overwrite").text(f"{folder}/config")

    def restore(self, spark, folder: str) -> "SequenceForecaster":
        """The saved model; its settings replace the ones of this object."""
        config = json.loads(spark.read.text(f"{folder}/config").first()[0])
        self.inputs, self.target, self.steps = config["inputs"], config["target"], config["steps"]
        self.validation_share = config["validation_share"]
        self.settings = SETTINGS[config["kind"]](**config["settings"])
        self.series = Series(**{k: tuple(v) if isinstance(v, list) else v for k, v in config["series"].items()})
        rows = spark.read.schema("name string, centre double, scale double").json(f"{folder}/scaler").collect()
        self.scaler = {r.name: (r.centre, r.scale) for r in rows}
        path = f"{folder}/model"
        kind = spark.read.text(f"{path}/metadata").first()[0]
        self.model = SavedModels[json.loads(kind)["class"].rsplit(".", 1)[-1]].load(path)
        return self
