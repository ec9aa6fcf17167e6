"""Distributed regressors behind one small interface.

Fitting, prediction and storage are Spark ML; the classes only map settings and metadata.
"""

import json
from collections import Counter
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoderModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F, types as T

from firn.operators.aggregates import error_metrics


@dataclass
class Linear:
    """linear, ridge, lasso or elasticnet with penalties on the scale of common libraries."""

    kind: str = "linear"
    alpha: float = 1.0
    l1_ratio: float = 0.5
    fit_intercept: bool = True

    @property
    def keeps_rows(self):
        """Whether a fit passes over its rows many times; without a penalty one pass will do."""
        return self.kind != "linear"

    def stage(self, df, label, weight):
        if self.kind not in ("linear", "ridge", "lasso", "elasticnet"):
            raise ValueError(f"Unknown model type: {self.kind}")
        reg, mix = 0.0, 0.0
        if self.kind != "linear":
            w = F.col(weight) if weight else F.lit(1.0)
            y = F.col(label)
            n, rows, m1, m2 = df.where(y.isNotNull()).agg(
                F.sum(w), F.count(y), F.sum(w * y), F.sum(w * y * y)).first()
            # Spark scales the label by its deviation, which leaves L1 alone and shrinks L2.
            spread = (max(m2 - m1 * m1 / n, 0.0) / (n * (rows - 1) / rows)) ** 0.5 if rows > 1 else 1.0
            if self.kind == "ridge":
                reg = self.alpha * spread / n
            elif self.kind == "lasso":
                reg, mix = self.alpha, 1.0
            else:
                l1, l2 = self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio) * spread
                reg = l1 + l2
                mix = l1 / reg if reg else 0.0
        model = LinearRegression(
            featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=mix,
            standardization=False, fitIntercept=self.fit_intercept, maxIter=500, tol=1e-9,
            solver="auto" if self.kind == "linear" else "l-bfgs")
        return model.setWeightCol(weight) if weight else model


@dataclass
class Forest:
    """Bagged trees, as deep as Spark can grow them by default."""

    trees: int = 100
    max_depth: int = 30
    min_leaf: int = 2
    features: str = "all"
    bootstrap: bool = True
    max_bins: int = 64
    seed: int = 42
    keeps_rows = True

    def stage(self, df, label, weight):
        if self.max_depth > 30:
            raise ValueError("Spark grows trees to depth 30 at most")
        model = RandomForestRegressor(
            featuresCol="features", labelCol=label, numTrees=self.trees,
            maxDepth=self.max_depth, minInstancesPerNode=self.min_leaf,
            featureSubsetStrategy=self.features, bootstrap=self.bootstrap, maxBins=self.max_bins,
            seed=self.seed)
        return model.setWeightCol(weight) if weight else model


@dataclass
class Boosting:
    """Gradient-boosted trees; a validation column stops early."""

    rounds: int = 200
    max_depth: int = 6
    learning_rate: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    min_leaf: int = 1
    max_bins: int = 64
    tolerance: float = 0.01
    validation: str | None = None
    seed: int = 42
    keeps_rows = True

    def stage(self, df, label, weight):
        model = GBTRegressor(
            featuresCol="features", labelCol=label, maxIter=self.rounds, maxDepth=self.max_depth,
            stepSize=self.learning_rate, subsamplingRate=self.row_share,
            featureSubsetStrategy=str(self.column_share), minInstancesPerNode=self.min_leaf,
            maxBins=self.max_bins, validationTol=self.tolerance, seed=self.seed)
        if self.validation:
            model = model.setValidationIndicatorCol(self.validation)
        return model.setWeightCol(weight) if weight else model


def quoted(name):
    return f"`{name}`"


#: Rows of one task of a fit, about.
TASK_ROWS = 500_000


def spread(df: DataFrame, rows=None) -> DataFrame:
    """`df` as it is or, where a task would hold more than `rows` rows, dealt evenly to more tasks.

    Spark ML keeps the rows of a fit in memory as objects, one block per task, and reads the blocks again
    in every pass. Files of well packed rows would make blocks many times their size.
    """
    rows = rows or TASK_ROWS
    held = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    most, total = held.agg(F.max("n"), F.sum("n")).first()
    return df if (most or 0) <= rows else df.repartition(-(-total // rows))


SETTINGS = {"linear": Linear, "forest": Forest, "boosting": Boosting}


@dataclass
class Forecaster:
    """Settings, inputs and, after `fit`, a Spark ML pipeline model."""

    settings: object
    inputs: list
    label: str
    encoders: list = field(default_factory=list)
    model: PipelineModel | None = None

    def fit(self, df: DataFrame, weight=None) -> "Forecaster":
        """Rows with an unknown input or label take no part."""
        plain = [c for c in self.inputs if c in df.columns]
        used = df.na.drop("any", subset=[*plain, self.label])
        if self.settings.keeps_rows:
            used = spread(used)
        assembler = VectorAssembler(inputCols=self.inputs, outputCol="features", handleInvalid="keep")
        stages = [*self.encoders, assembler, self.settings.stage(used, self.label, weight)]
        self.model = Pipeline(stages=stages).fit(used)
        return self

    def _fitted(self):
        if self.model is None:
            raise RuntimeError("Call fit before predict")
        return self.model

    def transform(self, df: DataFrame) -> DataFrame:
        """Add `prediction`, NULL where a numeric input is unknown; every row stays."""
        return self._known_only(df, self._fitted().transform(df).drop("features"))

    def _known(self, df):
        """Whether all numeric inputs of a row are known."""
        known = F.lit(True)
        for f in df.schema:
            if f.name in self.inputs and isinstance(f.dataType, T.NumericType):
                known = known & F.col(quoted(f.name)).isNotNull() & ~F.isnan(quoted(f.name))
        return known

    def _known_only(self, df, done):
        return done.withColumn("prediction", F.when(self._known(df), F.col("prediction")))

    def evaluate(self, df: DataFrame, *by) -> DataFrame:
        return error_metrics(self.transform(df), self.label, "prediction", *by)

    def input_names(self):
        """The input of every slot of the feature vector; an encoded input has one per category."""
        widths = {}
        for stage in self._fitted().stages:
            if isinstance(stage, OneHotEncoderModel):
                drop = int(stage.getDropLast())
                widths |= {c: n - drop for c, n in zip(stage.getOutputCols(), stage.categorySizes)}
        return [name for name in self.inputs for _ in range(widths.get(name, 1))]

    def importance(self) -> DataFrame:
        """Shares that sum to 1: split gains of trees, absolute coefficients of linear models.

        One row per input; the categories of an encoded one add up.
        """
        last = self._fitted().stages[-1]
        raw = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
        values = [abs(float(v)) for v in raw.toArray()]
        spark = self._session()
        names = self.input_names()
        scores = dict.fromkeys(names, 0.0)
        for n, v in zip(names, values, strict=True):
            scores[n] += v
        return normalise(spark.createDataFrame(list(scores.items()), "feature string, score double"))

    def coefficients(self) -> DataFrame:
        last = self._fitted().stages[-1]
        names, values = self.input_names(), last.coefficients.toArray()
        many = {n for n, k in Counter(names).items() if k > 1}
        seen = dict.fromkeys(names, 0)
        pairs = []
        for n, v in zip(names, values, strict=True):
            pairs.append((f"{n}[{seen[n]}]" if n in many else n, float(v)))
            seen[n] += 1
        pairs.append(("(intercept)", float(last.intercept)))
        return self._session().createDataFrame(pairs, "feature string, coefficient double")

    def _session(self):
        from pyspark.sql import SparkSession

        return SparkSession.active()

    def save(self, folder: str):
        """Model and settings below one folder, written by Spark."""
        self._fitted().write().overwrite().save(f"{folder}/model")
        kind = next(k for k, v in SETTINGS.items() if isinstance(self.settings, v))
        text = json.dumps({"kind": kind, "settings": asdict(self.settings), "inputs": self.inputs,
                           "label": self.label})
        self._session().createDataFrame([(text,)], "config string").coalesce(1).write.mode(
            "overwrite").text(f"{folder}/config")

    @classmethod
    def load(cls, spark, folder: str) -> "Forecaster":
        config = json.loads(spark.read.text(f"{folder}/config").first()[0])
        settings = SETTINGS[config["kind"]](**config["settings"])
        model = PipelineModel.load(f"{folder}/model")
        return cls(settings, config["inputs"], config["label"], [], model)


def normalise(scores: DataFrame, value="score") -> DataFrame:
    """Importance as a share of the total, 0 where the total is 0."""
    total = scores.agg(F.sum(value)).scalar()
    share = F.when(total == 0, 0.0).otherwise(F.col(value) / total)
    return scores.withColumn("importance", share).drop(value)
