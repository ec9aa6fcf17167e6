"""Regional winter outlook: three weighted forests in a causal chain.

Climate indices give temperature, both give rain, all of them give snow. Any number of
scenarios is predicted in one pass.
"""

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from firn import schemas as K
from firn.functions.scalars import period_label
from firn.models.regression import Forecaster, Forest
from firn.operators.aggregates import add_recency_weight, last_years
from firn.operators.cleaning import clamp_at_zero, validate_history
from firn.operators.joins import add_region, scenario_grid, split_years

REGION_FLAGS = [f"is_{r[0]}" for r in K.REGIONS]
BASE = ["water_year", "month", *REGION_FLAGS, "latitude", "elevation_m", *K.CLIMATE_INDICES]
CHAIN = (
    ("temperature_anomaly", BASE),
    ("precipitation_mm", [*BASE, "temperature_anomaly"]),
    ("snowfall_cm", [*BASE, "temperature_anomaly", "precipitation_mm"]),
)


def add_geography(df: DataFrame) -> DataFrame:
    """Latitude, elevation and one flag per region; an unknown region has no flag."""
    flags = {f"is_{r[0]}": (F.col("region") == r[0]).cast("int") for r in K.REGIONS}
    return add_region(df, "latitude", "elevation_m").withColumns(flags)


@dataclass
class WinterOutlook:
    trees: int = 180
    seed: int = 42
    half_life: float = 7.0
    max_depth: int = 30
    chain: dict = field(default_factory=dict)

    def fit(self, history: DataFrame) -> "WinterOutlook":
        rows = add_recency_weight(add_geography(validate_history(history)), self.half_life)
        settings = Forest(self.trees, self.max_depth, 2, "all", True, 64, self.seed)
        for label, inputs in CHAIN:
            self.chain[label] = Forecaster(settings, inputs, label).fit(rows, "weight")
        return self

    def predict_rows(self, frame: DataFrame) -> DataFrame:
        """Temperature, rain and snow for rows that carry year, month, region and indices."""
        if not self.chain:
            raise RuntimeError("Call fit before predict")
        out = add_geography(frame.drop(*[label for label, _ in CHAIN]))
        for label, _ in CHAIN:
            out = self.chain[label].transform(out).withColumnRenamed("prediction", label)
            if label != "temperature_anomaly":
                out = clamp_at_zero(out, [label])
        return out.drop(*REGION_FLAGS, "latitude", "elevation_m")

    def predict(self, scenarios: DataFrame) -> DataFrame:
        """42 rows per scenario row (`water_year`, indices and any naming columns)."""
        done = self.predict_rows(scenario_grid(scenarios))
        return add_region(done, "area_weight").withColumn("period", period_label("water_year", "month"))

    def save(self, folder: str):
        """The three models and the outlook's own settings below one folder."""
        config = {k: getattr(self, k) for k in ("trees", "seed", "half_life", "max_depth")}
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(config),)], "config string").coalesce(1).write.mode(
            "overwrite").text(f"{folder}/config")
        for label, f in self.chain.items():
            f.save(f"{folder}/{label}")

    def restore(self, spark, folder: str) -> "WinterOutlook":
        for name, value in json.loads(spark.read.text(f"{folder}/config").first()[0]).items():
            setattr(self, name, value)
        self.chain = {label: Forecaster.load(spark, f"{folder}/{label}") for label, _ in CHAIN}
        return self


def backtest(history: DataFrame, years=5, **settings) -> DataFrame:
    """One row of errors on the last whole water years, which the model never saw."""
    history = validate_history(history)
    train, test = split_years(history, last_years(history, years))
    model = WinterOutlook(**settings).fit(train)
    labels = [label for label, _ in CHAIN]
    truth = test.withColumnsRenamed({c: f"{c}_true" for c in labels})
    done = model.predict_rows(truth)
    made = {}
    for c, name in zip(labels, ("temperature", "precipitation", "snowfall")):
        unit = {"temperature": "c", "precipitation": "mm", "snowfall": "cm"}[name]
        err = F.col(f"{c}_true") - F.col(c)
        made[f"{name}_mae_{unit}"] = F.avg(F.abs(err))
        made[f"{name}_r2"] = 1 - F.avg(err * err) / F.nullif(F.var_pop(f"{c}_true"), F.lit(0.0))
    return done.agg(*[v.alias(k) for k, v in made.items()])

