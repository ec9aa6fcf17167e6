"""Experiment grid: feature sets x models x splits, scored and ranked in one table."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from firn.models.features import random_split, temporal_split
from firn.models.regression import Boosting, Forecaster, Forest, Linear
from firn.models.sequence import SequenceForecaster
from firn.operators.aggregates import error_metrics
from firn.operators.series import Series

# The default experiments (name, features, model, settings, priority, outcome).
DEFAULT_EXPERIMENTS = (
    {"name": "Baseline Temporal Model", "features": ("day_of_year", "swe_lag_7"), "model": "boosting",
     "settings": {"rounds": 100, "max_depth": 6}, "test_size": 0.2, "temporal": True, "priority": 8,
     "outcome": "Establish baseline performance for comparison"},
    {"name": "Climate + ENSO Model",
     "features": ("temperature_anomaly", "precipitation_roll_sum_30", "enso_cool", "enso_neutral", "enso_warm"),
     "model": "forest", "settings": {"trees": 200, "max_depth": 8}, "test_size": 0.2, "temporal": True,
     "priority": 9, "outcome": "Improve understanding of climate drivers"},
    {"name": "Sequence Model", "features": ("swe_lag_30", "swe_roll_mean_14"), "model": "sequence",
     "settings": {"steps": 7}, "test_size": 0.2, "temporal": True, "priority": 7,
     "outcome": "Capture complex temporal patterns in snowpack data"},
)

# Model presets.
PRESETS = {
    "boosting": {"rounds": 200, "max_depth": 6, "learning_rate": 0.1, "row_share": 0.8, "column_share": 0.8},
    "forest": {"trees": 100, "min_leaf": 2},
    "sequence": {"steps": 7},
    "linear": {"kind": "linear"},
}


def _model(kind, settings, features, target, series):
    made = {**PRESETS[kind], **settings}
    if kind == "sequence":
        return SequenceForecaster(list(features), target, series=series, **made)
    cls = {"boosting": Boosting, "forest": Forest, "linear": Linear}[kind]
    return Forecaster(cls(**made), list(features), target)


def run_experiments(features: DataFrame, experiments=DEFAULT_EXPERIMENTS, target="swe",
                    series=Series(), seed=42) -> DataFrame:
    """One row per experiment, best priority first.

    The list of experiments is short by nature, so the driver walks it; every fit and score is
    a distributed job. Pass a materialized feature table.
    """
    rows = []
    for e in sorted(experiments, key=lambda e: -e["priority"]):
        needed = [*series.keys, *series.order, *e["features"], target]
        data = features.select(*dict.fromkeys(needed))
        train, test = (
            temporal_split(data, e["test_size"], series.order[0], series.keys[0]) if e["temporal"]
            else random_split(data, e["test_size"], seed, (*series.keys, *series.order)))
        model = _model(e["model"], e["settings"], e["features"], target, series).fit(train)
        scored = error_metrics(model.transform(test), target, "prediction")
        rows.append(scored.select(
            F.lit(e["name"]).alias("experiment"), F.lit(e["model"]).alias("model"),
            F.lit(e["priority"]).alias("priority"), "row_count", "rmse", "mae", "r2"))
    return reduce(DataFrame.unionByName, rows)
