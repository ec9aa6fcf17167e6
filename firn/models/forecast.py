"""Forecasts over several steps, all stations at once.

Each step feeds its own prediction back into the lags, so later steps really depend on earlier
ones. The state of a station is one short array of its latest known values.
"""

from pyspark.sql import DataFrame, functions as F

from firn.models.features import season_waves
from firn.operators.aggregates import top_k
from firn.operators.series import Series
from firn.session import materialize

HORIZON, CUT_EVERY = 30, 10


def latest_state(history: DataFrame, target: str, reach: int, series=Series()) -> DataFrame:
    """Last known date and the last `reach` known values, oldest first.

    Spark keeps `reach` rows per station before the shuffle, so a hot station costs no more.
    """
    date = series.order[0]
    known = history.where(F.col(target).isNotNull()).select(*series.keys, date, target)
    last = top_k(known, reach, date, series.keys)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(date).alias("at"), F.col(target).cast("double").alias("v"))))
    return last.groupBy(*series.keys).agg(
        F.max(date).alias("__last"), F.transform(ordered, lambda e: e["v"]).alias("__values"))


def _features(target, lags, windows, step):
    values = F.col("__values")

    def at(k):
        return F.coalesce(F.try_element_at(values, F.lit(-k)), F.element_at(values, 1))

    def mean(n):
        tail = F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)
        return F.aggregate(tail, F.lit(0.0), lambda s, x: s + x) / F.size(tail)

    made = {f"{target}_lag_{k}": at(k) for k in lags}
    return made | {f"{target}_prev_mean_{n}": mean(n) for n in windows} | season_waves(
        F.date_add("__last", step))


def forecast_steps(model, history: DataFrame, target="swe", lags=(1, 7), windows=(7,),
                   horizon=HORIZON, series=Series()) -> DataFrame:
    """`horizon` daily steps per station: (station, step, date, prediction).

    Predicting is row-local, so the loop adds projections only; every few steps the small
    state table is written and read back to keep the plan short.
    """
    reach = max([*lags, *windows])
    state = materialize(latest_state(history, target, reach, series)).withColumn(
        "__path", F.array().cast("array<double>"))
    keep = [*series.keys, "__last", "__values", "__path"]
    for step in range(1, horizon + 1):
        ready = state.withColumns(_features(target, lags, windows, step))
        done = model.transform(ready)
        state = done.select(
            *series.keys, "__last",
            F.slice(F.concat("__values", F.array("prediction")), -F.least(F.size("__values") + 1, F.lit(reach)),
                    reach).alias("__values"),
            F.concat("__path", F.array("prediction")).alias("__path"))
        if step % CUT_EVERY == 0 and step < horizon:
            state = materialize(state.select(*keep))
    return state.select(*series.keys, "__last", F.posexplode("__path").alias("__at", "prediction")).select(
        *series.keys, (F.col("__at") + 1).alias("step"),
        F.date_add("__last", F.col("__at") + 1).alias(series.order[0]), "prediction")
