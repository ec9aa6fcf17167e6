"""Daily station pipeline: clean, join, build features, split, scale, fit and score."""

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from firn.functions import scalars as N
from firn.models.boosting import CategoryForecaster
from firn.models.features import apply_scaler, fit_scaler, random_split, sparse_one_hot, temporal_split
from firn.models.regression import Boosting, Forecaster
from firn.operators import windows as W
from firn.operators.aggregates import counted, key_level, key_stats, month_anomaly, month_normal
from firn.operators.cleaning import clean
from firn.operators.joins import join_index_month, join_sources, merge_shared
from firn.operators.series import Series, hot_keys, no_hot_join
from firn.session import materialize


@dataclass
class FeatureSettings:
    target: str = "swe"
    lags: tuple = W.LAGS
    windows: tuple = W.WINDOWS
    series: Series = field(default_factory=Series)
    include_current: bool = True
    phase_flags: bool = True
    time: bool = True
    lag: bool = True
    rolling: bool = True
    climate: bool = True
    index: bool = True
    stations: bool = True
    statistics: bool = True


def create_features(df: DataFrame, index: DataFrame = None, settings=None, hot="find") -> DataFrame:
    """All features next to the input columns.

    Hot stations are looked for once, if they are not known. Without any, lags, rolling windows, running sums and
    station statistics share one shuffle on the station. Statistics (station level and spread,
    month means) are those of all rows; switch them off and use `add_statistics` to take them
    from training rows only.
    """
    s = settings or FeatureSettings()
    date, station = s.series.order[0], s.series.keys[0]
    df = N.parse_dates(df, date)
    if isinstance(hot, str):
        hot = hot_keys(df, s.series)
    if s.time or s.climate:
        df = N.add_calendar(df, date)
    if s.time:
        df = N.add_cyclic(N.add_season_flags(df))
    made, reach = {}, [0]
    present = lambda cols: [c for c in cols if c in df.columns]
    if s.lag:
        made |= W.lag_columns(present((s.target, "temperature", "precipitation")), s.lags)
        reach += s.lags
    if s.rolling:
        made |= W.rolling_columns(
            present((s.target, "temperature")), present((s.target,)), present(("precipitation",)),
            s.windows, s.include_current)
        reach += s.windows
    df = W.add_window_columns(df, made, max(reach), s.series, hot)
    if s.climate and "precipitation" in df.columns:
        df = N.add_water_year(df, date)
        df = W.add_water_year_total(df, series=s.series, hot=hot if hot is None else "find")
        # The water year starts on October 1, so both totals are one.
        df = N.add_missing(df, {"precipitation_cum_oct1": F.col("precipitation_cum_wy")})
    if s.statistics:
        df = add_statistics(df, s, by_window=hot is None)
    if s.index and index is not None:
        df = join_index_month(df, index, date)
        if "oni" in df.columns:
            df = N.add_missing(df, {"enso_phase": N.index_phase()})
            if s.phase_flags:
                flags = dict(zip(N.PHASES, ("enso_cool", "enso_neutral", "enso_warm")))
                df = df.withColumns({
                    n: F.coalesce((F.col("enso_phase") == p).cast("int"), F.lit(0))
                    for p, n in flags.items()})
    return df


def add_statistics(df: DataFrame, settings=None, source=None, by_window=False, found=None) -> DataFrame:
    """Level and spread of the target per station and the anomaly from the mean of the month.

    With `source` the numbers come from its rows, as from training rows for a test set: a
    station or month it does not have gets NULL. `found` holds what `statistics` gave.
    """
    s, (levels, normal) = settings or FeatureSettings(), found or (None, None)
    if s.stations and s.target in df.columns:
        df = key_stats(df, s.target, s.series.keys[0], by_window=by_window and source is None, source=source, stats=levels)
    if s.climate and "temperature" in df.columns:
        df = month_anomaly(df, source=source, normal=normal)
    return df


def statistics(df: DataFrame, settings=None):
    """The numbers of `add_statistics` from the rows of `df`, written once: (per station, per month), None where not asked for."""
    s = settings or FeatureSettings()
    return (
        counted(key_level(df, s.target, s.series.keys[0])) if s.stations and s.target in df.columns else None,
        materialize(month_normal(df)) if s.climate and "temperature" in df.columns else None)


def feature_columns(df: DataFrame, target="swe", keys=("station_id", "date")):
    """Numeric inputs of a model: everything but keys and target."""
    return N.numeric_columns(df, (*keys, target))


def split_and_scale(df: DataFrame, target="swe", test_size=0.2, method="standard", temporal=True,
                    seed=42, series=Series(), settings=None):
    """(train, test, scaler). The scaler sees the training rows only.

    With `settings` both parts also get the statistics of the training rows.
    """
    train, test = (
        temporal_split(df, test_size, series.order[0], series.keys[0]) if temporal
        else random_split(df, test_size, seed, (*series.keys, *series.order)))
    scaler = fit_scaler(train, feature_columns(df, target), method)  # before a join that its columns do not need
    if settings is not None:
        found = statistics(train, settings)
        train, test = (add_statistics(part, settings, found=found) for part in (train, test))
    return apply_scaler(train, scaler), apply_scaler(test, scaler), scaler


def run_daily(snow: DataFrame, climate: DataFrame, index: DataFrame, settings=None, model=None,
              test_size=0.2) -> dict:
    """Cleaned sources to scored model: features, metrics, importance and the fitted model.

    The feature table is written once, because splitting, scaling and every boosting round
    read it again. Statistics come from the training rows, and the station enters the model as
    0/1 inputs, one per station trained on: boosting sums them per station, other models take a
    sparse vector.
    """
    s = settings or FeatureSettings(lags=(1, 7, 30), windows=(7, 30), include_current=False)
    sides = clean(snow, (s.target, "snow_depth"), series=s.series), clean(climate, (), series=s.series)
    joined = join_sources(*sides, (s.series.order[0], *s.series.keys))
    hot = None if no_hot_join(*sides, s.series) else "find"
    shared = [c[:-5] for c in joined.columns if c.endswith("_snow")]
    joined = merge_shared(joined, shared)
    features = materialize(create_features(joined, index, replace(s, statistics=False), hot))
    train, test, scaler = split_and_scale(
        features, s.target, test_size, series=s.series, settings=s if s.statistics else None)
    inputs, station, model = feature_columns(train, s.target), s.series.keys[0], model or Boosting()
    vector = f"{station}__vector"
    if not s.stations:
        fitted = Forecaster(model, inputs, s.target)
    elif isinstance(model, Boosting):
        fitted = CategoryForecaster(model, [*inputs, vector], s.target, encoded={vector: station})
    else:
        fitted = Forecaster(model, [*inputs, vector], s.target, sparse_one_hot([station]))
    fitted = fitted.fit(train)
    return {
        "features": features, "train": train, "test": test, "scaler": scaler, "model": fitted,
        "metrics": fitted.evaluate(test), "importance": fitted.importance(),
    }
