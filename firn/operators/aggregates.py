"""Aggregations. Few-valued keys use two-phase groupBy; nothing runs as a keyless window."""

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from firn.functions.scalars import numeric_columns
from firn.schemas import season_months
from firn.session import materialize

#: Rows up to which a counted side, of a key and a few numbers a row, is broadcast.
COUNTED_ROWS = 500_000


def one_row(stats: DataFrame):
    """A one-row aggregate as a scalar struct, to be used like a constant in another plan."""
    return stats.select(F.struct("*")).scalar()


def with_stats(df: DataFrame, stats: DataFrame, name="__stats") -> DataFrame:
    """Attach a one-row aggregate as a struct column; no join and no shuffle of `df`."""
    return df.withColumn(name, one_row(stats))


def bundle_counts(bundle: dict) -> DataFrame:
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("name"), "row_count")
        for name, df in bundle.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def month_normal(df: DataFrame, col="temperature") -> DataFrame:
    """The mean of every calendar month as `__normal`."""
    return df.groupBy("month").agg(F.avg(col).alias("__normal"))


def month_anomaly(df: DataFrame, col="temperature", name="temperature_anomaly", source=None, normal=None) -> DataFrame:
    """Difference from the mean of the calendar month, over `df` or the rows of `source`, or from the given `month_normal`.

    Needs a `month` column. The climatology has 12 rows at most plus NULL, so it is broadcast.
    """
    normal = month_normal(df if source is None else source, col) if normal is None else normal
    return (
        df.join(F.broadcast(normal), "month", "left")
        .withColumn(name, F.col(col) - F.col("__normal")).drop("__normal")
        .select(*[c for c in df.columns if c != name], name)
    )


def key_level(df: DataFrame, col="swe", key="station_id", prefix="station") -> DataFrame:
    """Mean and sample deviation of `col` per key, one row per key."""
    return df.groupBy(key).agg(F.avg(col).alias(f"{prefix}_mean_{col}"), F.stddev_samp(col).alias(f"{prefix}_std_{col}"))


def counted(df: DataFrame, rows=COUNTED_ROWS) -> DataFrame:
    """`df` written once; marked for a broadcast where it has at most `rows` rows, so that no shuffle of the other side comes before it."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= rows else df


def key_stats(df: DataFrame, col="swe", key="station_id", prefix="station", by_window=False, source=None, stats=None):
    """Mean and sample deviation of `col` per key on every row, over `df` or the rows of `source`, or from a given `key_level`.

    A key that `source` does not have gets NULL.

    The statistics combine map-side. The join carries no hint: with adaptive execution a small
    side turns into a broadcast by its measured size and a hot key is split. `by_window` is for
    data that is already partitioned by the key and known to have no hot key: no shuffle then.
    """
    if by_window:
        w = W.partitionBy(key)
        return df.select("*", F.avg(col).over(w).alias(f"{prefix}_mean_{col}"), F.stddev_samp(col).over(w).alias(f"{prefix}_std_{col}"))
    if stats is None:
        stats = key_level(df if source is None else source, col, key, prefix)
    return df.join(stats, key, "left")


def recency_weight(df: DataFrame, half_life=7.0, year="water_year", latest=None):
    """Weight column: halves every `half_life` years before the latest year."""
    if half_life <= 0:
        return F.lit(1.0)
    if latest is None:
        latest = df.agg(F.max(year)).scalar()
    return F.pow(F.lit(2.0), -(latest - F.col(year)) / F.lit(float(half_life)))


def add_recency_weight(df: DataFrame, half_life=7.0, name="weight") -> DataFrame:
    return df.withColumn(name, recency_weight(df, half_life))


def recency_normal(history: DataFrame, half_life=7.0) -> DataFrame:
    """Weighted mean rain and snow per region and month; at most 7 x 6 rows."""
    weighted = add_recency_weight(history, half_life, "__w")
    return weighted.groupBy("region", "month").agg(*[
        (F.sum(F.col("__w") * F.col(c)) / F.sum("__w")).alias(c)
        for c in ("precipitation_mm", "snowfall_cm")
    ])


def percent_of_normal(compared: DataFrame, floor=0.01) -> DataFrame:
    def pct(c):
        normal = F.col(f"{c}_normal")
        # greatest() would skip an unknown normal
        return F.when(normal.isNotNull(), 100 * F.col(c) / F.greatest(normal, F.lit(floor)))

    return compared.withColumns({
        f"{c}_pct_normal": pct(c) for c in ("precipitation_mm", "snowfall_cm")})


def _weighted(c, w="area_weight"):
    return F.sum(F.col(c) * F.col(w))


def _ratio(top, bottom):
    """Percent; 100 when there is no normal to compare with."""
    return F.when(bottom == 0, 100.0).otherwise(100 * top / bottom)


def trajectory(compared: DataFrame, *by) -> DataFrame:
    return compared.groupBy(*by, "period", "month").agg(
        _weighted("precipitation_mm").alias("precipitation_mm"),
        _weighted("snowfall_cm").alias("snowfall_cm"))


def statewide(compared: DataFrame, *by) -> DataFrame:
    """Area-weighted totals, percents of normal and mean temperature."""
    return compared.groupBy(*by).agg(
        _weighted("precipitation_mm").alias("precipitation_mm"),
        _weighted("snowfall_cm").alias("snowfall_cm"),
        (_weighted("temperature_anomaly") / F.sum("area_weight")).alias("temperature_anomaly_c"),
        (100 * _weighted("precipitation_mm") / _weighted("precipitation_mm_normal"))
        .alias("precipitation_pct_normal"),
        (100 * _weighted("snowfall_cm") / _weighted("snowfall_cm_normal"))
        .alias("snowfall_pct_normal"),
    )


def phase_rollup(compared: DataFrame, *by) -> DataFrame:
    """The same per season phase."""
    phases = season_months(compared.sparkSession).drop("month_order")
    return compared.join(phases, "month").groupBy(
        *by, "phase_id", "phase_order", "phase_label", "phase_months"
    ).agg(
        (_weighted("temperature_anomaly") / F.sum("area_weight")).alias("predicted_temp_c"),
        _weighted("precipitation_mm").alias("precipitation_mm"),
        _ratio(_weighted("precipitation_mm"), _weighted("precipitation_mm_normal"))
        .alias("precipitation_pct_normal"),
        _weighted("snowfall_cm").alias("snowfall_cm"),
    )


def region_rollup(compared: DataFrame, *by) -> DataFrame:
    rain, rain_n = F.sum("precipitation_mm"), F.sum("precipitation_mm_normal")
    snow, snow_n = F.sum("snowfall_cm"), F.sum("snowfall_cm_normal")
    return compared.groupBy(*by, "region").agg(
        rain.alias("precipitation_mm"), rain_n.alias("normal_mm"), snow.alias("snowfall_cm"),
        snow_n.alias("normal_snow_cm"), _ratio(rain, rain_n).alias("precipitation_pct_normal"),
        _ratio(snow, snow_n).alias("snowfall_pct_normal"),
        F.avg("temperature_anomaly").alias("temperature_anomaly_c"),
    )


def peak_month(months: DataFrame, by=(), value="precipitation_mm", order="month_order") -> DataFrame:
    """Wettest month, the earlier one on ties, and the chart maximum of at least 1."""
    return months.groupBy(*by).agg(
        F.max_by("month", F.struct(F.col(value), -F.col(order))).alias("peak_month"),
        F.greatest(F.lit(1.0), F.max(value)).alias("chart_max"))


def forecast_context(df: DataFrame, target, predicted, date="date") -> DataFrame:
    """Mean, deviation and date range of the past, and the forecast against that mean."""
    return df.agg(
        F.avg(target).alias("historical_mean"), F.stddev_samp(target).alias("historical_std"),
        F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        ((F.lit(float(predicted)) - F.avg(target)) / F.nullif(F.avg(target), F.lit(0.0)) * 100)
        .alias("pct_vs_mean"))


def stack_long(wide: DataFrame, names, fields, key="column_name") -> DataFrame:
    """One row per name from one wide aggregate row with columns `name__field`."""
    structs = [
        F.struct(F.lit(n).alias(key), *[F.col(f"`{n}__{f}`").alias(f) for f in fields]) for n in names
    ]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def profile(df: DataFrame, target=None) -> DataFrame:
    """Per numeric column: rows, missing percent, range, mean and correlation with the target."""
    nums = numeric_columns(df)
    n = F.count("*")
    made = {}
    for c in nums:
        made |= {
            f"{c}__row_count": n, f"{c}__missing_percent": 100 * (n - F.count(c)) / n,
            f"{c}__min_value": F.min(c).cast("double"), f"{c}__max_value": F.max(c).cast("double"),
            f"{c}__mean_value": F.avg(c),
            f"{c}__corr_target": F.corr(c, target) if target else F.lit(None).cast("double"),
        }
    wide = df.agg(*[v.alias(k) for k, v in made.items()])
    fields = ["row_count", "missing_percent", "min_value", "max_value", "mean_value", "corr_target"]
    return stack_long(wide, nums, fields)


def dataset_facts(df: DataFrame, station="station_id", date="date", elevation="elevation_m") -> DataFrame:
    """Rows, columns, stations, date span and, where known, the elevation range.

    Stations are counted after a two-phase distinct.
    """
    high = elevation in df.columns
    ends = [F.min(elevation).alias("low"), F.max(elevation).alias("high")] if high else []
    spans = df.groupBy(station).agg(
        F.count("*").alias("n"), F.min(date).alias("lo"), F.max(date).alias("hi"), *ends)
    ranges = [F.min("low").alias("lowest_station"), F.max("high").alias("highest_station")] if high else []
    return spans.agg(
        F.sum("n").alias("row_count"), F.lit(len(df.columns)).alias("column_count"),
        F.count(station).alias("station_count"), F.min("lo").alias("first_date"),
        F.max("hi").alias("last_date"),
        F.floor(F.datediff(F.max("hi"), F.min("lo")) / 365.25).cast("int").alias("span_years"), *ranges)


def distinct_counts(df: DataFrame, cols) -> DataFrame:
    """Exact distinct counts, one two-phase job per column: copies combine before the shuffle."""
    counted = [
        df.select(c).where(F.col(c).isNotNull()).distinct()
        .agg(F.count("*").alias("distinct_values"))
        .select(F.lit(c).alias("column_name"), "distinct_values")
        for c in cols
    ]
    return reduce(DataFrame.unionByName, counted)


def error_metrics(df: DataFrame, truth, predicted, *by) -> DataFrame:
    """RMSE, MAE, MSE and R2 in one pass with partial aggregates.

    R2 is 1 - mse / population variance; Spark merges partial variances stably.
    """
    err = F.col(truth) - F.col(predicted)
    known = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    mse = F.avg(err * err)
    return known.groupBy(*by).agg(
        F.count("*").alias("row_count"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
        (1 - mse / F.nullif(F.var_pop(truth), F.lit(0.0))).alias("r2"), mse.alias("mse"))


def top_k(df: DataFrame, k: int, value: str, by=(), tie=(), rank="rank") -> DataFrame:
    """The k largest per group. Spark limits to k rows per group before the shuffle."""
    order = [F.desc_nulls_last(value), *[F.asc(t) for t in tie]]
    if not by:
        return df.orderBy(*order).limit(k)
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def last_years(history: DataFrame, years: int, col="water_year") -> DataFrame:
    """The last distinct years; an error when nothing would be left to train on."""
    distinct = history.select(col).distinct()
    found = distinct.orderBy(F.desc(col)).limit(years + 1).count()
    if found <= years:
        raise ValueError("Not enough water years for the requested holdout")
    return distinct.orderBy(F.desc(col)).limit(years)


def missing_columns(df: DataFrame, required):
    return sorted(set(required) - set(df.columns))


def unknown_values(df: DataFrame, col: str, dimension: DataFrame) -> DataFrame:
    return df.select(col).distinct().join(dimension.select(col), col, "left_anti")


def changed_values(before: DataFrame, after: DataFrame, col: str) -> DataFrame:
    """Values that only one version of a column holds.

    A full outer join of the distinct values, so no set is ever gathered in one place.
    """
    a = before.select(col).distinct().withColumn("__a", F.lit(1))
    b = after.select(col).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, a[col].eqNullSafe(b[col]), "full")
    side = F.when(F.col("__b").isNull(), "removed").otherwise("added")
    return (
        both.where(F.col("__a").isNull() | F.col("__b").isNull())
        .select(F.coalesce(a[col], b[col]).alias("value"), side.alias("change"))
    )
