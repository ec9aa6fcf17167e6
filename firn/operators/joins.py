"""Joins between daily series, slow indices and small dimensions.

Only dimensions with a size known from the calendar or from a fixed list are broadcast. Joins
of two data tables carry no hint: adaptive execution measures both sides, broadcasts a small
one and splits hot keys.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from firn import schemas as K
from firn.functions.scalars import period_label
from firn.operators.series import join_same


def join_sources(left: DataFrame, right: DataFrame, on=("date", "station_id"), how="left",
                 suffixes=("_snow", "_clim"), null_safe=False) -> DataFrame:
    """Equi-join of two observation tables; names both sides have get a suffix each.

    With `null_safe` NULL keys match each other.
    """
    on = list(on)
    shared = [c for c in left.columns if c in right.columns and c not in on]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    if null_safe:
        return join_same(left, right, on, how)
    return left.join(right, on, how)


def merge_shared(df: DataFrame, cols, suffixes=("_snow", "_clim")) -> DataFrame:
    """One column again from the suffixed pair, the first side winning where known."""
    return df.withColumns({
        c: F.coalesce(F.col(c + suffixes[0]), F.col(c + suffixes[1])) for c in cols
    }).drop(*[c + s for c in cols for s in suffixes])


def join_index_exact(df: DataFrame, index: DataFrame, date="date", index_date="date") -> DataFrame:
    """Index values on days that carry the index date itself; a calendar-bounded broadcast.

    Of several index rows of a day the latest counts, of equal ones the largest.
    """
    cols = [c for c in index.columns if c != index_date]
    one = _one_per_day(index, index_date, "__index_date")
    return df.join(F.broadcast(one), df[date].cast("date") == one["__index_date"], "left").select(
        *[df[c] for c in df.columns], *[one[c] for c in cols])


def _one_per_day(index: DataFrame, index_date, name) -> DataFrame:
    """The last row of every calendar day; among equals the largest, so that reruns agree."""
    cols = [c for c in index.columns if c != index_date]
    last = F.max(F.struct(F.col(index_date).alias("__at"), *cols)).alias("__row")
    known = index.where(F.col(index_date).isNotNull())
    return known.groupBy(F.col(index_date).cast("date").alias(name)).agg(last).select(name, *[F.col(f"__row.{c}").alias(c) for c in cols])


def join_index_month(df: DataFrame, index: DataFrame, date="date", index_date="date") -> DataFrame:
    """Every day gets the index of its own month: 12 index rows a year, broadcast."""
    cols = [c for c in index.columns if c != index_date]
    monthly = index.groupBy(F.last_day(index_date).alias("__month_end")).agg(
        *[F.max_by(c, index_date).alias(c) for c in cols])
    keyed = df.withColumn("__month_end", F.last_day(date))
    return keyed.join(F.broadcast(monthly), "__month_end", "left").drop("__month_end").select(
        *df.columns, *cols)


def join_index_as_of(df: DataFrame, index: DataFrame, date="date", index_date="date") -> DataFrame:
    """Every day gets the last index published on or before it.

    Each index row is repeated for the days it stays valid, which makes the as-of match an
    equi-join on the day. The repeated table has one row per calendar day (36,525 a century),
    so it is broadcast, and the one keyless window runs over at most that many rows.
    """
    cols = [c for c in index.columns if c != index_date]
    per_day = _one_per_day(index, index_date, "__from")
    following = F.lead("__from").over(W.orderBy("__from"))
    valid = (
        per_day.withColumn("__until", F.coalesce(F.date_sub(following, 1), F.col("__from")))
        .withColumn("__day", F.explode(F.sequence("__from", "__until")))
        .select("__day", *cols)
    )
    last = per_day.agg(F.max("__from")).scalar()
    day = F.col(date).cast("date")
    keyed = df.withColumn("__day", F.when(day.isNotNull(), F.least(day, last)))
    return keyed.join(F.broadcast(valid), "__day", "left").select(*df.columns, *cols)


def add_region(df: DataFrame, *cols) -> DataFrame:
    """Region attributes by a 7-row broadcast."""
    cols = cols or ("latitude", "elevation_m", "area_weight", "label")
    return df.join(K.regions(df.sparkSession).select("region", *cols), "region", "left")


def compare_with_normal(forecast: DataFrame, normal: DataFrame) -> DataFrame:
    """Forecast rows with the normal of their region and month; adaptive execution measures the normals."""
    named = normal.select(
        "region", "month", *[F.col(c).alias(f"{c}_normal") for c in ("precipitation_mm", "snowfall_cm")])
    return forecast.join(named, ["region", "month"], "left")


def split_years(history: DataFrame, held_out: DataFrame, col="water_year"):
    """(train, test) by a short list of held-out years."""
    years = F.broadcast(held_out.select(col))
    return history.join(years, col, "left_anti"), history.join(years, col, "left_semi")


def scenario_grid(scenarios: DataFrame) -> DataFrame:
    """42 region-months for every scenario row, by exploding a fixed array."""
    cells = F.array(*[
        F.struct(F.lit(r[0]).alias("region"), F.lit(m).alias("month"))
        for r in K.REGIONS for m in K.WINTER_MONTHS
    ])
    return scenarios.withColumn("__cell", F.explode(cells)).select(
        *scenarios.columns, "__cell.region", "__cell.month")


def fan_out(df: DataFrame, scenarios) -> DataFrame:
    """Every data row once per scenario, by exploding the scenario list.

    `scenarios` is a Python list of (name, description, numbers, phase, category).
    """
    structs = F.array(*[scenario_literal(s) for s in scenarios])
    return df.withColumn("scenario", F.explode(structs))


def scenario_literal(s):
    name, description, numbers, phase, category = s
    pairs = [F.lit(x) for k, v in numbers.items() for x in (k, float(v))]
    parameters = F.create_map(*pairs) if pairs else F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<double>"))
    return F.struct(
        F.lit(name).alias("name"), F.lit(description).alias("description"),
        parameters.alias("parameters"), F.lit(phase).cast("string").alias("phase"),
        F.lit(category).alias("category"))


def as_forecast(history: DataFrame, year: int | None = None) -> DataFrame:
    """All observed winters, or one of them, in the shape of a forecast."""
    picked = history if year is None else history.where(F.col("water_year") == year)
    return add_region(picked, "area_weight").withColumn(
        "period", period_label("water_year", "month"))
