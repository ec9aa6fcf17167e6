"""Row-ordered work inside a key (a station) that stays parallel when one key is huge.

A plain `Window.partitionBy(station)` sorts each station in one task. That is the cheapest
plan as long as every station fits a task, so it is used whenever a count per key (partial
aggregation, key columns only) shows no key above `hot_rows`. Keys above it are cut into
chunks of consecutive rows:

* bounded frames (lags, rolling windows, sequences): each chunk also receives the `reach`
  rows before it, marked as halo and dropped after the window;
* unbounded frames (running sums, nearest known value): totals per calendar day first, a
  running value over the days, then the rows inside each day.

The calendar bounds the number of days per key, so no step sees a whole hot key at once.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

HOT_ROWS = 2_000_000
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Series:
    """Key columns, order columns (the first one is a date or timestamp) and the row limit."""

    keys: tuple = ("station_id",)
    order: tuple = ("date",)
    hot_rows: int = HOT_ROWS

    def day(self):
        return F.col(self.order[0]).cast("date")

    def sort(self):
        return [F.col(c).asc_nulls_first() for c in self.order]

    def window(self, *extra):
        return W.partitionBy(*self.keys, *extra).orderBy(*self.sort())


def join_same(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the right copies of the keys go away."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])




def hot_keys(df: DataFrame, series: Series):
    """Keys with more rows than one task should sort, or None.

    A short list is broadcast; a longer one than that joins as adaptive execution decides.
    """
    hot = (
        df.groupBy(*series.keys).agg(F.count("*").alias("__n"))
        .where(F.col("__n") > series.hot_rows).select(*series.keys)
    )
    rows = hot.take(BROADCAST_ROWS + 1)
    if not rows:
        return None
    if len(rows) > BROADCAST_ROWS:
        return hot
    return F.broadcast(df.sparkSession.createDataFrame(rows, hot.schema))


def no_hot_join(left: DataFrame, right: DataFrame, series: Series) -> bool:
    """Whether a left join on the series' keys, and more, is sure to have no hot key: row counts per key bound it without the join."""
    sides = [d.groupBy(*series.keys).agg(F.count("*").alias(n)) for d, n in ((left, "__n"), (right, "__m"))]
    rows = F.col("__n").cast("double") * F.greatest(F.coalesce("__m", F.lit(0)), F.lit(1))
    return (sides[0].join(sides[1], list(series.keys), "left").agg(F.max(rows)).first()[0] or 0) <= series.hot_rows


def split_hot(df: DataFrame, hot: DataFrame, series: Series):
    return (
        join_same(df, hot, series.keys, "left_anti"),
        join_same(df, hot, series.keys, "left_semi"),
    )


def numbered(df: DataFrame, series: Series, name="__rn") -> DataFrame:
    """Row number from 0 per key, from counts per day and a number inside each day."""
    days = df.withColumn("__day", series.day())
    per_day = days.groupBy(*series.keys, "__day").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*series.keys).orderBy(F.col("__day").asc_nulls_first())
    offsets = per_day.select(
        *series.keys, "__day",
        F.coalesce(
            F.sum("__n").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
    )
    inside = F.row_number().over(series.window("__day"))
    return (
        join_same(days, offsets, [*series.keys, "__day"])
        .withColumn(name, F.col("__before") + inside - 1)
        .drop("__before", "__day")
    )


def positions(df: DataFrame, series: Series, name="position", hot="find") -> DataFrame:
    """Row number from 1 per key; hot keys are numbered day by day."""
    if isinstance(hot, str):
        hot = hot_keys(df, series)

    def plain(part):
        return part.withColumn(name, F.row_number().over(series.window()).cast("long"))

    if hot is None:
        return plain(df)
    cold, heavy = split_hot(df, hot, series)
    return plain(cold).unionByName(numbered(heavy, series, name).withColumn(name, F.col(name) + 1))


def chunked(df: DataFrame, series: Series, reach: int, hot: DataFrame):
    """Add `__chunk` and `__halo` so that frames of up to `reach` earlier rows fit a chunk.

    Keys that are not hot keep one chunk.
    """
    cold, heavy = split_hot(df, hot, series)
    size = max(series.hot_rows, 2 * reach, 1)
    own = F.floor(F.col("__rn") / size)
    needed_later = F.col("__rn") % size >= size - reach
    heavy = (
        numbered(heavy, series)
        .withColumn("__own", own)
        .withColumn(
            "__chunk",
            F.explode(
                F.when(needed_later, F.array("__own", F.col("__own") + 1))
                .otherwise(F.array("__own"))
            ),
        )
        .withColumn("__halo", F.col("__chunk") != F.col("__own"))
        .drop("__own", "__rn")
    )
    cold = cold.withColumns({"__chunk": F.lit(0).cast("long"), "__halo": F.lit(False)})
    return cold.unionByName(heavy)


def over_rows(df: DataFrame, series: Series, reach: int, *builds, hot="find") -> DataFrame:
    """Add the columns of `build(window)`; frames may look back `reach` rows at most.

    A later build may use columns of those before it; `reach` counts back from the last one then.
    All columns share one window specification, so there is one shuffle and one sort.
    """
    if isinstance(hot, str):
        hot = hot_keys(df, series)

    def made(part, w):
        for build in builds:
            part = part.select("*", *[c.alias(n) for n, c in build(w).items()])
        return part

    if hot is None:
        return made(df, series.window())
    return made(chunked(df, series, reach, hot), series.window("__chunk")).where(~F.col("__halo")).drop(
        "__chunk", "__halo"
    )


def running_sums(df: DataFrame, series: Series, sums: dict, hot="find") -> DataFrame:
    """Add running sums `{new: column}` over all rows of the key up to the current one.

    A NULL input adds nothing and leaves its own row NULL.
    """
    if isinstance(hot, str):
        hot = hot_keys(df, series)

    def masked(total, c):
        return F.when(F.col(c).isNotNull(), total)

    def plain(part):
        w = series.window().rowsBetween(W.unboundedPreceding, 0)
        return part.select("*", *[masked(F.sum(c).over(w), c).alias(n) for n, c in sums.items()])

    if hot is None:
        return plain(df)
    cold, heavy = split_hot(df, hot, series)
    days = heavy.withColumn("__day", series.day())
    per_day = days.groupBy(*series.keys, "__day").agg(
        *[F.sum(c).alias(f"__d_{n}") for n, c in sums.items()]
    )
    before = (
        W.partitionBy(*series.keys).orderBy(F.col("__day").asc_nulls_first())
        .rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = per_day.select(
        *series.keys, "__day", *[F.sum(f"__d_{n}").over(before).alias(f"__b_{n}") for n in sums]
    )
    inside = series.window("__day").rowsBetween(W.unboundedPreceding, 0)
    heavy = join_same(days, offsets, [*series.keys, "__day"]).select(
        *df.columns,
        *[
            masked(F.coalesce(F.col(f"__b_{n}"), F.lit(0)) + F.sum(c).over(inside), c).alias(n)
            for n, c in sums.items()
        ],
    )
    return plain(cold).unionByName(heavy)


def nearest_known(df: DataFrame, series: Series, cols, hot="find") -> DataFrame:
    """Add `__prev_c` and `__next_c`, structs (at, value) of the nearest known values."""
    if isinstance(hot, str):
        hot = hot_keys(df, series)
    at = F.col(series.order[0])

    def known(c):
        return F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("value")))

    def sides(*extra):
        # Both directions as running frames: a frame that ends at the last row is quadratic.
        part = W.partitionBy(*series.keys, *extra)
        running = (W.unboundedPreceding, 0)
        back = part.orderBy(*series.sort()).rowsBetween(*running)
        ahead = part.orderBy(*[F.col(c).desc_nulls_last() for c in series.order]).rowsBetween(*running)
        return {
            c: (F.last(known(c), True).over(back), F.last(known(c), True).over(ahead)) for c in cols
        }

    def plain(part):
        found = sides()
        return part.select(
            "*",
            *[p.alias(f"__prev_{c}") for c, (p, _) in found.items()],
            *[n.alias(f"__next_{c}") for c, (_, n) in found.items()],
        )

    if hot is None:
        return plain(df)
    cold, heavy = split_hot(df, hot, series)
    days = heavy.withColumn("__day", series.day())
    rank = F.struct(*series.order)
    per_day = days.groupBy(*series.keys, "__day").agg(
        *[F.max_by(known(c), F.when(F.col(c).isNotNull(), rank)).alias(f"__l_{c}") for c in cols],
        *[F.min_by(known(c), F.when(F.col(c).isNotNull(), rank)).alias(f"__f_{c}") for c in cols],
    )
    over_days = W.partitionBy(*series.keys)
    before = (W.unboundedPreceding, -1)
    earlier = over_days.orderBy(F.col("__day").asc_nulls_first()).rowsBetween(*before)
    later = over_days.orderBy(F.col("__day").desc_nulls_last()).rowsBetween(*before)
    carried = per_day.select(
        *series.keys, "__day",
        *[F.last(f"__l_{c}", True).over(earlier).alias(f"__cl_{c}") for c in cols],
        *[F.last(f"__f_{c}", True).over(later).alias(f"__cf_{c}") for c in cols],
    )
    found = sides("__day")
    heavy = join_same(days, carried, [*series.keys, "__day"]).select(
        *df.columns,
        *[F.coalesce(p, F.col(f"__cl_{c}")).alias(f"__prev_{c}") for c, (p, _) in found.items()],
        *[F.coalesce(n, F.col(f"__cf_{c}")).alias(f"__next_{c}") for c, (_, n) in found.items()],
    )
    return plain(cold).unionByName(heavy)
