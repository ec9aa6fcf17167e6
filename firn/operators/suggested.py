"""Features by name: a list of catalogue names becomes one window pass and row-level columns.

Names follow a small grammar, so whatever suggests features (the rules, an experiment list, a
request) only has to name them:

    {column}_lag_{n}                 value n rows earlier
    {column}_roll_{mean|std|sum}_{n} trailing window of n rows, partial ones too
    {column}_full_{mean|sum}_{n}     the same once n known values fill it
    {column}_anomaly                 difference from the mean of the calendar month
    day_of_year, month, ...          calendar fields, season flags, water year
    enso_phase, enso_{cool|neutral|warm}  phase of the index and its 0/1 flags
"""

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from firn.functions import scalars as N
from firn.functions.rules import applicable_features
from firn.operators import windows as W
from firn.operators.aggregates import month_anomaly
from firn.operators.joins import join_index_month
from firn.operators.series import Series

LAG = re.compile(r"(.+)_lag_([1-9]\d*)")
ROLL = re.compile(r"(.+)_roll_(mean|std|sum)_([1-9]\d*)")
FULL = re.compile(r"(.+)_full_(mean|sum)_([1-9]\d*)")
ANOMALY = re.compile(r"(.+)_anomaly")

CALENDAR = ("year", "month", "day", "day_of_year", "week_of_year")
WATER_YEAR = ("water_year", "water_year_start", "days_since_wy_start", "days_since_oct1")
FLAGS = dict(zip(("enso_cool", "enso_neutral", "enso_warm"), N.PHASES))


@dataclass
class Compiled:
    """What a list of names needs: window builders with their reach, and row-level parts."""

    windows: dict = field(default_factory=dict)
    reach: int = 0
    calendar: list = field(default_factory=list)
    seasons: list = field(default_factory=list)
    water_year: list = field(default_factory=list)
    anomalies: dict = field(default_factory=dict)
    phases: list = field(default_factory=list)


def compile_features(names, columns, include_current=True) -> Compiled:
    """Sort the names by how they are made; a name that nothing can make is an error.

    `columns` are the columns at hand. Names among them are there already and need nothing.
    Lags and windows of all names share one specification, whose reach is the longest of them.
    """
    out, unknown = Compiled(), []
    for name in dict.fromkeys(names):
        if name in columns:
            continue
        lag, roll, full, anomaly = (p.fullmatch(name) for p in (LAG, ROLL, FULL, ANOMALY))
        if lag and lag[1] in columns:
            made, rows = W.lag_columns([lag[1]], [int(lag[2])]), int(lag[2])
        elif roll and roll[1] in columns:
            kind = {"mean": "mean", "std": "std", "sum": "total"}[roll[2]]
            rows = int(roll[3])
            made = W.rolling_columns(**{kind: [roll[1]]}, windows=[rows], include_current=include_current)
        elif full and full[1] in columns:
            made, rows = W.strict_columns([full[1]], [int(full[3])], full[2]), int(full[3])
        else:
            made, rows = {}, 0
            if name in CALENDAR:
                out.calendar.append(name)
            elif name in N.SEASONS:
                out.seasons.append(name)
            elif name in WATER_YEAR:
                out.water_year.append(name)
            elif anomaly and anomaly[1] in columns:
                out.anomalies[name] = anomaly[1]
            elif name == "enso_phase" or name in FLAGS:
                out.phases.append(name)
            else:
                unknown.append(name)
        out.windows |= made
        out.reach = max(out.reach, rows)
    if unknown:
        raise ValueError(f"no rule makes the features {unknown} from the columns {sorted(columns)}")
    return out


def make_features(df: DataFrame, names, index: DataFrame = None, series=Series(), include_current=True,
                  hot="find") -> DataFrame:
    """The rows of `df` with every named feature; its own columns come first and stay as they are.

    One shuffle and one sort for all lags and windows (hot stations in chunks), a broadcast of
    at most 13 monthly means per anomaly and of one index row a month. Phases need a column
    `oni` in `df` or in `index`. NULL inputs give NULL features; phase flags are then 0. Rows
    without a date have no calendar fields, and those of a station come before its dated ones.
    An empty list or table gives the same rows and the columns asked for.
    """
    own, date = list(df.columns), series.order[0]
    wanted = [n for n in dict.fromkeys(names) if n not in own]
    plan = compile_features(wanted, own, include_current)
    out = W.add_window_columns(df, plan.windows, plan.reach, series, hot)
    day = F.col(date).cast("date")
    fields = {"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day),
              "day_of_year": F.dayofyear(day), "week_of_year": F.weekofyear(day)}
    out = out.withColumns({n: fields[n] for n in plan.calendar})
    out = out.withColumns({n: F.month(day).isin(*N.SEASONS[n]).cast("int") for n in plan.seasons})
    if plan.water_year:
        start = F.make_date(N.water_year(date), F.lit(10), F.lit(1))
        years = {"water_year": N.water_year(date), "water_year_start": start,
                 "days_since_wy_start": F.datediff(day, start), "days_since_oct1": F.datediff(day, start)}
        out = out.withColumns({n: years[n] for n in plan.water_year})
    for name, col in plan.anomalies.items():
        kept = out.columns
        keyed = out.withColumn("__own_month", F.col("month") if "month" in kept else F.lit(None)).withColumn(
            "month", F.month(day))
        done = month_anomaly(keyed, col, name)
        done = done.withColumn("month", F.col("__own_month")) if "month" in kept else done
        out = done.select(*kept, name)
    if plan.phases:
        if "oni" not in out.columns:
            if index is None or "oni" not in index.columns:
                raise ValueError("phases need a column oni in the table or in an index")
            out = join_index_month(out, index.select("date", "oni"), date)
        phase = F.col("enso_phase") if "enso_phase" in own else N.index_phase()
        flag = lambda p: F.coalesce((phase == p).cast("int"), F.lit(0))
        out = out.withColumns({n: phase if n == "enso_phase" else flag(FLAGS[n]) for n in plan.phases})
    return out.select(*own, *wanted)


def make_suggested(df: DataFrame, target="swe", index: DataFrame = None, series=Series(), hot="find") -> DataFrame:
    """`df` with all features the rules suggest for its columns (and for those of `index`).

    The phase is suggested by the name of any index column but made from `oni`, so it is left
    out where there is no `oni`.
    """
    spark = df.sparkSession
    variables = [*df.columns, *(index.columns if index is not None else [])]
    listed = spark.createDataFrame([(v,) for v in dict.fromkeys(variables)], "column_name string")
    # At most as many rows as the fixed catalogue of suggestions.
    names = {r["feature"] for r in applicable_features(listed, target).select("feature").collect()}
    if "oni" not in variables:
        names.discard("enso_phase")
    return make_features(df, sorted(names), index, series, hot=hot)
