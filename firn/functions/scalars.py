"""Row-level features: dates, seasons, index phases, units and display text."""

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Index phase labels and their bin edges (right-closed).
PHASES = ("La Niña", "Neutral", "El Niño")
PHASE_EDGE = 0.5

SEASONS = {
    "is_winter": (12, 1, 2), "is_spring": (3, 4, 5), "is_summer": (6, 7, 8),
    "is_fall": (9, 10, 11),
}

# Unit conversions and unit labels.
MM_PER_INCH, CM_PER_INCH = 25.4, 2.54
UNIT_LABELS = {
    "metric": {"temperature": "C", "precipitation": "mm", "snowfall": "cm"},
    "imperial": {"temperature": "F", "precipitation": "in", "snowfall": "in"},
}


def is_numeric(dtype) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame, skip=()):
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in skip]


def text_columns(df: DataFrame, skip=()):
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN poisons sums and counts as known in Spark, so every reader turns it into NULL."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def add_missing(df: DataFrame, columns: dict) -> DataFrame:
    """Add the columns that are not there yet."""
    return df.withColumns({n: c for n, c in columns.items() if n not in df.columns})


#: What counts as a number; a cast alone would also take type suffixes such as `1d`.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
NOT_A_NUMBER = r"^\s*[+-]?(?i:nan)\s*$"


def number_of(col) -> Column:
    """The number a text holds, else NULL."""
    return F.when(F.col(col).rlike(NUMBER), F.col(col).try_cast("double"))


def coerce_numbers(df: DataFrame, skip=()) -> DataFrame:
    """Turn a text column into numbers if every known value parses; one pass for all columns.

    A `NaN` text is an unknown number.
    """
    cols = text_columns(df, skip)
    if not cols:
        return df
    bad = df.agg(*[
        F.count_if(F.col(c).isNotNull() & number_of(c).isNull() & ~F.col(c).rlike(NOT_A_NUMBER)).alias(c)
        for c in cols
    ]).first()
    return df.withColumns({c: number_of(c) for c in cols if bad[c] == 0})


def find_date_column(df: DataFrame, name="date") -> str:
    if name in df.columns:
        return name
    for c in df.columns:
        if "date" in c.lower():
            return c
    raise ValueError(f"No date column among {df.columns}")


def parse_dates(df: DataFrame, name="date") -> DataFrame:
    """Make the date column a DATE; text that is no date becomes NULL."""
    c = find_date_column(df, name)
    if isinstance(df.schema[c].dataType, T.StringType):
        return df.withColumn(c, F.try_to_date(c))
    return df.withColumn(c, F.col(c).cast("date"))


def add_calendar(df: DataFrame, date="date") -> DataFrame:
    return add_missing(df, {
        "year": F.year(date), "month": F.month(date), "day": F.dayofmonth(date),
        "day_of_year": F.dayofyear(date), "week_of_year": F.weekofyear(date),
    })


def add_season_flags(df: DataFrame) -> DataFrame:
    return add_missing(df, {n: F.col("month").isin(*m).cast("int") for n, m in SEASONS.items()})


def add_cyclic(df: DataFrame) -> DataFrame:
    turn = {"month": 2 * math.pi / 12, "day": 2 * math.pi / 31}
    return add_missing(df, {
        f"{c}_{fn}": getattr(F, fn)(F.col(c) * t) for c, t in turn.items() for fn in ("sin", "cos")
    })


def water_year(date, label="start") -> Column:
    """October to September, named after the calendar year it starts or ends in."""
    late = F.month(date) >= 10
    if label == "start":
        return F.when(late, F.year(date)).otherwise(F.year(date) - 1)
    if label == "end":
        return F.when(late, F.year(date) + 1).otherwise(F.year(date))
    raise ValueError("label must be 'start' or 'end'")


def add_water_year(df: DataFrame, date="date") -> DataFrame:
    start = F.make_date(water_year(date), F.lit(10), F.lit(1))
    return add_missing(df, {
        "water_year": water_year(date), "water_year_start": start,
        "days_since_wy_start": F.datediff(date, start),
        "days_since_oct1": F.datediff(date, start),
    })


def period_label(year, month) -> Column:
    """`YYYY-MM` of a winter month; October and later lie in the year before."""
    y, m = F.col(year), F.col(month)
    return F.format_string("%d-%02d", F.when(m >= 10, y - 1).otherwise(y), m)


def season_label(year) -> Column:
    """`2026-27` for water year 2027."""
    return F.format_string("%d-%02d", F.col(year) - 1, F.pmod(F.col(year), F.lit(100)))


def index_phase(col="oni") -> Column:
    c = F.col(col)
    return (
        F.when(c <= -PHASE_EDGE, PHASES[0]).when(c <= PHASE_EDGE, PHASES[1]).when(
            c.isNotNull(), PHASES[2])
    )


def one_hot(df: DataFrame, col: str, values=None, prefix=None, limit=500) -> DataFrame:
    """0/1 columns per value, all zero for NULL. The value list is sorted and size-checked.

    With more than `limit` values use `models.features.sparse_one_hot`, which keeps a vector.
    """
    if values is None:
        rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"{col} has more than {limit} values; use a sparse encoding")
        values = sorted(r[0] for r in rows)
    return df.withColumns({
        f"{prefix or col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values
    })


def check_units(units: str):
    if units not in UNIT_LABELS:
        raise ValueError("units must be 'metric' or 'imperial'")


def temp_delta_f(c) -> Column:
    return F.col(c) * 9 / 5


def mm_to_inches(c) -> Column:
    return F.col(c) / MM_PER_INCH


def cm_to_inches(c) -> Column:
    return F.col(c) / CM_PER_INCH


def unit_pairs(temperature, precipitation, snowfall) -> dict:
    """Both unit systems side by side as structs."""
    return {
        "temperature": F.struct(F.col(temperature).alias("c"), temp_delta_f(temperature).alias("f_delta")),
        "precipitation": F.struct(
            F.col(precipitation).alias("mm"), mm_to_inches(precipitation).alias("in")),
        "snowfall": F.struct(F.col(snowfall).alias("cm"), cm_to_inches(snowfall).alias("in")),
    }


def fixed_text(col, digits=1, plus=False) -> Column:
    """Fixed digits as text, halves away from zero; `plus` marks values above zero."""
    c = F.col(col) if isinstance(col, str) else col
    scale = 10 ** digits
    n = F.floor(F.abs(c) * scale + 0.5)
    whole = F.floor(n / scale).cast("string")
    body = whole if digits == 0 else F.concat(
        whole, F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))
    sign = F.when(c < 0, "-").when((c > 0) if plus else F.lit(False), "+").otherwise("")
    return F.concat(sign, body)


def python_signed_text(col, digits=1) -> Column:
    """Like `fixed_text(plus=True)` but zero also carries a plus."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c == 0, F.concat(F.lit("+"), fixed_text(c, digits))).otherwise(
        fixed_text(c, digits, plus=True))


def anomaly_text(col, units="metric", digits=1) -> Column:
    check_units(units)
    value = F.col(col) if units == "metric" else temp_delta_f(col)
    return F.concat(fixed_text(value, digits, plus=True), F.lit(f" {UNIT_LABELS[units]['temperature']}"))


def amount_text(col, units="metric", kind="precipitation") -> Column:
    """Whole metric amounts, inches with one digit."""
    check_units(units)
    if units == "metric":
        return F.floor(F.col(col) + 0.5).cast("string")
    return fixed_text(mm_to_inches(col) if kind == "precipitation" else cm_to_inches(col), 1)


def vs_normal_text(pct) -> Column:
    p = F.col(pct)
    return F.concat(
        F.when(p >= 100, "+").otherwise(""), F.floor(p - 100 + 0.5).cast("string"),
        F.lit("% vs normal"))
