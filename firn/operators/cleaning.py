"""Cleaning of observation tables.

Decisions about columns come from one wide aggregate each and bring one row to the driver.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from firn import schemas as K
from firn.functions.scalars import (
    add_calendar, coerce_numbers, is_numeric, nan_to_null, numeric_columns, parse_dates,
    text_columns,
)
from firn.operators.aggregates import stack_long, with_stats
from firn.operators.quantiles import SMALL, exact_medians, exact_quantiles
from firn.operators.series import Series, nearest_known
from firn.session import materialize

KEYS = ("station_id", "date")


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact copies go. Copies of one row combine before the shuffle, however many there are."""
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return copies.agg(
        F.sum("n").alias("rows_before"), F.count("*").alias("rows_after"),
        (F.sum("n") - F.count("*")).alias("rows_removed"))


def column_facts(df: DataFrame, wide=False) -> dict:
    """{column: (missing share, constant, rough distinct count)} from one pass.

    The distinct count is only estimated for text, and only when asked for.
    """
    flat = [
        f for f in df.schema
        if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    ]
    if not flat:
        return {}
    made = []
    for i, f in enumerate(flat):
        c = F.col(f"`{f.name}`")
        made += [F.avg(c.isNull().cast("int")).alias(f"m{i}"), (F.min(c) == F.max(c)).alias(f"k{i}")]
        if wide and isinstance(f.dataType, T.StringType):
            made.append(F.approx_count_distinct(c, 0.02).alias(f"d{i}"))
    row = df.agg(*made).first().asDict()
    return {
        f.name: (row[f"m{i}"] or 0.0, bool(row[f"k{i}"]), row.get(f"d{i}"))
        for i, f in enumerate(flat)
    }


def sparse_columns(df: DataFrame, threshold=0.3, keep=KEYS, facts=None):
    facts = facts or column_facts(df)
    return [c for c, (missing, _, _) in facts.items() if c not in keep and missing > threshold]


def drop_sparse_columns(df: DataFrame, threshold=0.3, keep=KEYS) -> DataFrame:
    return df.drop(*sparse_columns(df, threshold, keep))


def fill_mean(df: DataFrame, cols=None) -> DataFrame:
    cols = cols or numeric_columns(df)
    if not cols:
        return df
    stats = df.agg(*[F.avg(c).alias(c) for c in cols])
    filled = {c: F.coalesce(F.col(c), F.col(f"__stats.{c}")) for c in cols}
    return with_stats(df, stats).withColumns(filled).drop("__stats")


def fill_median(df: DataFrame, cols=None, small=SMALL, gaps=None) -> DataFrame:
    """Medians are looked for where there is a gap; `gaps` names the columns that have one, if that is known."""
    cols, counts = cols or numeric_columns(df), None
    if gaps is None:
        n, *known = df.agg(F.count("*"), *[F.count(c) for c in cols]).first()
        counts = dict(zip(cols, known))
        gaps = [c for c in cols if counts[c] < n]
    gaps = [c for c in cols if c in gaps]
    if not gaps and df.isEmpty():
        return df
    medians = exact_medians(df, gaps, small, counts) if gaps else {}
    whole = {c: F.col(c).cast("double") for c in cols if c not in gaps}  # as wide as a filled one
    return df.withColumns(whole | {
        c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items() if m is not None})


def fill_interpolate(df: DataFrame, cols=None, series=Series(), hot="find") -> DataFrame:
    """Linear in time per station. Leading gaps stay open, trailing gaps keep the last value."""
    cols = cols or numeric_columns(df)
    at = F.col(series.order[0])

    def seconds(c):
        return F.unix_timestamp(c.cast("timestamp")).cast("double")

    near = nearest_known(df, series, cols, hot)
    filled = {}
    for c in cols:
        before, after = F.col(f"__prev_{c}"), F.col(f"__next_{c}")
        share = (seconds(at) - seconds(before["at"])) / (seconds(after["at"]) - seconds(before["at"]))
        between = before["value"] + (after["value"] - before["value"]) * share
        filled[c] = F.coalesce(F.col(c), F.when(after.isNull(), before["value"]).otherwise(between))
    return near.withColumns(filled).select(*df.columns)


def most_frequent(df: DataFrame, col: str) -> DataFrame:
    """One row: the most frequent value, the smallest one on ties. Two-phase, no hot task."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by(col, F.struct(-F.col("n"), F.col(col))).alias(col))


def fill_most_frequent(df: DataFrame, cols=None) -> DataFrame:
    cols = cols or text_columns(df)
    return df.withColumns({
        c: F.coalesce(F.col(c), most_frequent(df, c).scalar()) for c in cols})


def handle_missing(df: DataFrame, strategy="median", threshold=0.3, keep=KEYS, series=Series(),
                   k=5, gaps=None) -> DataFrame:
    """Drop sparse columns, fill numbers by the strategy, then fill text by its mode.

    `gaps` names the columns with unknown values, if that is known.
    """
    from firn.operators.neighbours import fill_knn

    if threshold < 1:
        df = drop_sparse_columns(df, threshold, keep)
    nums = numeric_columns(df, keep)
    fills = {
        "drop": lambda d: d.na.drop("any"), "mean": lambda d: fill_mean(d, nums),
        "median": lambda d: fill_median(d, nums, gaps=gaps), "knn": lambda d: fill_knn(d, nums, k),
        "interpolate": lambda d: fill_interpolate(d, nums, series),
    }
    if strategy not in fills:
        raise ValueError(f"Unknown strategy {strategy!r}; expected one of {sorted(fills)}")
    df = fills[strategy](df)
    texts = text_columns(df, keep)
    return fill_most_frequent(df, texts) if texts else df


def _clip(c, low, high):
    """Clip known values only: greatest and least would skip the NULL."""
    return F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), low), high))


def cap_zscore(df: DataFrame, cols=None, threshold=3.0, targets=()) -> DataFrame:
    """Clip to mean +- t sample deviations where some value lies beyond t population deviations.

    With `targets`, only those; without any of them present, every numeric column.
    """
    nums = numeric_columns(df)
    cols = cols or [c for c in targets if c in nums] or nums
    if not cols:
        return df
    parts = {}
    for c in cols:
        parts |= {f"{c}__m": F.avg(c), f"{c}__s": F.stddev_samp(c), f"{c}__p": F.stddev_pop(c),
                  f"{c}__lo": F.min(c), f"{c}__hi": F.max(c)}
    stats = df.agg(*[v.alias(k) for k, v in parts.items()])
    capped = {}
    for c in cols:
        m, s, p, lo, hi = [F.col(f"__stats.{c}__{x}") for x in ("m", "s", "p", "lo", "hi")]
        outlying = F.greatest(hi - m, m - lo) > threshold * p
        capped[c] = F.when(outlying, _clip(c, m - threshold * s, m + threshold * s)).otherwise(
            F.col(c).cast("double"))
    return with_stats(df, stats).withColumns(capped).drop("__stats")


def cap_iqr(df: DataFrame, cols=None, threshold=3.0, small=SMALL) -> DataFrame:
    """Clip to Q1 - t IQR and Q3 + t IQR with exact interpolated quartiles."""
    cols = cols or numeric_columns(df)
    quartiles = exact_quantiles(df, {c: [0.25, 0.75] for c in cols}, small)
    capped = {}
    for c, (q1, q3) in quartiles.items():
        if q1 is not None:
            reach = threshold * (q3 - q1)
            capped[c] = _clip(c, F.lit(q1 - reach), F.lit(q3 + reach))
    return df.withColumns(capped)


def constant_columns(df: DataFrame, keep=KEYS, facts=None):
    facts = facts or column_facts(df)
    return [c for c, (_, constant, _) in facts.items() if c not in keep and constant]


def drop_constant_columns(df: DataFrame, keep=KEYS) -> DataFrame:
    """Columns with exactly one distinct known value; all-NULL columns stay."""
    return df.drop(*constant_columns(df, keep))


def wide_text_columns(df: DataFrame, limit=50, keep=KEYS, facts=None):
    """Text columns with more than `limit` values. The estimate decides far from the limit and
    an exact count, of few values by then, near it."""
    facts = facts or column_facts(df, wide=True)
    rough = {c: d for c, (_, _, d) in facts.items() if d is not None and c not in keep}
    wide = {c for c, d in rough.items() if d > 2 * limit}
    close = [c for c, d in rough.items() if limit / 2 <= d <= 2 * limit]
    if close:
        exact = df.agg(*[F.count_distinct(c).alias(c) for c in close]).first()
        wide |= {c for c in close if exact[c] > limit}
    return [c for c in rough if c in wide]


def drop_wide_text_columns(df: DataFrame, limit=50, keep=KEYS) -> DataFrame:
    return df.drop(*wide_text_columns(df, limit, keep))


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Long table (side, column, rows, columns, missing, mean, std, min, max)."""
    fields = ["row_count", "column_count", "missing_count", "mean_value", "std_value", "min_value",
              "max_value"]

    def side(df, label):
        made = {}
        for f in df.schema:
            c, number = f.name, is_numeric(f.dataType)
            none = F.lit(None).cast("double")
            made |= {
                f"{c}__row_count": F.count("*"), f"{c}__column_count": F.lit(len(df.columns)),
                f"{c}__missing_count": F.count("*") - F.count(c),
                f"{c}__mean_value": F.avg(c) if number else none,
                f"{c}__std_value": F.stddev_samp(c) if number else none,
                f"{c}__min_value": F.min(c).cast("double") if number else none,
                f"{c}__max_value": F.max(c).cast("double") if number else none,
            }
        wide = df.agg(*[v.alias(k) for k, v in made.items()])
        return stack_long(wide, df.columns, fields).withColumn("side", F.lit(label))

    return side(before, "original").unionByName(side(after, "cleaned"))


def clean(df: DataFrame, targets=("swe", "snow_depth"), strategy="median", threshold=0.3,
          outlier_threshold=3.0, keep=KEYS, series=Series()) -> DataFrame:
    """Coerce, parse dates, add calendar, drop copies, fill gaps, cap, drop useless columns.

    Station and date always stay, and so do the targets. The deduplicated table is written
    once; the passes after it read single columns of it. Filling and capping cannot make a
    column constant or wide, so which columns go is decided from one pass; `drop` removes rows,
    so it is decided after that.
    """
    keep = tuple(dict.fromkeys([*keep, *targets]))
    df = coerce_numbers(nan_to_null(df), skip=KEYS)
    df = drop_duplicates(parse_dates(df, series.order[0]))
    df = materialize(add_calendar(df, series.order[0]))  # of equal rows, so it need not be compared
    # What stays anyway is only asked for gaps to fill.
    asked = lambda d: d.drop(*[c for c in keep if c in d.columns and c not in numeric_columns(d)])
    facts = column_facts(asked(df), wide=True)
    df = df.drop(*sparse_columns(df, threshold, keep, facts))
    if strategy == "drop":
        df = materialize(df.na.drop("any"))
        facts = column_facts(asked(df), wide=True)
    facts = {c: facts[c] for c in df.columns if c in facts}
    useless = {*constant_columns(df, keep, facts), *wide_text_columns(df, keep=keep, facts=facts)}
    gaps = [c for c, (missing, _, _) in facts.items() if missing]
    df = handle_missing(df.drop(*useless), strategy, 1.0, KEYS, series, gaps=gaps)
    present = [t for t in targets if t in numeric_columns(df)]
    return cap_zscore(df, present or numeric_columns(df, KEYS), outlier_threshold)


def history_violations(history: DataFrame) -> DataFrame:
    """One row per broken rule: rule name and number of rows. Regions come with their name."""
    months = F.col("month").isin(*K.WINTER_MONTHS)
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in K.HISTORY_NUMBERS])
    negative = (F.col("precipitation_mm") < 0) | (F.col("snowfall_cm") < 0)
    known = F.coalesce(F.col("region").isin(*[r[0] for r in K.REGIONS]), F.lit(False))
    rules = {
        "no_rows": F.when(F.count("*") == 0, 1).otherwise(0),
        "month_outside_winter": F.count_if(~months),
        "unknown_region": F.count_if(~known),
        "missing_number": F.count_if(missing),
        "negative_amount": F.count_if(negative),
    }
    wide = history.agg(*[v.cast("bigint").alias(f"{k}__rows") for k, v in rules.items()])
    return stack_long(wide, list(rules), ["rows"], "rule").where("rows > 0")


def validate_history(history: DataFrame) -> DataFrame:
    """The history itself, or an error that names what is wrong with it."""
    required = {"region", *K.HISTORY_NUMBERS}
    absent = sorted(required - set(history.columns))
    if absent:
        raise ValueError(f"History is missing required columns: {absent}")
    broken = history_violations(history).collect()
    if broken:
        raise ValueError("History breaks rules: " + ", ".join(
            f"{r['rule']} ({r['rows']} rows)" for r in broken))
    return history


FORECAST_INPUTS = ("year", *K.CLIMATE_INDICES)


def numeric_inputs_valid(cols=FORECAST_INPUTS):
    """True when every input is a finite number."""
    def finite(c):
        n = F.col(c).try_cast("double")
        return F.coalesce(~F.isnan(n) & (F.abs(n) != F.lit(float("inf"))), F.lit(False))

    return reduce(lambda a, b: a & b, [finite(c) for c in cols])


def split_inputs(requests: DataFrame, cols=FORECAST_INPUTS):
    """(usable requests with numbers, rejected requests)."""
    ok = numeric_inputs_valid(cols)
    good = requests.where(ok).withColumns({c: F.col(c).try_cast("double") for c in cols})
    return good, requests.where(~ok)


def clamp_at_zero(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.col(c)))
                           for c in cols})
