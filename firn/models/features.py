"""Model inputs: scaling, splits, encodings and autoregressive features."""

import math

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, functions as F

from firn.functions.scalars import numeric_columns
from firn.operators.quantiles import exact_quantiles, order_statistics
from firn.operators.series import Series, over_rows

SCALERS = ("standard", "minmax", "robust", "none")
#: Columns of one aggregate; code generated for many more is too long to be compiled.
AGG_COLUMNS = 8


def fit_scaler(df: DataFrame, cols=None, method="standard") -> dict:
    """{column: (centre, scale)}. Population deviation, exact quartiles, scale 1 without spread."""
    if method not in SCALERS:
        raise ValueError(f"Unknown scaling method {method!r}; expected one of {SCALERS}")
    cols = cols or numeric_columns(df)
    if method == "none" or not cols:
        return {}
    if method == "robust":
        q = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols})
        pairs = {c: (m, b - a) for c, (a, m, b) in q.items() if m is not None}
    else:
        centre, spread = (F.avg, F.stddev_pop) if method == "standard" else (
            F.min, lambda c: F.max(c) - F.min(c))
        pairs = {}
        for at in range(0, len(cols), AGG_COLUMNS):
            part = cols[at: at + AGG_COLUMNS]
            row = df.agg(*[x for i, c in enumerate(part) for x in (
                centre(c).alias(f"c{i}"), spread(c).alias(f"s{i}"))]).first()
            pairs |= {c: (row[f"c{i}"], row[f"s{i}"]) for i, c in enumerate(part) if row[f"c{i}"] is not None}
    return {c: (float(m), float(s) or 1.0) for c, (m, s) in pairs.items()}


def apply_scaler(df: DataFrame, scaler: dict) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scaler.items()})


def unscale(col, pair) -> Column:
    centre, scale = pair
    return F.col(col) * scale + centre


def tie_key(station="station_id") -> Column:
    """A number that orders the stations of one day; spread evenly so it can be bracketed."""
    return F.conv(F.substring(F.md5(station), 1, 15), 16, 10).cast("bigint")


def temporal_split(df: DataFrame, test_size=0.2, date="date", station="station_id"):
    """(train, test): the first int(n (1 - t)) rows in time train.

    Only counts per calendar day reach the driver, and no row is sorted: the cut day is found
    from them, and inside it the cut station is an exact order statistic. Rows with the same
    station and day stay together; rows without a date test.
    """
    day = F.col(date).cast("date")
    counts = df.groupBy(day.alias("day")).agg(F.count("*").alias("n")).collect()
    left = int(sum(r["n"] for r in counts) * (1 - test_size))
    cut = None
    for r in sorted((r for r in counts if r["day"] is not None), key=lambda r: r["day"]):
        if left < r["n"]:
            cut = r["day"]
            break
        left -= r["n"]
    if cut is None:
        before = day.isNotNull()
    else:
        before = day < F.lit(cut)
        if left > 0:
            tied = df.where(day == F.lit(cut)).select(tie_key(station).alias("t"))
            n = next(r["n"] for r in counts if r["day"] == cut)
            last = order_statistics(tied, {"t": [left - 1]}, {"t": n})["t", left - 1]
            before = before | ((day == F.lit(cut)) & (tie_key(station) <= F.lit(last)))
    before = F.coalesce(before, F.lit(False))
    return df.where(before), df.where(~before)


def random_split(df: DataFrame, test_size=0.2, seed=42, keys=("station_id", "date")):
    """(train, test) by a hash of the key: the same row always lands on the same side."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    share = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 10_000
    test = share < int(round(test_size * 10_000))
    return df.where(~test), df.where(test)


def sparse_one_hot(cols):
    """Pipeline stages that encode text columns of any width as sparse vectors; NULL is all zero.

    Slots follow the sorted values, so the encoding does not depend on how often they occur.
    """
    indexed = [f"{c}__index" for c in cols]
    return [
        StringIndexer(inputCols=list(cols), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=[f"{c}__vector" for c in cols], dropLast=True),
    ]


def season_waves(date) -> dict:
    turn = F.dayofyear(date) * (2 * math.pi / 365.25)
    return {"season_sin": F.sin(turn), "season_cos": F.cos(turn)}


def autoregressive_names(target, lags, windows):
    return [*[f"{target}_lag_{k}" for k in lags], *[f"{target}_prev_mean_{n}" for n in windows],
            "season_sin", "season_cos"]


def autoregressive(df: DataFrame, target="swe", lags=(1, 7), windows=(7,), series=Series(),
                   hot="find") -> DataFrame:
    """Lags and trailing means of earlier known values, never the current one, plus the season."""
    known = df.where(F.col(target).isNotNull())

    def build(w):
        made = {f"{target}_lag_{k}": F.lag(target, k).over(w) for k in lags}
        return made | {
            f"{target}_prev_mean_{n}": F.avg(target).over(w.rowsBetween(-n, -1)) for n in windows}

    made = over_rows(known, series, max([*lags, *windows]), build, hot=hot)
    return made.withColumns(season_waves(series.order[0]))
