"""Window features per station, ordered by date. Frames count rows, not calendar days."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from firn.operators.series import Series, over_rows, running_sums

LAGS = (1, 7, 30, 90)
WINDOWS = (7, 30, 90)
#: Most frames that a longer one is joined from.
MAX_PARTS = 12


def trailing(w, rows, include_current=True):
    """Frame of the last `rows` rows; without the current row it shifts back by one."""
    return w.rowsBetween(-(rows - 1), 0) if include_current else w.rowsBetween(-rows, -1)


@dataclass(frozen=True)
class Rolling:
    """Builder of a trailing mean, sample deviation or sum over partial windows, too."""

    kind: str
    column: str
    rows: int
    include_current: bool = True

    def __call__(self, w):
        fn = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}[self.kind]
        return fn(self.column).over(trailing(w, self.rows, self.include_current))


def lag_columns(cols, periods=LAGS):
    """{name: builder} for lagged values."""
    return {f"{c}_lag_{k}": (lambda w, c=c, k=k: F.lag(c, k).over(w)) for k in periods for c in cols}


def rolling_columns(mean=(), std=(), total=(), windows=WINDOWS, include_current=True):
    """{name: builder} for rolling means, sample deviations and sums over partial windows too."""
    return {f"{c}_roll_{kind}_{n}": Rolling(kind, c, n, include_current)
            for kind, cols in (("mean", mean), ("std", std), ("sum", total)) for n in windows for c in cols}


def strict_columns(cols, windows, kind="mean"):
    """{name: builder} that stay NULL until `n` known values fill the window."""
    fn = {"mean": F.avg, "sum": F.sum}[kind]
    made = {}
    for n in windows:
        for c in cols:
            made[f"{c}_full_{kind}_{n}"] = lambda w, c=c, n=n: F.when(
                F.count(c).over(trailing(w, n)) == n, fn(c).over(trailing(w, n))
            )
    return made


def add_window_columns(df: DataFrame, columns: dict, reach: int, series=Series(), hot="find"):
    """Add the named columns that `df` does not have yet, all in one pass.

    Spark adds up a frame anew for every row, so a long one costs its length. Where a shorter one
    among the asked divides it, its sums at every so many rows before make the longer one.
    """
    fresh = {n: b for n, b in columns.items() if n not in df.columns}
    if not fresh:
        return df
    short = _short_frames(df, fresh)
    if not short:
        return over_rows(df, series, reach, lambda w: {n: b(w) for n, b in fresh.items()}, hot=hot)
    parts = {}
    for n, rows in short.items():
        b = fresh[n]
        shares, lags = parts.setdefault((b.column, rows, b.include_current), (set(), set()))
        shares |= {"sum", "count"} | ({"var"} if b.kind == "std" else set())
        lags |= set(range(rows, b.rows, rows))
    fn = {"sum": F.sum, "count": F.count, "var": F.var_pop}
    name = lambda share, key, back: f"__{share}_{key[0]}_{key[1]}_{int(key[2])}_{back}"

    def first(w):
        own = {n: b(w) for n, b in fresh.items() if n not in short}
        return own | {name(s, key, 0): fn[s](key[0]).over(trailing(w, *key[1:])) for key, (shares, _) in parts.items() for s in sorted(shares)}

    def back(w):
        return {name(s, key, k): F.lag(F.col(f"`{name(s, key, 0)}`"), k).over(w)
                for key, (shares, lags) in parts.items() for s in sorted(shares) for k in sorted(lags)}

    made = over_rows(df, series, reach, first, back, hot=hot)
    joined = {}
    for n, rows in short.items():
        b = fresh[n]
        key = (b.column, rows, b.include_current)
        joined[n] = _joined(b.kind, [{s: F.col(f"`{name(s, key, k)}`") for s in parts[key][0]} for k in range(0, b.rows, rows)])
    return made.select(*[F.col(f"`{c}`") for c in df.columns], *[joined.get(n, F.col(f"`{n}`")).alias(n) for n in fresh])


def _short_frames(df, columns):
    """{name: rows of the frame that divides its own or is it}; only of doubles, whose type sums keep."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    rolling = {n: b for n, b in columns.items() if isinstance(b, Rolling) and b.column in doubles}
    out = {}
    for n, b in rolling.items():
        fit = [o.rows for o in rolling.values() if o.include_current == b.include_current and 1 < o.rows < b.rows
               and b.rows % o.rows == 0 and b.rows <= MAX_PARTS * o.rows]
        if fit:
            out[n] = max(fit)
    # What the parts hold anyway is not added up twice.
    held = {(rolling[n].column, rows, rolling[n].include_current) for n, rows in out.items()}
    same = {n: b.rows for n, b in rolling.items() if (b.column, b.rows, b.include_current) in held}
    return same | out


def _joined(kind, parts):
    """The mean, deviation or sum of frames that follow one another; the deviation from their means and variances."""
    add = lambda cols: reduce(Column.__add__, cols)
    counts = [F.coalesce(p["count"], F.lit(0)) for p in parts]
    n, total = add(counts), add([F.coalesce(p["sum"], F.lit(0.0)) for p in parts])
    if kind != "std":
        return F.when(n > 0, total if kind == "sum" else total / n)
    mean = total / n
    squares = add([F.when(k > 0, k * (p["var"] + F.pow(p["sum"] / k - mean, 2))).otherwise(0.0) for k, p in zip(counts, parts)])
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def add_lags(df, cols=("swe", "temperature", "precipitation"), periods=LAGS, series=Series(),
             hot="find"):
    present = [c for c in cols if c in df.columns]
    return add_window_columns(df, lag_columns(present, periods), max(periods), series, hot)


def add_rolling(df, target="swe", windows=WINDOWS, series=Series(), include_current=True,
                hot="find"):
    """Rolling mean of target and temperature, deviation of target, sum of precipitation."""
    mean = [c for c in (target, "temperature") if c in df.columns]
    total = [c for c in ("precipitation",) if c in df.columns]
    made = rolling_columns(mean, [target], total, windows, include_current)
    return add_window_columns(df, made, max(windows), series, hot)


def add_strict_rolling(df, cols, windows, kind="mean", series=Series(), hot="find"):
    return add_window_columns(df, strict_columns(cols, windows, kind), max(windows), series, hot)


def add_water_year_total(df, value="precipitation", name="precipitation_cum_wy", series=Series(),
                         hot="find"):
    """Running total of `value` per station and water year; needs a `water_year` column."""
    per_year = Series((*series.keys, "water_year"), series.order, series.hot_rows)
    return running_sums(df, per_year, {name: value}, hot)


def index_trend(index: DataFrame, col="oni", windows=(3, 12)) -> DataFrame:
    """Trailing means of a monthly index.

    The window has no key on purpose: one row per calendar month is 1,200 rows a century. Rows
    are brought to that grain first, so a denser input cannot flood the single task.
    """
    monthly = index.groupBy(F.last_day("date").alias("date")).agg(
        *[F.max_by(c, index["date"]).alias(c) for c in index.columns if c != "date"]
    )
    w = W.orderBy("date")
    return monthly.select(
        "*", *[F.avg(col).over(trailing(w, n)).alias(f"{col}_{n}month_avg") for n in windows]
    )


def sequence_windows(df, features, target, steps, series=Series(), hot="find", short=False) -> DataFrame:
    """`steps` earlier feature vectors and the current target; short histories are dropped unless `short`."""

    def build(w):
        frame = w.rowsBetween(-steps, -1)
        vector = F.array(*[F.col(c).cast("double") for c in features])
        return {"sequence": F.collect_list(vector).over(frame)}

    made = over_rows(df, series, steps, build, hot=hot)
    kept = made if short else made.where(F.size("sequence") == steps)
    return kept.withColumn("label", F.col(target))
