"""Cleaning jobs over variants of the station view."""

from pyspark.sql import functions as F

from firn.catalog.joins import history
from firn.catalog.registry import day_text, fixed4, job
from firn.catalog.views import r4, stored, view
from firn.operators import cleaning as C
from firn.operators.isolation import anomaly_scores, drop_isolated
from firn.operators.neighbours import fill_knn as fill_neighbours
from firn.session import materialize

OBS = "station_id, CAST(date AS VARCHAR) AS date"

DOUBLED = """doubled AS (SELECT * FROM station_daily
  UNION ALL SELECT * FROM station_daily WHERE day(date) % 5 = 0)"""

# Columns that cleaning should take away, next to the usual ones.
WIDER = """wider AS (SELECT *, 'snow' AS kind, CASE WHEN day(date) > 10 THEN NULL ELSE temperature END AS rare,
  concat(station_id, '-', CAST(date AS VARCHAR)) AS row_code FROM station_daily)"""

SPIKED = """spiked AS (SELECT station_id, date, temperature, precipitation,
  CASE WHEN (CAST(substr(station_id, 3) AS BIGINT) + day(date)) % 97 = 0 THEN swe * 10 ELSE swe END AS swe
  FROM station_daily)"""


def daily(spark, sf):
    return view(spark, sf, "station_daily")


def written(spark, sf):
    return stored(spark, sf, "station_daily")


def doubled(spark, sf):
    df = daily(spark, sf)
    return df.unionByName(df.where(F.dayofmonth("date") % 5 == 0))


def wider(spark, sf):
    return written(spark, sf).select(
        "*", F.lit("snow").alias("kind"),
        F.when(F.dayofmonth("date") <= 10, F.col("temperature")).alias("rare"),
        F.concat("station_id", F.lit("-"), day_text()).alias("row_code"))


def spiked(spark, sf):
    number = F.substring("station_id", 3, 10).cast("bigint") + F.dayofmonth("date")
    return written(spark, sf).withColumn(
        "swe", F.when(number % 97 == 0, F.col("swe") * 10).otherwise(F.col("swe")))


def shown(df, *cols):
    return df.select("station_id", day_text().alias("date"), *[fixed4(c).alias(c) for c in cols])


@job("c1_drop_duplicates", f"WITH {DOUBLED} SELECT DISTINCT {OBS}, swe, precipitation, temperature FROM doubled")
def drop_duplicates(spark, sf):
    return C.drop_duplicates(doubled(spark, sf)).select(
        "station_id", day_text().alias("date"), "swe", "precipitation", "temperature")


@job("c1_duplicate_count", f"""WITH {DOUBLED}, kept AS (SELECT DISTINCT * FROM doubled)
SELECT (SELECT count(*) FROM doubled) AS rows_before, (SELECT count(*) FROM kept) AS rows_after,
       (SELECT count(*) FROM doubled) - (SELECT count(*) FROM kept) AS rows_removed""")
def duplicate_count(spark, sf):
    return C.duplicate_count(doubled(spark, sf))


@job("c2_drop_sparse_columns", f"""WITH {WIDER}
SELECT {OBS}, swe, precipitation, temperature, kind, row_code FROM wider""")
def drop_sparse(spark, sf):
    return C.drop_sparse_columns(wider(spark, sf)).withColumn("date", day_text())


@job("c3_drop_rows", f"""
SELECT {OBS}, swe, precipitation, temperature FROM station_daily
WHERE swe IS NOT NULL AND precipitation IS NOT NULL""")
def drop_rows(spark, sf):
    return C.handle_missing(written(spark, sf), "drop").withColumn("date", day_text()).select(
        "station_id", "date", "swe", "precipitation", "temperature")


@job("c4_fill_mean", f"""
SELECT {OBS}, {r4('coalesce(swe, (SELECT avg(swe) FROM station_daily))')} AS swe,
       {r4('coalesce(precipitation, (SELECT avg(precipitation) FROM station_daily))')} AS precipitation FROM station_daily""")
def fill_mean(spark, sf):
    return shown(C.fill_mean(daily(spark, sf), ["swe", "precipitation"]), "swe", "precipitation")


@job("c5_fill_median", f"""
SELECT {OBS}, {r4('coalesce(swe, (SELECT median(swe) FROM station_daily))')} AS swe,
       {r4('coalesce(precipitation, (SELECT median(precipitation) FROM station_daily))')} AS precipitation FROM station_daily""")
def fill_median(spark, sf):
    return shown(C.fill_median(written(spark, sf), ["swe", "precipitation"]), "swe", "precipitation")


def _knn(target, other):
    """Mean of the five nearest donors per distinct gap row; ties go to the smaller value."""
    return f"""near_{target} AS (SELECT p, t, list_avg(arg_min(v, {{'d': d, 'v': v}}, 5)) AS fill
  FROM (SELECT g.p, g.t, v, CASE WHEN g.p IS NULL OR d.p IS NULL THEN 3.0::DOUBLE / 1 * ((g.t - d.t) * (g.t - d.t))
      ELSE 3.0::DOUBLE / 2 * ((g.p - d.p) * (g.p - d.p) + (g.t - d.t) * (g.t - d.t)) END AS d
    FROM (SELECT DISTINCT {other} AS p, temperature AS t FROM station_daily WHERE {target} IS NULL) g,
         (SELECT {target} AS v, {other} AS p, temperature AS t FROM station_daily WHERE {target} IS NOT NULL) d) x
  GROUP BY 1, 2)"""


@job("c6_fill_knn", f"""WITH {_knn('swe', 'precipitation')}, {_knn('precipitation', 'swe')}
SELECT {OBS}, {r4('coalesce(swe, a.fill)')} AS swe, {r4('coalesce(precipitation, b.fill)')} AS precipitation, temperature
FROM station_daily s LEFT JOIN near_swe a ON swe IS NULL AND precipitation IS NOT DISTINCT FROM a.p AND temperature = a.t
LEFT JOIN near_precipitation b ON precipitation IS NULL AND swe IS NOT DISTINCT FROM b.p AND temperature = b.t""")
def fill_knn(spark, sf):
    df = fill_neighbours(written(spark, sf), ["swe", "precipitation", "temperature"])
    return df.select("station_id", day_text().alias("date"), fixed4("swe").alias("swe"),
                     fixed4("precipitation").alias("precipitation"), "temperature")


_W = "PARTITION BY station_id ORDER BY date ROWS BETWEEN"
_BACK = f"OVER ({_W} UNBOUNDED PRECEDING AND CURRENT ROW)"
_AHEAD = f"OVER ({_W} CURRENT ROW AND UNBOUNDED FOLLOWING)"


@job("c7_fill_interpolate", f"""
WITH near AS (SELECT station_id, date, swe,
    last_value(swe IGNORE NULLS) {_BACK} AS v0, first_value(swe IGNORE NULLS) {_AHEAD} AS v1,
    max(CASE WHEN swe IS NOT NULL THEN date END) {_BACK} AS d0,
    min(CASE WHEN swe IS NOT NULL THEN date END) {_AHEAD} AS d1 FROM station_daily)
SELECT {OBS}, {r4("coalesce(swe, CASE WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (date_diff('day', d0, date)::DOUBLE / date_diff('day', d0, d1)) END)")} AS swe
FROM near""")
def fill_interpolate(spark, sf):
    return shown(C.fill_interpolate(written(spark, sf), ["swe"]), "swe")


@job("c8_fill_most_frequent", f"""
WITH gaps AS (SELECT station_id, date, CASE WHEN day(date) % 7 <> 0 THEN dayname(date) END AS label FROM station_daily),
     mode AS (SELECT label FROM gaps WHERE label IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1)
SELECT {OBS}, coalesce(label, (SELECT label FROM mode)) AS label FROM gaps""")
def fill_most_frequent(spark, sf):
    df = daily(spark, sf).select("station_id", "date", F.when(
        F.dayofmonth("date") % 7 != 0, F.date_format("date", "EEEE")).alias("label"))
    return C.fill_most_frequent(df, ["label"]).withColumn("date", day_text())


def _capped(c):
    return f"""CASE WHEN (SELECT max(abs({c} - m)) > 3 * any_value(p) FROM spiked, (SELECT avg({c}) AS m, stddev_pop({c}) AS p FROM spiked) s)
  THEN CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, (SELECT avg({c}) - 3 * stddev_samp({c}) FROM spiked)), (SELECT avg({c}) + 3 * stddev_samp({c}) FROM spiked)) END
  ELSE {c} END"""


@job("c9_cap_zscore", f"WITH {SPIKED} SELECT {OBS}, {r4(_capped('swe'))} AS swe, {r4(_capped('temperature'))} AS temperature FROM spiked")
def cap_zscore(spark, sf):
    return shown(C.cap_zscore(spiked(spark, sf), ["swe", "temperature"]), "swe", "temperature")


def _iqr(c):
    q1, q3 = [f"(SELECT quantile_cont({c}, {q}) FROM spiked)" for q in (0.25, 0.75)]
    return (f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {q1} - 1.5 * ({q3} - {q1})), "
            f"{q3} + 1.5 * ({q3} - {q1})) END")


@job("c10_cap_iqr", f"WITH {SPIKED} SELECT {OBS}, {r4(_iqr('swe'))} AS swe, {r4(_iqr('precipitation'))} AS precipitation FROM spiked")
def cap_iqr(spark, sf):
    return shown(C.cap_iqr(spiked(spark, sf), ["swe", "precipitation"], 1.5), "swe", "precipitation")


@job("c11_isolation_forest")
def isolation_forest(spark, sf):
    return drop_isolated(spiked(spark, sf), ["swe", "precipitation", "temperature"]).withColumn(
        "date", day_text())


@job("c11_isolation_rows", f"""WITH {SPIKED}
SELECT count(*) AS row_count, true AS five_percent_gone, true AS incomplete_stay, true AS far_rows_gone_first FROM spiked""")
def isolation_rows(spark, sf):
    """What the forest drops: five of a hundred complete rows, and those farther out than the kept ones."""
    rows = spiked(spark, sf)
    cols = ["swe", "precipitation", "temperature"]
    scored = materialize(anomaly_scores(rows, cols))
    kept = drop_isolated(rows, cols)
    facts = scored.agg(F.count("*").alias("row_count"), F.count("anomaly_score").alias("known"), F.corr(F.abs(F.col("swe") - scored.agg(F.avg("swe")).scalar()), "anomaly_score").alias("far"))
    left = kept.agg(F.count("*").alias("kept"), F.count(F.when(F.col("swe").isNull() | F.col("precipitation").isNull() | F.col("temperature").isNull(), 1)).alias("incomplete"))
    gone = 1 - (F.col("kept") - F.col("incomplete")) / F.col("known")
    return facts.crossJoin(left).select(
        "row_count", gone.between(0.04, 0.0501).alias("five_percent_gone"), (F.col("incomplete") == F.col("row_count") - F.col("known")).alias("incomplete_stay"),
        (F.col("far") > 0).alias("far_rows_gone_first"))


@job("c12_drop_constant_columns", f"""WITH {WIDER}
SELECT {OBS}, swe, precipitation, temperature, rare, row_code FROM wider""")
def drop_constant(spark, sf):
    return C.drop_constant_columns(wider(spark, sf)).withColumn("date", day_text())


@job("c13_drop_wide_text", f"""WITH {WIDER}
SELECT {OBS}, swe, precipitation, temperature, rare, kind FROM wider""")
def drop_wide_text(spark, sf):
    return C.drop_wide_text_columns(wider(spark, sf)).withColumn("date", day_text())


def _report(side, table):
    return " UNION ALL ".join(
        f"""SELECT '{side}' AS side, '{c}' AS column_name, count(*) AS row_count, 3 AS column_count,
  count(*) - count({c}) AS missing_count, {r4(f'avg({c})')} AS mean_value, {r4(f'stddev_samp({c})')} AS std_value,
  {r4(f'min({c})')} AS min_value, {r4(f'max({c})')} AS max_value FROM {table}"""
        for c in ("swe", "precipitation", "temperature"))


@job("c14_cleaning_report", f"""
WITH full_rows AS (SELECT * FROM station_daily WHERE swe IS NOT NULL AND precipitation IS NOT NULL)
{_report('original', 'station_daily')} UNION ALL {_report('cleaned', 'full_rows')}""")
def cleaning_report(spark, sf):
    df = daily(spark, sf).select("swe", "precipitation", "temperature")
    report = C.cleaning_report(df, df.na.drop("any"))
    numbers = ["mean_value", "std_value", "min_value", "max_value"]
    return report.withColumns({c: fixed4(c) for c in numbers})


@job("c15_clean", f"""
WITH filled AS (SELECT station_id, date, coalesce(swe, (SELECT median(swe) FROM station_daily)) AS swe,
    coalesce(precipitation, (SELECT median(precipitation) FROM station_daily)) AS precipitation, temperature FROM station_daily),
  s AS (SELECT avg(swe) AS m, stddev_samp(swe) AS sd, stddev_pop(swe) AS p, max(swe) AS hi, min(swe) AS lo FROM filled)
SELECT {OBS}, {r4('CASE WHEN greatest(hi - m, m - lo) > 3 * p THEN least(greatest(swe, m - 3 * sd), m + 3 * sd) ELSE swe END')} AS swe,
       precipitation, temperature, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
       CAST(day(date) AS INT) AS day, CAST(dayofyear(date) AS INT) AS day_of_year, CAST(weekofyear(date) AS INT) AS week_of_year
FROM filled, s""")
def clean(spark, sf):
    df = wider(spark, sf)
    df = C.clean(df.unionByName(df.where(F.dayofmonth("date") % 5 == 0)))
    calendar = ["year", "month", "day", "day_of_year", "week_of_year"]
    return df.select("station_id", day_text().alias("date"), fixed4("swe").alias("swe"),
                     "precipitation", "temperature", *[F.col(c).cast("int").alias(c) for c in calendar])


BROKEN = """broken AS (SELECT water_year, CASE WHEN month = 4 AND water_year % 2 = 0 THEN 5 ELSE month END AS month,
  CASE WHEN month = 12 AND water_year = 1998 THEN 'atlantis' ELSE region END AS region, enso, pdo, ao,
  CASE WHEN water_year = 1997 AND month = 1 THEN NULL ELSE pna END AS pna, temperature_anomaly,
  CASE WHEN water_year = 1999 AND month = 2 THEN -1.0 ELSE precipitation_mm END AS precipitation_mm, snowfall_cm
  FROM winter_history)"""


@job("c16_history_rules", f"""WITH {BROKEN}
SELECT rule, "rows" FROM (
  SELECT 'month_outside_winter' AS rule, count(*) AS "rows" FROM broken WHERE month NOT IN (11, 12, 1, 2, 3, 4)
  UNION ALL SELECT 'unknown_region', count(*) FROM broken WHERE region = 'atlantis'
  UNION ALL SELECT 'missing_number', count(*) FROM broken WHERE pna IS NULL
  UNION ALL SELECT 'negative_amount', count(*) FROM broken WHERE precipitation_mm < 0 OR snowfall_cm < 0) x
WHERE "rows" > 0""")
def history_rules(spark, sf):
    y, m = F.col("water_year"), F.col("month")
    broken = history(spark, sf).withColumns({
        "pna": F.when(~((y == 1997) & (m == 1)), F.col("pna")),
        "region": F.when((m == 12) & (y == 1998), "atlantis").otherwise(F.col("region")),
        "precipitation_mm": F.when((y == 1999) & (m == 2), -1.0).otherwise(F.col("precipitation_mm")),
        "month": F.when((m == 4) & (y % 2 == 0), 5).otherwise(m),
    })
    return C.history_violations(broken)


@job("c17_input_guard", """
SELECT water_year, month, region, CAST(CASE WHEN month = 2 THEN 0 WHEN month = 3 THEN 0 ELSE 1 END AS INT) AS valid
FROM winter_history""")
def input_guard(spark, sf):
    text = lambda c: F.col(c).cast("string")
    m = F.col("month")
    requests = history(spark, sf).select(
        "water_year", "month", "region", text("water_year").alias("year"),
        F.when(m == 2, "warm").when(m == 3, "NaN").otherwise(text("enso")).alias("enso"),
        text("pdo").alias("pdo"), text("ao").alias("ao"), text("pna").alias("pna"))
    good, bad = C.split_inputs(requests)
    return good.select("water_year", "month", "region", F.lit(1).alias("valid")).unionByName(
        bad.select("water_year", "month", "region", F.lit(0).alias("valid")))


@job("c18_clamp", """
SELECT row_id, CAST(greatest(0, yhat - 20000) AS DOUBLE) AS yhat FROM scored""")
def clamp(spark, sf):
    df = view(spark, sf, "scored").select("row_id", (F.col("yhat") - 20000.0).alias("yhat"))
    return C.clamp_at_zero(df, ["yhat"])
