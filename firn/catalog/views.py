"""Test views over the given tables: one SQL text for Spark and for the oracle."""

import re

from pyspark.sql import DataFrame, SparkSession

from firn.session import materialize

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

STATION_DAILY = """
SELECT concat('ST', CAST(k AS STRING)) AS station_id, d AS date,
       CASE WHEN (k + day(d)) % 11 = 0 THEN NULL ELSE cents / 100000.0 END AS swe,
       CASE WHEN (k + day(d)) % 13 = 0 THEN NULL ELSE CAST(qty AS DOUBLE) END AS precipitation,
       CAST(15 + (month(d) * 7) % 12 - disc / n AS DOUBLE) AS temperature
FROM (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, count(*) AS n,
             CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS cents,
             CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
             CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS disc
      FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)) b
"""

CLIMATE_DAILY = """
SELECT concat('ST', CAST(k AS STRING)) AS station_id, d AS date,
       CAST(40 + tax % 50 AS DOUBLE) AS humidity, CAST(n AS DOUBLE) AS wind_speed
FROM (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, count(*) AS n,
             CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax
      FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_suppkey, CAST(l_shipdate AS DATE)) b
"""

INDEX_MONTHLY = """
SELECT last_day(m) AS date, oni, round(0.8 * oni, 4) AS mei, round(0.9 * oni, 4) AS nino34,
       round(-0.7 * oni, 4) AS soi
FROM (SELECT m, (cents % 5001 - 2500) / 1000.0E0 AS oni
      FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m,
                   CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
            FROM orders GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)) a) b
"""

WINTER_HISTORY = """
SELECT wy AS water_year, m AS month,
       CASE r WHEN 0 THEN 'north_coast' WHEN 1 THEN 'shasta_cascades' WHEN 2 THEN 'northern_sierra'
              WHEN 3 THEN 'central_sierra' WHEN 4 THEN 'southern_sierra'
              WHEN 5 THEN 'central_coast_valleys' ELSE 'southern_california' END AS region,
       ((wy * 37) % 51 - 25) / 10.0E0 AS enso, ((wy * 53) % 41 - 20) / 10.0E0 AS pdo,
       ((wy * 29) % 41 - 20) / 10.0E0 AS ao,   ((wy * 31) % 41 - 20) / 10.0E0 AS pna,
       ((wy * 43) % 31 - 15) / 10.0E0 AS temperature_anomaly,
       qty / 10.0E0 AS precipitation_mm, snow / 10.0E0 AS snowfall_cm
FROM (SELECT CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) >= 10 THEN 1 ELSE 0 END AS INT) AS wy,
             CAST(month(l_shipdate) AS INT) AS m, CAST(l_suppkey % 7 AS INT) AS r,
             CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
             CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS snow
      FROM lineitem WHERE month(l_shipdate) IN (11, 12, 1, 2, 3, 4)
      GROUP BY 1, 2, 3) b
"""

SCORED = """
SELECT o_orderkey AS row_id, o_orderpriority AS model_id, CAST(round(o_totalprice) AS BIGINT) AS y,
       CAST(round(o_totalprice) AS BIGINT) + (o_custkey % 201 - 100) * 50 AS yhat
FROM orders
"""

SCENARIO_TEXT = """
SELECT c_custkey AS text_id,
       CASE c_custkey % 8
         WHEN 0 THEN 'El Niño with 2°C warmer winter'   WHEN 1 THEN 'la niña and 15% less precipitation'
         WHEN 2 THEN 'a warm and wet season'            WHEN 3 THEN 'cold, dry months'
         WHEN 4 THEN '10% more snow'                    WHEN 5 THEN '1.5 C colder than usual'
         WHEN 6 THEN 'typical conditions'               ELSE c_name END AS text
FROM customer
"""

LABELLED_TEXT = """
SELECT c_custkey AS doc_id,
       concat('Summary: ', c_mktsegment, ' outlook
Confidence: ', CASE WHEN c_custkey % 3 = 0 THEN 'High' ELSE 'Low' END,
              '
Drivers:
lag_7|0.', CAST(c_custkey % 90 + 10 AS STRING), '|positive|recent state
bad row
Recommendations:
keep watch') AS text
FROM customer
"""

FORECAST_DOCS = """
SELECT page_id AS doc_id,
       CASE WHEN page_id % 5 = 0 THEN concat('no json here ', url)
            WHEN page_id % 5 = 1 THEN concat('text {"pct": ', CAST(page_id AS STRING), ', "riskLevel": "Extreme"} end')
            ELSE concat('text {"pct": ', CAST(page_id AS STRING), ', "riskLevel": "High", "summary": "s"} end') END AS body
FROM pages
"""

VIEWS = {
    "station_daily": STATION_DAILY,
    "climate_daily": CLIMATE_DAILY,
    "index_monthly": INDEX_MONTHLY,
    "winter_history": WINTER_HISTORY,
    "scored": SCORED,
    "scenario_text": SCENARIO_TEXT,
    "labelled_text": LABELLED_TEXT,
    "forecast_docs": FORECAST_DOCS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test view as a DataFrame; the SQL is resolved now, so re-registering is harmless."""
    text = VIEWS[name]
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view written once as a table, for jobs that pass over it several times."""
    return materialize(view(spark, sf_dir, name))


def with_views(body: str) -> str:
    """Put the views that `body` names in front of it as common table expressions."""
    used = [f"{n} AS ({VIEWS[n].strip()})" for n in VIEWS if re.search(rf"\b{n}\b", body)]
    body = body.strip()
    if not used:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {', '.join(used)}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(used)}, {body[5:]}"
    return f"WITH {', '.join(used)} {body}"


def r4(expr: str, scale=10000) -> str:
    """Four fixed digits in SQL. The offset keeps exact halves on one side in both engines."""
    return f"(floor(({expr}) * {scale} + 0.5001) / {scale})"


def r2(expr: str) -> str:
    return r4(expr, 100)
