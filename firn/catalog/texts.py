"""Text and JSON jobs over the text views."""

from pyspark.sql import functions as F

from firn import schemas as K
from firn.catalog.joins import history
from firn.catalog.registry import fixed4, job
from firn.catalog.views import r4, view
from firn.functions import texts as X
from firn.operators.joins import add_region

_T = r"([+-]?\d+(?:\.\d+)?)\s*°?[cf]\s*(warmer|colder)"
_P = r"(\d+(?:\.\d+)?)%\s*(more|less|increase|decrease)\s*(?:precipitation|rain|snow)"


@job("x1_scenario_text", f"""
WITH low AS (SELECT text_id, lower(text) AS t FROM scenario_text),
raw AS (SELECT text_id, t, CASE WHEN contains(t, 'el niño') THEN 'El Niño' WHEN contains(t, 'la niña') THEN 'La Niña' END AS phase,
    TRY_CAST(regexp_extract(t, '{_T}', 1) AS DOUBLE) * CASE WHEN regexp_extract(t, '{_T}', 2) = 'colder' THEN -1 ELSE 1 END AS deg,
    TRY_CAST(regexp_extract(t, '{_P}', 1) AS DOUBLE) * CASE WHEN regexp_extract(t, '{_P}', 2) IN ('less', 'decrease') THEN -1 ELSE 1 END AS pct,
    CASE WHEN contains(t, 'warm') THEN 1.0 WHEN contains(t, 'cold') THEN -1.0 END::DOUBLE AS wt,
    CASE WHEN contains(t, 'wet') THEN 1.2 WHEN contains(t, 'dry') THEN 0.8 END::DOUBLE AS wp FROM low),
used AS (SELECT *, coalesce(deg, wt) AS temperature_adjustment, coalesce(1 + pct / 100, wp) AS multiplier FROM raw),
named AS (SELECT *, concat_ws(' ', phase,
      CASE WHEN temperature_adjustment IS NOT NULL THEN concat(CAST(abs(temperature_adjustment) AS VARCHAR), '°', CASE WHEN abs(temperature_adjustment) < 10 THEN 'C' ELSE 'F' END,
        CASE WHEN temperature_adjustment > 0 THEN ' warmer' ELSE ' colder' END) END,
      CASE WHEN multiplier IS NOT NULL THEN concat(CAST(CAST(floor(abs((multiplier - 1) * 100) + 0.5) AS BIGINT) AS VARCHAR), '% ',
        CASE WHEN multiplier > 1 THEN 'more' ELSE 'less' END, ' precipitation') END) AS n FROM used)
SELECT text_id, CASE WHEN n = '' THEN 'Custom Scenario' ELSE n END AS name, phase,
  CASE WHEN phase = 'El Niño' THEN 1.5 WHEN phase = 'La Niña' THEN -1.5 END::DOUBLE AS oni, temperature_adjustment,
  {r4('multiplier')} AS precipitation_multiplier,
  CASE WHEN pct IS NULL AND wp IS NOT NULL THEN 'weather' WHEN deg IS NULL AND wt IS NOT NULL THEN 'climate'
       WHEN pct IS NOT NULL THEN 'weather' WHEN deg IS NOT NULL THEN 'climate' WHEN phase IS NOT NULL THEN 'enso' ELSE 'custom' END AS category
FROM named""")
def scenario_text(spark, sf):
    df = X.parse_scenarios(view(spark, sf, "scenario_text"))
    p = F.col("parameters")
    return df.select("text_id", "name", "phase", p["oni"].alias("oni"),
                     p["temperature_adjustment"].alias("temperature_adjustment"),
                     fixed4(p["precipitation_multiplier"]).alias("precipitation_multiplier"), "category")


@job("x2_json_in_text", r"""
WITH cut AS (SELECT doc_id, nullif(regexp_extract(body, '(?s)\{.*\}'), '') AS j FROM forecast_docs)
SELECT doc_id, j AS json, CAST(json_extract_string(j, '$.pct') AS DOUBLE) AS pct, json_extract_string(j, '$.riskLevel') AS level,
       json_extract_string(j, '$.summary') AS summary
FROM cut WHERE j IS NULL OR json_valid(j)""")
def json_in_text(spark, sf):
    df = X.extract_json(view(spark, sf, "forecast_docs"), "body")
    v = F.from_json("json", "pct double, riskLevel string, summary string")
    return df.withColumn("v", v).select("doc_id", "json", "v.pct", F.col("v.riskLevel").alias("level"),
                                        "v.summary")


@job("x3_labelled_sections", """
SELECT doc_id, trim(split_part(split_part(text, chr(10), 1), ':', 2)) AS summary,
       lower(trim(split_part(split_part(text, chr(10), 2), ':', 2))) AS confidence,
       concat(split_part(text, chr(10), 4), ' / ', split_part(text, chr(10), 5)) AS drivers,
       split_part(text, chr(10), 7) AS recommendations
FROM labelled_text""")
def labelled_sections(spark, sf):
    df = X.labelled_fields(view(spark, sf, "labelled_text"), "text", ("Summary", "Confidence"),
                           ("Drivers", "Recommendations"), ("Confidence",))
    return df.select("doc_id", "summary", "confidence", F.array_join("drivers", " / ").alias("drivers"),
                     F.array_join("recommendations", " / ").alias("recommendations"))


@job("x3_labelled_records", """
SELECT doc_id, part, record, summary, confidence FROM (
  SELECT doc_id, 1 AS part, 'Summary' AS record, trim(split_part(split_part(text, chr(10), 1), ':', 2)) AS summary,
         lower(trim(split_part(split_part(text, chr(10), 2), ':', 2))) AS confidence FROM labelled_text
  UNION ALL SELECT doc_id, 2, 'Drivers', NULL, NULL FROM labelled_text) x""")
def labelled_records(spark, sf):
    return X.labelled_records(view(spark, sf, "labelled_text"), ("Summary", "Drivers"),
                              ("Summary", "Confidence"), lower=("Confidence",)).drop("text")


@job("x4_driver_rows", """
SELECT doc_id, split_part(l, '|', 1) AS feature, CAST(split_part(l, '|', 2) AS DOUBLE) AS importance,
       split_part(l, '|', 3) AS direction, split_part(l, '|', 4) AS description
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM labelled_text) x
WHERE len(string_split(l, '|')) >= 3""")
def driver_rows(spark, sf):
    df = X.parse_explanations(view(spark, sf, "labelled_text"))
    return df.select("doc_id", F.explode("drivers").alias("d")).select("doc_id", "d.*")


@job("x5_parameters", r"""
WITH cut AS (SELECT doc_id, nullif(regexp_extract(body, '(?s)\{.*\}'), '') AS j FROM forecast_docs)
SELECT doc_id, CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.pct') ELSE CAST(doc_id % 7 AS VARCHAR) END AS pct,
       CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.riskLevel') ELSE 'Low' END AS level
FROM cut""")
def parameters(spark, sf):
    pairs = F.concat(F.lit("pct="), (F.col("doc_id") % 7).cast("string"), F.lit(", riskLevel = Low, loose"))
    text = F.coalesce(X.outer_json("body"), pairs)
    df = view(spark, sf, "forecast_docs").withColumn("p", X.parameters_of(text))
    return df.select("doc_id", F.col("p")["pct"].alias("pct"), F.col("p")["riskLevel"].alias("level"))


@job("x6_numbered_parts", """
SELECT doc_id, part, trim(p[part + 1], concat(chr(10), ' ')) AS part_text
FROM (SELECT doc_id, string_split(text, ':') AS p, CAST(unnest(range(1, len(string_split(text, ':')))) AS INT) AS part FROM labelled_text) x""")
def numbered_parts(spark, sf):
    return X.split_sections(view(spark, sf, "labelled_text"), ":").drop("text")


@job("x5_event_properties", """
SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind, CAST(value AS VARCHAR) AS shown FROM events""")
def event_properties(spark, sf):
    """The JSON of every event as a map, and the pairs `kind=..., shown=...` of the same event."""
    df = spark.read.parquet(f"{sf}/events.parquet")
    pairs = X.parameters_of(F.concat(F.lit("kind="), "event_type", F.lit(", loose, shown = "), F.col("value").cast("string")))
    df = df.select("event_id", X.parameters_of("props").alias("p"), pairs.alias("q"))
    return df.select("event_id", F.col("p")["k"].alias("k"), F.col("q")["kind"].alias("kind"), F.col("q")["shown"].alias("shown"))


@job("x6_document_parts", r"""
SELECT doc_id, part, regexp_replace(p[part + 1], '^\s+|\s+$', '', 'g') AS part_text
FROM (SELECT doc_id, string_split(text, '.') AS p, CAST(unnest(range(1, len(string_split(text, '.')))) AS INT) AS part FROM documents) x""")
def document_parts(spark, sf):
    """Whole documents cut at every full stop."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return X.split_sections(docs, ".").drop("text")


def forecast_documents(spark, sf):
    """A contract document per winter, some of them broken on purpose."""
    h = add_region(history(spark, sf), "label", "region_order")
    y = F.col("water_year")
    months = h.groupBy("water_year", "month").agg(F.sum("precipitation_mm").alias("precip"),
                                                  F.sum("snowfall_cm").alias("snow"))
    names = F.create_map(*[F.lit(x) for m, n in zip(K.WINTER_MONTHS, K.MONTH_NAMES) for x in (m, n)])
    order = F.when(F.col("month") >= 11, F.col("month") - 11).otherwise(F.col("month") + 1)
    paths = months.groupBy("water_year").agg(F.array_sort(F.collect_list(F.struct(
        order.alias("o"), names[F.col("month")].alias("month"), "precip", "snow"))).alias("trajectory"))
    regions = h.groupBy("water_year", "region_order", "label").agg(
        F.sum("precipitation_mm").alias("precip"), F.sum("snowfall_cm").alias("snow"))
    risks = F.when((y == 1997) & (F.col("region_order") == 2), " ").otherwise("storms")
    details = regions.groupBy("water_year").agg(F.array_sort(F.collect_list(F.struct(
        "region_order", F.col("label").alias("name"), "precip", F.col("precip").alias("normal"), "snow",
        risks.alias("risks")))).alias("details"))
    ids = [F.struct(F.lit(p[0]).alias("id"), F.lit(p[1]).alias("label")) for p in K.SEASON_PHASES]
    phases = F.when(y == 1998, F.array(*reversed(ids))).otherwise(F.array(*ids))
    impact = lambda level: F.struct(level.alias("riskLevel"), F.lit("text").alias("summary"))
    doc = F.struct(
        "trajectory", "details", phases.alias("seasonPhases"),
        impact(F.when(y == 1999, "Extreme").otherwise("High")).alias("waterAllocation"),
        impact(F.lit("Low")).alias("wildfireRisk"))
    return paths.join(details, "water_year").select(
        F.col("water_year").alias("doc_id"), F.concat(F.lit("Here it is: "), F.to_json(doc)).alias("body"))


@job("x7_contract", """
WITH docs AS (SELECT water_year, count(DISTINCT month) AS months, count(DISTINCT region) AS regions FROM winter_history GROUP BY 1),
judged AS (SELECT water_year AS doc_id, CASE WHEN months <> 6 OR regions <> 7 THEN 'incomplete_forecast'
    WHEN water_year = 1998 THEN 'incomplete_phases' WHEN water_year = 1997 THEN 'incomplete_regions'
    WHEN water_year = 1999 THEN 'incomplete_impacts' END AS first_error FROM docs
  UNION ALL SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'no_json' ELSE 'incomplete_forecast' END FROM pages)
SELECT doc_id, CAST(first_error IS NULL AS INT) AS valid, first_error FROM judged""")
def contract(spark, sf):
    short = view(spark, sf, "forecast_docs")
    docs = forecast_documents(spark, sf).select(F.col("doc_id").cast("bigint"), "body").unionByName(short)
    return X.contract_errors(docs, "body").select("doc_id", F.col("valid").cast("int").alias("valid"),
                                                  "first_error")
