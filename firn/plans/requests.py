"""Batch form of the dashboard call: guard requests, forecast, check documents, derive display."""

from pyspark.sql import DataFrame, functions as F

from firn.functions import scalars as N
from firn.functions.texts import contract_errors
from firn.models.outlook import WinterOutlook
from firn.operators.cleaning import split_inputs
from firn.plans.outlook import peak, summarize


def answer_requests(requests: DataFrame, model: WinterOutlook, history: DataFrame, key="request_id",
                    units="metric") -> dict:
    """Forecast every valid request (text columns year, enso, pdo, ao, pna) in one pass."""
    good, rejected = split_inputs(requests)
    scenarios = good.select(
        key, F.col("year").cast("int").alias("water_year"), "enso", "pdo", "ao", "pna")
    tables = summarize(model.predict(scenarios), history, units, model.half_life, (key,))
    state = tables["statewide"]
    tables["cards"] = state.select(
        key, N.anomaly_text("temperature_anomaly_c", units).alias("temperature"),
        N.amount_text("precipitation_mm", units).alias("precipitation"),
        N.amount_text("snowfall_cm", units, "snowfall").alias("snowfall"),
        N.vs_normal_text("precipitation_pct_normal").alias("vs_normal"))
    tables["peaks"] = peak(tables, (key,))
    tables["rejected"] = rejected
    return tables


def check_documents(docs: DataFrame, text="body") -> DataFrame:
    return contract_errors(docs, text)
