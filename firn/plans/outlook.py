"""Outlook summary: one tidy table per grain, and the same as one nested JSON-ready row."""

from pyspark.sql import DataFrame, functions as F

from firn.functions import rules as R, scalars as N
from firn.models.outlook import WinterOutlook, backtest
from firn.operators import aggregates as A, joins as J
from firn.operators.cleaning import validate_history
from firn.session import materialize


def summarize(forecast: DataFrame, climatology: DataFrame, units="metric", half_life=7.0,
              by=()) -> dict:
    """Tables `statewide`, `trajectory`, `season_phases`, `regional_summary`,
    `regional_monthly` and `display`; `by` names scenario columns to keep apart."""
    N.check_units(units)
    normal = A.recency_normal(validate_history(climatology), half_life)
    compared = A.percent_of_normal(J.compare_with_normal(forecast, normal))
    regions = A.region_rollup(compared, *by)
    regions = J.add_region(regions, "label", "region_order").withColumn("risks", R.regional_hazards(
        "region", "precipitation_pct_normal", "snowfall_pct_normal", "temperature_anomaly_c"))
    phases = A.phase_rollup(compared, *by).withColumn("category", R.wetness("precipitation_pct_normal"))
    state = A.statewide(compared, *by).withColumns({
        "wetness": R.wetness("precipitation_pct_normal"),
        "water_allocation": R.water_risk("precipitation_pct_normal", "snowfall_pct_normal"),
        "wildfire_risk": R.wildfire_risk("precipitation_pct_normal", "temperature_anomaly_c"),
        "recency_half_life_years": F.lit(float(half_life)), "units": F.lit(units),
    })
    pairs = N.unit_pairs("temperature_anomaly_c", "precipitation_mm", "snowfall_cm")
    phase_pairs = N.unit_pairs("predicted_temp_c", "precipitation_mm", "snowfall_cm")
    grain = [F.lit("statewide").alias("grain")]
    display = state.select(*by, *grain, *[c.alias(n) for n, c in pairs.items()]).unionByName(
        phases.select(*by, F.col("phase_id").alias("grain"), *[c.alias(n) for n, c in phase_pairs.items()]))
    return {
        "statewide": state, "trajectory": A.trajectory(compared, *by), "season_phases": phases,
        "regional_summary": regions, "regional_monthly": compared, "display": display,
    }


def nested(tables: dict, by=()) -> DataFrame:
    """One row per scenario with everything inside; every list has a fixed length (42 at most)."""
    state = tables["statewide"]

    def listed(name, order, drop=()):
        df = tables[name]
        cols = [c for c in df.columns if c not in (*by, *order, *drop)]
        item = F.struct(*order, *cols)
        return df.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias(name))

    parts = [
        listed("trajectory", ["period"]), listed("season_phases", ["phase_order"]),
        listed("regional_summary", ["region_order"]),
        listed("regional_monthly", ["region", "month"]), listed("display", ["grain"]),
    ]
    if by:
        for p in parts:
            state = state.join(p, list(by))
        return state
    return state.withColumns({p.columns[0]: p.scalar() for p in parts})


def run_outlook(history: DataFrame, scenarios: DataFrame, units="metric", years=None, by=(),
                **settings) -> dict:
    """Backtest (optional), fit on everything, predict all scenarios and summarize.

    The forecast is written once, because every summary table reads it again.
    """
    model = WinterOutlook(**settings).fit(history)
    forecast = materialize(model.predict(scenarios))
    tables = summarize(forecast, history, units, model.half_life, by)
    tables |= {"forecast": forecast, "model": model}
    if years:
        tables["backtest"] = backtest(history, years, **settings)
    return tables


def peak(tables: dict, by=()) -> DataFrame:
    """Wettest month and chart maximum of the trajectory."""
    order = F.when(F.col("month") >= 11, F.col("month") - 11).otherwise(F.col("month") + 1)
    return A.peak_month(tables["trajectory"].withColumn("month_order", order), by)

