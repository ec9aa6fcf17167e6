"""Rule-based scoring of forecasts: columns in, columns out, all inside code generation."""

from pyspark.sql import Column, DataFrame, functions as F

from firn.functions.scalars import fixed_text, python_signed_text
from firn.operators.aggregates import top_k

# Thresholds in percent of normal and in degrees.
WET, DRY = 110, 90
LOW, HIGH = 85, 115
BAND = 10

# Impact messages.
WATER_MESSAGES = {
    "short": "Below-normal snowpack and runoff increase the likelihood of tighter reservoir allocations, reduced agricultural deliveries, and conservation calls for urban users.",
    "ample": "Above-normal precipitation supports reservoir refill, but warm anomalies may shift runoff earlier and complicate flood-control versus storage tradeoffs.",
    "normal": "Near-normal supplies likely support routine reservoir operations, with allocation pressure concentrated in groundwater-dependent basins and dry southern zones.",
}
FIRE_MESSAGES = {
    "High": "Dry, warm winter conditions favor fine-fuel carryover, early grass curing, and elevated wildfire potential the following summer and fall.",
    "Low": "Wetter conditions increase soil moisture and delay curing, though wind events and late-season dry-down can still produce brief fire-weather windows.",
    "Moderate": "Mixed winter signals suggest typical fuel loading with fire-season severity depending on spring green-up and late-summer heat.",
}

# Hazard phrases in the order they are listed.
HAZARDS = {
    "flood": "elevated flood and debris-flow risk during atmospheric river events",
    "drought": "drought stress and reduced reservoir recharge",
    "snowpack": "below-normal snowpack and weaker spring runoff",
    "melt": "rain-on-snow and early melt at mid elevations",
    "frost": "agricultural frost and cold-sensitive crop stress",
    "landslide": "landslide and coastal erosion concerns on saturated slopes",
    "urban": "urban flooding and post-fire burn-scar runoff",
    "none": "typical winter variability with no dominant extreme hazard signal",
}
SOUTH = ("central_coast_valleys", "southern_california")
NORTH = ("north_coast", "shasta_cascades", "northern_sierra")


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def wetness(pct) -> Column:
    p = _col(pct)
    return F.when(p >= WET, "wet").when(p <= DRY, "dry").when(p.isNotNull(), "near_normal")


def water_risk(rain_pct, snow_pct) -> Column:
    """Struct of level and message."""
    rain, snow = _col(rain_pct), _col(snow_pct)
    short = (rain <= LOW) | (snow <= LOW)
    return F.struct(
        F.when(short, "High").otherwise("Moderate").alias("level"),
        F.when(short, WATER_MESSAGES["short"]).when(rain >= HIGH, WATER_MESSAGES["ample"])
        .otherwise(WATER_MESSAGES["normal"]).alias("summary"))


def wildfire_risk(rain_pct, temp) -> Column:
    rain, t = _col(rain_pct), _col(temp)
    level = F.when((rain <= LOW) & (t >= 0.5), "High").when(rain >= HIGH, "Low").otherwise("Moderate")
    message = F.create_map(*[F.lit(x) for kv in FIRE_MESSAGES.items() for x in kv])
    return F.struct(level.alias("level"), message[level].alias("summary"))


def regional_hazards(region, rain_pct, snow_pct, temp) -> Column:
    """Up to three hazards in a fixed order as one sentence."""
    r, rain, snow, t = _col(region), _col(rain_pct), _col(snow_pct), _col(temp)
    tests = [
        F.when(rain >= HIGH, HAZARDS["flood"]).when(rain <= LOW, HAZARDS["drought"]),
        F.when((snow <= LOW) | (t >= 0.8), HAZARDS["snowpack"]),
        F.when(t >= 1.0, HAZARDS["melt"]),
        F.when((t <= -0.8) & r.isin(*SOUTH), HAZARDS["frost"]),
        F.when(r.isin(*NORTH) & (rain >= WET), HAZARDS["landslide"]),
        F.when(r.isin(*SOUTH) & (rain >= WET), HAZARDS["urban"]),
    ]
    found = F.slice(F.filter(F.array(*tests), lambda h: h.isNotNull()), 1, 3)
    text = F.when(F.size(found) == 0, HAZARDS["none"]).otherwise(F.array_join(found, "; "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))), F.lit("."))


def change_percent(predicted, baseline) -> Column:
    p, b = _col(predicted), _col(baseline)
    return (p - b) / F.nullif(b, F.lit(0.0)) * 100


def trend(pct) -> Column:
    p = _col(pct)
    return (
        F.when(p > BAND, "significantly above average").when(p > 0, "above average")
        .when(p < -BAND, "significantly below average").when(p < 0, "below average")
        .otherwise("near average"))


def band(pct) -> Column:
    """high, low or normal change; NULL without a change."""
    p = _col(pct)
    return F.when(p > BAND, "high").when(p < -BAND, "low").when(p != 0, "normal")


def risk_level(pct) -> Column:
    return (F.when(band(pct) == "high", "low").when(band(pct) == "low", "high").otherwise("normal"))


# Impact per audience and band.
AUDIENCE_IMPACT = {
    "water_managers": {
        "high": "Above average snowpack suggests good water supply. Plan for normal to high reservoir releases.",
        "low": "Below average snowpack raises water supply concerns. Implement conservation measures.",
        "normal": "Near-average snowpack. Maintain normal water management operations.",
    },
    "ski_resorts": {
        "high": "Excellent snow conditions expected. Extended ski season likely.",
        "low": "Poor snow conditions expected. Consider early season closure or snowmaking investments.",
        "normal": "Average snow conditions. Normal ski season operations expected.",
    },
    "agriculture": {
        "high": "Adequate water supply for irrigation. Normal planting schedules recommended.",
        "low": "Water supply may be limited. Plan for reduced irrigation allocations.",
        "normal": "Normal water supply expected. Standard irrigation planning.",
    },
    "flood_control": {
        "high": "Monitor melt rates closely. Potential for above-normal runoff.",
        "low": "Low flood risk from snowmelt. Focus on drought preparedness.",
        "normal": "Normal flood risk. Standard monitoring procedures.",
    },
    "general_public": {
        "high": "Great conditions for winter recreation. Water conservation still recommended.",
        "low": "Limited winter recreation opportunities. Heightened water conservation awareness.",
        "normal": "Typical winter conditions. Normal recreation and water use.",
    },
}

# Recommendations per band.
RECOMMENDATIONS = {
    "high": ("Monitor snowpack accumulation rates to confirm trend",
             "Prepare for potential above-normal runoff in spring",
             "Consider water storage optimization strategies",
             "Communicate water supply outlook to stakeholders"),
    "low": ("Implement water conservation measures immediately",
            "Explore alternative water sources",
            "Communicate drought preparedness to stakeholders",
            "Monitor for potential early snowmelt"),
    "normal": ("Continue normal monitoring and operations",
               "Maintain contingency plans for both high and low scenarios",
               "Regular stakeholder communication"),
}


def _by_band(pct, texts) -> Column:
    b = band(pct)
    out = F.when(b == "high", texts["high"])
    for name in ("low", "normal"):
        out = out.when(b == name, texts[name])
    return out


def audience_impact(pct) -> Column:
    """Map audience -> text; NULL without a band."""
    pairs = [x for a, texts in AUDIENCE_IMPACT.items() for x in (F.lit(a), _by_band(pct, texts))]
    return F.when(band(pct).isNotNull(), F.create_map(*pairs))


def recommendations(pct) -> Column:
    lists = {b: F.array(*[F.lit(x) for x in items]) for b, items in RECOMMENDATIONS.items()}
    return _by_band(pct, lists)


# Names and units of the known targets.
TARGET_NAMES = {"swe": ("Snow Water Equivalent", "inches"), "snow_depth": ("Snow Depth", "inches")}


def forecast_summary(predicted, baseline, horizon: str, target: str) -> Column:
    """One sentence; without a usable baseline only the forecast itself."""
    p, b = _col(predicted), _col(baseline)
    name, unit = TARGET_NAMES.get(target, (target.upper(), "units"))
    pct = F.coalesce(change_percent(p, b), F.lit(0.0))
    head = F.concat(F.lit(f"The forecast predicts {name} of "), fixed_text(p),
                    F.lit(f" {unit} for the {horizon} period"))
    full = F.concat(head, F.lit(", which is "), trend(pct), F.lit(" ("), python_signed_text(pct),
                    F.lit("% from the historical average of "), fixed_text(b), F.lit(f" {unit})."))
    return F.when(b.isNotNull() & (b != 0), full).otherwise(F.concat(head, F.lit(".")))


def explain(df: DataFrame, predicted, baseline, horizon="30 days", target="swe") -> DataFrame:
    """All explanation columns for a table of forecasts that carries its baseline."""
    pct = change_percent(predicted, baseline)
    return df.withColumn("change_percentage", pct).withColumns({
        "forecast_horizon": F.lit(horizon),
        "confidence": F.lit("medium"),
        "risk_level": risk_level("change_percentage"),
        "trend": trend(F.coalesce("change_percentage", F.lit(0.0))),
        "summary": forecast_summary(predicted, baseline, horizon, target),
        "stakeholder_impact": audience_impact("change_percentage"),
        "recommendations": recommendations("change_percentage"),
    })


def driver_direction(importance) -> Column:
    return F.when(_col(importance) > 0, "positive").otherwise("negative")


def key_drivers(importance: DataFrame, k=5, by=()) -> DataFrame:
    """Top drivers with direction and a short description."""
    top = top_k(importance, k, "importance", by, ["feature"])
    return top.withColumns({
        "direction": driver_direction("importance"),
        "description": F.concat("feature", F.lit(" with importance "), fixed_text("importance", 3)),
    })


def with_drivers(explained: DataFrame, importance: DataFrame, k=5, by=()) -> DataFrame:
    """Explained forecasts with `key_drivers`, at most k structs from the most important down.

    `by` names columns of both tables that tell models apart; a forecast of a model without
    importances gets an empty list.
    """
    item = F.struct(F.col("importance").alias("__i"), "feature", "importance", "direction", "description")
    # By falling importance, ties by name, as `top_k` picks them.
    order = lambda a, b: (
        F.when(a["__i"] > b["__i"], -1).when(a["__i"] < b["__i"], 1)
        .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0))
    lists = key_drivers(importance, k, by).groupBy(*by).agg(F.array_sort(F.collect_list(item), order).alias("__d"))
    joined = explained.join(lists, list(by), "left") if by else explained.withColumn("__d", lists.scalar())
    shown = F.transform("__d", lambda d: F.struct(*[d[c].alias(c) for c in ("feature", "importance", "direction", "description")]))
    return joined.withColumn("key_drivers", F.coalesce(shown, F.array())).drop("__d")


# What is known about common features (explanation, influence, implications).
GLOSSARY = {
    "day_of_year": (
        "Day of year captures seasonal patterns in snowpack accumulation and melt.",
        "Strong seasonal cycle with accumulation in winter and melt in spring.",
        "Essential for capturing the annual snowpack cycle."),
    "temperature": (
        "Temperature affects snow accumulation (cold) and melt (warm).",
        "Higher temperatures generally reduce snowpack through melt.",
        "Critical for understanding melt dynamics and timing."),
    "precipitation": (
        "Precipitation provides the water input for snowpack accumulation.",
        "Higher precipitation increases snowpack, especially as snow.",
        "Primary driver of snowpack accumulation."),
    "swe_lag_7": (
        "7-day lag of SWE captures recent snowpack conditions.",
        "Recent snowpack conditions strongly influence current conditions.",
        "Helps model understand recent accumulation or melt trends."),
    "temperature_anomaly": (
        "Temperature anomaly shows deviation from normal conditions.",
        "Positive anomalies (warmer) reduce snowpack, negative anomalies (colder) increase it.",
        "Important for understanding climate variability impacts."),
    "precipitation_roll_sum_30": (
        "30-day rolling sum of precipitation captures recent moisture input.",
        "Higher recent precipitation leads to higher snowpack.",
        "Helps model understand recent accumulation patterns."),
    "oni": (
        "Oceanic Niño Index measures ENSO phase and strength.",
        "El Niño typically brings wetter conditions, La Niña drier to California.",
        "Important for seasonal forecasting and climate context."),
    "enso_phase": (
        "ENSO phase (El Niño, La Niña, Neutral) categorizes climate state.",
        "Different phases have characteristic impacts on precipitation and temperature.",
        "Provides categorical climate context for interpretation."),
}


def explain_features(importance: DataFrame, target: str, k=5) -> DataFrame:
    """The k most important features with stored texts, generic ones for unknown features."""
    spark = importance.sparkSession
    known = spark.createDataFrame(
        [(f, *t) for f, t in GLOSSARY.items()],
        "feature string, explanation string, influence string, implications string")
    top = top_k(importance, k, "importance", (), ["feature"])
    generic = {
        "explanation": F.concat("feature", F.lit(f" is an important predictor of {target}.")),
        "influence": F.concat(F.lit("Higher "), "feature",
                              F.lit(f" values tend to be associated with higher {target}.")),
        "implications": F.lit(
            f"This feature provides valuable information for {target} prediction."),
    }
    joined = top.join(F.broadcast(known), "feature", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), g) for c, g in generic.items()})


def scenario_effect(change_pct) -> Column:
    """Struct of direction and magnitude wording."""
    p = _col(change_pct)
    return F.struct(
        F.when(p > BAND, "significantly increases").when(p > 0, "increases")
        .when(p < -BAND, "significantly decreases").when(p < 0, "decreases")
        .otherwise("has little effect on").alias("direction"),
        F.when(p > BAND, "substantial increase").when(p > 0, "moderate increase")
        .when(p < -BAND, "substantial decrease").when(p < 0, "moderate decrease")
        .otherwise("minimal change in").alias("magnitude"))


def scenario_summary(name, change_pct, parameters, category, target="swe") -> Column:
    """One paragraph per scenario; lists its first three parameters by name."""
    shown = {"swe": "Snow Water Equivalent", "snow_depth": "snow depth"}.get(target, target)
    effect = scenario_effect(change_pct)
    keys = F.array_join(F.slice(F.array_sort(F.map_keys(_col(parameters))), 1, 3), ", ")
    return F.concat(
        F.lit("The '"), _col(name), F.lit("' scenario "), effect["direction"],
        F.lit(f" {shown} predictions, resulting in a "), effect["magnitude"], F.lit(" of "),
        python_signed_text(_col(change_pct)),
        F.lit("% from the baseline. The scenario adjusts parameters including "), keys,
        F.lit(". This demonstrates how "), _col(category),
        F.lit(" variations can significantly impact snowpack forecasts, highlighting the importance "
              "of considering these factors in water resource planning."))


def quality_findings(profile: DataFrame, span_years: int, outliers: DataFrame = None) -> DataFrame:
    """(subject, issue, severity, action) rows from a column profile and the time span.

    `outliers` holds (column_name, outlier_count).
    """
    name = F.col("column_name")
    missing = profile.where("missing_percent > 10").select(
        name.alias("subject"),
        F.concat(name, F.lit(" has "), fixed_text("missing_percent"), F.lit("% missing values")).alias("issue"),
        F.when(F.col("missing_percent") > 30, "high").otherwise("medium").alias("severity"),
        F.concat(F.lit("Impute or interpolate missing values in "), name).alias("action"))
    found = missing
    if outliers is not None:
        found = found.unionByName(outliers.where("outlier_count > 0").select(
            name.alias("subject"),
            F.concat(name, F.lit(" has "), F.col("outlier_count").cast("string"), F.lit(" outliers")).alias("issue"),
            F.lit("medium").alias("severity"),
            F.concat(F.lit("Cap or remove outliers in "), name).alias("action")))
    if span_years is not None and span_years < 5:
        row = [("time span", f"Dataset only covers {span_years} years", "high",
                "Collect more historical data for better model training")]
        found = found.unionByName(profile.sparkSession.createDataFrame(
            row, "subject string, issue string, severity string, action string"))
    return found


def outlier_counts(df: DataFrame, cols, threshold=3.0) -> DataFrame:
    """Values beyond t population deviations per column."""
    from firn.operators.aggregates import stack_long, with_stats

    stats = df.agg(*[f(c).alias(f"{c}__{n}") for c in cols
                     for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    far = [
        F.count_if(F.abs(F.col(c) - F.col(f"__stats.{c}__m")) > threshold * F.col(f"__stats.{c}__s"))
        .alias(f"{c}__outlier_count") for c in cols
    ]
    return stack_long(with_stats(df.select(*cols), stats).agg(*far), cols, ["outlier_count"])


# Feature, needed column ("*date" any date-like, "*index" any index column),
# description, importance, category. {t} is the target.
FEATURES = (
    ("day_of_year", "*date", "Day of year for seasonal patterns", "high", "temporal"),
    ("water_year", "*date", "Water year (Oct 1 - Sep 30) for hydrological analysis", "high", "temporal"),
    ("{t}_lag_7", "{t}", "7-day lag of {t}", "high", "temporal"),
    ("{t}_lag_30", "{t}", "30-day lag of {t}", "medium", "temporal"),
    ("precipitation_roll_sum_30", "precipitation", "30-day rolling sum of precipitation", "high", "climate"),
    ("temperature_anomaly", "temperature", "Temperature anomaly from monthly climatology", "high", "climate"),
    ("enso_phase", "*index", "ENSO phase (El Niño, La Niña, Neutral)", "high", "climate"),
)


def applicable_features(variables: DataFrame, target="swe") -> DataFrame:
    """Feature suggestions whose needed column is among `variables` (a `column_name` table)."""
    v = F.lower("column_name")
    kinds = variables.select(F.explode(F.filter(F.array(
        F.col("column_name"), F.when(v.contains("date"), "*date"),
        F.when(v.contains("enso") | v.contains("oni"), "*index"),
    ), lambda x: x.isNotNull())).alias("needs")).distinct()
    rows = [tuple(x.format(t=target) for x in f) for f in FEATURES]
    catalogue = variables.sparkSession.createDataFrame(
        rows, "feature string, needs string, description string, importance string, category string")
    return F.broadcast(catalogue).join(kinds, "needs", "left_semi").drop("needs")
