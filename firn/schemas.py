"""Source schemas, regions, season phases, scenarios, thresholds."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

D, S, I = T.DoubleType(), T.StringType(), T.IntegerType()


def _fields(*pairs):
    return T.StructType([T.StructField(n, t) for n, t in pairs])


SNOW_SCHEMA = _fields(
    ("date", T.DateType()), ("station_id", S), ("swe", D), ("snow_depth", D),
    ("temperature", D), ("precipitation", D),
)
CLIMATE_SCHEMA = _fields(
    ("date", T.DateType()), ("station_id", S), ("temperature", D), ("precipitation", D),
    ("humidity", D), ("wind_speed", D),
)
INDEX_SCHEMA = _fields(
    ("date", T.DateType()), ("oni", D), ("mei", D), ("nino34", D), ("soi", D),
)
HISTORY_SCHEMA = _fields(
    ("water_year", I), ("month", I), ("region", S), ("enso", D), ("pdo", D), ("ao", D),
    ("pna", D), ("temperature_anomaly", D), ("precipitation_mm", D), ("snowfall_cm", D),
)

# Data sources and default stations.
SNOW_SOURCES = ("cdec", "usgs", "nrcs")
CLIMATE_SOURCES = ("noaa", "cimis")
SNOW_STATIONS = (
    "CAC001", "CAC002", "CAC003", "NAC001", "NAC002", "NAC003", "SAC001", "SAC002", "SAC003",
)
CLIMATE_STATIONS = ("USC0004", "USC0005", "USC0006")

# Winter months in season order.
WINTER_MONTHS = (11, 12, 1, 2, 3, 4)
MONTH_NAMES = ("Nov", "Dec", "Jan", "Feb", "Mar", "Apr")
CLIMATE_INDICES = ("enso", "pdo", "ao", "pna")
HISTORY_NUMBERS = (
    "water_year", "month", "precipitation_mm", "snowfall_cm", *CLIMATE_INDICES,
    "temperature_anomaly",
)

# Phase id, label, months text, month numbers.
SEASON_PHASES = (
    ("early", "Early season", "Nov–Dec", (11, 12)),
    ("mid", "Mid season", "Jan–Feb", (1, 2)),
    ("late", "Late season", "Mar–Apr", (3, 4)),
)

# Region, latitude, elevation in m, area weight, label.
REGIONS = (
    ("north_coast", 40.2, 900, 0.16, "North Coast"),
    ("shasta_cascades", 41.0, 1700, 0.12, "Shasta & Cascades"),
    ("northern_sierra", 39.6, 2100, 0.14, "Northern Sierra"),
    ("central_sierra", 38.3, 2300, 0.15, "Central Sierra"),
    ("southern_sierra", 36.8, 2400, 0.13, "Southern Sierra"),
    ("central_coast_valleys", 36.7, 250, 0.18, "Central Coast & Valleys"),
    ("southern_california", 34.2, 750, 0.12, "Southern California"),
)

# The default what-if scenarios (name, description, numbers, phase, category).
DEFAULT_SCENARIOS = (
    ("Strong El Niño",
     "Strong El Niño conditions with increased precipitation and warmer temperatures",
     {"oni": 2.0, "precipitation_multiplier": 1.2, "temperature_adjustment": 1.5},
     "El Niño", "enso"),
    ("Strong La Niña",
     "Strong La Niña conditions with decreased precipitation and cooler temperatures",
     {"oni": -2.0, "precipitation_multiplier": 0.8, "temperature_adjustment": -1.0},
     "La Niña", "enso"),
    ("Warm Winter", "Warmer than average winter temperatures",
     {"temperature_adjustment": 2.0, "snow_line_elevation": 100.0}, None, "climate"),
    ("Cold Winter", "Colder than average winter temperatures",
     {"temperature_adjustment": -2.0, "snow_line_elevation": -100.0}, None, "climate"),
    ("Wet Winter", "Wetter than average winter with increased precipitation",
     {"precipitation_multiplier": 1.5, "storm_frequency": 1.2}, None, "weather"),
    ("Dry Winter", "Drier than average winter with decreased precipitation",
     {"precipitation_multiplier": 0.6, "storm_frequency": 0.8}, None, "weather"),
)

SCENARIO_SCHEMA = T.StructType([
    T.StructField("name", S), T.StructField("description", S),
    T.StructField("parameters", T.MapType(S, D)), T.StructField("phase", S),
    T.StructField("category", S),
])


def regions(spark: SparkSession) -> DataFrame:
    """The 7-row region dimension; small by definition, so always broadcast."""
    rows = [(i, *r) for i, r in enumerate(REGIONS)]
    return F.broadcast(spark.createDataFrame(
        rows, "region_order int, region string, latitude double, elevation_m int, "
              "area_weight double, label string"))


def season_months(spark: SparkSession) -> DataFrame:
    """The 6-row month to season-phase dimension; always broadcast."""
    rows = [
        (m, WINTER_MONTHS.index(m), i, pid, label, text)
        for i, (pid, label, text, months) in enumerate(SEASON_PHASES) for m in months
    ]
    return F.broadcast(spark.createDataFrame(
        rows, "month int, month_order int, phase_order int, phase_id string, "
              "phase_label string, phase_months string"))


def default_scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_SCENARIOS, SCENARIO_SCHEMA)
