"""Scans of the three observation sources and their named bundle."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from firn import schemas as K
from firn.functions.scalars import nan_to_null


def _read(spark, path, schema, fmt):
    return nan_to_null(spark.read.schema(schema).format(fmt).load(path))


def pick(df: DataFrame, stations=None, start=None, end=None) -> DataFrame:
    """Station list and inclusive date range as plain predicates, so they reach the scan.

    `stations="all"` keeps every station; a DataFrame with `station_id` keeps its stations by a
    semi-join, for lists too long to write into a plan. A `year` column, as folders by year
    have, is limited too, so whole folders are skipped.
    """
    if isinstance(stations, DataFrame):
        df = df.join(stations.select("station_id"), "station_id", "left_semi")
    elif stations is not None and stations != "all":
        df = df.where(F.col("station_id").isin(*stations))
    for bound, side in ((start, "__ge__"), (end, "__le__")):
        if bound is not None:
            df = df.where(getattr(F.col("date"), side)(F.to_date(F.lit(bound))))
            if "year" in df.columns:
                df = df.where(getattr(F.col("year"), side)(int(bound[:4])))
    return df


def during(df: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows of `df` whose date lies in any of the (start, end) periods, both days included.

    Periods become the years they touch, so the join is an equi-join on `year`. On a table in
    folders by year Spark prunes the folders at run time by the years it finds. Periods that
    overlap keep a row once; those without a start or an end, or with both reversed, keep none.
    """
    years = periods.where("start <= end").select(
        "start", "end", F.explode(F.sequence(F.year("start"), F.year("end"))).alias("__year"))
    year = df["year"] if "year" in df.columns else F.year(df["date"])
    inside = (df["date"] >= years["start"]) & (df["date"] <= years["end"])
    return df.join(years, (year == years["__year"]) & inside, "left_semi")


def trailing_start(as_of: str, years: int) -> str:
    """First of January `years` before `as_of`, the default window of the scans."""
    return f"{int(as_of[:4]) - years:04d}-01-01"


def load_snow(spark, paths: dict, source="cdec", stations=None, start=None, end=None, as_of=None,
              fmt="parquet") -> DataFrame:
    """Snow observations of one source. `paths` maps sources to folders.

    Without `stations` the default ones are read; a list, a DataFrame or "all" overrides them.
    """
    if source not in K.SNOW_SOURCES:
        raise ValueError(f"Unknown snow source {source!r}; expected one of {K.SNOW_SOURCES}")
    df = _read(spark, paths[source], K.SNOW_SCHEMA, fmt)
    return _defaults(df, K.SNOW_STATIONS if stations is None else stations, start, end, as_of, 20)


def load_climate(spark, paths: dict, source="noaa", stations=None, start=None, end=None,
                 as_of=None, fmt="parquet") -> DataFrame:
    if source not in K.CLIMATE_SOURCES:
        raise ValueError(f"Unknown climate source {source!r}; expected one of {K.CLIMATE_SOURCES}")
    df = _read(spark, paths[source], K.CLIMATE_SCHEMA, fmt)
    return _defaults(df, K.CLIMATE_STATIONS if stations is None else stations, start, end, as_of, 20)


def load_index(spark, path, start=None, end=None, as_of=None, fmt="parquet") -> DataFrame:
    return _defaults(_read(spark, path, K.INDEX_SCHEMA, fmt), None, start, end, as_of, 50)


def _defaults(df, stations, start, end, as_of, years):
    if start is None and as_of is not None:
        start = trailing_start(as_of, years)
    return pick(df, stations, start, end or as_of)


def load_bundle(spark: SparkSession, snow_paths, climate_paths, index_path, start=None, end=None,
                as_of=None, fmt="parquet", views=False, stations=None) -> dict:
    """All sources by name; with `views` also as temporary views of those names.

    `stations` is for both station sources; without it each reads its default ones.
    """
    bundle = {
        "snowpack": load_snow(spark, snow_paths, stations=stations, start=start, end=end, as_of=as_of, fmt=fmt),
        "climate": load_climate(spark, climate_paths, stations=stations, start=start, end=end, as_of=as_of, fmt=fmt),
        "enso": load_index(spark, index_path, start, end, as_of, fmt),
    }
    if views:
        for name, df in bundle.items():
            df.createOrReplaceTempView(name)
    return bundle


def load_history(spark, path, fmt="parquet") -> DataFrame:
    return _read(spark, path, K.HISTORY_SCHEMA, fmt)
