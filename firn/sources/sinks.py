"""Result sinks: tidy tables as parquet, the nested outlook as JSON."""

from pyspark.sql import DataFrame


def write_tidy(tables: dict, folder: str, mode="overwrite"):
    """One parquet folder per grain."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


def write_json(nested: DataFrame, folder: str, mode="overwrite"):
    nested.write.mode(mode).json(folder)


def write_daily(df: DataFrame, folder: str, mode="overwrite"):
    """Daily observations by year, so date filters skip folders.

    Rows spread over 32 writers per year; a year never funnels through one task.
    """
    from pyspark.sql import functions as F

    spread = F.pmod(F.xxhash64("station_id", "date"), F.lit(32))
    out = df.withColumn("year", F.year("date"))
    out.repartition("year", spread).write.mode(mode).partitionBy("year").parquet(folder)
