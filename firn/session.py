"""Session set-up for local runs, and lineage cutting that survives lost executors."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores="*", shuffle_partitions=8) -> SparkSession:
    """A session for tests and the bench. On a cluster use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("firn")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="firn-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`, else one in the warehouse.

    Both are shared by the driver and all executors.
    """
    shared = configured_folder(spark) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/firn_scratch"
    return shared.rstrip("/")


def configured_folder(spark: SparkSession):
    return spark.conf.get("spark.checkpoint.dir", None) or None


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as parquet to the shared folder and go on from there.

    This cuts the lineage, survives lost executors, and later passes read only the columns
    they need. `forget` removes the files.
    """
    path = f"{shared_folder(df.sparkSession)}/firn-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.firn_path = path
    return out


def forget(df: DataFrame) -> None:
    """Remove what `materialize` wrote for `df`; nothing may read it afterwards."""
    path = getattr(df, "firn_path", None)
    if path is None:
        raise ValueError("not a table that materialize returned")
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
