"""One list of named jobs: how Spark runs them and the SQL that checks them."""

from pyspark.sql import functions as F

from firn.catalog.views import with_views

JOBS = {}
CHECKS = {}


def job(name, sql=None):
    """Register `fn(spark, sf_dir)` under `name`, with its check where SQL can state it."""

    def keep(fn):
        JOBS[name] = fn
        if sql is not None:
            CHECKS[name] = with_views(sql)
        return fn

    return keep


def fixed4(col, scale=10000):
    """Four fixed digits; the offset keeps exact halves on one side in both engines."""
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(col * scale + 0.5001) / scale


def fixed2(col):
    return fixed4(col, 100)


def day_text(col="date"):
    return F.col(col).cast("string")
