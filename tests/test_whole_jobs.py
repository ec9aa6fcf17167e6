"""Jobs on small tables of their own: the whole input is read, and rows are no wider than they need be."""

import datetime as dt

import pytest

from firn.catalog import JOBS

LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


@pytest.fixture
def tables(spark, tmp_path):
    """Twelve years of three stations, some rows without a station or a day."""
    days = [dt.datetime(1990 + i, 1 + i % 12, 3 + i) for i in range(12)]
    rows = [(i, 1, k, 1, 5.0 + i, 100.0 * k + i, 0.05, 0.02, "N", "O", d) for k in (4, 9, 11) for i, d in enumerate(days)]
    rows += [(90, 1, None, 1, 5.0, 10.0, 0.05, 0.02, "N", "O", days[0]), (91, 1, 4, 1, 5.0, 10.0, 0.05, 0.02, "N", "O", None)]
    spark.createDataFrame(rows, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, 100.0 + i, d) for i, d in enumerate(days)], "o_orderkey long, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_bundle_counts_every_row(spark, tables):
    got = {r["name"]: r["row_count"] for r in JOBS["s5_bundle"](spark, tables).collect()}
    assert got == {"snowpack": 38, "climate": 38, "enso": 12}


def test_station_encoding_stays_sparse(spark, tables):
    """Slots in sorted order, none for a row without a station, and no array as wide as there are stations."""
    done = JOBS["m18_station_encoding"](spark, tables)
    assert {(r.station_id, r.slot, r.total, r.width) for r in done.collect()} == {
        ("ST11", 1, 1.0, 3), ("ST4", 2, 1.0, 3), ("ST9", 3, 1.0, 3), (None, 0, 0.0, 3)}
    assert "UDF(station_id__vector" not in done._jdf.queryExecution().toString()
