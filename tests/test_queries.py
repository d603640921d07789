"""Every query of the engine against its SQL."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from skycensus.registry import QUERIES, SQL  # noqa: E402

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.mark.parametrize("name", SQL)
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = QUERIES[name](spark, DIR)
    rel = con.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    key = lambda r: tuple((x is None, -1 if x is None else round(x, 5) if isinstance(x, float) else x) for x in r)
    want = sorted(con.execute(f"select {', '.join(cols)} from ({SQL[name]})").fetchall(), key=key)
    have = sorted((tuple(r) for r in got.select(*cols).collect()), key=key)
    assert len(have) == len(want) > 0
    for a, b in zip(have, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, (int, float)) and x is not None for x in a) else key(a) == key(b)
