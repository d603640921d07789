"""Queries against their SQL on keys that the small tables don't have: over 60,000, over a million, circular orbits."""

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


def compared(spark, name, at):
    """(rows of the query, rows of its SQL) over the tables in folder `at`, sorted."""
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    got = QUERIES[name](spark, str(at))
    cols = sorted(got.columns)
    key = lambda r: tuple((x is None, -1 if x is None else round(x, 5) if isinstance(x, float) else x) for x in r)
    have = sorted((key(tuple(r)) for r in got.select(*cols).collect()))
    return have, sorted(key(r) for r in con.execute(f"select {', '.join(cols)} from ({SQL[name]})").fetchall())


def shifted(at, by):
    """The tables of sf0.01 with keys k of objects moved by the SQL expression `by`."""
    con = duckdb.connect()
    con.execute(f"copy (select * replace (c_custkey + {by.format('c_custkey')} as c_custkey) from '{DIR}/customer.parquet') to '{at}/customer.parquet'")
    con.execute(f"copy (select * replace (o_custkey + {by.format('o_custkey')} as o_custkey) from '{DIR}/orders.parquet') to '{at}/orders.parquet'")


@pytest.mark.parametrize("name", ["catalog_from_lines", "alias_rewrite", "obs_lines"])
def test_names_of_large_keys(spark, tmp_path, name):
    shifted(tmp_path, "[0, 60000, 1500000, 13000000][({0} % 4 + 1)::INT]")
    have, want = compared(spark, name, tmp_path)
    assert have == want and len(have) >= 1500


def test_half_of_a_circle(spark, tmp_path):
    """Circular orbits weigh their 96 places alike: the median is the 48th distance, whatever the rounding of the sum."""
    con = duckdb.connect()
    con.execute(f"copy (select * replace (c_custkey * 950 as c_custkey) from '{DIR}/customer.parquet') to '{tmp_path}/customer.parquet'")
    con.execute(f"copy (from '{DIR}/orders.parquet' limit 10) to '{tmp_path}/orders.parquet'")
    have, want = compared(spark, "neo_grid", tmp_path)
    assert have == want and len(have) >= 1500
