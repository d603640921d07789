"""Readers on files written here, in the layouts that the catalogs have."""

import gzip
import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from skycensus.operators import observations  # noqa: E402
from skycensus.sources import files  # noqa: E402


def put(path, text):
    (gzip.open if str(path).endswith(".gz") else open)(path, "wt").write(text)
    return str(path)


def test_fixed_width_catalogs(spark, tmp_path):
    row = lambda *x: "".join(str(v).rjust(w) for v, w in zip(x, [15, 12, 25, 25, 25, 25, 25, 25, 6, 6, 3], strict=True))
    text = "".join(f"head {k}\n" for k in range(6)) + row("'2008VK110'", 60000, 2.5, 0.1, 3.25, 4, 5, 6, 15.2, 0.15, 0) + "\n\n" + row("'1999AB'", 60001, "bad", 0.2, 1, 2, 3, 4, "", 0.15, 0) + "\n"
    got = files.fixed_width_file(spark, put(tmp_path / "one.cat", text), files.EXTERNAL_1).collect()
    assert [(r.name, r.epoch_mjd, r.a, r.e, r.h) for r in got] == [("'2008VK110'", 60000.0, 2.5, 0.1, 15.2), ("'1999AB'", 60001.0, None, 0.2, None)]
    row = lambda *x: "".join(str(v).rjust(w) for v, w in zip(x, [14, 6, 12, 11, 10, 10, 10, 12, 6, 5, 10], strict=True))
    path = put(tmp_path / "two.gz", "names\n-----\n" + row("2020 AB1", 60000, 2.5, 0.1, 3, 4, 5, 6, 15.25, 0.15, "JPL 3") + "\n")
    (r,) = files.fixed_width_file(spark, path, files.EXTERNAL_2).collect()
    assert (r.desig, r.h, r.ref, r.node) == ("2020 AB1", 15.25, "JPL 3", 5.0)
    mags = files.fixed_width_file(spark, put(tmp_path / "mags", "PK20A01A12.50rest of the line\nDK21B02B 9.1 x\n"), files.COMET_MAGNITUDES)
    assert [tuple(r) for r in mags.collect()] == [("PK20A01A", 12.5), ("DK21B02B", 9.1)]


def line(obj, day, part, mag="15.0", band="V", station="F51"):
    return ("     " + obj + "  C" + day + part).ljust(65) + mag.rjust(5) + band + " " * 6 + station


def test_observation_files_aliases_and_reduction(spark, tmp_path):
    one = [line("K20A01A", "2020 01 05", ".25000 "), line("K20A01A", "2020 01 05", ".25000 ", "9.0"), line("K20A01A", "2020 01 05", ".75000 ", "?"), line("K20B02B", "2020 13 05", ".25000 "), line("K20A01A", "2020 01 06", ".25001 ", "16.0", "R")[:70]]
    two = [line("OLD0001", "2020 08 01", ".50000 ", "17.0", "r"), line("OLD0002", "2020 08  2", ".50000 ")]
    rows = files.observation_lines(spark, put(tmp_path / "a.txt", "\n".join(one) + "\n"), put(tmp_path / "b.txt", "\n".join(two) + "\n"))
    assert files.observation_lines(spark, str(tmp_path / "a.txt"), str(tmp_path / "none")).count() == 5
    ids = files.lines(spark, put(tmp_path / "ids.txt", "K20A01AOLD0001\nXXXXXXXOLD0002\n"))
    nums = files.lines(spark, put(tmp_path / "nums.txt", "000001K20A01AOLD0002\n"))
    parsed = observations.renamed(observations.lines(rows), [observations.aliases(ids), observations.aliases(nums, 6)])
    got = sorted((r.obj, round(r.t, 5), r.mag, r.band) for r in parsed.collect())
    base = 18266
    assert got == [("K20A01A", base + 0.25, 15.0, "V"), ("K20A01A", base + 0.75, None, "V"), ("K20A01A", base + 1.25001, None, ""), ("K20A01A", base + 209.5, 17.0, "r"), ("K20A01A", base + 210.5, 15.0, "V")]
    (r,) = observations.reduced(parsed).collect()
    # nights begin over half a day past the last beginning: exactly half a day doesn't count
    assert (r.opposition_count, r.nights_total, r.opp_with_most_nights, round(r.v_max, 2), r.v_second_min, r.majority_station) == (2, 4, 2, 17.23, 15.0, "F51")


def test_packed_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("K07Tf8A",), ("PLS2040",), ("J95X00A",), ("00433",), ("A0345",), ("bad",), (None,)], "p string")
    assert [r.n for r in df.select(observations.unpacked(F.col("p")).alias("n")).collect()] == ["2007 TA418", "2040 P-L", "1995 XA", "433", "100345", None, None]
    days = spark.createDataFrame([("K194S",), ("k194s5",), ("K19Z1",), ("J9611",), ("K192V",), (None,)], "p string")
    assert [r.d for r in days.select(observations.packed_day(F.col("p")).alias("d")).collect()] == [2458601.5, 2458602.0, None, 2450083.5, None, None]


def test_side_tables(spark, tmp_path):
    path = put(tmp_path / "fix.csv", 'Object,  Corrected H,Reason\n2020 AB, 15.5,"two lines,\nand a ""quote"""\n"2021 CD",bad,\n')
    got = files.csv(spark, path, {"Object": "string", "Corrected H": "double", "Reason": "string"}).collect()
    assert [tuple(r) for r in got] == [("2020 AB", 15.5, 'two lines,\nand a "quote"'), ("2021 CD", None, None)]
    assert files.csv_or_none(spark, str(tmp_path / "none.csv"), {"Object": "string", "Min Nights": "int"}).count() == 0
    assert [r.item for r in files.json_list(spark, put(tmp_path / "l.json", '["2020 AB", "P/2019 X"]')).collect()] == ["2020 AB", "P/2019 X"]
    assert [r.item for r in files.json_list(spark, put(tmp_path / "n.json", "[-1, -22]"), "bigint").collect()] == [-1, -22]
    stats = files.stats_json(spark, put(tmp_path / "s.json", json.dumps({"A": {"total_arc": 1.5, "nights_total": 3}, "B": {"total_arc": 0, "v_mag_min": None}})), "total_arc double, nights_total bigint, v_mag_min double")
    assert {tuple(r) for r in stats.collect()} == {("A", 1.5, 3, None), ("B", 0.0, None, None)}
    path = put(tmp_path / "o.json.gz", json.dumps([{"Principal_desig": "2020 AB", "a": 2.5, "U": "3"}, {"Principal_desig": "2021 CD", "U": "E", "H": 33.5}, {"Principal_desig": "2022 EF"}]))
    assert [(r.Principal_desig, r.a, r.U, r.H) for r in files.orbits(spark, path).collect()] == [("2020 AB", 2.5, 3.0, None), ("2021 CD", None, 10.0, 33.5), ("2022 EF", None, 10.0, None)]


def test_snapshots_scores_and_kept_lines(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.25), ("b", None)], "desig string, ext double")
    assert sorted(map(tuple, files.snapshot(df, str(tmp_path / "snap")).collect()), key=str) == [("a", 0.25), ("b", None)]
    assert any(f.endswith(".zstd.parquet") for f in os.listdir(tmp_path / "snap"))
    files.scores(df, str(tmp_path / "scores"))
    assert sorted(map(tuple, files.read_scores(spark, str(tmp_path / "scores")).collect()), key=str) == [("a", 0.25), ("b", None)]
    rows = files.lines(spark, put(tmp_path / "els", "    PK20\n    CK21\n   PK22\n    DK23\n    AK24\n"))
    assert [r.value for r in files.kept_lines(rows).collect()] == ["    PK20", "    DK23", "    AK24"]


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def test_statistics_and_scores_join_the_catalog(spark, tmp_path):
    """Packed and plain names, two rows of one name, names that clash, objects without either, empty sides."""
    from skycensus.operators import catalog

    orb = spark.createDataFrame([("2020 AA1", 5.0, 0.5), ("433", 6.0, None), ("2021 BB", None, 0.1), (None, 1.0, 0.2)], "desig string, total_arc double, ext double")
    stats = spark.createDataFrame([("K20A01A", 3, 10.0, 1.5), ("2020 AA1", 5, 2.0, 2.5), ("00433", 7, 1.0, None), ("K99Z99Z", 1, 1.0, 1.0), (None, 9, 9.0, 9.0)], "obj string, nights_total long, total_arc double, v_min double")
    files.write_stats(stats.filter("obj is not null"), str(tmp_path / "stats"), "obj")
    read = files.stats_lines(spark, str(tmp_path / "stats"), "nights_total bigint, total_arc double, v_min double", "obj")
    assert sorted(map(tuple, read.select(*stats.columns).collect())) == sorted(map(tuple, stats.filter("obj is not null").collect()))
    got = catalog.with_observations(orb, stats)
    assert got.columns == ["desig", "total_arc", "ext", "nights_total", "v_min"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("2020 AA1", 5.0, 0.5, 5, 2.5), ("433", 6.0, None, 7, None), ("2021 BB", None, 0.1, None, None), (None, 1.0, 0.2, None, None)], key=str)
    assert catalog.with_observations(orb, stats.filter("obj = 'none'")).filter("nights_total is null").count() == 4
    scores = spark.createDataFrame([("433", 0.25), ("433", 0.75), ("no such", 0.5), ("2021 BB", None)], "desig string, ext double")
    assert sorted([(r.desig, r.ext) for r in catalog.with_scores(orb, scores).collect()], key=str) == sorted([("2020 AA1", None), ("433", 0.75), ("2021 BB", None), (None, None)], key=str)
    assert catalog.with_scores(orb.filter("desig = 'x'"), scores).count() == 0
