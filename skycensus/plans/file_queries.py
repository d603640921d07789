"""Queries that go through written files: observation lines to catalog rows, catalogs, side tables, snapshots and scores; DuckDB SQL written out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycensus.operators import catalog, observations
from skycensus.operators.lineage import fresh
from skycensus.plans import fixtures as fx
from skycensus.plans.base import FINAL, OBS, ORB, query, rounded
from skycensus.plans.observation_queries import LINES, NIGHTS, PACKED, RECURSIVE, obs_text
from skycensus.sources import files

c = F.col
STATS = "total_arc double, nights_total bigint, opposition_count bigint, opp_with_most_nights bigint, other_opps bigint, longest_opp_arc double"


def packed_text(spark, sf_dir) -> DataFrame:
    """obs_text() with packed provisional names: the year, half and second letter and the cycle of named()."""

    def name(k):
        tens = F.substr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), F.floor(k % 600 / 10).cast("int") + 1, F.lit(1))
        year, half, second = named(k)
        return F.concat(F.lit("K"), year, half, tens, (k % 10).cast("string"), second)

    return obs_text(spark, sf_dir, name)


def named(k):
    """Two digits of the year, half and second letter of the name of object k: 600 cycles a year, 100 years a pair of letters, AB before BB."""
    block = F.floor(k / 60_000)
    letter = lambda x, n: F.substr(F.lit("ABCDEFGHJKLMNOPQRSTUVWXYZ"), (x % n + 1).cast("int"), F.lit(1))
    return F.lpad(F.floor(k / 600 % 100).cast("string"), 2, "0"), letter(block, 24), letter(F.floor(block / 24) + 1, 25)


NAMED = "'20' || lpad((k // 600 % 100)::VARCHAR, 2, '0') || ' ' || substring('ABCDEFGHJKLMNOPQRSTUVWXY', (k // 60000 % 24)::INT + 1, 1) || substring('ABCDEFGHJKLMNOPQRSTUVWXYZ', ((k // 1440000 + 1) % 25)::INT + 1, 1) || CASE WHEN k % 600 > 0 THEN (k % 600)::VARCHAR ELSE '' END"


@query(RECURSIVE + NIGHTS.replace(OBS, LINES) + f""", per AS (SELECT obj, max(segment)::BIGINT AS opposition_count, sum(nights)::BIGINT AS nights_total, max(nights)::BIGINT AS most, coalesce(max(arc) FILTER (arc > 0), 0) AS opp_arc FROM seg GROUP BY obj),
 arcs AS (SELECT obj, max(t) - min(t) AS total_arc FROM g GROUP BY obj), base AS (SELECT c_custkey::BIGINT AS k, (c_custkey % 60)::DOUBLE AS arc_length FROM customer)
 SELECT {NAMED} AS desig, arc_length, round(total_arc, 6) AS total_arc, nights_total, opposition_count, most AS opp_with_most_nights, nights_total - most AS other_opps, round(opp_arc, 6) AS longest_opp_arc,
  CASE WHEN k % 7 <> 0 THEN round((k * 97) % 1000 / 1000.0, 6)::DOUBLE END AS ext, k % 59 = 0 OR k % 62 = 0 AS filtered_out FROM base LEFT JOIN arcs ON arcs.obj = {PACKED.format("'K'", 'k')} LEFT JOIN per ON per.obj = arcs.obj""")  # fmt: skip
def catalog_from_lines(spark, sf_dir):
    """From two files of 80-column lines to flagged catalog rows: reduced, statistics and earlier scores written and read, joined, kept as a snapshot."""
    text, at = packed_text(spark, sf_dir), fresh(spark, "catalog")
    text.filter("line_no < 100000000").select("value").write.text(f"{at}/one")
    text.filter("line_no >= 100000000").select("value").write.text(f"{at}/two")
    seen = observations.reduced(observations.lines(files.observation_lines(spark, f"{at}/one", f"{at}/two")), dealt=True)
    files.write_stats(seen, f"{at}/stats", "obj")
    k = c("c_custkey").cast("bigint")
    name = F.concat(F.lit("20"), named(k)[0], F.lit(" "), *named(k)[1:], F.when(k % 600 > 0, (k % 600).cast("string")).otherwise(""))
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("k"), name.alias("desig"), (k % 60).cast("double").alias("arc_length"))
    files.scores(keys.filter("k % 7 <> 0").withColumn("ext", c("k") * 97 % 1000 / 1000), f"{at}/scores")
    orb = catalog.with_observations(keys.drop("k"), files.stats_lines(spark, f"{at}/stats", STATS, "obj"))
    orb = catalog.with_scores(orb, files.read_scores(spark, f"{at}/scores"))
    until = keys.filter("k % 31 = 0").select("desig", F.when(c("k") % 2 == 0, c("arc_length")).otherwise(-1.0).alias("arc_length"))
    return files.snapshot(rounded(catalog.flagged(orb, keys.filter("k % 59 = 0").select("desig"), until)), f"{at}/snapshot")


@query(f"WITH {ORB} SELECT 'A' || desig AS desig, round(a, 6) AS a, round(e, 6) AS e, round(h, 6) AS h, CASE WHEN desig % 11 = 0 THEN 10.0 WHEN desig % 13 = 0 THEN 10.0 ELSE u END::DOUBLE AS u, num_opps FROM orb")
def orbit_json_scan(spark, sf_dir):
    """Orbit catalogs of a thousand objects each, one JSON array a file; U is text there, or a letter, or absent."""
    k, at = c("desig"), fresh(spark, "orbits")
    one = F.struct(F.concat(F.lit("A"), k.cast("string")).alias("Principal_desig"), "a", "e", c("h").alias("H"), F.when(k % 11 == 0, "E").when(k % 13 != 0, c("u").cast("string")).alias("U"), c("num_opps").alias("Num_opps"))
    text = fx.orbits(spark, sf_dir).groupBy(F.floor(k / 1000).alias("file")).agg(F.to_json(F.collect_list(one)).alias("value"))
    text.repartition("file").write.partitionBy("file").text(at)  # a file for each, as an array may not be cut
    got = files.orbits(spark, f"{at}/*")
    return rounded(got.select(c("Principal_desig").alias("desig"), "a", "e", c("H").alias("h"), c("U").alias("u"), c("Num_opps").alias("num_opps")))


@query(f"WITH {FINAL} SELECT desig, CASE WHEN desig % 6 = 0 THEN NULL ELSE round(h + 0.5, 6) END AS wanted, 'two lines,' || chr(10) || 'a \"quote\" of ' || desig AS reason FROM final WHERE desig % 3 = 0")
def side_table_scan(spark, sf_dir):
    """A side table as CSV: names with blanks, texts with commas, quotes and line ends, bad numbers."""
    k, at = c("desig"), fresh(spark, "side")
    rows = fx.final(spark, sf_dir).filter("desig % 3 = 0").select(k.alias("Object"), F.when(k % 6 == 0, "bad").otherwise((c("h") + 0.5).cast("string")).alias(" Corrected H"), F.concat(F.lit("two lines,\na \"quote\" of "), k.cast("string")).alias("Reason"))
    rows.write.option("header", True).option("escape", '"').csv(at)
    got = files.csv_or_none(spark, at, {"Object": "bigint", "Corrected H": "double", "Reason": "string"})
    got = got.unionByName(files.csv_or_none(spark, f"{at}-absent", {"Object": "bigint", "Corrected H": "double", "Reason": "string"}))
    return rounded(got.select(c("Object").alias("desig"), c("Corrected H").alias("wanted"), c("Reason").alias("reason")))


@query(f"WITH {ORB} SELECT desig, round(a, 6) AS a, NULL::DOUBLE AS tp, NULL::VARCHAR AS ref FROM orb")
def missing_columns(spark, sf_dir):
    """A snapshot without some columns, read with them as nulls."""
    kept = files.snapshot(fx.orbits(spark, sf_dir).select("desig", "a"), fresh(spark, "snapshot"))
    return rounded(catalog.with_columns_or_null(kept, {"a": "double", "tp": "double", "ref": "string"}))
