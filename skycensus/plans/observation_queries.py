"""Queries of the observation reduction and its text formats, and DuckDB SQL written out by hand for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycensus.operators import observations
from skycensus.plans import fixtures as fx
from skycensus.plans.base import OBS, query, rounded
from skycensus.sources.text import fixed_width

SHIFT = "CASE band WHEN 'R' THEN 0.40 WHEN 'g' THEN -0.28 WHEN 'r' THEN 0.23 WHEN 'o' THEN 0.33 WHEN 'w' THEN 0.16 WHEN 'i' THEN 0.39 WHEN 'c' THEN -0.05 WHEN 'G' THEN 0.28 WHEN 'y' THEN 0.36 WHEN 'z' THEN 0.37 WHEN 'B' THEN -0.80 ELSE 0 END"
DEDUPED = OBS + ", ded AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY obj, t ORDER BY line_no) = 1)"
GAPS = DEDUPED + ", g0 AS (SELECT *, t - lag(t) OVER (PARTITION BY obj ORDER BY t, line_no) AS gap FROM ded), g AS (SELECT *, 1 + sum(CASE WHEN gap >= 180 THEN 1 ELSE 0 END) OVER (PARTITION BY obj ORDER BY t, line_no ROWS UNBOUNDED PRECEDING) AS segment FROM g0)"
NIGHTS = GAPS + """, o AS (SELECT obj, segment, t, row_number() OVER (PARTITION BY obj, segment ORDER BY t) AS k FROM g),
 walk AS (SELECT obj, segment, k, t AS anchor, 1 AS n FROM o WHERE k = 1 UNION ALL
  SELECT o.obj, o.segment, o.k, CASE WHEN o.t - w.anchor > 0.5 THEN o.t ELSE w.anchor END, w.n + CASE WHEN o.t - w.anchor > 0.5 THEN 1 ELSE 0 END
  FROM walk w JOIN o ON o.obj = w.obj AND o.segment = w.segment AND o.k = w.k + 1),
 seg AS (SELECT g.obj, g.segment, max(g.t) - min(g.t) AS arc, count(*) AS n_obs, max(n) AS nights FROM g JOIN (SELECT obj, segment, max(n) AS n FROM walk GROUP BY ALL) x ON x.obj = g.obj AND x.segment = g.segment GROUP BY ALL)"""
RUNS = """r0 AS (SELECT *, gap < 0.5 AS is_day FROM g WHERE gap IS NOT NULL), r1 AS (SELECT *, CASE WHEN is_day <> lag(is_day) OVER (PARTITION BY obj ORDER BY t, line_no) THEN 1 ELSE 0 END AS turn FROM r0),
 r2 AS (SELECT *, sum(turn) OVER (PARTITION BY obj ORDER BY t, line_no ROWS UNBOUNDED PRECEDING) AS run FROM r1), r3 AS (SELECT obj, run, any_value(is_day) AS is_day, sum(gap) AS total FROM r2 GROUP BY obj, run),
 runs AS (SELECT * FROM r3 QUALIFY run < max(run) OVER (PARTITION BY obj) AND total > 0)"""
RECURSIVE = "WITH RECURSIVE "


def obs(spark, sf_dir):
    return observations.dedupe(fx.observations(spark, sf_dir))


@query(RECURSIVE + NIGHTS + " SELECT obj, segment::BIGINT AS segment, round(arc, 6) AS arc, nights::BIGINT AS nights, n_obs::BIGINT AS n_obs FROM seg")
def obs_segments(spark, sf_dir):
    return rounded(observations.segments(obs(spark, sf_dir)))


@query(RECURSIVE + NIGHTS + ", " + RUNS + """, s AS (SELECT obj, max(segment)::BIGINT AS opposition_count, sum(nights)::BIGINT AS nights_total, list_sort(list(nights), 'DESC') AS ns,
  coalesce(max(arc) FILTER (arc > 0), 0) AS longest_opp_arc, coalesce(min(arc) FILTER (arc > 0), 0) AS shortest_opp_arc FROM seg GROUP BY obj),
 t AS (SELECT obj, max(t) - min(t) AS total_arc, coalesce(max(gap) FILTER (gap >= 180), 0) AS longest_opp_gap, coalesce(min(gap) FILTER (gap >= 180), 0) AS shortest_opp_gap FROM g GROUP BY obj),
 d AS (SELECT obj, max(total) FILTER (is_day) AS d, list_sort(list(total) FILTER (NOT is_day), 'DESC') AS gs FROM runs GROUP BY obj)
 SELECT obj, round(total_arc, 6) AS total_arc, round(longest_opp_gap, 6) AS longest_opp_gap, round(shortest_opp_gap, 6) AS shortest_opp_gap, opposition_count, nights_total,
  ns[1]::BIGINT AS opp_with_most_nights, coalesce(ns[2], 0)::BIGINT AS opp_with_second_most_nights, round(longest_opp_arc, 6) AS longest_opp_arc, round(shortest_opp_arc, 6) AS shortest_opp_arc,
  round(coalesce(d, 0), 6) AS longest_day_arc, round(coalesce(gs[1], 0), 6) AS longest_gap_arc, round(coalesce(gs[2], 0), 6) AS second_longest_gap_arc, round(coalesce(gs[-1], 0), 6) AS shortest_gap_arc,
  (nights_total - ns[1])::BIGINT AS other_opps FROM t JOIN s USING (obj) LEFT JOIN d USING (obj)""")  # fmt: skip
def obs_stats(spark, sf_dir):
    return rounded(observations.stats(obs(spark, sf_dir)))


@query("WITH " + GAPS + ", " + RUNS + " SELECT obj, run::BIGINT AS run, is_day, round(total, 6) AS total FROM runs")
def obs_runs(spark, sf_dir):
    return rounded(observations.runs(obs(spark, sf_dir)))


@query("WITH " + DEDUPED + f", vm AS (SELECT obj, mag + {SHIFT} AS mag FROM ded), l AS (SELECT obj, list_sort(list(mag) FILTER (mag IS NOT NULL)) AS m, avg(mag) AS v FROM vm GROUP BY obj) SELECT obj, round(m[1], 6) AS v_min, round(m[2], 6) AS v_second_min, round(m[-1], 6) AS v_max, CASE WHEN len(m) > 1 THEN round(m[-2], 6) END AS v_second_max, round(v, 6) AS v_avg FROM l")
def obs_mag_stats(spark, sf_dir):
    return rounded(observations.magnitudes(observations.correct_bands(obs(spark, sf_dir))))


@query("WITH " + DEDUPED + " SELECT obj, station FROM (SELECT obj, station, count(*) AS n FROM ded WHERE trim(station) <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY obj ORDER BY n DESC, station) = 1")
def station_mode(spark, sf_dir):
    return observations.majority_station(obs(spark, sf_dir))


@query("WITH " + OBS + f" SELECT line_no, round(mag + {SHIFT}, 6) AS v_mag FROM obs")
def band_correct(spark, sf_dir):
    return rounded(observations.correct_bands(fx.observations(spark, sf_dir)).select("line_no", "v_mag"))


CODES = "V v N T j u U B g c w r G o y z i C R W L Y I J H K _ Lu Lg Lr Li Lz Ly Ac Ao Bj Gb Gr Ic Rc Uj Vj Pg Pi Pr Pw Py Pz Sg Si Sr Sz UNK IR VR Lx W2 W3 W4 ??".split()
#: Fixed values, by hand: the codes of a shift.
SHIFTED = [("u", -2.5), ("U Uj", -1.3), ("B Bj", -0.8), ("g Pg Sg", -0.28), ("c Ac", -0.05), ("w Pw", 0.16), ("r Pr Sr", 0.23), ("G Gb Gr", 0.28), ("o Ao", 0.33), ("y Py", 0.36), ("z Pz Sz", 0.37), ("i Pi Si", 0.39), ("C R W Rc", 0.4), ("L", 0.2), ("Y", 0.7), ("I Ic", 0.8),
           ("J", 1.2), ("H", 1.4), ("K", 1.7), ("Lu", -1.771), ("Lg", -0.349), ("Lr", 0.214), ("Li", 0.373), ("Lz", 0.35), ("Ly", 0.355)]


@query("WITH c AS (SELECT o_orderkey AS line_no, replace([" + ", ".join(f"'{c}'" for c in CODES) + "][(o_orderkey % 60)::INT + 1], '_', ' ') AS band FROM orders) SELECT line_no, band, round(15.0::DOUBLE + CASE " + " ".join(f"WHEN band IN ({', '.join(repr(c) for c in cs.split())}) THEN {v}" for cs, v in SHIFTED) + " ELSE 0 END, 6) AS v_mag FROM c")
def band_table(spark, sf_dir):
    """Every code of the band table, and one that it lacks, over the orders."""
    codes = F.array(*[F.lit(c.replace("_", " ")) for c in CODES])
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("line_no"), F.element_at(codes, (F.col("o_orderkey") % 60 + 1).cast("int")).alias("band"), F.lit(15.0).alias("mag"))
    return rounded(observations.correct_bands(rows).select("line_no", "band", "v_mag"))


@query("WITH " + OBS + " SELECT line_no, obj, round(mag, 3) AS mag, band FROM obs")
def fixed_width_scan(spark, sf_dir):
    rows = fx.observations(spark, sf_dir)
    mag = F.coalesce(F.format_string("%.3f", "mag"), F.lit(""))
    lines = rows.select(F.concat(F.lpad(F.col("line_no").cast("string"), 12, " "), F.lpad(F.col("obj").cast("string"), 12, " "), F.lpad(mag, 8, " "), "band").alias("value"))
    return fixed_width(lines, [("line_no", 1, 12, "bigint"), ("obj", 13, 12, "bigint"), ("mag", 25, 8, "double"), ("band", 33, 1, "string")])


#: Seven places for a number: a letter from the given one on for the millions, then six digits.
PACKED = "chr((ord({0}) + ({1}) // 1000000)::INT) || lpad((({1}) % 1000000)::VARCHAR, 6, '0')"
#: Lines of orders: some twice with other fields, some with a bad date, some cut off before the band.
LINES = f"""src AS (SELECT o_orderkey AS line_no, o_custkey::BIGINT AS k, o_orderdate::DATE AS day, o_orderkey % 97 AS part, 14.0 + (o_orderkey % 800) / 100.0 AS mag, substring('VRgrowicGyzBx', (o_orderkey % 13)::INT + 1, 1) AS band, 'S' || (o_orderkey % 7) AS station FROM orders),
 good AS (SELECT * FROM src WHERE line_no % 53 <> 0), one AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY k, day, part ORDER BY line_no) = 1),
 obs AS (SELECT line_no, {PACKED.format("'K'", 'k')} AS obj, date_diff('day', DATE '1970-01-01', day) + part / 100.0 AS t, CASE WHEN line_no % 59 <> 0 AND line_no % 61 <> 0 THEN mag END AS mag, CASE WHEN line_no % 59 = 0 THEN '' ELSE band END AS band, CASE WHEN line_no % 59 = 0 THEN '' ELSE station END AS station FROM one)"""


def packed(head, k):
    """PACKED as a column."""
    return F.concat(F.char(F.ascii(F.lit(head)) + F.floor(k / 1_000_000)), F.lpad((k % 1_000_000).cast("string"), 6, "0"))


def obs_text(spark, sf_dir, name=lambda k: packed("K", k)):
    """80-column lines (line_no, value) of the orders; name: that of an object in seven places."""
    key = F.col("o_orderkey")
    src = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("line_no"), name(F.col("o_custkey").cast("bigint")).alias("obj"), F.date_format("o_orderdate", "yyyy MM dd").alias("day"), (key % 97).alias("part"), (14 + (key % 800) / 100).alias("mag"), F.substr(F.lit("VRgrowicGyzBx"), (key % 13 + 1).cast("int"), F.lit(1)).alias("band"), F.concat(F.lit("S"), (key % 7).cast("string")).alias("station"))
    bad, dim = F.col("line_no") % 53 == 0, F.col("line_no") % 61 == 0
    day = F.when(bad, "2020 13 45").otherwise(F.col("day"))
    line = lambda mag, station: F.concat(F.lit("     "), "obj", F.lit("  C"), day, F.lit("."), F.rpad(F.lpad(F.col("part").cast("string"), 2, "0"), 6, " "), F.repeat(F.lit(" "), F.lit(33)), F.lpad(F.when(dim, "  ?").otherwise(F.format_string("%.2f", mag)), 5, " "), "band", F.repeat(F.lit(" "), F.lit(6)), F.rpad(station, 3, " "))
    whole = src.withColumn("value", line(F.col("mag"), F.col("station")))
    cut = whole.withColumn("value", F.when(F.col("line_no") % 59 == 0, F.substring("value", 1, 70)).otherwise(F.col("value")))
    again = src.filter("line_no % 50 = 0").withColumn("value", line(F.lit(9.0), F.lit("ZZ"))).withColumn("line_no", F.col("line_no") + 100_000_000)
    return cut.select("line_no", "value").unionByName(again.select("line_no", "value"))


@query(f"WITH {LINES} SELECT line_no, obj, round(t, 6) AS t, round(mag, 6) AS mag, band, station FROM obs")
def obs_lines(spark, sf_dir):
    return rounded(observations.lines(obs_text(spark, sf_dir)))


ALIAS = f"""ids AS (SELECT {PACKED.format("'K'", 'k')} AS alias, {PACKED.format("'K'", 'k - k % 20')} AS primary_name FROM (SELECT DISTINCT o_custkey::BIGINT AS k FROM orders) d WHERE k % 20 IN (1, 3)),
 nums AS (SELECT {PACKED.format("'K'", 'k')} AS alias, {PACKED.format("'N'", 'k // 3')} AS primary_name FROM (SELECT DISTINCT o_custkey::BIGINT AS k FROM orders) d WHERE k % 60 = 3)"""


def alias_text(spark, sf_dir):
    """Two alias files as (line_no, value): a primary and two aliases a line; a 6-character head, then a primary and one alias."""
    k = F.col("k")
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k")).distinct()
    heads = keys.filter("k % 20 in (1, 3)").select((k - k % 20).alias("k")).distinct()
    ids = heads.select(k.alias("line_no"), F.concat(packed("K", k), packed("K", k + 1), packed("K", k + 3)).alias("value"))
    nums = keys.filter("k % 60 = 3").select(k.alias("line_no"), F.concat(F.lpad(k.cast("string"), 6, " "), packed("N", F.floor(k / 3)), packed("K", k)).alias("value"))
    return ids, nums


@query(f"WITH {LINES}, {ALIAS} SELECT line_no, coalesce(nums.primary_name, ids.primary_name, obj) AS obj FROM obs LEFT JOIN ids ON ids.alias = obj LEFT JOIN nums ON nums.alias = obj")
def alias_rewrite(spark, sf_dir):
    ids, nums = alias_text(spark, sf_dir)
    rows = observations.lines(obs_text(spark, sf_dir))
    return observations.renamed(rows, [observations.aliases(ids), observations.aliases(nums, 6)]).select("line_no", "obj")


@query(f"WITH {LINES}, v AS (SELECT obj, mag + {SHIFT} AS mag, station FROM obs), l AS (SELECT obj, list_sort(list(mag) FILTER (mag IS NOT NULL)) AS m, avg(mag) AS v FROM v GROUP BY obj), st AS (SELECT obj, station FROM (SELECT obj, station, count(*) AS n FROM v WHERE station <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY obj ORDER BY n DESC, station) = 1), a AS (SELECT obj, max(t) - min(t) AS total_arc FROM obs GROUP BY obj) SELECT obj, round(total_arc, 6) AS total_arc, round(m[1], 6) AS v_min, round(m[2], 6) AS v_second_min, round(m[-1], 6) AS v_max, CASE WHEN len(m) > 1 THEN round(m[-2], 6) END AS v_second_max, round(v, 6) AS v_avg, station AS majority_station FROM a LEFT JOIN l USING (obj) LEFT JOIN st USING (obj)")
def obs_reduced(spark, sf_dir):
    """The whole reduction from 80-column lines to one row per object."""
    return rounded(observations.reduced(observations.lines(obs_text(spark, sf_dir)), dealt=True).select("obj", "total_arc", "v_min", "v_second_min", "v_max", "v_second_max", "v_avg", "majority_station"))


@query("WITH p AS (SELECT DISTINCT o_orderkey % 20000 AS k FROM orders), q AS (SELECT k, 1800 + (k * 7) % 250 AS y, substring('ABCDEFGHJKLMNOPQRSTUVWXY', (k % 24)::INT + 1, 1) AS half, substring('ABCDEFGHJKLMNOPQRSTUVWXYZ', (k % 25)::INT + 1, 1) AS second, (k * 13) % 620 AS n FROM p) SELECT k, CASE k % 4 WHEN 3 THEN (1000 + k % 9000)::VARCHAR || ' ' || ['P-L', 'T-1', 'T-2', 'T-3'][(k % 16 // 4)::INT + 1] ELSE y::VARCHAR || ' ' || half || second || CASE WHEN n > 0 THEN n::VARCHAR ELSE '' END END AS name FROM q WHERE k % 4 <> 2 UNION ALL SELECT k, (k * 31 % 620000)::VARCHAR FROM q WHERE k % 4 = 2")
def unpack_designations(spark, sf_dir):
    """Names packed here by plain columns, read back by the operator."""
    k, base = F.col("k"), "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 20000).alias("k")).distinct()
    digit = lambda x: F.substr(F.lit(base), x.cast("int") + 1, F.lit(1))
    y, n, number = 1800 + (k * 7) % 250, (k * 13) % 620, k * 31 % 620000
    cent = lambda x: F.concat(digit(F.floor(x / 100)), F.lpad((x % 100).cast("string"), 2, "0"))
    provisional = F.concat(cent(y), F.substr(F.lit("ABCDEFGHJKLMNOPQRSTUVWXY"), (k % 24 + 1).cast("int"), F.lit(1)), digit(F.floor(n / 10)), (n % 10).cast("string"), F.substr(F.lit("ABCDEFGHJKLMNOPQRSTUVWXYZ"), (k % 25 + 1).cast("int"), F.lit(1)))
    survey = F.concat(F.element_at(F.array(*map(F.lit, ("PLS", "T1S", "T2S", "T3S"))), (F.floor(k % 16 / 4) + 1).cast("int")), (1000 + k % 9000).cast("string"))
    packed_number = F.concat(digit(F.floor(number / 10_000)), F.lpad((number % 10_000).cast("string"), 4, "0"))
    return keys.select("k", observations.unpacked(F.when(k % 4 == 3, survey).when(k % 4 == 2, packed_number).otherwise(provisional)).alias("name"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE round(date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 2440587.5 + CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 100) / 100.0 ELSE 0 END, 6) END AS jd FROM orders")
def packed_dates(spark, sf_dir):
    key, base = F.col("o_orderkey"), "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    digit = lambda x: F.substr(F.lit(base), x.cast("int") + 1, F.lit(1))
    d = F.col("o_orderdate")
    packed = F.concat(digit(F.floor(F.year(d) / 100)), F.lpad((F.year(d) % 100).cast("string"), 2, "0"), digit(F.month(d)), digit(F.day(d)), F.when(key % 3 == 0, F.lpad((key % 100).cast("string"), 2, "0")).otherwise(""))
    packed = F.when(key % 10 == 9, F.concat(F.substring(packed, 1, 3), F.lit("Z9"))).when(key % 10 == 8, F.lower(packed)).otherwise(packed)
    return rounded(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", observations.packed_day(packed).alias("jd")))
