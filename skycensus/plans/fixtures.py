"""Observation and orbit views over the driver tables, for Spark and for DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_OBS = """SELECT CAST(o_custkey AS BIGINT) AS obj, o_orderkey AS line_no,
  {micros} / 86400000000.0 + CAST(o_orderkey % 97 AS DOUBLE) / 128.0 AS t,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 14.0 + CAST(o_orderkey % 1000 AS DOUBLE) / 125.0 END AS mag,
  SUBSTRING('VRgrowicGyzBx', CAST(o_orderkey % 13 AS INT) + 1, 1) AS band,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE SUBSTRING('ABCDEF', CAST(o_orderkey % 6 AS INT) + 1, 1) END AS station
FROM orders"""
ORB = """SELECT k AS desig, 1.05 + CAST((k*7919) % 4000 AS DOUBLE)/1000.0 AS a, CAST((k*104729) % 950 AS DOUBLE)/1000.0 AS e,
  CAST((k*15485863) % 6000 AS DOUBLE)/100.0 AS i, CAST((k*32452843) % 36000 AS DOUBLE)/100.0 AS node,
  CAST((k*86028121) % 36000 AS DOUBLE)/100.0 AS peri, CAST((k*122949823) % 36000 AS DOUBLE)/100.0 AS m, 2460000.5 + CAST(k % 1000 AS DOUBLE) AS epoch,
  CASE WHEN k % 37 = 0 THEN NULL ELSE 10.0 + CAST((k*49979687) % 1200 AS DOUBLE)/100.0 END AS h,
  CASE WHEN k % 5 = 0 THEN NULL ELSE 10.0 + CAST((k*49979687) % 1200 AS DOUBLE)/100.0 + CAST(k % 7 AS DOUBLE)/64.0 END AS h_b,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 10.0 + CAST((k*49979687) % 1200 AS DOUBLE)/100.0 - CAST(k % 11 AS DOUBLE)/64.0 END AS h_c,
  CAST(1 + k % 12 AS BIGINT) AS num_opps, CAST(5 + (k*31) % 60 AS BIGINT) AS num_obs,
  CASE WHEN k % 12 = 0 THEN CAST((k*17) % 60 AS DOUBLE) END AS arc_length, CAST(k % 10 AS BIGINT) AS u
FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) base"""
SCORED = f"""SELECT o.*, 1.0 + CAST((desig*37) % 1500 AS DOUBLE)/100.0 AS expected, CAST((desig*53) % 1400 AS DOUBLE)/100.0 AS quantile_opps,
  CASE WHEN desig % 41 = 0 THEN NULL ELSE CAST((desig*71) % 1000 AS DOUBLE)/1000.0 END AS prob,
  CASE WHEN desig % 7 = 0 THEN NULL ELSE CAST((desig*97) % 1000 AS DOUBLE)/1000.0 END AS ext, desig % 11 AS nights FROM ({ORB}) o"""
#: ORB and rows at its edges: null and high e, a under, at and without value, null i, H over 33, H of -9.99, epoch and M absent.
ORBX = f"""SELECT desig, a, e, i, node, peri, m, epoch, h, h_b, h_c, num_opps, num_obs, arc_length, u FROM ({ORB}) plain UNION ALL
SELECT -desig, CASE desig % 10 WHEN 2 THEN 0.7 WHEN 3 THEN NULL WHEN 4 THEN 1.0 ELSE a END, CASE desig % 10 WHEN 0 THEN NULL WHEN 1 THEN 0.9995 ELSE e END,
  CASE WHEN desig % 10 = 5 THEN NULL ELSE i END, node, peri, CASE WHEN desig % 10 = 8 THEN NULL ELSE m END, CASE WHEN desig % 10 = 9 THEN NULL ELSE epoch END,
  CASE WHEN desig % 10 = 6 THEN 33.5 WHEN desig % 20 = 7 THEN -9.99 WHEN desig % 10 = 7 THEN NULL ELSE h END,
  CASE WHEN desig % 20 = 16 THEN 34.0 WHEN desig % 10 = 7 THEN NULL ELSE h_b END, CASE WHEN desig % 10 = 7 THEN NULL ELSE h_c END, num_opps, num_obs, arc_length, u
FROM ({ORB}) edge WHERE desig BETWEEN 1 AND 60"""
#: A scored frame on which every ranked list has rows: much of prob near 1, of ext near 0, of objects of one opposition.
FINAL = """SELECT k AS desig, CAST(CASE WHEN k % 5 = 0 THEN 2025 ELSE 1985 + k % 40 END AS VARCHAR(4)) || CASE WHEN k % 61 = 0 THEN '-' ELSE ' ' END || 'AB' || CAST(k AS VARCHAR(12)) AS name,
  a, e, i, a*(1-e) AS q, a*(1+e) AS aphelion, pow(a, 1.5) AS period, 5.203/a + 2*cos(radians(i))*sqrt(a/5.203*(1-e*e)) AS tj, node, peri,
  CASE WHEN k % 37 = 0 THEN NULL ELSE 10.0 + CAST((k*49979687) % 1200 AS DOUBLE)/100.0 END AS h, num_opps, num_obs,
  CASE WHEN num_opps = 1 AND k % 17 <> 0 THEN CAST((k*29) % 60 AS DOUBLE) END AS arc_length, CASE WHEN k % 43 = 0 THEN NULL ELSE k % 11 END AS u,
  1.0 + CAST((k*37) % 1500 AS DOUBLE)/100.0 AS expected, CAST((k*53) % 1400 AS DOUBLE)/100.0 AS quantile_opps,
  CASE WHEN k % 41 = 0 THEN NULL WHEN k % 7 = 3 THEN 1.0 - CAST((k*71) % 1000 AS DOUBLE)/1000.0 ELSE 1.0 - CAST((k*71) % 1000 AS DOUBLE)/2000000.0 END AS prob,
  CASE WHEN k % 19 = 0 THEN NULL WHEN k % 3 = 0 THEN CAST((k*97) % 1000 AS DOUBLE)/1000.0 ELSE CAST((k*97) % 1000 AS DOUBLE)/250000.0 END AS ext,
  CASE WHEN k % 13 = 0 THEN NULL ELSE (k*11) % 12 END AS nights, CASE WHEN k % 29 = 0 THEN NULL ELSE k % 4 END AS second_nights, CAST((k*41) % 100 AS DOUBLE)/5.0 AS longest_opp_arc,
  2449000.5 + CAST((k*13) % 9000 AS DOUBLE) AS tp, CASE WHEN k % 23 = 0 THEN 'E2026-A' || CAST(k % 7 AS VARCHAR(4)) ELSE 'E2024-B' || CAST(k % 7 AS VARCHAR(4)) END AS ref,
  CAST((k*67) % 100 AS DOUBLE)/200.0 AS rms, CASE WHEN k % 31 = 0 THEN NULL ELSE 17.0 + CAST((k*73) % 400 AS DOUBLE)/100.0 END AS v_avg,
  CASE WHEN k % 31 = 0 THEN NULL ELSE 17.0 + CAST((k*73) % 400 AS DOUBLE)/100.0 - CAST((k*79) % 450 AS DOUBLE)/100.0 END AS v_min,
  CASE WHEN k % 31 = 0 THEN NULL ELSE 17.0 + CAST((k*73) % 400 AS DOUBLE)/100.0 + CAST((k*83) % 300 AS DOUBLE)/100.0 END AS v_max,
  CASE WHEN k % 31 = 0 THEN NULL ELSE 17.0 + CAST((k*73) % 400 AS DOUBLE)/100.0 - CAST((k*79) % 450 AS DOUBLE)/200.0 END AS v_second_min,
  CASE WHEN k % 31 = 0 THEN NULL ELSE 17.0 + CAST((k*73) % 400 AS DOUBLE)/100.0 + CAST((k*83) % 300 AS DOUBLE)/200.0 END AS v_second_max, k % 47 = 0 AS known, k % 59 = 0 AS filtered_out
FROM (SELECT k, CASE WHEN k % 9 = 0 THEN 4.0 + CAST((k*7919) % 3500 AS DOUBLE)/1000.0 ELSE 1.05 + CAST((k*7919) % 4000 AS DOUBLE)/1000.0 END AS a,
    CAST((k*104729) % 950 AS DOUBLE)/1000.0 AS e, CAST((k*15485863) % 6000 AS DOUBLE)/100.0 AS i, CAST((k*32452843) % 36000 AS DOUBLE)/100.0 AS node,
    CAST((k*86028121) % 36000 AS DOUBLE)/100.0 AS peri, CASE WHEN k % 2 = 0 THEN 1 ELSE 1 + k % 12 END AS num_opps, 5 + (k*31) % 60 AS num_obs
  FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) keys) base"""
OBS_DUCK = _OBS.format(micros="epoch_us(o_orderdate)")


def _view(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "orders", _OBS.format(micros="unix_micros(CAST(o_orderdate AS TIMESTAMP))"))


def orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "customer", ORB)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "customer", SCORED)


def orbits_with_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "customer", ORBX)


def final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "customer", FINAL)
