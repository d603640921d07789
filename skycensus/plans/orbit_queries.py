"""Queries of the closed-form orbit columns, and DuckDB SQL written out by hand for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycensus.functions import orbit
from skycensus.plans import fixtures as fx
from skycensus.plans.base import FINAL, ORBX, query, r6, rounded

CLIP = "CASE WHEN e IS NULL THEN NULL ELSE greatest(0.0, least(0.999, e)) END"
#: Distances of the visibility columns; mr, d and alpha of an inclined orbit.
BASE = f"""{ORBX}, o1 AS (SELECT *, {CLIP} AS e1, radians(i) AS ir FROM orb),
 o2 AS (SELECT *, a*(1+e1*e1/2) AS mr, a*(1+e1/2) AS ry, a*pow(1-e1*e1, 0.25) AS rf, a*sqrt(1-e1*e1) AS rs, a*(1-e1/2) AS rm, a*(1-e1) AS rq, a*(1+e1) AS rfar FROM o1),
 o3 AS (SELECT *, CASE WHEN mr IS NOT NULL AND ir IS NOT NULL THEN sqrt(greatest(mr*mr - 2*mr*cos(ir) + 1, 0.001)) END AS d FROM o2),
 o4 AS (SELECT *, CASE WHEN d IS NOT NULL THEN tan(acos(greatest(-1.0, least(1.0, (mr - cos(ir)) / greatest(d, 0.001)))) / 2) END AS th FROM o3),
 o5 AS (SELECT *, CASE WHEN th IS NOT NULL THEN -2.5*log10(greatest(0.85*exp(-3.33*pow(greatest(th, 0.0), 0.63)) + 0.15*exp(-1.87*pow(greatest(th, 0.0), 1.22)), 1e-30)) END AS dim FROM o4)"""


def at(r: str, by: float) -> str:
    return f"CASE WHEN {r} IS NOT NULL THEN 5*log10(greatest({r}, 0.001)*greatest({r}-({by}), 0.001)) + h END"


QUAD = "greatest(sqrt(greatest(abs(mr*mr-1), 0.001)) - ({}), 0.001)"


@query(f"WITH {BASE} SELECT desig, " + r6(
    vis_timeavg=f"CASE WHEN mr IS NOT NULL THEN 5*log10(greatest(mr, 0.001)*{QUAD.format(0.9)}) + h END", vis_typ=at("ry", 0.51), vis_flux=at("rf", 1.0), vis_smin=at("rs", 1.0), vis_mid=at("rm", 1.0), vis_q=at("rq", 0.8),
    vis_inc_old="5*log10(greatest(mr, 0.001)*d) + h", vis_inc="5*log10(greatest(mr, 0.001)*d) + h + dim", inc_opp_penalty="5*log10(d/sqrt(greatest(mr*mr-1, 0.001))) + dim",
) + " FROM o5")
def vis_closed(spark, sf_dir):
    return rounded(fx.orbits_with_edges(spark, sf_dir).select("desig", *[c.alias(n) for n, c in orbit.visibility().items()]))


@query(f"WITH {BASE} SELECT desig, " + r6(
    typical=at("ry", -0.2), perihelion=at("rq", 0.8), aphelion=at("rfar", 1.0), flux=at("rf", 0.6), super1=at("mr", 0.7),
    super4="CASE WHEN mr IS NOT NULL THEN 5*log10(greatest(mr, 0.001)*greatest(mr-1, 0.001)) + h + 1.4*asin(least(1/greatest(mr, 0.001), 1.0)) END",
    super5=f"CASE WHEN mr IS NOT NULL THEN 5*log10(greatest(mr, 0.001)*{QUAD.format(0.3)}) + h END",
) + " FROM o5")
def vis_families(spark, sf_dir):
    by = {"typical": -0.2, "perihelion": 0.8, "aphelion": 1.0, "flux": 0.6, "super1": 0.7, "super4": 1.4, "super5": 0.3}
    return rounded(fx.orbits_with_edges(spark, sf_dir).select("desig", *[orbit.family(n, d).alias(n) for n, d in by.items()]))


COMET = "5*log10(greatest({0}, 1.0)*(greatest({0}, 1.0)-({1}))) + h"


@query(f"WITH {FINAL}, r AS (SELECT *, a*(1+e/2) AS r FROM final) SELECT desig, " + r6(vis_06=COMET.format("r", 0.6), vis_q_m01=COMET.format("q", -0.1), vis_q_m02=COMET.format("q", -0.2)) + " FROM r")
def comet_visibility(spark, sf_dir):
    cols = [orbit.comet_visibility(0.6)["vis"].alias("vis_06"), orbit.comet_visibility(-0.1)["vis_q"].alias("vis_q_m01"), orbit.comet_visibility(-0.2)["vis_q"].alias("vis_q_m02")]
    return rounded(fx.final(spark, sf_dir).select("desig", *cols))


VECTOR = """v AS (SELECT *, cos(radians(node))*cos(radians(peri)) - sin(radians(node))*sin(radians(peri))*cos(ir) AS x, sin(radians(node))*cos(radians(peri)) + cos(radians(node))*sin(radians(peri))*cos(ir) AS y, sin(radians(peri))*sin(ir) AS z FROM o5)"""


@query(f"WITH {BASE}, {VECTOR} SELECT desig, " + r6(
    mag_amplitude="CASE WHEN rq IS NOT NULL THEN 5*log10(greatest(rfar*(rfar-1), 0.001)/greatest(rq*(rq-1), 0.001)) END",
    synodic_period="CASE WHEN a IS NOT NULL THEN least(1/greatest(abs(1 - 1/greatest(pow(a, 1.5), 0.001)), 0.0001), 10000.0) END",
    gal_lat_perihelion="CASE WHEN x IS NOT NULL THEN degrees(asin(greatest(-1.0, least(1.0, -0.86767*x - 0.00041*y + 0.49717*z)))) END",
    frac_high_lat="CASE WHEN sin(ir) > sin(radians(10.0)) THEN 1 - 2/pi()*asin(sin(radians(10.0))/sin(ir)) WHEN ir IS NOT NULL THEN 0.0 END",
    vis_aphelion=at("rfar", 1.0), ecl_lat_perihelion="degrees(asin(z))",
    opp_angular_speed_typ="CASE WHEN mr IS NOT NULL THEN abs(1/greatest(sqrt(greatest(mr, 0.001)), 0.001) - 1)/greatest(abs(mr-1), 0.001) END",
    vis_phase_corr=f"{at('mr', 1.0)} - 2.5*log10(greatest(0.85*exp(-3.332*pow(tan(asin(least(1/mr, 1.0))/4), 0.631)) + 0.15*exp(-1.862*pow(tan(asin(least(1/mr, 1.0))/4), 1.218)), 0.001))",
    moid_proxy="CASE WHEN rq IS NOT NULL THEN sqrt(pow(least(greatest(1.0, rq), rfar) - 1, 2) + pow(least(greatest(1.0, rq), rfar)*sin(ir), 2)) END",
    jupiter_moid_approx="CASE WHEN rq IS NOT NULL THEN sqrt(pow(least(greatest(5.204, rq), rfar) - 5.204, 2) + pow(least(greatest(5.204, rq), rfar)*sin(ir), 2)) END",
    lon_perihelion="(node+peri) % 360",
) + " FROM v")
def candidate_features(spark, sf_dir):
    return rounded(fx.orbits_with_edges(spark, sf_dir).select("desig", *[c.alias(n) for n, c in orbit.candidates().items()]))


@query(f"WITH {BASE} SELECT desig, a > 5.0 AND a < 5.4 AND e < 0.3 AND i < 40 AS is_trojan, " + r6(
    orbital_period_sync="abs(pow(a, 1.5)-round_even(pow(a, 1.5), 0))", tj="5.203/a+2*cos(ir)*sqrt(a/5.203*(1-e*e))", node_plus_peri="(node+peri) % 360",
    galactic_inc="degrees(acos(greatest(-1.0, least(1.0, CASE WHEN ir IS NOT NULL THEN -0.86767*sin(ir)*sin(radians(node)) + 0.00041*sin(ir)*cos(radians(node)) + 0.49717*cos(ir) END))) + CASE WHEN ir IS NOT NULL THEN 0 END)",
    perihelion="rq", aphelion="rfar", opik_u="CASE WHEN rq IS NOT NULL AND ir IS NOT NULL THEN sqrt(greatest(3-1/greatest(a, 0.001)-2*sqrt(a*(1-e1*e1))*cos(ir), 0)) END",
) + " FROM o5")
def dynamics(spark, sf_dir):
    return rounded(fx.orbits_with_edges(spark, sf_dir).select("desig", *[c.alias(n) for n, c in orbit.dynamics().items()]))


@query(f"WITH {BASE}, {VECTOR} SELECT desig, " + r6(peri_x="x", peri_y="y", peri_z="z", peri_x_e="x*e", peri_y_e="y*e", peri_z_e="z*e", dec_perihelion="degrees(asin(y*sin(radians(23.44))+z*cos(radians(23.44))))") + " FROM v")
def perihelion_vector(spark, sf_dir):
    return rounded(fx.orbits_with_edges(spark, sf_dir).select("desig", *[c.alias(n) for n, c in orbit.perihelion().items()]))


def _passage(k: int, back: int) -> str:
    """CTEs of Earth, distance and magnitude at the passage `back` periods before the last."""
    prev = "p0" if k == 0 else f"v{k - 1}"
    dim = f"-2.5*log10(greatest(0.85*exp(-3.33*pow(tan(acos(cosa{k})/2), 0.63)) + 0.15*exp(-1.87*pow(tan(acos(cosa{k})/2), 1.22)), 1e-30))"
    return f""" t{k} AS (SELECT *, (t0 - {back}*2*pi()/rate - 2451545.0)/36525.0 AS c{k} FROM {prev}), g{k} AS (SELECT *, radians(357.52911+35999.05029*c{k}) AS ma{k} FROM t{k}),
 l{k} AS (SELECT *, radians(280.46646+36000.76983*c{k}) + 0.033416*sin(ma{k}) + 0.000349*sin(2*ma{k}) + pi() AS lon{k}, 1.00014061 - 0.01670861*cos(ma{k}) - 0.00013957*cos(2*ma{k}) AS re{k} FROM g{k}),
 d{k} AS (SELECT *, x - re{k}*cos(lon{k}) AS dx{k}, y - re{k}*sin(lon{k}) AS dy{k} FROM l{k}), s{k} AS (SELECT *, sqrt(dx{k}*dx{k}+dy{k}*dy{k}+z*z) AS dist{k} FROM d{k}),
 a{k} AS (SELECT *, CASE WHEN dist{k} IS NOT NULL THEN greatest(-1.0, least(1.0, (x*dx{k}+y*dy{k}+z*z)/(greatest(rq, 0.001)*greatest(dist{k}, 0.001)))) END AS cosa{k} FROM s{k}),
 v{k} AS (SELECT *, CASE WHEN cosa{k} IS NOT NULL THEN h + 5*log10(greatest(rq, 0.001)*greatest(dist{k}, 0.001)) + {dim} END AS vis{k} FROM a{k})"""


@query(f"""WITH {BASE}, {VECTOR}, p0 AS (SELECT * REPLACE (x*rq AS x, y*rq AS y, z*rq AS z), CASE WHEN a IS NOT NULL THEN sqrt(0.0002959122082855911)/pow(greatest(a, 0.001), 1.5) END AS rate, epoch - radians(m)/(sqrt(0.0002959122082855911)/pow(a, 1.5)) AS t0 FROM v),
 {_passage(0, 0)}, {_passage(1, 1)}, {_passage(2, 3)} SELECT desig, """ + r6(perihelion_time="t0", vis_last_perihelion="vis0", vis_second_perihelion="vis1", vis_third_perihelion="vis2", perihelion_delta="dist0", perihelion_dec="degrees(asin(greatest(-1.0, least(1.0, CASE WHEN dist0 IS NOT NULL THEN (dy0*sin(radians(23.439291))+z*cos(radians(23.439291)))/greatest(dist0, 0.001) END))) + CASE WHEN dist0 IS NOT NULL THEN 0 END)") + " FROM v2")  # fmt: skip
def perihelion_passages(spark, sf_dir):
    names = ["perihelion_time", "vis_last_perihelion", "vis_second_perihelion", "vis_third_perihelion", "perihelion_delta", "perihelion_dec"]
    return rounded(orbit.passages(fx.orbits_with_edges(spark, sf_dir)).select("desig", *names))


@query(f"WITH {FINAL}, p AS (SELECT desig, num_opps - 1 AS k, expected - 1 AS m FROM final) SELECT desig, round((SELECT sum(exp(-m) * pow(m, j) / factorial(j::INT)) FROM range(0, 13) r(j) WHERE j <= k), 6) AS poisson FROM p")
def poisson_score(spark, sf_dir):
    df = fx.final(spark, sf_dir)
    return rounded(df.select("desig", orbit.poisson_cdf(F.col("num_opps") - 1, F.col("expected") - 1).alias("poisson")))


@query(f"""WITH {FINAL} SELECT desig, try_cast(nullif(regexp_extract(name, '^((1[89]|20)[0-9][0-9])[ ]+[A-Z][A-Z]', 1), '') AS DOUBLE) AS desig_year, round(quantile_opps - num_opps, 6) + 0.0 AS delta_q, round(expected - num_opps, 6) + 0.0 AS deficit,
 round(num_opps / expected, 6) AS ratio, round(quantile_opps - num_opps - 15.5*ext, 6) + 0.0 AS priority, round(ln(greatest(1e-15, least(1 - 1e-15, CASE WHEN prob IS NOT NULL THEN prob END)) / (1 - greatest(1e-15, least(1 - 1e-15, prob)))), 6) + CASE WHEN prob IS NOT NULL THEN 0.0 END AS logit_prob,
 round(v_max - v_min, 6) AS v_gap, round(v_second_max - v_second_min, 6) AS v_second_gap, round(v_max - v_avg, 6) AS v_gap_1, round(v_avg - v_min, 6) AS v_gap_2 FROM final""")
def deficit_scores(spark, sf_dir):
    c = F.col
    return rounded(fx.final(spark, sf_dir).select(
        "desig", orbit.designation_year(c("name")).alias("desig_year"), (c("quantile_opps") - c("num_opps")).alias("delta_q"), (c("expected") - c("num_opps")).alias("deficit"), (c("num_opps") / c("expected")).alias("ratio"),
        (c("quantile_opps") - c("num_opps") - 15.5 * c("ext")).alias("priority"), orbit.logit(c("prob")).alias("logit_prob"),
        (c("v_max") - c("v_min")).alias("v_gap"), (c("v_second_max") - c("v_second_min")).alias("v_second_gap"), (c("v_max") - c("v_avg")).alias("v_gap_1"), (c("v_avg") - c("v_min")).alias("v_gap_2"),
    ))


@query("""WITH d AS (SELECT o_orderkey, (1500 + o_orderkey % 700)::DOUBLE AS y, (1 + o_orderkey % 12)::DOUBLE AS mo, 1 + (o_orderkey % 280) / 10.0 AS day FROM orders
  UNION ALL SELECT -k, 1582.0, 10.0, d FROM (VALUES (1, 4.0), (2, 15.0), (3, 4.5), (4, 5.0)) v(k, d)),
 e AS (SELECT *, CASE WHEN mo <= 2 THEN y - 1 ELSE y END AS y2, CASE WHEN mo <= 2 THEN mo + 12 ELSE mo END AS m2 FROM d)
 SELECT o_orderkey, round(floor(365.25*(y2+4716)) + floor(30.6001*(m2+1)) + day + CASE WHEN y2 < 1582 OR (y2 = 1582 AND (mo < 10 OR (mo = 10 AND day <= 4))) THEN 0 ELSE 2 - floor(y2/100) + floor(floor(y2/100)/4) END - 1524.5, 6) AS jd FROM e""")
def julian_days(spark, sf_dir):
    key = F.col("o_orderkey")
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (1500 + key % 700).cast("double").alias("y"), (1 + key % 12).cast("double").alias("mo"), (1 + (key % 280) / 10).alias("day"))
    edges = spark.sql("SELECT -k AS o_orderkey, 1582D AS y, 10D AS mo, d AS day FROM VALUES (1L, 4D), (2L, 15D), (3L, 4.5D), (4L, 5D) AS v(k, d)")
    return rounded(days.unionByName(edges).select("o_orderkey", orbit.julian_day(F.col("y"), F.col("mo"), F.col("day")).alias("jd")))
