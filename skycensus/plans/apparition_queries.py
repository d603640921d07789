"""Queries of the apparition tables and their features. The SQL solves the same orbits by recursion, step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycensus.functions import orbit
from skycensus.operators import apparitions, grid
from skycensus.plans import fixtures as fx
from skycensus.plans import grid_queries, orbit_queries  # noqa: F401  their SQL is used below
from skycensus.plans.base import ORBX, SQL, query, rounded

c = F.col
TAU = "(2*pi())"
LON = "(radians(280.46646+36000.76983*{t}/36525.0) + 0.033416*sin(radians(357.52911+35999.05029*{t}/36525.0)) + 0.000349*sin(2*radians(357.52911+35999.05029*{t}/36525.0)) + pi())"
DIST = "(1.00014061 - 0.01670861*cos(radians(357.52911+35999.05029*{t}/36525.0)) - 0.00013957*cos(2*radians(357.52911+35999.05029*{t}/36525.0)))"


def mod(x: str) -> str:
    return f"(({x}) - {TAU}*floor(({x})/{TAU}))"


def wrap(x: str) -> str:
    return f"({mod(f'({x}) + pi()')} - pi())"


def _ways(src: str, to: str, t: str) -> str:
    """CTEs that solve the orbit of src at the time column t: <to> has x, y, z, r. Twelve Newton steps by recursion."""
    u = "way*2*atan2(sqrt(1+e1)*sin(ee/2), sqrt(1-e1)*cos(ee/2)) + wr"
    start = "least(mm + e1, pi(), mm/(1 - e1), cbrt(12*mm/greatest(e1, 1e-12)))"
    return f"""{to}0 AS (SELECT *, abs({wrap(f'm0 + rate*{t}')}) AS mm, CASE WHEN {wrap(f'm0 + rate*{t}')} < 0 THEN -1 ELSE 1 END AS way FROM {src}),
 {to}k AS (SELECT *, {start} AS ee, 0 AS it FROM {to}0 UNION ALL SELECT * REPLACE (ee - (ee - e1*sin(ee) - mm)/greatest(1 - e1*cos(ee), 1e-12) AS ee, it + 1 AS it) FROM {to}k WHERE it < 12),
 {to}u AS (SELECT * EXCLUDE (it), {u} AS uu, a*(1-e1*cos(ee)) AS r FROM {to}k WHERE it = 12), {to} AS (SELECT * EXCLUDE (uu, mm, ee, way), r*(cos(nr)*cos(uu)-sin(nr)*sin(uu)*cos(ir)) AS x, r*(sin(nr)*cos(uu)+cos(nr)*sin(uu)*cos(ir)) AS y, r*sin(uu)*sin(ir) AS z FROM {to}u)"""


def _table(n: int, era: bool) -> str:
    """CTE `seen`: desig, k, t, v, dec, ra, gal_b, rate, valid."""
    year = "radians(36000.76983/36525.0)" if not era else f"({TAU}/365.256)"
    last = "CASE WHEN near > 0 THEN near - cycle ELSE near END" if not era else "near - ceil(near/cycle)*cycle"
    out = f"""{ORBX}, b0 AS (SELECT desig, a, epoch, epoch - 2451545.0 AS day, h, greatest(0.0, least(0.999, e)) AS e1, radians(i) AS ir, radians(node) AS nr, radians(peri) AS wr, {mod('radians(m)')} AS m0, sqrt(0.0002959122082855911)/pow(greatest(a, 0.001), 1.5) AS rate FROM orb WHERE a IS NOT NULL AND e IS NOT NULL AND i IS NOT NULL AND m IS NOT NULL AND epoch IS NOT NULL),
 b1 AS (SELECT *, abs(rate - {year}) >= 2.5e-4 AS passed, CASE WHEN abs(rate - {year}) >= 2.5e-4 THEN rate - {year} ELSE 1.0 END AS slow, {wrap(f"nr + wr + m0 - {LON.format(t='day')}")} AS psi FROM b0),
 b2 AS (SELECT *, {TAU}/abs(slow) AS cycle, -psi/slow AS near FROM b1), b3 AS (SELECT *, {last} AS last_t FROM b2),
 s0 AS (SELECT * EXCLUDE (psi, near, last_t), k, last_t - k*cycle AS guess, last_t - k*cycle AS t FROM b3, range({n}) r(k))"""
    ahead = f"atan2(y, x) - {LON.format(t='(day + t)')}"
    for step in range(4):
        moved = f"t - {wrap(ahead)}/slow"
        held = f"greatest(guess - cycle/2, least(guess + cycle/2, {moved}))" if not era else moved
        out += f", {_ways(f's{step}', f'w{step}', 't')}, s{step + 1} AS (SELECT * EXCLUDE (x, y, z, r) REPLACE ({held} AS t) FROM w{step})"
    out += f""", {_ways('s4', 'w4', 't')}, d0 AS (SELECT *, x - {DIST.format(t='(day + t)')}*cos({LON.format(t='(day + t)')}) AS dx, y - {DIST.format(t='(day + t)')}*sin({LON.format(t='(day + t)')}) AS dy, abs({wrap(ahead)}) <= 1e-6 AS met FROM w4), d1 AS (SELECT *, sqrt(dx*dx+dy*dy+z*z) AS d, t + 1 AS t1 FROM d0),
 d2 AS (SELECT *, tan(acos(greatest(-1.0, least(1.0, (x*dx+y*dy+z*z)/(greatest(r, 0.001)*greatest(d, 0.001)))))/2) AS th, asin(greatest(-1.0, least(1.0, (dy*sin(radians(23.439291))+z*cos(radians(23.439291)))/d))) AS dec, atan2(dy*cos(radians(23.439291))-z*sin(radians(23.439291)), dx) AS ra, dx/d AS ux, dy/d AS uy, z/d AS uz FROM d1),
 d3 AS (SELECT * EXCLUDE (x, y, z, r, dx, dy, d), h + 5*log10(greatest(r, 0.001)*greatest(d, 0.001)) - 2.5*log10(greatest(0.85*exp(-3.33*pow(th, 0.63)) + 0.15*exp(-1.87*pow(th, 1.22)), 1e-30)) AS v FROM d2), {_ways('d3', 'w5', 't1')},
 e0 AS (SELECT *, x - {DIST.format(t='(day + t1)')}*cos({LON.format(t='(day + t1)')}) AS dx, y - {DIST.format(t='(day + t1)')}*sin({LON.format(t='(day + t1)')}) AS dy FROM w5),
 all_seen AS (SELECT desig, k, epoch + t AS t, v, degrees(dec) AS dec, degrees(ra) - 360*floor(degrees(ra)/360) AS ra, degrees(asin(greatest(-1.0, least(1.0, sin(dec)*sin(radians(27.12825)) + cos(dec)*cos(radians(27.12825))*cos(ra - radians(192.85948)))))) AS gal_b,
  degrees(acos(greatest(-1.0, least(1.0, (ux*dx+uy*dy+uz*z)/sqrt(dx*dx+dy*dy+z*z))))) AS rate, passed AND -t <= 20*365.25{" AND -t >= -1" if era else ""} AS valid, passed AND met AS converged, passed, epoch FROM e0),
 seen AS (SELECT desig, k, valid, converged, epoch, {", ".join(f"CASE WHEN passed THEN {x} END AS {x}" for x in ("t", "v", "dec", "ra", "gal_b", "rate"))} FROM all_seen)"""
    return out




def orbits(spark, sf_dir):
    return fx.orbits_with_edges(spark, sf_dir)


@query(f"WITH RECURSIVE {_table(17, False)} SELECT desig, k::BIGINT AS k, valid, converged, round(t, 3) AS t, round(v, 4) AS v, round(dec, 3) + 0.0 AS dec FROM seen")
def apparition_table(spark, sf_dir):
    rows = apparitions.table(orbits(spark, sf_dir))
    return rows.select("desig", c("k").cast("bigint").alias("k"), "valid", "converged", F.round("t", 3).alias("t"), F.round("v", 4).alias("v"), (F.round("dec", 3) + 0.0).alias("dec"))


@query(f"WITH RECURSIVE {_table(25, True)} SELECT desig, k::BIGINT AS k, valid, converged, round(t, 3) AS t, round(v, 2) AS v, round(gal_b, 3) + 0.0 AS gal_b, round(rate, 4) AS rate FROM seen")
def era_table(spark, sf_dir):
    rows = apparitions.table(orbits(spark, sf_dir), apparitions.ERA_COUNT, True)
    return rows.select("desig", c("k").cast("bigint").alias("k"), "valid", "converged", F.round("t", 3).alias("t"), F.round("v", 2).alias("v"), (F.round("gal_b", 3) + 0.0).alias("gal_b"), F.round("rate", 4).alias("rate"))


OBJECTS = f"objects AS (SELECT m.desig, m.vis_mag_multi AS vis_orbit, d.fraction, p.vis_last_perihelion AS vis_last FROM ({SQL['grid_mag_multi']}) m JOIN ({SQL['grid_discoverability']}) d USING (desig) JOIN ({SQL['perihelion_passages']}) p USING (desig))"


def objects(spark, sf_dir):
    """What the features over apparitions need of each object, rounded as the other queries return it."""
    orb = orbits(spark, sf_dir)
    level, share = rounded(grid.gated(orb)), rounded(grid.discoverability(orb)).select("desig", "fraction")
    return level.withColumnRenamed("vis_mag_multi", "vis_orbit").join(share, "desig").join(rounded(orbit.passages(orb).select("desig", c("vis_last_perihelion").alias("vis_last"))), "desig")


@query(f"""WITH RECURSIVE {_table(17, False)}, {OBJECTS}, g AS (SELECT desig, avg(v) FILTER (valid) AS mean, avg(v) FILTER (valid AND k < 5) AS five, count(*) FILTER (valid)::DOUBLE AS n_valid, coalesce(sum(1/(1+exp(-(21.5-v)/0.5))) FILTER (valid), 0) AS soft, regr_slope(v, k) FILTER (valid) AS slope,
  count(*) FILTER (valid AND v IS NOT NULL) AS nv, min(v) FILTER (valid) AS least_v, count(*) FILTER (valid AND v < 21)::DOUBLE AS bright, -2.5*log10(CASE WHEN avg(v) FILTER (valid) IS NOT NULL THEN greatest(avg(pow(10.0, -0.4*v)) FILTER (valid), 1e-30) END) AS light FROM seen GROUP BY desig),
 j AS (SELECT *, -2.5*log10(CASE WHEN fraction IS NOT NULL THEN greatest(fraction, 0.001) END) AS dim FROM g LEFT JOIN objects USING (desig))
 SELECT desig, {", ".join(f"round({x}, 4) + 0.0 AS {n}" for n, x in dict(vis_opp_mean='mean', vis_opp_minus_orbit='mean - vis_orbit', vis_opp5_minus_orbit='five - vis_orbit', vis_opp5_minus_opp17='five - mean', n_valid='n_valid', vis_opp_soft_detect='soft', vis_opp_slope='CASE WHEN nv > 1 THEN slope END',
  vis_oppmin_minus_orbit='least_v - vis_orbit', vis_opp_bright_frac='bright/greatest(n_valid, 1)', vis_lastperi_minus_orbit='vis_last - vis_orbit', opp_bright_count='bright', vis_opp_fluxsum='light', vis_oppflux_minus_orbit='light - vis_orbit', vis_opp_mean_disc='mean + dim', vis_opp_fluxsum_disc='light + dim').items())} FROM j""")  # fmt: skip
def apparition_features(spark, sf_dir):
    rows = apparitions.table(orbits(spark, sf_dir))
    return rounded(apparitions.features(rows, objects(spark, sf_dir)), 4)


@query(f"WITH RECURSIVE {_table(20, False)}, {OBJECTS}, n AS (SELECT unnest(range(10, 21)) AS n), g AS (SELECT desig, n, avg(CASE WHEN valid THEN v WHEN v IS NOT NULL THEN 28.0 END) AS m FROM seen, n WHERE k < n GROUP BY ALL) SELECT n::BIGINT AS n, count(m)::BIGINT AS rows, round(avg(m - 2.5*log10(greatest(fraction, 0.001))), 4) AS mean_value FROM g LEFT JOIN objects USING (desig) GROUP BY n")
def sweep_apparitions(spark, sf_dir):
    rows = apparitions.table(orbits(spark, sf_dir), 20)
    got = apparitions.first_n(rows, objects(spark, sf_dir))
    return rounded(got.groupBy("n").agg(F.count("value").alias("rows"), F.avg("value").alias("mean_value")), 4)


PIXEL = "(31*({y}) + 17*({x})) % 256"


@query(f"""WITH p AS (SELECT desig, ((desig*37) % 7200)/20.0 AS ra, ((desig*53) % 3600)/20.0 - 90 AS dec FROM (SELECT c_custkey::BIGINT AS desig FROM customer) k), q AS (SELECT *, (720.0-ra)*36/360.0 - 0.5 - 36*floor(((720.0-ra)*36/360.0 - 0.5)/36) AS x, greatest(0.0, least(16.999999, (90-dec)*18/180.0 - 0.5)) AS y FROM p),
 f AS (SELECT *, floor(x)::INT AS ix, floor(y)::INT AS iy, x - floor(x) AS fx, y - floor(y) AS fy FROM q) SELECT desig, round(({PIXEL.format(y='iy', x='ix % 36')})*(1-fx)*(1-fy) + ({PIXEL.format(y='iy', x='(ix+1) % 36')})*fx*(1-fy) + ({PIXEL.format(y='least(iy+1, 17)', x='ix % 36')})*(1-fx)*fy + ({PIXEL.format(y='least(iy+1, 17)', x='(ix+1) % 36')})*fx*fy, 6) AS conf FROM f""")  # fmt: skip
def raster_sample(spark, sf_dir):
    k = c("desig")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(c("c_custkey").cast("bigint").alias("desig")).select(k, (k * 37 % 7200 / 20).alias("ra"), (k * 53 % 3600 / 20 - 90).alias("dec"))
    return rounded(apparitions.confusion(rows, raster(spark), 36, 18).select("desig", "conf"))


def raster(spark):
    return spark.range(36 * 18).select(F.floor(c("id") / 36).cast("int").alias("iy"), (c("id") % 36).cast("int").alias("ix")).withColumn("value", (31 * c("iy") + 17 * c("ix")) % 256)


_P = "greatest(0.0, least(1.0, 1/(1+exp(-greatest(-30.0, least(30.0, margin/{w})))) * 1/(1+pow(conf/25.0, 2)) * 1/(1+exp(-(dec+30)/12)) / (1+exp((dec-70)/12)) / greatest(1 + rate*3600*30/86400/1.5, 1.0)))"


@query(f"""WITH RECURSIVE {_table(25, True)}, y0 AS (SELECT *, 2000.0 + (t-2451545.0)/365.25 AS year FROM seen), y1 AS (SELECT *, valid AND year >= 1998 AS in_era, CASE WHEN valid AND v IS NOT NULL THEN CASE WHEN year >= 2020 THEN 22.0 WHEN year >= 2012 THEN 21.5 WHEN year >= 2005 THEN 20.5 WHEN year >= 1998 THEN 19.5 END - v END AS margin,
  (720.0-ra)*36/360.0 - 0.5 - 36*floor(((720.0-ra)*36/360.0 - 0.5)/36) AS px, greatest(0.0, least(16.999999, (90-dec)*18/180.0 - 0.5)) AS py FROM y0), y2 AS (SELECT *, floor(px)::INT AS ix, floor(py)::INT AS iy, px - floor(px) AS fx, py - floor(py) AS fy FROM y1),
 y3 AS (SELECT *, ({PIXEL.format(y='iy', x='ix % 36')})*(1-fx)*(1-fy) + ({PIXEL.format(y='iy', x='(ix+1) % 36')})*fx*(1-fy) + ({PIXEL.format(y='least(iy+1, 17)', x='ix % 36')})*(1-fx)*fy + ({PIXEL.format(y='least(iy+1, 17)', x='(ix+1) % 36')})*fx*fy AS conf FROM y2),
 y4 AS (SELECT *, CASE WHEN in_era AND margin IS NOT NULL THEN {_P.format(w=0.3)} ELSE 0 END AS p3, CASE WHEN in_era AND margin IS NOT NULL THEN {_P.format(w=0.7)} ELSE 0 END AS p7 FROM y3),
 g AS (SELECT desig, count(*) FILTER (valid AND abs(gal_b) < 15) / greatest(count(*) FILTER (valid), 1) AS low, max(epoch) - max(t) FILTER (valid) AS since, min(year) FILTER (in_era AND margin > 0) AS first_year, sum(p3) AS e_full, sum(p7*(1-p7)) AS e_var FROM y4 GROUP BY desig)
 SELECT desig, round(low, 4) AS gal_lat_frac_low, round(since, 3) AS days_since_last_opp, round(first_year, 4) AS first_det_year, round(e_full, 4) AS e_full, round(e_var, 4) AS e_var FROM g""")  # fmt: skip
def era_expectation(spark, sf_dir):
    orb = orbits(spark, sf_dir)
    rows = apparitions.confusion(apparitions.table(orb, apparitions.ERA_COUNT, True), raster(spark), 36, 18)
    got = apparitions.era_features(rows, orb)
    return got.select("desig", F.round("gal_lat_frac_low", 4).alias("gal_lat_frac_low"), F.round("days_since_last_opp", 3).alias("days_since_last_opp"), F.round("first_det_year", 4).alias("first_det_year"), F.round("e_full", 4).alias("e_full"), F.round("e_var", 4).alias("e_var"))
