"""Queries of the orbit-grid features and sweeps, and DuckDB SQL written out by hand for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycensus.operators import grid
from skycensus.plans import fixtures as fx
from skycensus.plans.base import ORBX, query, r6, rounded


def _cells(n: int) -> str:
    return f"""{ORBX}, k AS (SELECT *, CASE WHEN e IS NULL THEN NULL ELSE greatest(0.0, least(0.999, e)) END AS e1, radians(i) AS ir, unnest(range({n})) AS k FROM orb),
 c AS (SELECT *, k*(2*pi()/{n}) AS nu, a*(1-e1*e1)/(1+e1*cos(k*(2*pi()/{n}))) AS r, radians(peri)+k*(2*pi()/{n}) AS uu FROM k),
 x AS (SELECT *, r*(cos(radians(node))*cos(uu)-sin(radians(node))*sin(uu)*cos(ir)) AS x, r*(sin(radians(node))*cos(uu)+cos(radians(node))*sin(uu)*cos(ir)) AS y, r*sin(uu)*sin(ir) AS z, r*r AS w FROM c)"""


def _seen(src: str, to: str, off: str, n: str) -> str:
    """CTE `to` over src: dx, dy, d, v with suffix n, seen from `off` radians ahead."""
    return f"""{to}1 AS (SELECT *, x - cos(atan2(y, x)+{off}) AS dx{n}, y - sin(atan2(y, x)+{off}) AS dy{n} FROM {src}), {to}2 AS (SELECT *, sqrt(dx{n}*dx{n}+dy{n}*dy{n}+z*z) AS d{n} FROM {to}1),
 {to}3 AS (SELECT *, CASE WHEN d{n} IS NOT NULL THEN tan(acos(greatest(-1.0, least(1.0, (w+d{n}*d{n}-1)/(2*greatest(r, 0.001)*greatest(d{n}, 0.001)))))/2) END AS th{n} FROM {to}2),
 {to} AS (SELECT *, CASE WHEN th{n} IS NOT NULL THEN h + 5*log10(greatest(r, 0.001)*greatest(d{n}, 0.001)) - 2.5*log10(greatest(0.85*exp(-3.33*pow(greatest(th{n}, 0.0), 0.63)) + 0.15*exp(-1.87*pow(greatest(th{n}, 0.0), 1.22)), 1e-30)) END AS v{n} FROM {to}3)"""


OPP = f"{_cells(32)}, {_seen('x', 'o', '0.0', '')}, opp AS (SELECT *, CASE WHEN d IS NOT NULL THEN degrees(asin(greatest(-1.0, least(1.0, z/greatest(d, 0.001))))) END AS beta, CASE WHEN d IS NOT NULL THEN degrees(asin(greatest(-1.0, least(1.0, (dy*sin(radians(23.44))+z*cos(radians(23.44)))/greatest(d, 0.001))))) END AS dec, pow(10.0, -0.4*v) AS flux FROM o)"
MULTI = f"{OPP}, {_seen('opp', 'p', 'radians(30.0)', '30')}, {_seen('p', 'q', 'radians(60.0)', '60')}"
VW, LW = "CASE WHEN v IS NOT NULL THEN greatest(0.0, least(1.0, (22.9-v)/1.8)) END", "greatest(0.0, least(1.0, (32-abs(beta))/30))"
FEATURES = f"""g AS (SELECT desig, sum(w) AS w, sum(w*{VW}*{LW}) AS s, sum(flux*w) AS f, sum(dec*flux*w) AS fd, min(dec) AS low, sum(CASE WHEN dec < -30 THEN flux*w ELSE flux*w*0 END) AS fs,
 sum((flux+pow(10.0, -0.4*v30)+pow(10.0, -0.4*v60))/3*w) AS f3, sum((v+v30+v60)/3*w) AS m3 FROM q GROUP BY desig)"""
#: sum of a column without any value is null, so a floor never makes a number of it
ITEMS = dict(fraction="s/greatest(w, 0.001)", vis_flux_opp="-2.5*log10(CASE WHEN f IS NOT NULL THEN greatest(f/greatest(w, 0.001), 1e-30) END)", dec_flux_weighted="fd/greatest(f, 1e-30)", dec_orbit_min="low", frac_flux_south30="fs/greatest(f, 1e-30)",
             vis_flux_multi="-2.5*log10(CASE WHEN f3 IS NOT NULL THEN greatest(f3/greatest(w, 0.001), 1e-30) END)", vis_mag_multi_old="m3/greatest(w, 0.001)")


@query(f"WITH {MULTI}, {FEATURES} SELECT desig, {r6(**ITEMS)} FROM g")
def grid_discoverability(spark, sf_dir):
    return rounded(grid.discoverability(fx.orbits_with_edges(spark, sf_dir)))


AROUND = f"{_cells(32)}, j AS (SELECT *, unnest(range(24))*(2*pi()/24) AS off FROM x), {_seen('j', 'a', 'off', '')}, el AS (SELECT *, CASE WHEN d IS NOT NULL THEN degrees(acos(greatest(-1.0, least(1.0, (-cos(atan2(y, x)+off)*dx - sin(atan2(y, x)+off)*dy)/greatest(d, 0.001))))) END AS elong FROM a)"
GATE = "greatest(0.0, least(1.0, (elong-{least})/({full}-{least})))"
DIMMED = "CASE WHEN n IS NOT NULL THEN CASE WHEN d > 0.001 THEN n/greatest(d, 0.001) ELSE vw/greatest(w, 0.001) END - 2.5*log10(greatest(d/greatest(w, 0.001), 0.001)) END"
GATED = f"gt AS (SELECT desig, sum(w) AS w, sum(v*w) AS vw, sum(w*{GATE.format(least=60.0, full=150.0)}) AS d, sum(v*w*{GATE.format(least=60.0, full=150.0)}) AS n FROM el GROUP BY desig)"


@query(f"WITH {AROUND}, {GATED} SELECT desig, {r6(vis_mag_multi=DIMMED)} FROM gt")
def grid_mag_multi(spark, sf_dir):
    return rounded(grid.gated(fx.orbits_with_edges(spark, sf_dir)))


@query(f"WITH {MULTI}, {FEATURES}, left_side AS (SELECT desig, {r6(**ITEMS)} FROM g), {AROUND.split(', j AS', 1)[1].join(['j AS', ''])}, {GATED}, right_side AS (SELECT desig, {r6(vis_mag_multi=DIMMED)} FROM gt) SELECT * FROM left_side JOIN right_side USING (desig)")
def grid_features_arrow(spark, sf_dir):
    """All grid features by the Arrow kernel, against the SQL of the exploded form."""
    return rounded(grid.features(fx.orbits_with_edges(spark, sf_dir)))


@query(f"""WITH {_cells(32)}, t AS (SELECT *, a*(1+e1*e1/2) AS rt FROM x), g AS (SELECT desig, sum(w) AS w, sum(CASE WHEN h + 5*log10(greatest(r, 0.001)*greatest(r-1, 0.001)) < 22.5 THEN w WHEN r IS NOT NULL AND h IS NOT NULL THEN 0 END) AS b,
 sum(CASE WHEN z IS NOT NULL THEN asin(greatest(-1.0, least(1.0, (y*sin(radians(23.44))+z*cos(radians(23.44)))/greatest(r, 0.001)))) END * w) AS d,
 avg(CASE WHEN rt IS NOT NULL THEN CASE WHEN degrees(acos(greatest(-1.0, least(1.0, (1-rt*cos(nu))/sqrt(greatest(1+rt*rt-2*rt*cos(nu), 0.001)))))) > 60 THEN 1.0 ELSE 0.0 END END) AS q FROM t GROUP BY desig)
 SELECT desig, {r6(bright_frac="b/greatest(w, 0.001)", mean_opp_dec="degrees(d/greatest(w, 0.001))", solar_elong_quality="q")} FROM g""")  # fmt: skip
def grid_trial_features(spark, sf_dir):
    return rounded(grid.trial_features(fx.orbits_with_edges(spark, sf_dir)))


@query(f"""WITH {_cells(96)}, n0 AS (SELECT *, sqrt(x*x+y*y) AS rho, CASE WHEN r IS NOT NULL AND ir IS NOT NULL THEN sqrt(greatest(3-1/greatest(a, 0.001)-2*sqrt(a*(1-e1*e1))*cos(ir), 0)) END AS speed FROM x), n1 AS (SELECT *, CASE WHEN rho IS NOT NULL THEN sqrt(greatest(w+1-2*rho, 0.001)) END AS d FROM n0),
 n2 AS (SELECT *, sum(w) OVER (PARTITION BY desig ORDER BY d, w, k ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY desig) AS total, row_number() OVER (PARTITION BY desig ORDER BY d, k) AS rn FROM n1),
 med AS (SELECT desig, min(d) AS half FROM n2 WHERE upto/greatest(total, 0.001) >= 0.5 - 1e-9 GROUP BY desig),
 ns AS (SELECT desig, sum(CASE WHEN r < 1 THEN w ELSE w*0 END)/greatest(sum(w), 0.001) AS inside, sum(CASE WHEN d < 0.3 THEN w ELSE w*0 END)/greatest(sum(w), 0.001) AS near FROM n1 GROUP BY desig),
 m AS (SELECT *, CASE WHEN d IS NOT NULL THEN acos(greatest(-1.0, least(1.0, (r*r-rho)/(greatest(r, 0.001)*greatest(d, 0.001))))) END AS alpha FROM n2 WHERE rn = 1)
 SELECT m.desig, {r6(earth_moid="d", geo_dist_opp_typ="half", phase_at_moid="degrees(alpha)", vis_at_moid="h + 5*log10(greatest(r, 0.001)*d) - 2.5*log10(greatest(0.85*exp(-3.33*pow(tan(alpha/2), 0.63)) + 0.15*exp(-1.87*pow(tan(alpha/2), 1.22)), 1e-30))",
 sky_rate_moid="degrees(speed*2*pi()/365.25/d)", frac_time_inside_1au="inside", frac_time_close="CASE WHEN d IS NOT NULL THEN near END")} FROM m LEFT JOIN ns USING (desig) LEFT JOIN med USING (desig)""")  # fmt: skip
def neo_grid(spark, sf_dir):
    return rounded(grid.near_earth(fx.orbits_with_edges(spark, sf_dir)))


def sweep(rows, feature: dict[str, tuple[dict, object]]):
    """Count and mean over objects of each candidate's weighted share, all from one pass over the cells; no cross join."""
    per = rows.groupBy("desig").agg(*[(F.sum(F.col("w") * x) / F.sum("w")).alias(name) for name, (_, x) in feature.items()])
    one = per.agg(*[s for name in feature for s in (F.count(name).alias(f"n_{name}"), F.avg(name).alias(f"m_{name}"))])
    row = lambda name, at: F.struct(*[F.lit(float(v)).alias(k) for k, v in at.items()], F.col(f"n_{name}").alias("n"), F.col(f"m_{name}").alias("mean_fraction"))
    return rounded(one.select(F.explode(F.array(*[row(name, at) for name, (at, _) in feature.items()])).alias("s")).select("s.*"))


def _sweep_sql(params: str, weight: str, names: str) -> str:
    return f"WITH {OPP}, s AS (SELECT desig, {names}, sum(w*({weight}))/sum(w) AS f FROM opp, {params} WHERE v IS NOT NULL GROUP BY ALL) SELECT {names}, count(f)::BIGINT AS n, round(avg(f), 6) AS mean_fraction FROM s GROUP BY ALL"


@query(_sweep_sql("(SELECT l::DOUBLE AS lim FROM range(10, 36) t(l)) p", "CASE WHEN v <= 22.5 AND abs(beta) <= lim THEN 1.0 ELSE 0.0 END", "lim"))
def sweep_latitude(spark, sf_dir):
    rows = grid.opposition(fx.orbits_with_edges(spark, sf_dir))
    return sweep(rows, {f"f{x}": ({"lim": x}, F.when(F.col("v").isNotNull(), ((F.col("v") <= 22.5) & (F.abs("beta") <= x)).cast("double"))) for x in range(10, 36)})


@query(_sweep_sql("(SELECT l::DOUBLE AS half FROM range(0, 18) t(l)) p", "CASE WHEN v <= 22.5 THEN 1.0 ELSE 0.0 END * CASE WHEN half = 0 THEN CASE WHEN abs(beta) <= 17 THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, least(1.0, (17+half-abs(beta))/(2*half))) END", "half"))
def sweep_rolloff(spark, sf_dir):
    rows = grid.opposition(fx.orbits_with_edges(spark, sf_dir))
    lit = F.when(F.col("v").isNotNull(), (F.col("v") <= 22.5).cast("double"))
    return sweep(rows, {f"f{x}": ({"half": x}, lit * grid.ramp(F.abs("beta"), 17.0 - x, 17.0 + x)) for x in range(18)})


@query(_sweep_sql("(SELECT 20.8+f/3.0 AS lower, round(0.8+wd*1.4/3.0, 9) AS width FROM range(0, 4) t(f), range(0, 4) u(wd)) p", "greatest(0.0, least(1.0, (lower+width-v)/width))*" + LW, "lower, width").replace("SELECT lower, width, count", "SELECT round(lower, 6) AS lower, round(width, 6) AS width, count"))
def sweep_brightness(spark, sf_dir):
    rows = grid.opposition(fx.orbits_with_edges(spark, sf_dir))
    at = [(20.8 + f / 3, 0.8 + w * 1.4 / 3) for f in range(4) for w in range(4)]
    return sweep(rows, {f"f{k}": ({"lower": x, "width": w}, grid.ramp(F.col("v"), x, x + w) * grid.ramp(F.abs("beta"), 2.0, 32.0)) for k, (x, w) in enumerate(at)})


@query(f"""WITH {AROUND}, p AS (SELECT 48.0+m*10.5 AS least_at, 135.0+f*20.0 AS full_at FROM range(0, 5) t(m), range(0, 5) u(f)), s AS (SELECT desig, least_at, full_at, sum(w) AS w, sum(v*w) AS vw,
 sum(w*{GATE.format(least='least_at', full='full_at')}) AS d, sum(v*w*{GATE.format(least='least_at', full='full_at')}) AS n FROM el, p GROUP BY ALL) SELECT least_at::DOUBLE AS least_at, full_at::DOUBLE AS full_at, count(n)::BIGINT AS n, round(avg({DIMMED}), 6) AS mean_magnitude FROM s GROUP BY ALL""")  # fmt: skip
def sweep_elongation(spark, sf_dir):
    """Every elongation ramp of a 5 x 5 grid from one pass over the stored cells."""
    gates = [(48.0 + m * 10.5, 135.0 + f * 20.0) for m in range(5) for f in range(5)]
    per = grid.gated(fx.orbits_with_edges(spark, sf_dir), gates, "v")
    one = per.agg(*[s for k in range(len(gates)) for s in (F.count(f"v_{k}").alias(f"n{k}"), F.avg(f"v_{k}").alias(f"m{k}"))])
    out = [F.struct(F.lit(a).alias("least_at"), F.lit(b).alias("full_at"), F.col(f"n{k}").alias("n"), F.col(f"m{k}").alias("mean_magnitude")) for k, (a, b) in enumerate(gates)]
    return rounded(one.select(F.explode(F.array(*out)).alias("s")).select("s.*"))
