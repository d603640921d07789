"""Closed-form columns of an orbit (a, e, i, node, peri, m in degrees; epoch as a Julian day; h), all inside codegen.

A null element makes every column that uses it null: floors and clips let null through.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS, OBLIQUITY, JUPITER = 1e-3, 23.44, 5.203
#: North galactic pole in ecliptic coordinates; slopes of the phase function.
GALACTIC_POLE = (-0.86767, -0.00041, 0.49717)
PHASE, PHASE_TYPICAL = ((3.33, 0.63), (1.87, 1.22)), ((3.332, 0.631), (1.862, 1.218))


def floor_at(x: Column, least: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(least)))


def held(x: Column, least: float, most: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(least)), F.lit(most)))


def elements() -> tuple[Column, Column, Column, Column]:
    """a, inclination in radians, h, and e held to 0 .. 0.999."""
    return F.col("a"), F.radians("i"), F.col("h"), held(F.col("e"), 0.0, 0.999)


def phase(alpha: Column, slopes=PHASE, least: float = 1e-30) -> Column:
    """Share of the light at a phase angle in radians."""
    t = floor_at(F.tan(held(alpha, 0.0, 3.141592653589793) / 2), 0.0)
    (a1, b1), (a2, b2) = slopes
    return floor_at(0.85 * F.exp(-a1 * F.pow(t, F.lit(b1))) + 0.15 * F.exp(-a2 * F.pow(t, F.lit(b2))), least)


def magnitude(r: Column, d: Column) -> Column:
    return 5 * F.log10(floor_at(r, EPS) * d) + F.col("h")


def offset(r: Column, by: float) -> Column:
    """Magnitude at the distance r with the observer `by` nearer."""
    return magnitude(r, floor_at(r - by, EPS))


def _inclined() -> tuple[Column, Column, Column]:
    """Mean distance, distance from Earth and phase angle of an inclined orbit."""
    a, i, _, e = elements()
    r = a * (1 + e * e / 2)
    d = F.sqrt(floor_at(r * r - 2 * r * F.cos(i) + 1, EPS))
    return r, d, F.acos(held((r - F.cos(i)) / floor_at(d, EPS), -1.0, 1.0))


def visibility() -> dict[str, Column]:
    a, _, _, e = elements()
    r, d, alpha = _inclined()
    level = F.sqrt(floor_at(r * r - 1, EPS))
    return {
        "vis_timeavg": magnitude(r, floor_at(F.sqrt(floor_at(F.abs(r * r - 1), EPS)) - 0.9, EPS)),
        "vis_typ": offset(a * (1 + e / 2), 0.51),
        "vis_flux": offset(a * F.pow(1 - e * e, F.lit(0.25)), 1.0),
        "vis_smin": offset(a * F.sqrt(1 - e * e), 1.0),
        "vis_mid": offset(a * (1 - e / 2), 1.0),
        "vis_q": offset(a * (1 - e), 0.8),
        "vis_inc_old": magnitude(r, d),
        "vis_inc": magnitude(r, d) - 2.5 * F.log10(phase(alpha)),
        "inc_opp_penalty": 5 * F.log10(d / level) - 2.5 * F.log10(phase(alpha)),
    }


#: Distance of each family of visibility columns from a and e.
FAMILIES = {"typical": lambda a, e: a * (1 + e / 2), "perihelion": lambda a, e: a * (1 - e), "aphelion": lambda a, e: a * (1 + e), "flux": lambda a, e: a * F.pow(floor_at(1 - e * e, 0.0), F.lit(0.25))}


def family(name: str, d: float) -> Column:
    """A visibility column of a family with its offset d; super4 takes d as the slope of the greatest phase angle."""
    a, _, _, e = elements()
    if name in FAMILIES:
        return offset(FAMILIES[name](a, e), d)
    r = a * (1 + e * e / 2)
    if name == "super1":
        return offset(r, d)
    if name == "super4":
        return offset(r, 1.0) + d * F.asin(held(1 / floor_at(r, EPS), 0.0, 1.0))
    if name == "super5":
        return magnitude(r, floor_at(F.sqrt(floor_at(F.abs(r * r - 1), EPS)) - d, EPS))
    raise ValueError(f"no such family: {name}")


def comet_visibility(d: float) -> dict[str, Column]:
    """Both legacy columns of an offset, with distances of at least 1."""
    at = lambda r: 5 * F.log10(floor_at(r, 1.0) * (floor_at(r, 1.0) - d)) + F.col("h")
    return {"vis": at(F.col("a") * (1 + F.col("e") / 2)), "vis_q": at(F.col("q"))}


def candidates(band: float = 10.0) -> dict[str, Column]:
    """Columns that searches for new features try; `band` is the ecliptic latitude that surveys cover, in degrees."""
    a, i, _, e = elements()
    r, _, _ = _inclined()
    q, far, z = a * (1 - e), a * (1 + e), perihelion()
    period = F.pow(a, F.lit(1.5))
    reach = lambda x, at: F.when(x["q"].isNotNull() & x["far"].isNotNull(), F.least(F.greatest(F.lit(at), x["q"]), x["far"]))
    ends = {"q": q, "far": far}
    earth, jupiter = reach(ends, 1.0), reach(ends, 5.204)
    share = 1 - 2 / 3.141592653589793 * F.asin(held(F.sin(F.radians(F.lit(band))) / floor_at(F.sin(i), EPS), 0.0, 1.0))
    gal = z["peri_x"] * GALACTIC_POLE[0] + z["peri_y"] * GALACTIC_POLE[1] + z["peri_z"] * GALACTIC_POLE[2]
    typical = F.asin(held(1 / floor_at(r, EPS), 0.0, 1.0)) / 2
    return {
        "mag_amplitude": 5 * F.log10(floor_at(far * (far - 1), EPS) / floor_at(q * (q - 1), EPS)),
        "synodic_period": held(1 / floor_at(F.abs(1 - 1 / floor_at(period, EPS)), 1e-4), 0.0, 1e4),
        "gal_lat_perihelion": F.degrees(F.asin(held(gal, -1.0, 1.0))),
        "frac_high_lat": F.when(F.sin(i) > F.sin(F.radians(F.lit(band))), share).when(i.isNotNull(), 0.0),
        "vis_aphelion": offset(far, 1.0),
        "ecl_lat_perihelion": F.degrees(F.asin(held(z["peri_z"], -1.0, 1.0))),
        "opp_angular_speed_typ": F.abs(1 / floor_at(F.sqrt(floor_at(r, EPS)), EPS) - 1) / floor_at(F.abs(r - 1), EPS),
        "vis_phase_corr": offset(r, 1.0) - 2.5 * F.log10(phase(typical, PHASE_TYPICAL, EPS)),
        "moid_proxy": F.sqrt((earth - 1) * (earth - 1) + earth * F.sin(i) * earth * F.sin(i)),
        "jupiter_moid_approx": F.sqrt((jupiter - 5.204) * (jupiter - 5.204) + jupiter * F.sin(i) * jupiter * F.sin(i)),
        "lon_perihelion": F.pmod(F.col("node") + F.col("peri"), F.lit(360.0)),
    }


def dynamics() -> dict[str, Column]:
    a, i, _, e = elements()
    period = F.pow(a, F.lit(1.5))
    raw, n = F.col("e"), F.radians("node")
    pole = GALACTIC_POLE[0] * F.sin(i) * F.sin(n) - GALACTIC_POLE[1] * F.sin(i) * F.cos(n) + GALACTIC_POLE[2] * F.cos(i)
    near = floor_at(a, EPS)
    return {
        "orbital_period_sync": F.abs(period - F.rint(period)),
        "tj": JUPITER / a + 2 * F.cos(i) * F.sqrt(a / JUPITER * (1 - raw * raw)),
        "is_trojan": (a > 5.0) & (a < 5.4) & (raw < 0.3) & (F.col("i") < 40),
        "node_plus_peri": F.pmod(F.col("node") + F.col("peri"), F.lit(360.0)),
        "galactic_inc": F.degrees(F.acos(held(pole, -1.0, 1.0))),
        "perihelion": a * (1 - e),
        "aphelion": a * (1 + e),
        "opik_u": F.sqrt(floor_at(3 - 1 / near - 2 * F.sqrt(floor_at(a * (1 - e * e), 0.0)) * F.cos(i), 0.0)),
    }


def perihelion() -> dict[str, Column]:
    _, i, _, _ = elements()
    n, p = F.radians("node"), F.radians("peri")
    x = F.cos(n) * F.cos(p) - F.sin(n) * F.sin(p) * F.cos(i)
    y = F.sin(n) * F.cos(p) + F.cos(n) * F.sin(p) * F.cos(i)
    z = F.sin(p) * F.sin(i)
    tilt = F.radians(F.lit(OBLIQUITY))
    south = held(y * F.sin(tilt) + z * F.cos(tilt), -1.0, 1.0)
    return {"peri_x": x, "peri_y": y, "peri_z": z, "peri_x_e": x * F.col("e"), "peri_y_e": y * F.col("e"), "peri_z_e": z * F.col("e"), "dec_perihelion": F.degrees(F.asin(south))}


#: Gaussian constant squared; mean longitude, anomaly and distance of the Sun seen from Earth; obliquity of J2000.
MU, SUN = 0.0002959122082855911, {"l0": 280.46646, "l1": 36000.76983, "m0": 357.52911, "m1": 35999.05029, "c1": 0.033416, "c2": 0.000349, "r0": 1.00014061, "r1": 0.01670861, "r2": 0.00013957}
OBLIQUITY_2000 = 23.439291


def earth(t: Column) -> tuple[Column, Column]:
    """Ecliptic x and y of Earth at a Julian day."""
    c = (t - 2451545.0) / 36525.0
    m = F.radians(SUN["m0"] + SUN["m1"] * c)
    lon = F.radians(SUN["l0"] + SUN["l1"] * c) + SUN["c1"] * F.sin(m) + SUN["c2"] * F.sin(2 * m) + 3.141592653589793
    r = SUN["r0"] - SUN["r1"] * F.cos(m) - SUN["r2"] * F.cos(2 * m)
    return r * F.cos(lon), r * F.sin(lon)


def passages(df):
    """df with the last perihelion time and, for it and the passages one and three periods before, magnitude, distance and declination."""
    a, i, h, e = elements()
    n, p = F.radians("node"), F.radians("peri")
    r = a * (1 - e)
    rate = F.sqrt(F.lit(MU)) / F.pow(floor_at(a, EPS), F.lit(1.5))
    df = df.withColumns({
        "_x": r * (F.cos(n) * F.cos(p) - F.sin(n) * F.sin(p) * F.cos(i)), "_y": r * (F.sin(n) * F.cos(p) + F.cos(n) * F.sin(p) * F.cos(i)),
        "_z": r * F.sin(p) * F.sin(i), "_r": floor_at(r, EPS), "_rate": floor_at(rate, EPS),
        "perihelion_time": F.col("epoch") - F.pmod(F.radians("m"), F.lit(2 * 3.141592653589793)) / floor_at(rate, EPS),
    })
    for name, back in (("last", 0), ("second", 1), ("third", 3)):
        ex, ey = earth(F.col("perihelion_time") - back * 2 * 3.141592653589793 / F.col("_rate"))
        df = df.withColumns({"_dx": F.col("_x") - ex, "_dy": F.col("_y") - ey})
        df = df.withColumn("_d", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") + F.col("_z") * F.col("_z")))
        dot = F.col("_x") * F.col("_dx") + F.col("_y") * F.col("_dy") + F.col("_z") * F.col("_z")
        alpha = F.acos(held(dot / (F.col("_r") * floor_at(F.col("_d"), EPS)), -1.0, 1.0))
        df = df.withColumn(f"vis_{name}_perihelion", h + 5 * F.log10(F.col("_r") * floor_at(F.col("_d"), EPS)) - 2.5 * F.log10(phase(alpha)))
        if not back:
            tilt = F.radians(F.lit(OBLIQUITY_2000))
            dec = F.asin(held((F.col("_dy") * F.sin(tilt) + F.col("_z") * F.cos(tilt)) / floor_at(F.col("_d"), EPS), -1.0, 1.0))
            df = df.withColumns({"perihelion_delta": F.col("_d"), "perihelion_dec": F.degrees(dec)})
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def designation_year(name: Column) -> Column:
    """Year of a provisional designation such as 2008 VK110; else null."""
    return F.nullif(F.regexp_extract(name, r"^((?:1[89]|20)[0-9]{2})\s+[A-Z]{2}", 1), F.lit("")).cast("double")


def julian_day(year: Column, month: Column, day: Column) -> Column:
    """Julian day of a calendar date with a fraction of a day; Gregorian from 1582-10-05 on."""
    early = month <= 2
    y, m = F.when(early, year - 1).otherwise(year), F.when(early, month + 12).otherwise(month)
    century = F.floor(y / 100)
    julian = (y < 1582) | ((y == 1582) & (month < 10)) | ((y == 1582) & (month == 10) & (day <= 4))
    shift = F.when(julian, 0).otherwise(2 - century + F.floor(century / 4))
    return F.floor(365.25 * (y + 4716)) + F.floor(30.6001 * (m + 1)) + day + shift - 1524.5


def logit(p: Column) -> Column:
    safe = held(p, 1e-15, 1 - 1e-15)
    return F.ln(safe / (1 - safe))


def poisson_cdf(k: Column, mean: Column) -> Column:
    """P(X <= k) by a running term, in logs so that no mean is too large; 0 for k under 0, null for a mean under 0."""
    start = F.struct((-mean).alias("log"), F.exp(-mean).alias("sum"))

    def step(acc, j):
        log = acc["log"] + F.ln(mean / j)
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    upto = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.when(mean.isNull() | k.isNull() | (mean < 0), None).when(k < 0, 0.0).when(mean == 0, 1.0).otherwise(F.least(F.aggregate(upto, start, step, lambda acc: acc["sum"]), F.lit(1.0)))
