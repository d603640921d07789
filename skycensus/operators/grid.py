"""Features over an orbit grid, in two forms that give the same.

Exploded: each object meets its true anomalies (and Earth longitudes) made in its own row, then one grouped sum; any
column of a cell is at hand, and map-side sums keep the shuffle to a row per object and task. Arrow: the same features by
numpy on batches of objects, without a shuffle; the form for many objects. An object with a null element has null features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycensus.functions.orbit import EPS, OBLIQUITY, PHASE, elements, floor_at, held, phase

SAMPLES, LONGITUDES, NEO_SAMPLES = 32, 24, 96
TURN = 2 * 3.141592653589793
#: Half of all weight, less what the rounding of a sum of some hundred weights may take.
HALF = 0.5 - 1e-9


def ramp(x: Column, full: float, none: float) -> Column:
    """1 up to full, 0 from none on, linear between; a hard cut at full if none isn't beyond it."""
    return held((none - x) / (none - full), 0.0, 1.0) if none > full else F.when(x.isNotNull(), (x <= full).cast("double"))


def dealt(orb: DataFrame) -> DataFrame:
    """orb by object over all shuffle partitions, before each row becomes many; sums by object then need no other exchange."""
    return orb.repartition(int(orb.sparkSession.conf.get("spark.sql.shuffle.partitions")), "desig")


def cells(orb: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """orb with a row per true anomaly: k, nu, r, w (equal-time weight), x, y, z and the longitude lon."""
    a, i, _, e = elements()
    grid = dealt(orb).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("nu", F.col("k") * (TURN / samples))
    grid = grid.withColumn("r", a * (1 - e * e) / (1 + e * F.cos("nu")))
    n, u = F.radians("node"), F.radians("peri") + F.col("nu")
    grid = grid.withColumns({
        "x": F.col("r") * (F.cos(n) * F.cos(u) - F.sin(n) * F.sin(u) * F.cos(i)),
        "y": F.col("r") * (F.sin(n) * F.cos(u) + F.cos(n) * F.sin(u) * F.cos(i)), "z": F.col("r") * F.sin(u) * F.sin(i), "w": F.col("r") * F.col("r"),
    })
    return grid.withColumn("lon", F.atan2("y", "x"))


def clip(x: Column, least: float, most: float) -> Column:
    """x within bounds. A null x gives a bound: callers ask for null once, around the whole, so that nothing is worked out twice."""
    return F.least(F.greatest(x, F.lit(least)), F.lit(most))


def seen(rows: DataFrame, off: Column, to: str = "") -> DataFrame:
    """Adds dx, dy, d and v seen from Earth at 1 AU, `off` radians ahead of the object's longitude; each step is a column of its own."""
    at, n = F.col("lon") + off, lambda x: F.col(x + to)
    rows = rows.withColumns({f"dx{to}": F.col("x") - F.cos(at), f"dy{to}": F.col("y") - F.sin(at)})
    rows = rows.withColumn(f"d{to}", F.sqrt(n("dx") * n("dx") + n("dy") * n("dy") + F.col("z") * F.col("z")))
    r, d = F.greatest("r", F.lit(EPS)), F.greatest(n("d"), F.lit(EPS))
    rows = rows.withColumn(f"th{to}", F.tan(F.acos(clip((F.col("w") + n("d") * n("d") - 1) / (2 * r * d), -1.0, 1.0)) / 2))
    (a1, b1), (a2, b2) = PHASE
    lit = F.greatest(0.85 * F.exp(-a1 * F.pow(n("th"), F.lit(b1))) + 0.15 * F.exp(-a2 * F.pow(n("th"), F.lit(b2))), F.lit(1e-30))
    return rows.withColumn(f"v{to}", F.when(n("d").isNotNull(), F.col("h") + 5 * F.log10(r * d) - 2.5 * F.log10(lit)))


def opposition(orb: DataFrame) -> DataFrame:
    """Cells seen at opposition, with the geocentric ecliptic latitude beta and declination dec in degrees."""
    rows, tilt = seen(cells(orb), F.lit(0.0)), F.radians(F.lit(OBLIQUITY))
    d, known = F.greatest("d", F.lit(EPS)), F.col("d").isNotNull()
    beta, dec = clip(F.col("z") / d, -1.0, 1.0), clip((F.col("dy") * F.sin(tilt) + F.col("z") * F.cos(tilt)) / d, -1.0, 1.0)
    return rows.withColumns({"beta": F.when(known, F.degrees(F.asin(beta))), "dec": F.when(known, F.degrees(F.asin(dec))), "flux": F.pow(F.lit(10.0), -0.4 * F.col("v"))})


def light(x: Column) -> Column:
    return -2.5 * F.log10(floor_at(x, 1e-30))


def discoverability(orb: DataFrame) -> DataFrame:
    """desig and the features of cells at opposition and of Earth 0, 30 and 60 degrees ahead."""
    rows = seen(seen(opposition(orb), F.radians(F.lit(30.0)), "30"), F.radians(F.lit(60.0)), "60")
    c = F.col
    rows = rows.withColumns({"three": c("flux") + F.pow(F.lit(10.0), -0.4 * c("v30")) + F.pow(F.lit(10.0), -0.4 * c("v60")), "lit": c("flux") * c("w")})
    three, lit = c("three"), c("lit")
    per = rows.groupBy("desig").agg(
        F.sum("w").alias("w"), F.sum(c("w") * ramp(c("v"), 21.1, 22.9) * ramp(F.abs("beta"), 2.0, 32.0)).alias("s"), F.sum(lit).alias("f"),
        F.sum(c("dec") * lit).alias("fd"), F.min("dec").alias("low"), F.sum(F.when(c("dec") < -30, lit).when(lit.isNotNull(), 0.0)).alias("fs"),
        F.sum(three / 3 * c("w")).alias("f3"), F.sum((c("v") + c("v30") + c("v60")) / 3 * c("w")).alias("m3"),
    )
    w, f = floor_at(c("w"), EPS), floor_at(c("f"), 1e-30)
    return per.select(
        "desig", (c("s") / w).alias("fraction"), light(c("f") / w).alias("vis_flux_opp"), (c("fd") / f).alias("dec_flux_weighted"), c("low").alias("dec_orbit_min"),
        (c("fs") / f).alias("frac_flux_south30"), light(c("f3") / w).alias("vis_flux_multi"), (c("m3") / w).alias("vis_mag_multi_old"),
    )


def around(orb: DataFrame) -> DataFrame:
    """Cells for each of 24 Earth longitudes around the circle, with the solar elongation elong in degrees."""
    rows = cells(orb).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(LONGITUDES - 1)))).withColumn("off", F.col("j") * (TURN / LONGITUDES))
    rows = seen(rows, F.col("off"))
    at = F.col("lon") + F.col("off")
    cos = clip((-F.cos(at) * F.col("dx") - F.sin(at) * F.col("dy")) / F.greatest("d", F.lit(EPS)), -1.0, 1.0)
    return rows.withColumn("elong", F.when(F.col("d").isNotNull(), F.degrees(F.acos(cos))))


def gated(orb: DataFrame, gates: list[tuple[float, float]] = ((60.0, 150.0),), name: str = "vis_mag_multi") -> DataFrame:
    """desig and, for each gate (elongation of no and of full efficiency), the mean magnitude while observable, dimmed by the share of time that it is.

    All gates come from one pass over the cells: each is a pair of sums. Never observable: the ungated mean, at the most dimming.
    """
    rows, c = around(orb), F.col
    sums = [F.sum(c("w")).alias("w"), F.sum(c("v") * c("w")).alias("vw")]
    for k, (least, full) in enumerate(gates):
        eff = c("w") * held((c("elong") - least) / (full - least), 0.0, 1.0)
        sums += [F.sum(eff).alias(f"d{k}"), F.sum(c("v") * eff).alias(f"n{k}")]
    total = floor_at(c("w"), EPS)
    out = []
    for k in range(len(gates)):
        mean = F.when(c(f"d{k}") > EPS, c(f"n{k}") / floor_at(c(f"d{k}"), EPS)).otherwise(c("vw") / total)
        out.append((mean - 2.5 * F.log10(floor_at(c(f"d{k}") / total, 1e-3))).alias(name if len(gates) == 1 else f"{name}_{k}"))
    return rows.groupBy("desig").agg(*sums).select("desig", *out)


def trial_features(orb: DataFrame, limit: float = 22.5, elongation: float = 60.0) -> DataFrame:
    """bright_frac, mean_opp_dec and solar_elong_quality of each object."""
    a, _, _, e = elements()
    rows, tilt = cells(orb.withColumn("rt", a * (1 + e * e / 2))), F.radians(F.lit(OBLIQUITY))
    c, r = F.col, floor_at(F.col("r"), EPS)
    v = c("h") + 5 * F.log10(r * floor_at(c("r") - 1, EPS))
    dec = F.asin(held((c("y") * F.sin(tilt) + c("z") * F.cos(tilt)) / r, -1.0, 1.0))
    far = F.sqrt(floor_at(1 + c("rt") * c("rt") - 2 * c("rt") * F.cos("nu"), EPS))
    elong = F.degrees(F.acos(held((1 - c("rt") * F.cos("nu")) / far, -1.0, 1.0)))
    per = rows.groupBy("desig").agg(F.sum("w").alias("w"), F.sum(F.when(v < limit, c("w")).when(v.isNotNull(), 0.0)).alias("b"), F.sum(dec * c("w")).alias("d"), F.avg((elong > elongation).cast("double")).alias("solar_elong_quality"))
    w = floor_at(c("w"), EPS)
    return per.select("desig", (c("b") / w).alias("bright_frac"), F.degrees(c("d") / w).alias("mean_opp_dec"), "solar_elong_quality")


def near_earth(orb: DataFrame, close: float = 0.3) -> DataFrame:
    """Distances from a circular Earth orbit over 96 anomalies: the least one and its geometry, the weighted median, shares of time."""
    a, i, _, e = elements()
    speed = F.sqrt(floor_at(3 - 1 / floor_at(a, EPS) - 2 * F.sqrt(floor_at(a * (1 - e * e), 0.0)) * F.cos(i), 0.0))
    rows, c = cells(orb.withColumn("speed", speed), NEO_SAMPLES), F.col
    rows = rows.withColumn("rho", F.sqrt(c("x") * c("x") + c("y") * c("y")))
    rows = rows.withColumn("d", F.sqrt(floor_at(c("w") + 1 - 2 * c("rho"), EPS)))
    at = F.when(c("d").isNotNull(), F.struct("d", "k", "r", "rho"))  # ties go to the first anomaly
    per = rows.groupBy("desig").agg(
        F.min(at).alias("m"), F.first("h").alias("h"), F.first("speed").alias("speed"), F.sum("w").alias("w"), F.sum(F.when(c("r") < 1, c("w")).when(c("w").isNotNull(), 0.0)).alias("inside"),
        F.sum(F.when(c("d") < close, c("w")).when(c("d").isNotNull(), 0.0)).alias("near"), F.sort_array(F.collect_list(F.when(c("d").isNotNull(), F.struct("d", "w")))).alias("all"),
    )
    m, w = c("m"), floor_at(c("w"), EPS)
    # the first distance at which the running weight is half of all; on a circle that is half of equal weights, which sums reach but for a last bit
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("d"))
    half = F.aggregate("all", start, lambda s, x: F.struct((s["sum"] + x["w"]).alias("sum"), F.when(s["d"].isNotNull(), s["d"]).when((s["sum"] + x["w"]) / w >= HALF, x["d"]).alias("d")), lambda s: s["d"])
    d, r = floor_at(m["d"], EPS), floor_at(m["r"], EPS)
    alpha = F.acos(held((m["r"] * m["r"] - m["rho"]) / (r * d), -1.0, 1.0))
    return per.select(
        "desig", m["d"].alias("earth_moid"), half.alias("geo_dist_opp_typ"), F.degrees(alpha).alias("phase_at_moid"), (c("h") + 5 * F.log10(r * d) - 2.5 * F.log10(phase(alpha))).alias("vis_at_moid"),
        F.degrees(c("speed") * (TURN / 365.25) / d).alias("sky_rate_moid"), (c("inside") / w).alias("frac_time_inside_1au"), (c("near") / w).alias("frac_time_close"),
    )


FEATURES = ["fraction", "vis_flux_opp", "dec_flux_weighted", "dec_orbit_min", "frac_flux_south30", "vis_flux_multi", "vis_mag_multi_old", "vis_mag_multi"]


def _phase(alpha: np.ndarray) -> np.ndarray:
    t = np.maximum(np.tan(alpha / 2), 0)
    (a1, b1), (a2, b2) = PHASE
    return np.maximum(0.85 * np.exp(-a1 * t**b1) + 0.15 * np.exp(-a2 * t**b2), 1e-30)


def kernel(a, e, i, node, peri, h) -> dict[str, np.ndarray]:
    """The features of discoverability() and gated() for arrays of objects; NaN where an element is NaN."""
    e, tilt = np.clip(e, 0, 0.999)[:, None], np.radians(OBLIQUITY)
    a, h, i, n = a[:, None], h[:, None], np.radians(i)[:, None], np.radians(node)[:, None]
    nu = np.arange(SAMPLES) * TURN / SAMPLES
    r, u = a * (1 - e * e) / (1 + e * np.cos(nu)), np.radians(peri)[:, None] + nu
    x, y = r * (np.cos(n) * np.cos(u) - np.sin(n) * np.sin(u) * np.cos(i)), r * (np.sin(n) * np.cos(u) + np.cos(n) * np.sin(u) * np.cos(i))
    z, w, near, rho = r * np.sin(u) * np.sin(i), r * r, np.maximum(r, EPS), np.hypot(x, y)
    cos, sin = np.where(rho > 0, x / np.where(rho > 0, rho, 1), 1.0), np.where(rho > 0, y / np.where(rho > 0, rho, 1), 0.0)
    total = np.maximum(w.sum(1), EPS)

    def view(off: float):
        cx, cy = cos * np.cos(off) - sin * np.sin(off), sin * np.cos(off) + cos * np.sin(off)
        dx, dy = x - cx, y - cy
        d = np.sqrt(dx * dx + dy * dy + z * z)
        safe = np.maximum(d, EPS)
        v = h + 5 * np.log10(near * safe) - 2.5 * np.log10(_phase(np.arccos(np.clip((w + d * d - 1) / (2 * near * safe), -1, 1))))
        return v, safe, dy, np.clip((-cx * dx - cy * dy) / safe, -1, 1)

    v, d, dy, _ = view(0.0)
    flux = 10 ** (-0.4 * v)
    lit, dec = flux * w, np.degrees(np.arcsin(np.clip((dy * np.sin(tilt) + z * np.cos(tilt)) / d, -1, 1)))
    beta = np.abs(np.degrees(np.arcsin(np.clip(z / d, -1, 1))))
    v30, v60 = view(np.radians(30))[0], view(np.radians(60))[0]
    all_lit, dim = np.maximum(lit.sum(1), 1e-30), lambda f: -2.5 * np.log10(np.maximum(f, 1e-30))
    out = {
        "fraction": (w * np.clip((22.9 - v) / 1.8, 0, 1) * np.clip((32 - beta) / 30, 0, 1)).sum(1) / total, "vis_flux_opp": dim(lit.sum(1) / total), "dec_flux_weighted": (dec * lit).sum(1) / all_lit,
        "dec_orbit_min": dec.min(1), "frac_flux_south30": (np.where(np.isnan(lit), np.nan, dec < -30) * lit).sum(1) / all_lit,
        "vis_flux_multi": dim(((flux + 10 ** (-0.4 * v30) + 10 ** (-0.4 * v60)) / 3 * w).sum(1) / total), "vis_mag_multi_old": ((v + v30 + v60) / 3 * w).sum(1) / total,
    }
    gate = vgate = ungated = 0.0
    for j in range(LONGITUDES):
        v, _, _, sun = view(j * TURN / LONGITUDES)
        eff = w * np.clip((np.degrees(np.arccos(sun)) - 60) / 90, 0, 1)
        gate, vgate, ungated = gate + eff.sum(1), vgate + (v * eff).sum(1), ungated + (v * w).sum(1)
    every = np.maximum(total * LONGITUDES, EPS)
    out["vis_mag_multi"] = np.where(gate > EPS, vgate / np.maximum(gate, EPS), ungated / every) - 2.5 * np.log10(np.maximum(gate / every, 1e-3))
    return out


def features(orb: DataFrame) -> DataFrame:
    """desig and all features by numpy, 4096 objects at once; nothing is shuffled but the narrow rows of objects, once."""
    names = ["a", "e", "i", "node", "peri", "h"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                with np.errstate(invalid="ignore"):
                    got = kernel(*(np.asarray(part[c].to_numpy(zero_copy_only=False), dtype=float) for c in names))
                yield pa.RecordBatch.from_arrays([part["desig"], *(pa.array(got[c], from_pandas=True) for c in FEATURES)], names=["desig", *FEATURES])

    key = orb.schema["desig"].dataType.simpleString()
    return dealt(orb).select("desig", *[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(run, f"desig {key}, " + ", ".join(f"{c} double" for c in FEATURES))
