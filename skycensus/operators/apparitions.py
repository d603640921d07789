"""Apparitions: the times at which Earth passes an object in longitude, as a table of rows per object, and features over it.

The times come from a linear guess refined by Newton steps with a Kepler solve in each; that is numpy on batches of
objects, one row in and n rows out, without a shuffle. Everything after it is grouped sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycensus.functions.orbit import EPS, MU, OBLIQUITY_2000, SUN, floor_at, held
from skycensus.operators.grid import TURN, _phase, dealt

COUNT, ERA_COUNT, LOOKBACK = 17, 25, 20 * 365.25
#: Radians by which a solved passage may be off; radians a day that an object has to gain on Earth.
CONVERGED, SLOWEST = 1e-6, 2.5e-4
#: First years of survey eras and their limiting magnitudes; north galactic pole in degrees.
ERAS, POLE = ((1998.0, 19.5), (2005.0, 20.5), (2012.0, 21.5), (2020.0, 22.0)), (192.85948, 27.12825)
c = F.col


def earth(day: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longitude (not wrapped), x and y of Earth on a day from 2451545."""
    s, cy = SUN, day / 36525.0
    m = np.radians(s["m0"] + s["m1"] * cy)
    lon = np.radians(s["l0"] + s["l1"] * cy) + s["c1"] * np.sin(m) + s["c2"] * np.sin(2 * m) + np.pi
    r = s["r0"] - s["r1"] * np.cos(m) - s["r2"] * np.cos(2 * m)
    return lon, r * np.cos(lon), r * np.sin(lon)


def _wrap(x: np.ndarray) -> np.ndarray:
    return np.mod(x + np.pi, TURN) - np.pi


class Orbits:
    """Orbits as columns of one row each, to meet several times. Times are days from the epoch: whole Julian days would cost five digits."""

    def __init__(self, a, e, i, node, peri, m, epoch, h):
        self.a, self.e = a[:, None], e[:, None]
        self.i, self.node, self.peri, self.m = (np.radians(x)[:, None] for x in (i, node, peri, m))
        self.m, self.day, self.h = np.mod(self.m, TURN), epoch[:, None] - 2451545.0, h[:, None]
        self.rate = np.sqrt(MU) / np.maximum(self.a, EPS) ** 1.5

    def at(self, t: np.ndarray) -> tuple[np.ndarray, ...]:
        """x, y, z and r at times t."""
        m = _wrap(self.m + self.rate * t)
        near, e = np.abs(m), self.e
        # never under the root, so that the steps come down to it, whatever e
        ecc = np.minimum(np.minimum(near + e, np.pi), np.minimum(near / (1 - e), np.cbrt(12 * near / np.maximum(e, 1e-12))))
        for _ in range(12):
            ecc = ecc - (ecc - e * np.sin(ecc) - near) / np.maximum(1 - e * np.cos(ecc), 1e-12)
        ecc = np.where(m < 0, -ecc, ecc)
        u = self.peri + 2 * np.arctan2(np.sqrt(1 + self.e) * np.sin(ecc / 2), np.sqrt(1 - self.e) * np.cos(ecc / 2))
        r, cu, su, cn, sn, ci = self.a * (1 - self.e * np.cos(ecc)), np.cos(u), np.sin(u), np.cos(self.node), np.sin(self.node), np.cos(self.i)
        return r * (cn * cu - sn * su * ci), r * (sn * cu + cn * su * ci), r * su * np.sin(self.i), r

    def oppositions(self, n: int, era: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Times of the n last passages at or before the epoch, whether each is solved to CONVERGED, and whether Earth passes at all; era: guessed with the sidereal year, steps not held."""
        slow = self.rate - (TURN / 365.256 if era else np.radians(36000.76983 / 36525.0))
        passed = np.abs(slow) >= SLOWEST
        slow = np.where(passed, slow, 1.0)
        cycle, off = TURN / np.abs(slow), _wrap(self.node + self.peri + self.m - earth(self.day)[0])
        last = -off / slow
        last = last - np.ceil(last / cycle) * cycle if era else np.where(last > 0, last - cycle, last)
        guess = last - np.arange(n) * cycle
        t = guess
        for _ in range(4):
            t = t - self.ahead(t) / slow
            if not era:
                t = np.clip(t, guess - cycle / 2, guess + cycle / 2)
        return t, np.abs(self.ahead(t)) <= CONVERGED, passed

    def ahead(self, t: np.ndarray) -> np.ndarray:
        """Angle by which the object is ahead of Earth."""
        x, y, _, _ = self.at(t)
        return _wrap(np.arctan2(y, x) - earth(self.day + t)[0])

    def seen(self, t: np.ndarray) -> dict[str, np.ndarray]:
        x, y, z, r = self.at(t)
        _, ex, ey = earth(self.day + t)
        dx, dy = x - ex, y - ey
        d = np.sqrt(dx * dx + dy * dy + z * z)
        alpha = np.arccos(np.clip((x * dx + y * dy + z * z) / (np.maximum(r, EPS) * np.maximum(d, EPS)), -1, 1))
        tilt, (ra0, dec0) = np.radians(OBLIQUITY_2000), np.radians(POLE)
        dec = np.arcsin(np.clip((dy * np.sin(tilt) + z * np.cos(tilt)) / np.maximum(d, 1e-12), -1, 1))
        ra = np.arctan2(dy * np.cos(tilt) - z * np.sin(tilt), dx)
        b = np.arcsin(np.clip(np.sin(dec) * np.sin(dec0) + np.cos(dec) * np.cos(dec0) * np.cos(ra - ra0), -1, 1))
        v = self.h + 5 * np.log10(np.maximum(r, EPS) * np.maximum(d, EPS)) - 2.5 * np.log10(_phase(alpha))
        return {"v": v, "dec": np.degrees(dec), "ra": np.mod(np.degrees(ra), 360), "gal_b": np.degrees(b), "way": np.stack((dx, dy, z)) / np.maximum(d, 1e-12)}


def table(orb: DataFrame, n: int = COUNT, era: bool = False) -> DataFrame:
    """desig, k (0: the last), t, v, dec, ra, gal_b, rate (degrees a day), valid and converged: n rows per object whose elements are all known.

    valid: not over 20 years before the epoch, and (era) not over a day after it. h may be null, and makes v null. converged: Earth and
    object agree in longitude to CONVERGED radians after the steps taken; other times are where the steps ended. An object of a period so
    near a year that it gains less than SLOWEST on Earth has no determined passage: its rows are null, not valid and not converged."""
    names = ["a", "e", "i", "node", "peri", "m", "epoch", "h"]
    cols = ["t", "v", "dec", "ra", "gal_b", "rate"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                a, e, *rest = (np.asarray(part[x].to_numpy(zero_copy_only=False), dtype=float) for x in names)
                with np.errstate(invalid="ignore", divide="ignore"):
                    orbits = Orbits(a, np.clip(e, 0, 0.999), *rest)
                    t, converged, passed = orbits.oppositions(n, era)
                    got = orbits.seen(t)
                    got["rate"] = np.degrees(np.arccos(np.clip((got["way"] * orbits.seen(t + 1)["way"]).sum(0), -1, 1)))
                got["t"], age = part["epoch"].to_numpy(zero_copy_only=False).astype(float)[:, None] + t, -t
                got = {x: np.where(passed, got[x], np.nan) for x in cols}
                valid = passed & (age <= LOOKBACK) & ((age >= -1) | (not era))
                rows = [pa.array(np.repeat(part["desig"].to_numpy(), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(a)))]
                yield pa.RecordBatch.from_arrays([*rows, *(pa.array(got[x].ravel(), from_pandas=True) for x in cols), pa.array(valid.ravel()), pa.array((converged & passed).ravel())], names=["desig", "k", *cols, "valid", "converged"])

    known = dealt(orb).select("desig", *[c(x).cast("double").alias(x) for x in names]).na.drop("any", subset=names[:-1])
    return known.mapInArrow(run, "desig bigint, k int, " + ", ".join(f"{x} double" for x in cols) + ", valid boolean, converged boolean")


def features(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """Means, counts and trends of magnitudes over valid apparitions; objects has vis_orbit, fraction and vis_last of each desig."""
    v = F.when(c("valid"), c("v"))
    first = F.when(c("k") < 5, v)
    bright = F.count(F.when(v < 21.0, 1))
    per = rows.groupBy("desig").agg(
        F.avg(v).alias("vis_opp_mean"), F.avg(first).alias("_five"), F.count(F.when(c("valid"), 1)).cast("double").alias("n_valid"),
        F.coalesce(F.sum(1 / (1 + F.exp(-(21.5 - v) / 0.5))), F.lit(0.0)).alias("vis_opp_soft_detect"), F.regr_slope(v, c("k").cast("double")).alias("vis_opp_slope"), F.min(v).alias("_least"),
        bright.cast("double").alias("opp_bright_count"), F.avg(F.pow(F.lit(10.0), -0.4 * v)).alias("_flux"),
    ).join(objects, "desig", "left")
    dim, light = -2.5 * F.log10(floor_at(c("fraction"), 1e-3)), -2.5 * F.log10(floor_at(c("_flux"), 1e-30))
    return per.select(
        "desig", "vis_opp_mean", (c("vis_opp_mean") - c("vis_orbit")).alias("vis_opp_minus_orbit"), (c("_five") - c("vis_orbit")).alias("vis_opp5_minus_orbit"), (c("_five") - c("vis_opp_mean")).alias("vis_opp5_minus_opp17"),
        "n_valid", "vis_opp_soft_detect", "vis_opp_slope", (c("_least") - c("vis_orbit")).alias("vis_oppmin_minus_orbit"), (c("opp_bright_count") / F.greatest("n_valid", F.lit(1.0))).alias("vis_opp_bright_frac"),
        (c("vis_last") - c("vis_orbit")).alias("vis_lastperi_minus_orbit"), "opp_bright_count", light.alias("vis_opp_fluxsum"), (light - c("vis_orbit")).alias("vis_oppflux_minus_orbit"),
        (c("vis_opp_mean") + dim).alias("vis_opp_mean_disc"), (light + dim).alias("vis_opp_fluxsum_disc"),
    )


def first_n(rows: DataFrame, objects: DataFrame, least: int = 10, most: int = 20, stale: float = 28.0) -> DataFrame:
    """Mean magnitude of the first n apparitions for each n, stale ones as faint as `stale`, dimmed by the discoverability; one pass."""
    v = F.when(c("valid"), c("v")).otherwise(F.when(c("v").isNotNull(), stale))
    per = rows.groupBy("desig").agg(*[F.avg(F.when(c("k") < n, v)).alias(f"m{n}") for n in range(least, most + 1)]).join(objects.select("desig", "fraction"), "desig", "left")
    dim = -2.5 * F.log10(floor_at(c("fraction"), 1e-3))
    return per.select("desig", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), (c(f"m{n}") + dim).alias("value")) for n in range(least, most + 1)])).alias("s")).select("desig", "s.*")


def limiting(year: Column) -> Column:
    """Limiting magnitude of a survey era; null before the first."""
    out = F.lit(None).cast("double")
    for start, limit in ERAS:
        out = F.when(year >= start, limit).otherwise(out)
    return out


def confusion(rows: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Adds conf, the raster's value at ra and dec (degrees), bilinear; right ascension runs backwards and wraps. No pixel: null.

    pixels (iy, ix, value) meet the four neighbours of a row by equi-joins."""
    x = F.pmod((720.0 - F.pmod("ra", F.lit(360.0))) * width / 360.0 - 0.5, F.lit(float(width)))
    y = held((90.0 - held(c("dec"), -90.0, 90.0)) * height / 180.0 - 0.5, 0.0, height - 1.000001)
    rows = rows.withColumns({"_x": x, "_y": y})
    rows = rows.withColumns({"_ix": F.floor("_x").cast("int"), "_iy": F.floor("_y").cast("int")})
    rows = rows.withColumns({"_fx": c("_x") - c("_ix"), "_fy": c("_y") - c("_iy")})
    for dy in (0, 1):
        for dx in (0, 1):
            part = pixels.select(c("iy").alias("_py"), c("ix").alias("_px"), c("value").cast("double").alias(f"_v{dy}{dx}"))
            rows = rows.join(part, (F.least(c("_iy") + dy, F.lit(height - 1)) == c("_py")) & (F.pmod(c("_ix") + dx, F.lit(width)) == c("_px")), "left").drop("_py", "_px")
    mixed = (c("_v00") * (1 - c("_fx")) + c("_v01") * c("_fx")) * (1 - c("_fy")) + (c("_v10") * (1 - c("_fx")) + c("_v11") * c("_fx")) * c("_fy")
    return rows.withColumn("conf", mixed).drop(*[x for x in rows.columns if x.startswith("_")])


def era_features(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """Features of the survey eras over a table of era apparitions with conf; objects has the epoch of each desig. A null conf detects nothing."""
    year = 2000.0 + (c("t") - 2451545.0) / 365.25
    rows = rows.withColumns({"year": year, "in_era": c("valid") & (year >= ERAS[0][0])}).withColumn("margin", F.when(c("valid"), limiting(c("year")) - c("v")))

    def chance(width: float) -> Column:
        mag = 1 / (1 + F.exp(-held(c("margin") / width, -30.0, 30.0)))
        gal = 1 / (1 + F.pow(floor_at(c("conf"), 0.0) / 25.0, F.lit(2.0)))
        dec = 1 / (1 + F.exp(-(c("dec") + 30.0) / 12.0)) / (1 + F.exp((c("dec") - 70.0) / 12.0))
        trail = 1 / floor_at(1 + c("rate") * 3600 * 30.0 / 86400 / 1.5, 1.0)
        return F.when(c("in_era"), F.coalesce(held(mag * gal * dec * trail, 0.0, 1.0), F.lit(0.0))).otherwise(0.0)

    p = chance(0.7)
    detected = c("in_era") & (c("margin") > 0)
    per = rows.groupBy("desig").agg(
        (F.count(F.when(c("valid") & (F.abs("gal_b") < 15), 1)) / F.greatest(F.count(F.when(c("valid"), 1)), F.lit(1))).alias("gal_lat_frac_low"), F.max(F.when(c("valid"), c("t"))).alias("_last"),
        F.min(F.when(detected, c("year"))).alias("first_det_year"), F.sum(chance(0.3)).alias("e_full"), F.sum(p * (1 - p)).alias("e_var"),
    )
    return per.join(objects.select("desig", "epoch"), "desig").select("desig", "gal_lat_frac_low", (c("epoch") - c("_last")).alias("days_since_last_opp"), "first_det_year", "e_full", "e_var")
