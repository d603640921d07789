"""Catalog clean-up: flags, comparison with other catalogs, overrides, fused magnitudes, training filters, label frames.

Side tables (overrides, lists, other catalogs) may hold a key more than once; each operator says which row counts, so no
join makes more rows of an object. Joins are plain equi-joins: Spark broadcasts a side whose size it knows to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skycensus.operators.observations import unpacked

c = F.col


def coerced(name: str, default: float) -> Column:
    """Text as a number; blank, bad or null text gives the default."""
    return F.coalesce(F.trim(name).try_cast("double"), F.lit(default))


def flagged(orb: DataFrame, always: DataFrame, unless: DataFrame) -> DataFrame:
    """Adds filtered_out: desig is in `always`, or (desig, arc_length) is in `unless` (until the arc changes)."""
    a = always.select("desig").distinct().withColumn("_a", F.lit(True))
    u = unless.select("desig", "arc_length").distinct().withColumn("_u", F.lit(True))
    rows = orb.join(a, "desig", "left").join(u, ["desig", "arc_length"], "left")
    return rows.withColumn("filtered_out", F.coalesce("_a", F.lit(False)) | F.coalesce("_u", F.lit(False))).drop("_a", "_u")


def with_observations(orb: DataFrame, stats: DataFrame) -> DataFrame:
    """orb with the statistics of its objects' observations, null where there are none; stats' obj is a packed name, or the name itself.

    Of several rows that read as one name that of the most nights, then of the longest arc, counts; orb keeps its rows and its
    own columns where names clash.
    """
    rest = [n for n in stats.columns if n not in orb.columns and n != "obj"]
    named = stats.withColumn("_name", F.coalesce(unpacked(F.trim("obj")), F.trim("obj")))
    one = named.groupBy("_name").agg(F.max_by(F.struct(*rest), F.struct("nights_total", "total_arc")).alias("_s"))
    rows = orb.join(one, c("desig") == c("_name"), "left")
    return rows.select(*[c(n) for n in orb.columns], *[c(f"_s.{n}").alias(n) for n in rest])


def with_scores(orb: DataFrame, scores: DataFrame) -> DataFrame:
    """orb with ext of an earlier run (desig, ext), null where it has none; of several the greatest counts."""
    return orb.drop("ext").join(scores.groupBy("desig").agg(F.max("ext").alias("ext")), "desig", "left")


def external_elements(other: DataFrame) -> DataFrame:
    """Mean motion, perihelion, aphelion, epoch and a readable name of an external catalog (name, epoch_mjd, a, e)."""
    name = F.replace("name", F.lit("'"), F.lit(""))
    return other.withColumns({
        "n": 360 / F.pow("a", F.lit(1.5)) / 365.2569, "perihelion": c("a") * (1 - c("e")), "aphelion": c("a") * (1 + c("e")), "epoch": c("epoch_mjd") + 2400000.5,
        "name": F.concat(F.substring(name, 1, 4), F.lit(" "), F.substr(name, F.lit(5), F.lit(1000))),
    })


def compared(orb: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Adds the elements of catalog 1 (a, e, i, h, multi) as *_b and multi_disagree, and h of catalog 2 as h_c.

    A catalog's rows of one desig count once, the one of the least h (nulls last).
    """
    one = lambda df, cols: df.groupBy("desig").agg(F.min_by(F.struct(*cols), F.struct(F.isnull("h"), "h", *cols)).alias("s"))
    b = one(first, ["a", "e", "i", "h", "multi"]).select("desig", *[c(f"s.{k}").alias(f"{k}_b") for k in ("a", "e", "i", "h", "multi")])
    s = one(second, ["h"]).select("desig", c("s.h").alias("h_c"))
    rows = orb.drop("h_b", "h_c").join(b, "desig", "left").join(s, "desig", "left")
    return rows.withColumn("multi_disagree", c("multi_b").isNotNull() & (c("multi_b") != F.coalesce((c("num_opps") > 1).cast("int"), F.lit(0))))


def differences(orb: DataFrame) -> DataFrame:
    """Magnitudes over 33 become null; absolute differences with fills for a missing side; h_mpc keeps the catalog's own."""
    rows = orb.withColumns({k: F.when(c(k) <= 33, c(k)) for k in ("h", "h_b", "h_c")}).withColumn("h_mpc", c("h"))
    diff = lambda k, other, fill: F.coalesce(F.abs(c(k) - c(other)), F.lit(fill))
    rows = rows.withColumns({"h_diff": diff("h", "h_b", 0.011), "a_diff": diff("a", "a_b", 0.0), "e_diff": diff("e", "e_b", 0.0), "i_diff": diff("i", "i_b", 0.0), "h_diff_c": diff("h", "h_c", 0.012)})
    return rows.withColumn("h_diff_abs_max", F.greatest("h_diff", "h_diff_c"))


def fuse_h(orb: DataFrame) -> DataFrame:
    """h becomes the median of three, else the greatest present; rows whose h is then -9.99 go, those without one stay."""
    three = c("h").isNotNull() & c("h_b").isNotNull() & c("h_c").isNotNull()
    fused = F.when(three, F.sort_array(F.array("h", "h_b", "h_c"))[1]).otherwise(F.greatest("h", "h_b", "h_c"))
    return orb.withColumn("h", fused).filter(~c("h").eqNullSafe(F.lit(-9.99)))


def corrected(orb: DataFrame, fixes: DataFrame) -> DataFrame:
    """h replaced by the last correction (line_no) of the object."""
    last = fixes.groupBy("desig").agg(F.max_by("h", "line_no").alias("_h"))
    return orb.join(last, "desig", "left").withColumn("h", F.coalesce("_h", "h")).drop("_h")


def raise_only(df: DataFrame, over: DataFrame, key: str, value: str, null_too: bool = True) -> DataFrame:
    """value becomes the greatest override where that is larger, or (null_too) value is null."""
    top = over.groupBy(key).agg(F.max(value).alias("_new"))
    new = F.greatest(value, "_new")
    return df.join(top, key, "left").withColumn(value, new if null_too else F.when(c(value).isNotNull(), new)).drop("_new")


def targets(orb: DataFrame, threshold: int = 4) -> DataFrame:
    """Arc lengths only of objects of one opposition; the targets of both models."""
    arc = F.when(F.coalesce(c("num_opps") < 2, F.lit(True)), c("arc_length"))
    return orb.withColumns({"arc_length": arc, "is_past_threshold": F.coalesce((c("num_opps") >= threshold).cast("int"), F.lit(0)), "num_opps_minus_one": c("num_opps") - 1})


def training_filter(rows: DataFrame, known: DataFrame, dual: DataFrame, kind: str = "notebook") -> DataFrame:
    """Objects with good orbits, none of them known active (by desig) or of two designations (by number).

    notebook: near objects (q < 1.3) are let off arc, ext and u. tuner: none is, and a missing ext fails. neo: near objects alone, with looser limits.
    """
    near = F.coalesce(c("q") < 1.3, F.lit(False))
    arc, agree = lambda n: (c("arc_length") >= n) | c("arc_length").isNull(), ~c("multi_disagree")
    close = lambda a, e, i: (c("a_diff") < a) & (c("e_diff") < e) & (c("i_diff") < i)
    where = {
        "notebook": [arc(20) | near, c("num_obs") >= 16, ~c("filtered_out"), close(0.0005, 0.00015, 0.003), agree, (c("ext") < 0.1) | c("ext").isNull() | near, (c("u") < 9) | near],
        "tuner": [arc(20), c("num_obs") >= 16, c("h_diff_abs_max") < 0.3, close(0.0005, 0.00015, 0.003), agree, c("ext") < 0.1, c("u") < 9],
        "neo": [near, arc(3), c("num_obs") >= 16, c("h_diff_abs_max") < 0.4, close(0.0008, 0.00025, 0.004), agree, c("ext") < 0.25],
    }[kind]
    for x in where:
        rows = rows.filter(x)
    return rows.join(known.select("desig"), "desig", "left_anti").join(dual.select("number"), "number", "left_anti")


def filled_columns(df: DataFrame, names: list[str], most: float = 0.1) -> list[str]:
    """Of names those of whose values at most that share is null, from one aggregate."""
    row = df.agg(*[F.avg(F.isnull(n).cast("double")).alias(n) for n in names]).first()
    return [n for n in names if row[n] is not None and row[n] <= most]


def with_columns_or_null(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with each missing column as a null of its type."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in names.items() if n not in df.columns})


def bag_union(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; a column that a part lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def heaviest(df: DataFrame, key: str, weight: str, source: str) -> DataFrame:
    """One row per key: the heaviest, of equals the first source."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(weight), source))
    return df.withColumn("_n", at).filter("_n = 1").drop("_n")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", at).filter("_n = 1").drop("_n")


def stratified(df: DataFrame, keep: Column, n: int, draw: str) -> DataFrame:
    """All rows where keep holds, and of the others the n of the least draw."""
    rest = df.filter(~F.coalesce(keep, F.lit(False))).orderBy(draw, "desig").limit(n)
    return df.filter(keep).unionByName(rest)


def looked_up(names: DataFrame, data: DataFrame, key: str = "name") -> DataFrame:
    """data joined to names by key, else by the key without the number of a periodic comet in front (282P/...).

    The first row (line_no) of a key in data counts."""
    one = first_rows(data, [key], ["line_no"]).drop("line_no")
    cols = [x for x in one.columns if x != key]
    exact = one.select(c(key).alias("_k1"), F.struct(*cols).alias("_exact"))
    bare = one.select(c(key).alias("_k2"), F.struct(*cols).alias("_bare"))
    rows = names.withColumn("_stripped", F.regexp_replace(key, "^[0-9]+[PDAI]/", ""))
    rows = rows.join(exact, c(key) == c("_k1"), "left").join(bare, (c("_stripped") == c("_k2")) & c("_k1").isNull(), "left")
    got = F.coalesce("_exact", "_bare")
    return rows.select(*names.columns, *[got[x].alias(x) for x in cols])


def overlaid(full: DataFrame, oof: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Predictions of full, with those of out-of-fold rows in their place where there are some."""
    fresh = oof.select(key, *[c(n).alias(f"_{n}") for n in names])
    return full.join(fresh, key, "left").withColumns({n: F.coalesce(f"_{n}", n) for n in names}).drop(*[f"_{n}" for n in names])


#: Label sources: number, predicate over the frame, weight. A weight of None is the next number over the rows of the source.
def positives(rows: DataFrame, orb: DataFrame, unless: DataFrame, named: DataFrame) -> DataFrame:
    """desig, source, weight of poorly linked or uncertain objects: the heaviest source of each, after the clean-up.

    `unless` (desig, arc_length, reason) and `named` (desig, reason) count where the reason speaks of a mislinkage.
    """
    gap, second, gap1, gap2 = c("v_max") - c("v_min"), c("v_second_max") - c("v_second_min"), c("v_max") - c("v_avg"), c("v_avg") - c("v_min")
    single = (c("prob") > 0.975) & (c("num_opps") == 1)
    few = c("num_opps").between(2, 3)
    rules = [
        (1, (c("prob") > 0.985) & few & (c("nights") <= 10), 1.0), (2, single & (c("nights") < 4), 1.0), (3, single & (c("nights") >= 4) & (c("ext") >= 0.01), 0.2),
        (6, (gap > 3) & (gap1 > 0.5) & (gap2 > 1.5) & (second > 1.5) & c("arc_length").between(7, 30) & (c("nights") <= 4) & c("q").between(1.6, 3.5), 1.0),
        (7, (c("prob") > 0.98) & few & (c("longest_opp_arc") < 5) & (c("nights") <= 7), 5.0), (8, single & (c("u") == 9), 0.4),
    ]
    found = sourced(usable(rows), rules)
    tells = F.lower("reason").contains("misl")
    once = lambda df, keys, n: orb.join(df.filter(tells).select(*keys).distinct(), keys).select("desig", F.lit(n).alias("source"), F.lit(1.0).alias("weight"))
    found = found.unionByName(once(unless, ["desig", "arc_length"], 4)).unionByName(once(named, ["desig"], 5))
    best = heaviest(found, "desig", "weight", "source").join(orb.select("desig", "arc_length", "nights", "num_opps", "second_nights"), "desig")
    secure = (c("arc_length") >= 12) & (c("nights") >= 5) & (c("num_opps") == 1)
    return best.filter(~F.coalesce(secure, F.lit(False)) & ~F.coalesce(c("second_nights") > 1, F.lit(False))).select("desig", "source", "weight")


def usable(rows: DataFrame) -> DataFrame:
    """Rows that labels may come from: not of the latest circulars, nights known."""
    return rows.filter(~F.coalesce(F.substring("ref", 1, 5) == "E2026", F.lit(False)) & c("nights").isNotNull())


def sourced(rows: DataFrame, rules: list[tuple]) -> DataFrame:
    """(desig, source, weight) for each rule a row passes, from one scan."""
    hit = F.array(*[F.when(F.coalesce(p, F.lit(False)), F.struct(F.lit(n).alias("source"), F.lit(w).cast("double").alias("weight"))) for n, p, w in rules])
    return rows.select("desig", F.explode(F.array_compact(hit)).alias("r")).select("desig", "r.*")


def negatives(rows: DataFrame) -> DataFrame:
    """desig, source, weight of well linked objects: a source weighs as many rows as its target number over what it has."""
    okay, few = (c("prob") < 0.6) & (c("num_opps") < 3), c("nights") == 3
    second = c("v_second_max") - c("v_second_min")
    rules = [
        (1, okay & (c("nights") >= 5) & (c("num_opps") == 1), 5000), (2, okay, 5000), (3, okay & ((c("nights") >= 4) | (few & c("arc_length").between(11, 22))), 7000), (4, c("num_opps") >= 3, 2000),
        (5, (c("num_opps") >= 4) & (c("longest_opp_arc") < 6), 500), (6, okay & (c("nights") == 4) & (c("u") < 9), 8000), (7, (c("prob") < 0.97) & (c("num_opps") == 3), 500),
        (8, okay & (second < 0.8) & c("arc_length").between(11, 17) & c("nights").between(3, 5) & (c("prob") < 0.4) & (c("rms") < 0.09), None), (9, c("second_nights") == 2, 2000),
    ]
    found = sourced(usable(rows), rules)
    counts = found.groupBy("source").agg(F.count("*").alias("n"))  # at most one row a source
    found = found.join(F.broadcast(counts), "source").select("desig", "source", F.coalesce(c("weight") / c("n"), F.lit(1.0)).alias("weight"))
    return heaviest(found, "desig", "weight", "source")
