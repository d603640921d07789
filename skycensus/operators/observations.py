"""Timestamped observations reduced to statistics per object: one exchange by object, then windows and grouped sums on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPPOSITION_GAP, NIGHT = 180.0, 0.5
#: Shift from the magnitude in a band to V. An unknown band has none.
BANDS = {
    "V": 0.0, "v": 0.0, "N": 0.0, "T": 0.0, "j": 0.0, "u": -2.50, "U": -1.30, "B": -0.80, "g": -0.28, "c": -0.05, "w": 0.16, "r": 0.23, "G": 0.28, "o": 0.33, "y": 0.36, "z": 0.37, "i": 0.39, "C": 0.40, "R": 0.40, "W": 0.40,
    "L": 0.20, "Y": 0.70, "I": 0.80, "J": 1.20, "H": 1.40, "K": 1.70, " ": 0.0, "Lu": -1.771, "Lg": -0.349, "Lr": 0.214, "Li": 0.373, "Lz": 0.350, "Ly": 0.355, "Ac": -0.05, "Ao": 0.33, "Bj": -0.80, "Gb": 0.28, "Gr": 0.28,
    "Ic": 0.80, "Rc": 0.40, "Uj": -1.30, "Vj": 0.0, "Pg": -0.28, "Pi": 0.39, "Pr": 0.23, "Pw": 0.16, "Py": 0.36, "Pz": 0.37, "Sg": -0.28, "Si": 0.39, "Sr": 0.23, "Sz": 0.37, "UNK": 0.0, "IR": 0.0, "VR": 0.0, "Lx": 0.0, "W2": 0.0, "W3": 0.0, "W4": 0.0,
}


def dedupe(obs: DataFrame, dealt: bool = False) -> DataFrame:
    """The first line of each (obj, t) stays. Rows are dealt by object alone, if they aren't `dealt` so, and all windows and groups by obj that follow go on from there."""
    at = F.row_number().over(Window.partitionBy("obj", "t").orderBy("line_no"))
    rows = obs if dealt else obs.repartition("obj")
    return rows.withColumn("_n", at).filter("_n = 1").drop("_n")


def gaps(obs: DataFrame, opposition: float = OPPOSITION_GAP) -> DataFrame:
    """Adds gap (to the previous observation) and segment (from 1; a new one at each opposition gap)."""
    w = Window.partitionBy("obj").orderBy("t", "line_no")
    rows = obs.withColumn("gap", F.col("t") - F.lag("t").over(w))
    new = F.sum(F.when(F.col("gap") >= opposition, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("segment", 1 + new)


def nights(times: Column, span: float = NIGHT) -> Column:
    """How many nights sorted times make: a night begins once a time is over `span` past the last beginning."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).cast("long").alias("n"))
    fresh = lambda acc, t: acc["anchor"].isNull() | (t - acc["anchor"] > span)
    step = lambda acc, t: F.struct(F.when(fresh(acc, t), t).otherwise(acc["anchor"]).alias("anchor"), (acc["n"] + fresh(acc, t).cast("long")).alias("n"))
    return F.aggregate(times, start, step, lambda acc: acc["n"])


def segments(obs: DataFrame) -> DataFrame:
    """obj, segment, arc, nights, n_obs."""
    per = gaps(obs).groupBy("obj", "segment").agg(F.sort_array(F.collect_list("t")).alias("ts"), (F.max("t") - F.min("t")).alias("arc"), F.count("*").alias("n_obs"))
    return per.select("obj", "segment", "arc", nights(F.col("ts")).alias("nights"), "n_obs")


def marked(obs: DataFrame, day: float = NIGHT) -> DataFrame:
    """gaps() with is_day (a gap under `day`) and run, the number of the run of gaps of one kind that the row's gap is in."""
    w = Window.partitionBy("obj").orderBy("t", "line_no")
    rows = gaps(obs).withColumn("is_day", F.col("gap") < day)
    turn = F.when(F.col("is_day") != F.lag("is_day").over(w), 1).otherwise(0)
    return rows.withColumn("turn", turn).withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("turn")


def runs(obs: DataFrame, day: float = NIGHT) -> DataFrame:
    """Runs of day gaps and of longer gaps with their sums; the last run of an object and empty runs are left out."""
    per = marked(obs, day).filter("gap is not null").groupBy("obj", "run").agg(F.first("is_day").alias("is_day"), F.sum("gap").alias("total"))
    return per.withColumn("last", F.max("run").over(Window.partitionBy("obj"))).filter("run < last and total > 0").select("obj", "run", "is_day", "total")


#: What magnitudes() and majority_station() give, under the names that reduced() has.
PHOTOMETRY = ("v_min", "v_second_min", "v_max", "v_second_max", "v_avg", "majority_station")


def _photometry_of_segment() -> list[Column]:
    """Two least and two greatest v_mag of a segment, their sum and number, and rows per station."""
    mags, stations = F.sort_array(F.collect_list("v_mag")), F.collect_list(F.when(F.trim("station") != "", F.trim("station")))
    return [F.slice(mags, 1, 2).alias("low"), F.slice(F.reverse(mags), 1, 2).alias("high"), F.sum("v_mag").alias("v_sum"), F.count("v_mag").alias("v_n"), stations.alias("stations")]


def _photometry_of_object() -> list[Column]:
    every = lambda name: F.flatten(F.collect_list(name))
    return [F.sort_array(every("low")).alias("low"), F.sort_array(every("high"), asc=False).alias("high"), (F.sum("v_sum") / F.nullif(F.sum("v_n"), F.lit(0))).alias("v_avg"), every("stations").alias("stations")]


def _photometry() -> list[Column]:
    c, first = F.col, lambda name, k: F.get(name, F.lit(k))
    rows = F.aggregate("stations", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("station")), lambda best, r: F.when((r["n"] > best["n"]) | ((r["n"] == best["n"]) & (r["station"] < best["station"])), r).otherwise(best))
    return [first("low", 0).alias("v_min"), first("low", 1).alias("v_second_min"), first("high", 0).alias("v_max"), first("high", 1).alias("v_second_max"), c("v_avg"), rows["station"].alias("majority_station")]


def _counted(stations: Column | str, n: Callable[[Column], Column], name: Callable[[Column], Column]) -> Column:
    """(n, station) of each station once, from an array whose items stand for n rows of a station."""
    names = F.array_distinct(F.transform(stations, name))
    return F.transform(names, lambda x: F.struct(F.aggregate(F.filter(stations, lambda r: name(r) == x), F.lit(0).cast("bigint"), lambda s, r: s + n(r)).alias("n"), x.alias("station")))


def stats(obs: DataFrame, photometry: bool = False) -> DataFrame:
    """Oppositions, nights, arcs and gaps of each object; a missing arc or gap is 0. One exchange, by object.

    With photometry (v_mag and station needed) also PHOTOMETRY, from the same grouping.

    Rows are summed up by (obj, segment, run) first, so that a night count sees one segment's times at most; the parts of a
    segment and of a run are then put together per object.
    """
    zero, c = lambda x: F.coalesce(x, F.lit(0.0)), F.col
    parts = marked(obs).groupBy("obj", "segment").agg(
        F.sort_array(F.collect_list("t")).alias("ts"), F.min("t").alias("first"), F.max("t").alias("last"), F.max("gap").alias("gap"),
        F.max("run").alias("last_run"), F.collect_list(F.when(c("gap").isNotNull(), F.struct("run", "is_day", "gap"))).alias("gaps"),
        *(_photometry_of_segment() if photometry else []),
    )
    more = []
    if photometry:
        parts = parts.withColumn("stations", _counted("stations", lambda r: F.lit(1).cast("bigint"), lambda r: r))
        more = ["low", "high", "v_sum", "v_n", "stations"]
    # a segment begins at its opposition gap, the greatest it has; runs of a segment are summed before segments meet
    sums = F.transform(F.array_distinct(F.transform("gaps", lambda g: g["run"])), lambda r: F.struct(r.alias("run"), F.aggregate(F.filter("gaps", lambda g: g["run"] == r), F.struct(F.lit(False).alias("is_day"), F.lit(0.0).alias("total")), lambda s, g: F.struct(g["is_day"].alias("is_day"), (s["total"] + g["gap"]).alias("total"))).alias("s")))
    seg = parts.select("obj", "segment", "first", "last", "last_run", (c("last") - c("first")).alias("arc"), nights(c("ts")).alias("nights"), F.when(c("gap") >= OPPOSITION_GAP, c("gap")).alias("gap"), sums.alias("runs"), *more)
    whole = seg.groupBy("obj").agg(
        (F.max("last") - F.min("first")).alias("total_arc"), zero(F.max("gap")).alias("longest_opp_gap"), zero(F.min("gap")).alias("shortest_opp_gap"), F.max("segment").alias("opposition_count"), F.sum("nights").alias("nights_total"),
        F.sort_array(F.collect_list("nights"), asc=False).alias("tops"), zero(F.max(F.when(c("arc") > 0, c("arc")))).alias("longest_opp_arc"), zero(F.min(F.when(c("arc") > 0, c("arc")))).alias("shortest_opp_arc"),
        F.max("last_run").alias("end"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        *(_photometry_of_object() if photometry else []),
    )
    if photometry:
        whole = whole.withColumn("stations", _counted("stations", lambda r: r["n"], lambda r: r["station"]))
    # only a run of gaps can go on over segments: parts of one run are neighbours in order of the run
    start = F.struct(F.lit(-1).cast("bigint").alias("run"), F.lit(0.0).alias("sum"), F.lit(False).alias("day"), F.lit(0.0).alias("d"), F.lit(0.0).alias("g1"), F.lit(0.0).alias("g2"), F.lit(None).cast("double").alias("g0"))

    def close(s):
        day, gap = s["day"] & (s["sum"] > 0), ~s["day"] & (s["sum"] > 0)
        return F.struct(s["run"].alias("run"), s["sum"].alias("sum"), s["day"].alias("day"), F.when(day, F.greatest(s["d"], s["sum"])).otherwise(s["d"]).alias("d"), F.when(gap, F.greatest(s["g1"], s["sum"])).otherwise(s["g1"]).alias("g1"),
                        F.when(gap, F.greatest(s["g2"], F.least(s["g1"], s["sum"]))).otherwise(s["g2"]).alias("g2"), F.when(gap, F.least(s["g0"], s["sum"])).otherwise(s["g0"]).alias("g0"))

    def step(s, r):
        done = close(s)
        same = s["run"] == r["run"]
        pick = lambda a, b: F.when(same, a).otherwise(b)
        return F.struct(r["run"].alias("run"), pick(s["sum"] + r["s"]["total"], r["s"]["total"]).alias("sum"), r["s"]["is_day"].alias("day"), *[pick(s[k], done[k]).alias(k) for k in ("d", "g1", "g2", "g0")])

    # the run that is open at the end is never closed, so the last run of an object counts for nothing
    out = whole.withColumn("f", F.aggregate("runs", start, step))
    return out.select(
        "obj", "total_arc", "longest_opp_gap", "shortest_opp_gap", "opposition_count", "nights_total", F.get("tops", F.lit(0)).alias("opp_with_most_nights"), F.coalesce(F.get("tops", F.lit(1)), F.lit(0)).alias("opp_with_second_most_nights"),
        "longest_opp_arc", "shortest_opp_arc", c("f.d").alias("longest_day_arc"), c("f.g1").alias("longest_gap_arc"), c("f.g2").alias("second_longest_gap_arc"), zero(c("f.g0")).alias("shortest_gap_arc"), (c("nights_total") - F.get("tops", F.lit(0))).alias("other_opps"),
        *(_photometry() if photometry else []),
    )


def magnitudes(obs: DataFrame, value: str = "v_mag") -> DataFrame:
    """First and second least and greatest magnitude and their mean; null where there are too few. Equal ones count each."""
    w = lambda order: F.row_number().over(Window.partitionBy("obj").orderBy(order))
    at = lambda n, k: F.max(F.when(F.col(n) == k, F.col(value)))
    rows = obs.withColumn("_up", w(F.col(value).asc_nulls_last())).withColumn("_down", w(F.col(value).desc_nulls_last()))
    return rows.groupBy("obj").agg(at("_up", 1).alias("v_min"), at("_up", 2).alias("v_second_min"), at("_down", 1).alias("v_max"), at("_down", 2).alias("v_second_max"), F.avg(value).alias("v_avg"))


def majority_station(obs: DataFrame) -> DataFrame:
    """The most frequent station that isn't null or blank; of equals the least code."""
    n = obs.filter("trim(station) <> ''").groupBy("obj", F.trim("station").alias("station")).agg(F.count("*").alias("n"))
    return n.groupBy("obj").agg(F.min_by("station", F.struct(-F.col("n"), "station")).alias("station"))


def correct_bands(obs: DataFrame, shifts: dict[str, float] | None = None) -> DataFrame:
    """Adds v_mag: mag and the shift of its band, 0 for an unknown one."""
    pairs = F.create_map(*[F.lit(x) for kv in (shifts or BANDS).items() for x in kv])
    return obs.withColumn("v_mag", F.col("mag") + F.coalesce(F.try_element_at(pairs, F.col("band")), F.lit(0.0)))


def reduced(obs: DataFrame, dealt: bool = False) -> DataFrame:
    """All statistics of an object: arcs and nights, magnitudes in V and the majority station, from (line_no, obj, t, mag, band, station).

    One exchange of the rows, by object; none if they are `dealt` by object already, as lines() gives them."""
    return stats(correct_bands(dedupe(obs, dealt)), photometry=True)


#: First places and lengths of the fields of an 80-column line.
LINE = {"obj": (6, 7), "date": (16, 10), "part": (26, 7), "mag": (66, 5), "band": (71, 1), "station": (78, 3)}


def lines(text: DataFrame, value: str = "value") -> DataFrame:
    """line_no, obj, t (days from 1970-01-01), mag, band, station of 80-column lines (line_no, value).

    Of lines alike in object and time text the first stays, before dates are read; a line without a date or fraction of a
    day is then left out, one under 71 characters or with a bad magnitude has none. Rows come dealt by object.
    """
    part = lambda name: F.substring(value, *LINE[name])
    rows = text.select("line_no", *[part(k).alias(k) for k in LINE], F.length(value).alias("n")).repartition("obj")
    at = F.row_number().over(Window.partitionBy("obj", "date", "part").orderBy("line_no"))
    rows = rows.withColumn("_n", at).filter("_n = 1")
    day = F.when(F.col("date").rlike("^[0-9]{4} [0-9 ][0-9] [0-9 ][0-9]$"), F.try_to_date(F.concat_ws("-", F.substring("date", 1, 4), *[F.replace(F.substring("date", k, 2), F.lit(" "), F.lit("0")) for k in (6, 9)]), "yyyy-MM-dd"))
    rows = rows.select("line_no", "obj", (F.datediff(day, F.lit("1970-01-01").cast("date")) + F.trim("part").try_cast("double")).alias("t"), F.when(F.col("n") >= 71, F.trim("mag").try_cast("double")).alias("mag"), "band", F.trim("station").alias("station"))
    return rows.filter("t is not null")


def aliases(text: DataFrame, skip: int = 0, value: str = "value") -> DataFrame:
    """(alias, primary, line_no) of an alias file: chunks of 7 characters from place `skip` on, the first of a line is the primary."""
    rest = F.substring(value, skip + 1, 100_000)
    n = F.ceil(F.length(rest) / 7).cast("int")
    rows = text.withColumn("rest", rest).filter(F.length("rest") > 0)
    chunks = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substr("rest", k * 7 + 1, F.lit(7)))
    return rows.select(F.explode(chunks).alias("alias"), F.substring("rest", 1, 7).alias("primary"), "line_no")


def renamed(obs: DataFrame, names: list[DataFrame]) -> DataFrame:
    """obs with obj replaced by its primary; of an alias named twice the later line, and the later file, holds."""
    every = None
    for k, df in enumerate(names):
        df = df.withColumn("_file", F.lit(k))
        every = df if every is None else every.unionByName(df)
    last = every.groupBy("alias").agg(F.max_by("primary", F.struct("_file", "line_no")).alias("primary"))
    return obs.join(last, F.col("obj") == F.col("alias"), "left").withColumn("obj", F.coalesce("primary", "obj")).drop("alias", "primary")


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def unpacked(packed: Column) -> Column:
    """Readable designation of a packed provisional one (K07Tf8A: 2007 TA418; PLS2040: 2040 P-L), or of a packed number."""
    code = lambda c: F.instr(F.lit(_BASE62), c) - 1
    c = lambda k: F.substring(packed, k, 1)
    cycle = code(c(5)) * 10 + code(c(6))
    year = F.concat(code(c(1)).cast("string"), F.substring(packed, 2, 2))
    provisional = F.concat(year, F.lit(" "), c(4), c(7), F.when(cycle > 0, cycle.cast("string")).otherwise(""))
    survey = F.concat(F.substring(packed, 4, 4), F.lit(" "), c(1), F.lit("-"), c(2))
    number = (code(F.substring(packed, 1, 1)) * 10_000 + F.substring(packed, 2, 4).try_cast("int")).cast("string")
    return F.when(packed.rlike("^(PL|T1|T2|T3)S[0-9]{4}$"), survey).when(packed.rlike("^[I-L][0-9]{2}[A-Z][0-9A-Za-z][0-9][A-Z]$"), provisional).when(F.trim(packed).rlike("^[0-9A-Za-z][0-9]{4}$"), number)


def packed_day(packed: Column) -> Column:
    """Julian day of a packed date such as K194S or K194S5 (a fraction may follow), in either case; bad ones are null."""
    packed = F.upper(packed)
    code = lambda k: F.instr(F.lit(_BASE62), F.substring(packed, k, 1)) - 1
    fine = packed.rlike("^[I-K][0-9]{2}[1-9A-C][1-9A-V][0-9]*$")
    text = F.concat_ws("-", (code(1) * 100 + F.substring(packed, 2, 2).try_cast("int")).cast("string"), F.lpad(code(4).cast("string"), 2, "0"), F.lpad(code(5).cast("string"), 2, "0"))
    day = F.try_to_date(text, "yyyy-MM-dd")
    part = F.when(F.length(packed) > 5, F.concat(F.lit("0."), F.substring(packed, 6, 20)).try_cast("double")).otherwise(0.0)
    return F.when(fine, F.datediff(day, F.lit("1970-01-01").cast("date")) + 2440587.5 + part)
