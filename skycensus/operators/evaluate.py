"""Ranking measures, histograms, standardised columns, nearest neighbours, cross-validation metrics, counterfactual solves."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skycensus.operators.lineage import spread

c = F.col


def ranked(rows: DataFrame, group: str, score: str, n: str, parts: int = 64) -> DataFrame:
    """rows (one for each group and score, standing for n) with `before`, the sum of n over the group's smaller scores.

    Scores are cut into ranges, alike for all groups; a range's rows are summed on their own and moved on by the ranges
    before it, so no task holds a whole group.
    """
    marks = rows.agg(F.percentile_approx(score, [k / parts for k in range(1, parts)], 1000).alias("_cuts"))  # one row
    per = rows.crossJoin(F.broadcast(marks)).withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda x: x < c(score))), F.lit(0))).drop("_cuts")
    sums = per.groupBy(group, "_range").agg(F.sum(n).alias("_n"))  # at most `parts` rows a group
    up_to = lambda *by: Window.partitionBy(*by).orderBy(score if len(by) > 1 else "_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, "_range", F.coalesce(F.sum("_n").over(up_to(group)), F.lit(0)).alias("_start"))
    per = per.withColumn("_inside", F.coalesce(F.sum(n).over(up_to(group, "_range")), F.lit(0))).join(starts, [group, "_range"])
    return per.withColumn("before", c("_start") + c("_inside")).drop("_range", "_start", "_inside")


def auc(df: DataFrame, group: str, score: Column, positive: Column, higher: bool = True) -> DataFrame:
    """Area under the curve per group from tie-averaged ranks; null scores are left out, a single class gives null."""
    rows = df.select(c(group), (score if higher else -score).alias("s"), positive.cast("long").alias("p")).filter("s is not null")
    per = ranked(rows.groupBy(group, "s").agg(F.count("*").alias("m"), F.sum("p").alias("p")), group, "s", "m")
    sums = per.groupBy(group).agg(F.sum(c("p") * (c("before") + (c("m") + 1) / 2)).alias("r"), F.sum("p").alias("pos"), F.sum(c("m") - c("p")).alias("neg"))
    value = (F.coalesce("r", F.lit(0.0)) - c("pos") * (c("pos") + 1) / 2) / (c("pos") * c("neg"))
    return sums.select(group, "pos", "neg", F.when((c("pos") > 0) & (c("neg") > 0), value).alias("auc"))


def metrics(df: DataFrame, names: dict[str, bool]) -> DataFrame:
    """(metric, s, desig, label) for each metric column of df and each row that has it; turned so that higher is more anomalous."""
    each = F.array(*[F.struct(F.lit(n).alias("metric"), (c(n) if up else -c(n)).cast("double").alias("s")) for n, up in names.items()])
    return df.select("desig", "label", F.explode(each).alias("m")).select("m.*", "desig", "label").filter("s is not null")


def separability(rows: DataFrame) -> DataFrame:
    """Per metric of metrics(): how far down the worst positive lies and what is above it. Ties go by desig."""
    rows = rows.withColumn("_down", -c("s"))
    above = ranked(rows.groupBy("metric", "_down").agg(F.count("*").alias("m")), "metric", "_down", "m").select("metric", "_down", "before")
    among = F.row_number().over(Window.partitionBy("metric", "_down").orderBy("desig"))  # rows of one score only
    ordered = rows.join(above, ["metric", "_down"]).withColumn("r", c("before") + among).drop("before", "_down")
    worst = ordered.groupBy("metric").agg(F.sum(c("label").cast("long")).alias("n_positives"), F.max(F.when(c("label"), c("r"))).alias("rank_of_worst"))
    rows = ordered.join(worst, "metric").filter("n_positives > 0")
    top = c("r") <= c("n_positives")
    return rows.groupBy("metric", "n_positives", "rank_of_worst").agg((F.count(F.when(top & c("label"), 1)) / F.max("n_positives")).alias("precision_at_n_pos")).select(
        "metric", "n_positives", "rank_of_worst", (c("rank_of_worst") - c("n_positives")).alias("interlopers"), (c("n_positives") / c("rank_of_worst")).alias("precision_at_full_recall"), "precision_at_n_pos")


def compare(df: DataFrame, names: dict[str, bool]) -> DataFrame:
    """auc and separability of each metric."""
    rows = metrics(df, names)
    return auc(rows, "metric", c("s"), c("label")).select("metric", "auc").join(separability(rows), "metric", "left")


def marginal(df: DataFrame, new: str, old: str, threshold: float, n: int = 50) -> DataFrame:
    """Of the n highest by the new metric those that the old metric's threshold leaves out."""
    return df.orderBy(c(new).desc_nulls_last(), "desig").limit(n).filter(c(old) < threshold)


def min_gap(df: DataFrame, level: str, ext: float = 0.1, low: float = 1.15, high: float = 20.0) -> DataFrame:
    """Per level: counts, auc and the gap between the least active and the greatest inert deficit, over well linked objects."""
    rows = df.filter((c("ext") < ext) & c("a").between(low, high) & c("deficit").isNotNull() & ((c("arc_length") > 7) | c("arc_length").isNull()))
    ends = rows.groupBy(level).agg(F.min(F.when(c("label"), c("deficit"))).alias("min_active"), F.max(F.when(~c("label"), c("deficit"))).alias("max_inert"))
    return auc(rows, level, c("deficit"), c("label")).join(ends, level).select(level, c("pos").alias("n_active"), c("neg").alias("n_inert"), "auc", F.when(c("auc").isNotNull(), c("min_active") - c("max_inert")).alias("min_gap"))


def best_level(levels: DataFrame, level: str) -> DataFrame:
    """The level of the best auc; among several of 1.0 that of the greatest gap, then the least level."""
    whole = F.abs(c("auc") - 1) <= 1e-5
    many = levels.agg(F.count(F.when(whole, 1)).alias("perfect"))
    key = F.struct(F.when(c("perfect") > 1, F.when(whole, c("min_gap"))).otherwise(c("auc")).alias("k"), (-c(level)).alias("l"))
    return levels.crossJoin(F.broadcast(many)).filter("auc is not null").filter((c("perfect") <= 1) | whole).agg(F.max_by(F.struct(level, "auc", "min_gap", (c("perfect") > 1).alias("tiebreak")), key).alias("b")).select("b.*")


def histogram(df: DataFrame, value: Column, edges: list[float], by: list[str] | None = None) -> DataFrame:
    """Rows per bin of fixed edges; the last bin holds its upper edge, as the others hold their lower one."""
    marks = F.array(*map(F.lit, edges))
    at = F.size(F.filter(marks, lambda x: x <= value)) - 1
    at = F.when(value == edges[-1], len(edges) - 2).otherwise(at)
    rows = df.filter(value.between(edges[0], edges[-1])).withColumn("bin", at.cast("long"))
    return rows.groupBy(*(by or []), "bin").agg(F.count("*").alias("n"))


def poisson_expected(df: DataFrame, count: str, mean: float, most: int) -> DataFrame:
    """count 0 .. most, observed rows of it, and how many a Poisson law of the mean expects of as many rows."""
    spark = df.sparkSession
    seen = df.groupBy(c(count).cast("long").alias("k")).agg(F.count("*").alias("observed"))
    n = df.agg(F.count("*").alias("rows"))
    ks = spark.range(most + 1).withColumnRenamed("id", "k")
    pmf = F.exp(F.lit(-mean)) * F.aggregate(F.sequence(F.lit(1), F.greatest(c("k"), F.lit(1))), F.lit(1.0), lambda s, j: F.when(c("k") == 0, s).otherwise(s * mean / j))
    return ks.crossJoin(F.broadcast(n)).join(seen, "k", "left").select("k", F.coalesce("observed", F.lit(0)).alias("observed"), (pmf * c("rows")).alias("expected"))


def latest_by_bin(rows: DataFrame, value: str, name: str, bins: int = 29) -> DataFrame:
    """bin 1 .. bins with the greatest name among rows whose value is in [bin, bin + 1); null for an empty bin."""
    top = rows.filter(c(value).isNotNull()).groupBy(F.floor(value).alias("bin")).agg(F.max(name).alias("latest"))
    return rows.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin").join(F.broadcast(top), "bin", "left")


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """(x, y, r) of each pair of columns, from one aggregate; rows where either is null don't count for it."""
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), c(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("p")).select("p.*")


def standardised(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; null stays, a constant column is 0."""
    one = df.agg(*[F.struct(F.avg(n).alias("m"), F.stddev_pop(n).alias("s")).alias(f"_{n}") for n in names])
    z = lambda n: F.when(c(f"_{n}.s") > 0, (c(n) - c(f"_{n}.m")) / c(f"_{n}.s")).when(c(n).isNotNull(), 0.0)
    return df.crossJoin(F.broadcast(one)).withColumns({n: z(n) for n in names}).drop(*[f"_{n}" for n in names])


def nearest(df: DataFrame, names: list[str], desig: int, k: int = 25) -> DataFrame:
    """The k objects nearest to one by distance on standardised columns, itself first; rows with a null are left out."""
    rows = standardised(df, names).na.drop("any", subset=names)
    one = rows.filter(c("desig") == desig).select(*[c(n).alias(f"_{n}") for n in names])
    far = F.sqrt(sum((F.pow(c(n) - c(f"_{n}"), F.lit(2)) for n in names[1:]), F.pow(c(names[0]) - c(f"_{names[0]}"), F.lit(2))))
    return rows.crossJoin(F.broadcast(one)).withColumn("distance", far).orderBy("distance", "desig").limit(k).select("desig", "distance")


def fold_metrics(df: DataFrame, fold: str, y: str, predictions: list[str], mask: Column | None = None) -> DataFrame:
    """rmse, Poisson deviance and r2 per fold of the mean of the predictions, not under 1e-3; mask scores a part, folds of under 2 rows of it are left out."""
    m = F.greatest(sum((c(p) for p in predictions[1:]), c(predictions[0])) / len(predictions), F.lit(1e-3))
    rows = (df if mask is None else df.filter(mask)).select(fold, c(y).cast("double").alias("y"), m.alias("m"))
    dev = 2 * F.avg(F.when(c("y") > 0, c("y") * F.ln(c("y") / c("m"))).otherwise(0.0) - c("y") + c("m"))
    sse = F.sum(F.pow(c("y") - c("m"), F.lit(2)))
    return rows.groupBy(fold).agg(F.count("*").alias("n"), F.sqrt(sse / F.count("*")).alias("rmse"), dev.alias("deviance"), (1 - sse / F.nullif(F.var_pop("y") * F.count("*"), F.lit(0.0))).alias("r2")).filter("n >= 2")


def accepted(trials: DataFrame, rmse: float, deviance: float, r2: float) -> DataFrame:
    """Trials better than the incumbent on two of three metrics at least."""
    wins = (c("rmse") < rmse).cast("int") + (c("deviance") < deviance).cast("int") + (c("r2") > r2).cast("int")
    return trials.withColumn("accepted", wins >= 2)


def solve(df: DataFrame, score_fn: Callable[[DataFrame], DataFrame], target: str, most: float = 15.0, rounds: int = 12, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The least d in 0 .. most with score(h + d) <= target, by bisection of all rows at once.

    score_fn adds a column `score` to a frame whose h has been shifted; a score that doesn't rise with h is assumed. Adds
    delta, censored (not reached at `most`: delta is most), already_neutral (0) and invalid (a null score or target: null).
    cut, where given, writes a round's rows and reads them again.
    """
    keep = df.columns

    def at(rows: DataFrame, shift: Column, name: str) -> DataFrame:
        rest = [x for x in rows.columns if x not in keep]
        shifted = rows.withColumn("_h", c("h")).withColumn("h", c("h") + shift)
        return score_fn(shifted).withColumn("h", c("_h")).select(*keep, *rest, c("score").alias(name))

    rows = at(at(df, F.lit(0.0), "score_at_h"), F.lit(most), "_end")
    invalid = F.isnull("score_at_h") | F.isnull(target)
    neutral = ~F.coalesce(c("score_at_h") > c(target), F.lit(False))
    rows = rows.withColumns({"invalid": invalid, "already_neutral": neutral & ~invalid, "censored": F.coalesce(c("_end") > c(target), F.lit(False)) & ~neutral, "_lo": F.lit(0.0), "_hi": F.lit(most)})
    for k in range(rounds):
        rows = at(rows, (c("_lo") + c("_hi")) / 2, "_mid")
        high, middle = F.coalesce(c("_mid") > c(target), F.lit(False)), (c("_lo") + c("_hi")) / 2
        rows = rows.withColumns({"_lo": F.when(high, middle).otherwise(c("_lo")), "_hi": F.when(high, c("_hi")).otherwise(middle)}).drop("_mid")
        if cut and k % 4 == 3:
            rows = cut(rows)
    delta = F.when(c("invalid"), None).when(c("already_neutral"), 0.0).when(c("censored"), most).otherwise(c("_hi"))
    return rows.withColumn("delta", delta).drop("_lo", "_hi", "_end")


def neutrality(solved: DataFrame, sigma: float = 0.45) -> DataFrame:
    """h_neutral and z_h of a solve."""
    return solved.withColumns({"h_neutral": c("h") + c("delta"), "z_h": c("delta") / sigma})


def solve_by(df: DataFrame, score: Callable[[Column], Column], target: str, most: float = 15.0, rounds: int = 12) -> DataFrame:
    """As solve(), of a score that is an expression of h: all rounds in one expression, so that the plan doesn't grow with them."""
    over = lambda h: F.coalesce(score(h) > c(target), F.lit(False))
    middle = lambda s: (s["lo"] + s["hi"]) / 2
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def halved(s, _):
        high = over(c("h") + middle(s))
        return pair(F.when(high, middle(s)).otherwise(s["lo"]), F.when(high, s["hi"]).otherwise(middle(s)))

    rows = df.withColumn("score_at_h", score(c("h")))
    invalid, high = F.isnull("score_at_h") | F.isnull(target), F.coalesce(c("score_at_h") > c(target), F.lit(False))
    rows = rows.withColumns({"invalid": invalid, "already_neutral": ~high & ~invalid, "censored": high & over(c("h") + most)})
    least = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), pair(F.lit(0.0), F.lit(most)), halved, lambda s: s["hi"])
    return rows.withColumn("delta", F.when(c("invalid"), None).when(c("already_neutral"), 0.0).when(c("censored"), most).otherwise(least))


def neutrality_table(df: DataFrame, solves: dict[str, Callable[[DataFrame], DataFrame]], sigma: Column | float = 0.45) -> DataFrame:
    """df with, for each name in solves, full_<name>, dh_<name>, censored_<name> and invalid_<name>; h_neutral and z_h by the primary one.

    A solve takes rows and gives them with what solve() or solve_by() adds; its score works out all that hangs on h anew, the
    scores that it rests on included. The primary shift is that of 'q' where it is asked for, else that of the first name. A null h,
    score or target gives null shifts and invalid. `sigma`: deviation of h, one or by row; 0 gives no z_h.
    """
    rows = df
    for name, f in solves.items():
        rows = f(rows).select(*rows.columns, c("score_at_h").alias(f"full_{name}"), c("delta").alias(f"dh_{name}"), c("censored").alias(f"censored_{name}"), c("invalid").alias(f"invalid_{name}"))
    primary = c("dh_q" if "q" in solves else f"dh_{next(iter(solves))}")
    return rows.withColumns({"h_neutral": c("h") + primary, "z_h": primary / F.nullif(F.lit(sigma), F.lit(0.0))})


def solve_many(df: DataFrame, score_fn: Callable[[DataFrame], DataFrame], targets: dict[str, tuple[str, Column]], key: str, cut: Callable[[DataFrame], DataFrame] | None = None, **limits) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Solves for neutrality_table(), one for each name in targets (its score's column, its target), found in the same passes.

    score_fn adds all score columns, under names that df doesn't have, to a frame whose h has been shifted. A row stands once for each target and
    all are bisected together, so the passes are those of one solve however many targets there are."""
    ends = F.array(*[F.struct(F.lit(name).alias("name"), target.cast("double").alias("target")) for name, (_, target) in targets.items()])
    long = df.withColumn("_end", F.explode(ends)).withColumns({"_name": c("_end.name"), "_target": c("_end.target")}).drop("_end")

    def own(rows: DataFrame) -> DataFrame:
        pick = F.coalesce(*[F.when(c("_name") == name, c(score)) for name, (score, _) in targets.items()])
        return score_fn(rows).withColumn("score", F.nanvl(pick.cast("double"), F.lit(None).cast("double")))

    made = ["score_at_h", "invalid", "already_neutral", "censored", "delta"]
    solved = solve(long, own, "_target", cut=cut, **limits).select(key, "_name", *made)
    solved = cut(solved) if cut else solved
    return {name: lambda rows, name=name: rows.join(solved.filter(c("_name") == name).drop("_name"), key) for name in targets}


def neutral_candidates(final: DataFrame, score_fn: Callable[[DataFrame], DataFrame], prob: float = 0.998, ext: float = 0.5, most: int = 250) -> DataFrame:
    """place, desig and what h_grid() finds for the objects of high prob and low ext, the first `most` of them by priority.

    Priority: quantile_opps less num_opps less 15.5 ext, ties by desig. In the table those within tolerance come first, then the
    greatest brightening, then the highest priority.
    """
    priority = c("quantile_opps") - c("num_opps") - 15.5 * c("ext")
    some = final.filter((c("prob") >= prob) & (c("ext") <= ext) & c("num_opps").isNotNull() & c("h").isNotNull()).withColumn("priority", priority)
    some = some.orderBy(c("priority").desc_nulls_last(), "desig").limit(most)
    got = h_grid(some, score_fn, "num_opps").join(some.select("desig", "h", "num_opps", "ext", "prob", "priority"), "desig")
    order = Window.orderBy(F.desc("within"), F.desc("h_change"), F.desc("priority"), "desig")  # at most `most` rows
    return got.withColumn("place", F.row_number().over(order))


def archival(table: DataFrame, limits: DataFrame) -> DataFrame:
    """Margin of an archival limit (desig, h_limit; the faintest counts) over h_neutral, and whether it supports the shift."""
    best = limits.groupBy("desig").agg(F.max("h_limit").alias("h_limit"))
    rows = table.join(best, "desig", "left").withColumn("margin", c("h_limit") - c("h_neutral"))
    return rows.withColumn("supported", F.coalesce(c("margin") >= 0, F.lit(False)))


def h_grid(df: DataFrame, score_fn: Callable[[DataFrame], DataFrame], observed: str, least: float = 5.0, most: float = 30.0, step: float = 0.05, tolerance: float = 0.5) -> DataFrame:
    """Per object the grid h whose score is within tolerance of what was observed and nearest to its own h, else that of the least residual.

    An object without h takes the first within tolerance. The grid is scored twice: the first pass leaves the least distance and residual of an
    object, plain minima that need no sort; of the second only rows at these minima go on. A batch of them leaves the best row of each object."""
    n = round((most - least) / step)

    def scored(rows: DataFrame) -> DataFrame:
        grid = rows.withColumn("_own", c("h").cast("double")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("h", least + c("_k") * step)
        return score_fn(grid).withColumn("residual", F.abs(c("score") - c(observed))).filter("residual is not null")

    dealt, fine = spread(df, "desig"), c("residual") <= tolerance
    away = F.coalesce(F.abs(c("h") - c("_own")), F.lit(0.0))
    ends = scored(dealt).groupBy(c("desig").alias("_of")).agg(F.min(F.when(fine, away)).alias("_near"), F.min("residual").alias("_low"))
    rows = scored(dealt.join(ends, c("desig").eqNullSafe(c("_of"))))
    above = 1 + 1e-9  # what is best is decided below, by the whole order
    rows = rows.filter(F.when(c("_near").isNotNull(), fine & (away <= c("_near") * above)).otherwise(c("residual") <= c("_low") * above))
    key = F.struct((~fine).alias("a"), F.when(fine, F.abs(c("h") - c("_own"))).otherwise(c("residual")).alias("b"), c("_k").alias("k"))
    best = F.min_by(F.struct(c("h").alias("h_neutral"), (c("h") - c("_own")).alias("h_change"), "residual", fine.alias("within")), key)
    rows = rows.select("desig", "_own", "_k", "h", "residual")

    def run(batches):
        for batch in batches:
            number = lambda name, batch=batch: batch[name].to_numpy(zero_copy_only=False).astype(float)
            residual, k = number("residual"), number("_k")
            near = residual <= tolerance
            key = np.where(near, np.abs(number("h") - number("_own")), residual)
            obj = batch["desig"].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((k, key, ~near, obj))
            first = np.flatnonzero(np.diff(obj[order], prepend=-1))
            yield batch.take(pa.array(order[first]))

    rows = rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))
    return rows.groupBy("desig").agg(best.alias("b")).select("desig", "b.*")


def history(trials: DataFrame, by: str) -> DataFrame:
    """Tries, acceptances and the best deviance for each move or segment."""
    return trials.groupBy(by).agg(F.count("*").alias("tries"), F.sum(c("accepted").cast("long")).alias("accepts"), F.min("deviance").alias("best"))


def subset_trace(sizes: DataFrame) -> DataFrame:
    """sizes (size, features, scores) with the features gained and lost from the size before, mean and population deviation of the scores."""
    prev = F.lag("features").over(Window.orderBy("size"))  # one row per number of features
    rows = sizes.withColumn("_prev", F.coalesce(prev, F.expr("cast(array() as array<string>)")))
    mean = F.aggregate("scores", F.lit(0.0), lambda s, x: s + x) / F.size("scores")
    rows = rows.withColumn("mean", mean)
    spread = F.sqrt(F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.pow(x - c("mean"), F.lit(2))) / F.size("scores"))
    return rows.select("size", F.array_sort(F.array_except("features", "_prev")).alias("gained"), F.array_sort(F.array_except("_prev", "features")).alias("lost"), "mean", spread.alias("spread"))
