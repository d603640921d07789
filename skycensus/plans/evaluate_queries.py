"""Queries of the measures, histograms, metrics and counterfactual solves, and DuckDB SQL written out by hand for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycensus.functions import orbit
from skycensus.operators import catalog, evaluate
from skycensus.plans import fixtures as fx
from skycensus.plans.base import FINAL, query, r6, rounded

c = F.col


@query(f"WITH {FINAL}, r AS (SELECT num_opps AS grp, known AS p, rank() OVER (PARTITION BY num_opps ORDER BY prob) + (count(*) OVER (PARTITION BY num_opps, prob) - 1) / 2.0 AS k FROM final WHERE prob IS NOT NULL), s AS (SELECT grp, sum(CASE WHEN p THEN k ELSE 0 END) AS r, count(*) FILTER (p) AS pos, count(*) FILTER (NOT p) AS neg FROM r GROUP BY grp) SELECT grp, pos::BIGINT AS pos, neg::BIGINT AS neg, CASE WHEN pos > 0 AND neg > 0 THEN round((r - pos*(pos+1)/2.0)/(pos*neg), 6) END AS auc FROM s")
def roc_auc(spark, sf_dir):
    return rounded(evaluate.auc(fx.final(spark, sf_dir).withColumn("grp", c("num_opps")), "grp", c("prob"), c("known")))


METRICS = {"prob": True, "ext": False, "quantile_opps": True, "v_avg": False}
LONG = "m AS (SELECT desig, known AS label, unnest(['prob', 'ext', 'quantile_opps', 'v_avg']) AS metric, unnest([prob, -ext, quantile_opps, -v_avg]) AS s FROM final), l AS (SELECT * FROM m WHERE s IS NOT NULL)"


@query(f"""WITH {FINAL}, {LONG}, a0 AS (SELECT metric, label, rank() OVER (PARTITION BY metric ORDER BY s) + (count(*) OVER (PARTITION BY metric, s) - 1) / 2.0 AS k FROM l), a AS (SELECT metric, (sum(k) FILTER (label) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2.0) / (count(*) FILTER (label) * count(*) FILTER (NOT label)) AS auc FROM a0 GROUP BY metric),
 o AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY s DESC, desig) AS r, count(*) FILTER (label) OVER (PARTITION BY metric) AS np FROM l), w AS (SELECT metric, max(np)::BIGINT AS n_positives, max(r) FILTER (label) AS worst, count(*) FILTER (label AND r <= np) AS top FROM o GROUP BY metric)
 SELECT metric, round(auc, 6) AS auc, n_positives, worst::BIGINT AS rank_of_worst, (worst - n_positives)::BIGINT AS interlopers, round(n_positives / worst, 6) AS precision_at_full_recall, round(top / n_positives, 6) AS precision_at_n_pos FROM a JOIN w USING (metric)""")  # fmt: skip
def compare_rankings(spark, sf_dir):
    return rounded(evaluate.compare(fx.final(spark, sf_dir).withColumn("label", c("known")), METRICS))


@query(f"WITH {FINAL}, t AS (SELECT desig, prob, quantile_opps - num_opps AS deficit FROM final ORDER BY prob DESC NULLS LAST, desig LIMIT 50) SELECT desig, round(prob, 9) AS prob, round(deficit, 6) AS deficit FROM t WHERE deficit < 3")
def marginal_discoveries(spark, sf_dir):
    rows = fx.final(spark, sf_dir).withColumn("deficit", c("quantile_opps") - c("num_opps"))
    return evaluate.marginal(rows, "prob", "deficit", 3.0).select("desig", F.round("prob", 9).alias("prob"), F.round("deficit", 6).alias("deficit"))


LEVELS = f"""{FINAL}, lv AS (SELECT *, unnest(range(1, 9)) AS level FROM final), g0 AS (SELECT level, known AS label, quantile_opps + CASE WHEN known THEN level * 3 ELSE 0 END - num_opps AS deficit FROM lv WHERE ext < 0.1 AND a BETWEEN 1.15 AND 20 AND (arc_length > 7 OR arc_length IS NULL)),
 g1 AS (SELECT *, rank() OVER (PARTITION BY level ORDER BY deficit) + (count(*) OVER (PARTITION BY level, deficit) - 1) / 2.0 AS k FROM g0),
 g AS (SELECT level, count(*) FILTER (label)::BIGINT AS n_active, count(*) FILTER (NOT label)::BIGINT AS n_inert, round((sum(k) FILTER (label) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2.0) / (count(*) FILTER (label) * count(*) FILTER (NOT label)), 6) AS auc, round(min(deficit) FILTER (label) - max(deficit) FILTER (NOT label), 6) AS min_gap FROM g1 GROUP BY level)"""


def _levels(spark, sf_dir):
    rows = fx.final(spark, sf_dir).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(8)).cast("array<bigint>"))).withColumn("label", c("known"))
    rows = rows.withColumn("deficit", c("quantile_opps") + F.when(c("known"), c("level") * 3).otherwise(0) - c("num_opps"))
    return rounded(evaluate.min_gap(rows, "level"))


@query(f"WITH {LEVELS} SELECT * FROM g")
def min_gap(spark, sf_dir):
    return _levels(spark, sf_dir)


@query(f"WITH {LEVELS}, p AS (SELECT count(*) FILTER (abs(auc - 1) <= 1e-5) AS perfect FROM g) SELECT level, auc, min_gap, perfect > 1 AS tiebreak FROM g, p WHERE perfect <= 1 OR abs(auc - 1) <= 1e-5 ORDER BY CASE WHEN perfect > 1 THEN min_gap ELSE auc END DESC, level LIMIT 1")
def level_selection(spark, sf_dir):
    return evaluate.best_level(_levels(spark, sf_dir), "level")


@query(f"WITH {FINAL}, v AS (SELECT known, ln(prob/(1-prob)) AS x FROM final WHERE arc_length > 7 AND num_obs > 6 AND prob > 0.987 AND prob < 1 AND a > 1.1 AND NOT a BETWEEN 5 AND 5.4 AND ext < 0.02 AND period < 20) SELECT known, least(floor((x - 4.0) / 0.5), 19)::BIGINT AS bin, count(*)::BIGINT AS n FROM v WHERE x BETWEEN 4.0 AND 14.0 GROUP BY ALL")
def logit_histogram(spark, sf_dir):
    rows = fx.final(spark, sf_dir).filter((c("arc_length") > 7) & (c("num_obs") > 6) & (c("prob") > 0.987) & (c("prob") < 1) & (c("a") > 1.1) & ~c("a").between(5, 5.4) & (c("ext") < 0.02) & (c("period") < 20))
    return evaluate.histogram(rows, F.ln(c("prob") / (1 - c("prob"))), [4.0 + k / 2 for k in range(21)], ["known"])


@query(f"WITH {FINAL}, s AS (SELECT num_opps - 1 AS k FROM final WHERE expected > 5.8 AND expected < 6.2 AND num_obs > 13), t AS (SELECT count(*) AS n FROM s) SELECT r.k::BIGINT AS k, (SELECT count(*) FROM s WHERE s.k = r.k)::BIGINT AS observed, round(exp(-5.0) * pow(5.0, r.k) / factorial(r.k::INT) * t.n, 6) AS expected FROM range(0, 17) r(k), t")
def poisson_against_observed(spark, sf_dir):
    rows = fx.final(spark, sf_dir).filter((c("expected") > 5.8) & (c("expected") < 6.2) & (c("num_obs") > 13)).withColumn("k", c("num_opps") - 1)
    return rounded(evaluate.poisson_expected(rows, "k", 5.0, 16))


@query(f"WITH {FINAL}, s AS (SELECT floor(expected)::BIGINT AS b, max(name) AS latest FROM final WHERE name < '2027 ' AND q BETWEEN 1.3 AND 4 AND (arc_length > 7 OR arc_length IS NULL) AND NOT contains(name, '-') AND NOT known AND num_opps > 1 GROUP BY ALL) SELECT r.b::BIGINT AS bin, latest FROM range(1, 30) r(b) LEFT JOIN s ON s.b = r.b")
def latest_by_bin(spark, sf_dir):
    rows = fx.final(spark, sf_dir).filter((c("name") < "2027 ") & c("q").between(1.3, 4) & ((c("arc_length") > 7) | c("arc_length").isNull()) & ~c("name").contains("-") & ~c("known") & (c("num_opps") > 1))
    return evaluate.latest_by_bin(rows, "expected", "name")


@query(f"WITH {FINAL} SELECT 'a' AS x, 'e' AS y, round(corr(a, e), 6) AS r FROM final UNION ALL SELECT 'a', 'h', round(corr(a, h), 6) FROM final UNION ALL SELECT 'a', 'expected', round(corr(a, expected), 6) FROM final UNION ALL SELECT 'e', 'h', round(corr(e, h), 6) FROM final UNION ALL SELECT 'e', 'expected', round(corr(e, expected), 6) FROM final UNION ALL SELECT 'h', 'expected', round(corr(h, expected), 6) FROM final")
def correlations(spark, sf_dir):
    return rounded(evaluate.correlations(fx.final(spark, sf_dir), ["a", "e", "h", "expected"]))


_Z = "({0} - (SELECT avg({0}) FROM final)) / (SELECT stddev_pop({0}) FROM final)"


@query(f"WITH {FINAL} SELECT desig, {r6(h=_Z.format('h'), e=_Z.format('e'), i=_Z.format('i'))} FROM final")
def standardise(spark, sf_dir):
    return rounded(evaluate.standardised(fx.final(spark, sf_dir), ["h", "e", "i"]).select("desig", "h", "e", "i"))


@query(f"WITH {FINAL}, z AS (SELECT desig, {_Z.format('h')} AS zh, {_Z.format('e')} AS ze, {_Z.format('i')} AS zi, {_Z.format('peri')} AS zp FROM final WHERE h IS NOT NULL) SELECT b.desig, round(sqrt(pow(b.zh-o.zh, 2) + pow(b.ze-o.ze, 2) + pow(b.zi-o.zi, 2) + pow(b.zp-o.zp, 2)), 6) AS distance FROM z b, z o WHERE o.desig = 20 ORDER BY sqrt(pow(b.zh-o.zh, 2) + pow(b.ze-o.ze, 2) + pow(b.zi-o.zi, 2) + pow(b.zp-o.zp, 2)), b.desig LIMIT 25")
def nearest_neighbours(spark, sf_dir):
    return rounded(evaluate.nearest(fx.final(spark, sf_dir), ["h", "e", "i", "peri"], 20))


_METRIC = "count(*)::BIGINT AS n, round(sqrt(avg(pow(y-m, 2))), 6) AS rmse, round(2*avg(CASE WHEN y > 0 THEN y*ln(y/m) ELSE 0 END - y + m), 6) AS deviance, round(1 - sum(pow(y-m, 2))/nullif(var_pop(y)*count(*), 0), 6) AS r2"
_BLEND = "v AS (SELECT desig % 8 AS fold, (num_opps - 1)::DOUBLE AS y, greatest((expected - 1 + quantile_opps) / 2, 0.001) AS m, q FROM final)"


@query(f"WITH {FINAL}, {_BLEND} SELECT fold, {_METRIC} FROM v GROUP BY fold")
def cv_metrics(spark, sf_dir):
    rows = fx.final(spark, sf_dir).select((c("desig") % 8).alias("fold"), (c("num_opps") - 1).alias("y"), (c("expected") - 1).alias("p1"), c("quantile_opps").alias("p2"), "q")
    return rounded(evaluate.fold_metrics(rows, "fold", "y", ["p1", "p2"]))


@query(f"WITH {FINAL}, {_BLEND} SELECT fold, {_METRIC} FROM v WHERE q < 0.3 GROUP BY fold HAVING count(*) >= 2")
def cv_metrics_of_part(spark, sf_dir):
    rows = fx.final(spark, sf_dir).select((c("desig") % 8).alias("fold"), (c("num_opps") - 1).alias("y"), (c("expected") - 1).alias("p1"), c("quantile_opps").alias("p2"), "q")
    return rounded(evaluate.fold_metrics(rows, "fold", "y", ["p1", "p2"], c("q") < 0.3))


@query(f"WITH {FINAL}, o AS (SELECT desig, expected + 1 AS expected FROM final WHERE desig % 3 = 0) SELECT desig, round(coalesce(o.expected, f.expected), 6) AS expected, round(f.quantile_opps, 6) AS quantile_opps FROM final f LEFT JOIN o USING (desig)")
def oof_overlay(spark, sf_dir):
    full = fx.final(spark, sf_dir).select("desig", "expected", "quantile_opps")
    oof = full.filter("desig % 3 = 0").withColumn("expected", c("expected") + 1)
    return rounded(catalog.overlaid(full, oof, "desig", ["expected"]))


@query(f"WITH {FINAL}, m AS (SELECT desig, unnest(range(8)) AS fold, expected FROM final), p AS (SELECT desig, CASE WHEN desig % 3 = 0 THEN max(CASE WHEN fold = desig % 8 THEN expected + fold * 0.1 END) ELSE avg(expected + fold * 0.1) END AS pred FROM m GROUP BY desig) SELECT desig, round(pred, 6) AS pred FROM p")
def fold_model_mean(spark, sf_dir):
    """Rows outside training get the mean of the fold models, training rows (here every third) that of their own fold."""
    each = fx.final(spark, sf_dir).select("desig", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("fold"), "expected").withColumn("pred", c("expected") + c("fold") * 0.1)
    mean = each.groupBy("desig").agg(F.avg("pred").alias("pred"))
    own = each.filter((c("desig") % 3 == 0) & (c("fold") == c("desig") % 8)).select("desig", "pred")
    return rounded(catalog.overlaid(mean, own, "desig", ["pred"]))


@query(f"WITH {FINAL}, f AS (SELECT desig % 8 AS fold, q < 1.5 AS inner_part, expected FROM final) SELECT fold, count(*)::BIGINT AS n, count(*) FILTER (inner_part)::BIGINT AS n_part, round(avg(expected), 6) AS mean_all, round(avg(expected) FILTER (inner_part), 6) AS mean_part FROM f GROUP BY fold")
def fold_diagnostics(spark, sf_dir):
    part = c("q") < 1.5
    return rounded(fx.final(spark, sf_dir).groupBy((c("desig") % 8).alias("fold")).agg(F.count("*").alias("n"), F.count_if(part).alias("n_part"), F.avg("expected").alias("mean_all"), F.avg(F.when(part, c("expected"))).alias("mean_part")))


TRIALS = f"{FINAL}, t AS (SELECT desig AS trial, ['add', 'remove', 'swap'][(desig % 3)::INT + 1] AS move, desig % 5 AS segment, 1.5 + (desig*37 % 100)/1000.0 AS rmse, 0.4 + (desig*53 % 100)/1000.0 AS deviance, 0.9 + (desig*71 % 100)/1000.0 AS r2 FROM final), a AS (SELECT *, (rmse < 1.53)::INT + (deviance < 0.43)::INT + (r2 > 0.96)::INT >= 2 AS accepted FROM t)"


def _trials(spark, sf_dir):
    k = c("desig")
    rows = fx.final(spark, sf_dir).select(k.alias("trial"), F.element_at(F.array(*map(F.lit, ("add", "remove", "swap"))), (k % 3 + 1).cast("int")).alias("move"), (k % 5).alias("segment"), (1.5 + k * 37 % 100 / 1000).alias("rmse"), (0.4 + k * 53 % 100 / 1000).alias("deviance"), (0.9 + k * 71 % 100 / 1000).alias("r2"))
    return evaluate.accepted(rows, 1.53, 0.43, 0.96)


@query(f"WITH {TRIALS} SELECT move, count(*)::BIGINT AS tries, count(*) FILTER (accepted)::BIGINT AS accepts, round(min(deviance)::DOUBLE, 6) AS best FROM a GROUP BY move")
def search_history(spark, sf_dir):
    return rounded(evaluate.history(_trials(spark, sf_dir), "move"))


@query(f"WITH {FINAL}, s AS (SELECT num_opps AS size, list_sort(list(DISTINCT 'f' || (desig % 37))) AS features, list(expected ORDER BY desig) AS scores FROM final GROUP BY num_opps), p AS (SELECT *, coalesce(lag(features) OVER (ORDER BY size), []) AS prev FROM s) SELECT size, array_to_string(list_sort(list_filter(features, lambda x: NOT list_contains(prev, x))), ',') AS gained, array_to_string(list_sort(list_filter(prev, lambda x: NOT list_contains(features, x))), ',') AS lost, round(list_avg(scores), 6) AS mean, round(list_stddev_pop(scores), 6) AS spread FROM p")
def subset_trace(spark, sf_dir):
    rows = fx.final(spark, sf_dir).groupBy(c("num_opps").alias("size")).agg(F.collect_set(F.concat(F.lit("f"), (c("desig") % 37).cast("string"))).alias("features"), F.collect_list("expected").alias("scores"))
    got = evaluate.subset_trace(rows)
    return rounded(got.withColumns({k: F.array_join(k, ",") for k in ("gained", "lost")}))


#: A closed score that falls with h: what a survey of limiting magnitude 21 sees of an object at its mean distance.
def brightness(df):
    return df.withColumn("score", 1 + 14 / (1 + F.exp(orbit.offset(c("a"), 1.0) - 21.0)))


_V = "(5*log10(greatest(a, 0.001)*greatest(a-1, 0.001)) + {0})"
_SCORE = "(1 + 14/(1 + exp(" + _V + " - 21.0)))"
SOLVE = f"""{FINAL}, s0 AS (SELECT *, {_SCORE.format('h')} AS s_h, {_SCORE.format('h + 15.0')} AS s_end FROM final), b0 AS (SELECT *, 0.0::DOUBLE AS lo, 15.0::DOUBLE AS hi, 0 AS k FROM s0),
 b AS (SELECT * FROM b0 UNION ALL SELECT * REPLACE (CASE WHEN {_SCORE.format('h + (lo+hi)/2')} > num_opps THEN (lo+hi)/2 ELSE lo END AS lo, CASE WHEN {_SCORE.format('h + (lo+hi)/2')} > num_opps THEN hi ELSE (lo+hi)/2 END AS hi, k + 1 AS k) FROM b WHERE k < 12),
 sol AS (SELECT desig, h, s_h IS NULL AS invalid, s_h <= num_opps AS already_neutral, s_h > num_opps AND s_end > num_opps AS censored, CASE WHEN s_h IS NULL THEN NULL WHEN s_h <= num_opps THEN 0.0 WHEN s_end > num_opps THEN 15.0 ELSE hi END AS delta FROM b WHERE k = 12)"""


@query(f"WITH RECURSIVE {SOLVE} SELECT desig, invalid, coalesce(already_neutral, false) AS already_neutral, coalesce(censored, false) AS censored, round(delta::DOUBLE, 12) AS delta, round(h + delta::DOUBLE, 12) AS h_neutral, round(delta::DOUBLE/0.45, 12) AS z_h FROM sol")
def dh_solve(spark, sf_dir):
    got = evaluate.neutrality(evaluate.solve(fx.final(spark, sf_dir), brightness, "num_opps"))
    return rounded(got.select("desig", "invalid", "already_neutral", "censored", "delta", "h_neutral", "z_h"), 12)  # halves of halves end in ties at fewer places


def _bright(h):
    """brightness() as an expression of h."""
    least = lambda x: F.greatest(x, F.lit(0.001))
    return 1 + 14 / (1 + F.exp(5 * F.log10(least(c("a")) * least(c("a") - 1)) + h - 21.0))


#: Three scores of the same brightness, as a mean, a low quantile and odds come from three models, and their targets.
SCORES = {"e": (_bright, "num_opps"), "q": (lambda h: _bright(h) * 0.6, "num_opps"), "p": (lambda h: 1 / (1 + F.exp(4 - _bright(h))), "even")}


def _solved_sql(name: str, score: str, target: str) -> str:
    at = lambda x: score.format(_SCORE.format(x))
    return f""" z{name} AS (SELECT desig, h, a, {target} AS target, {at('h')} AS s_h, {at('h + 15.0')} AS s_end, 0.0::DOUBLE AS lo, 15.0::DOUBLE AS hi, 0 AS k FROM final),
 y{name} AS (SELECT * FROM z{name} UNION ALL SELECT * REPLACE (CASE WHEN {at('h + (lo+hi)/2')} > target THEN (lo+hi)/2 ELSE lo END AS lo, CASE WHEN {at('h + (lo+hi)/2')} > target THEN hi ELSE (lo+hi)/2 END AS hi, k + 1 AS k) FROM y{name} WHERE k < 12),
 x{name} AS (SELECT desig, h, s_h, s_h IS NULL AS invalid, coalesce(s_h > target AND s_end > target, false) AS censored, CASE WHEN s_h IS NULL THEN NULL WHEN s_h <= target THEN 0.0 WHEN s_end > target THEN 15.0 ELSE hi END::DOUBLE AS dh FROM y{name} WHERE k = 12)"""


@query(f"WITH RECURSIVE {FINAL}," + ",".join([_solved_sql("e", "{}", "num_opps"), _solved_sql("q", "({} * 0.6)", "num_opps"), _solved_sql("p", "(1/(1 + exp(4 - {})))", "0.5")]) + """ SELECT xe.desig, round(xe.s_h, 6) AS full_e, round(xe.dh, 12) AS dh_e, xe.censored AS censored_e, xe.invalid AS invalid_e, round(xq.s_h, 6) AS full_q, round(xq.dh, 12) AS dh_q, xq.censored AS censored_q, xq.invalid AS invalid_q,
 round(xp.s_h, 6) AS full_p, round(xp.dh, 12) AS dh_p, xp.censored AS censored_p, xp.invalid AS invalid_p, round(xe.h + xq.dh, 12) AS h_neutral, round(xq.dh / 0.45, 12) AS z_h FROM xe JOIN xq USING (desig) JOIN xp USING (desig)""")  # fmt: skip
def neutrality_table(spark, sf_dir):
    """Shifts of h by all three scores; z_h and h_neutral by that of the low quantile."""
    rows = fx.final(spark, sf_dir).withColumn("even", F.lit(0.5))
    got = evaluate.neutrality_table(rows, {k: lambda df, f=f, to=to: evaluate.solve_by(df, f, to) for k, (f, to) in SCORES.items()})
    fine = {k: F.round(k, 12) for k in (*[f"dh_{k}" for k in SCORES], "h_neutral", "z_h")}  # halves of halves end in ties at fewer places
    coarse = {f"full_{k}": F.round(f"full_{k}", 6) for k in SCORES}
    return got.withColumns(fine | coarse).select("desig", *[f"{x}_{k}" for k in SCORES for x in ("full", "dh", "censored", "invalid")], "h_neutral", "z_h")


@query(f"""WITH {FINAL}, pick AS (SELECT *, quantile_opps - num_opps - 15.5*ext AS priority FROM final WHERE prob >= 0.998 AND ext <= 0.5 AND h IS NOT NULL ORDER BY priority DESC, desig LIMIT 250),
 g AS (SELECT *, unnest(range(501)) AS k FROM pick), s AS (SELECT *, 5.0::DOUBLE + k*0.05::DOUBLE AS gh, abs({_SCORE.format('(5.0::DOUBLE + k*0.05::DOUBLE)')} - num_opps) AS residual FROM g),
 r AS (SELECT *, row_number() OVER (PARTITION BY desig ORDER BY residual > 0.5, CASE WHEN residual <= 0.5 THEN abs(gh - h) ELSE residual END, k) AS rn FROM s)
 SELECT row_number() OVER (ORDER BY residual <= 0.5 DESC, gh - h DESC, priority DESC, desig) AS place, desig, {r6(h='h', h_neutral='gh', h_change='gh - h', residual='residual', ext='ext', prob='prob', priority='priority')}, residual <= 0.5 AS within, num_opps::BIGINT AS num_opps FROM r WHERE rn = 1""")  # fmt: skip
def neutral_candidates(spark, sf_dir):
    return rounded(evaluate.neutral_candidates(fx.final(spark, sf_dir), brightness))


@query(f"WITH RECURSIVE {SOLVE}, l AS (SELECT desig, max(h + 3.0) AS h_limit FROM final WHERE desig % 4 = 0 GROUP BY desig) SELECT desig, round(h_limit - (h + delta::DOUBLE), 12) + 0.0 AS margin, coalesce(h_limit - (h + delta::DOUBLE) >= 0, false) AS supported FROM sol LEFT JOIN l USING (desig)")
def archival_consistency(spark, sf_dir):
    final = fx.final(spark, sf_dir)
    limits = final.filter("desig % 4 = 0").select("desig", (c("h") + 3).alias("h_limit"))
    limits = limits.unionByName(limits.withColumn("h_limit", c("h_limit") - 1))
    got = evaluate.archival(evaluate.neutrality(evaluate.solve(final, brightness, "num_opps")), limits)
    return rounded(got.select("desig", "margin", "supported"), 12)


@query(f"""WITH {FINAL}, g AS (SELECT desig, h AS own, num_opps, a, unnest(range(501)) AS k FROM final), s AS (SELECT *, 5.0::DOUBLE + k*0.05::DOUBLE AS gh, abs({_SCORE.format('5.0::DOUBLE + k*0.05::DOUBLE')} - num_opps) AS residual FROM g),
 r AS (SELECT *, row_number() OVER (PARTITION BY desig ORDER BY residual > 0.5, CASE WHEN residual <= 0.5 THEN abs(gh - own) ELSE residual END, k) AS rn FROM s) SELECT desig, {r6(h_neutral='gh', h_change='gh - own', residual='residual')}, residual <= 0.5 AS within FROM r WHERE rn = 1""")  # fmt: skip
def h_grid(spark, sf_dir):
    """Every object of the table; one without h takes the first grid h within tolerance and has no change."""
    return rounded(evaluate.h_grid(fx.final(spark, sf_dir), brightness, "num_opps"))


@query(f"WITH {FINAL}, d AS (SELECT desig, q, (desig*7919) % 10007 AS draw FROM final) (SELECT desig FROM d WHERE q < 1.5) UNION ALL (SELECT desig FROM (SELECT * FROM d WHERE NOT q < 1.5 ORDER BY draw, desig LIMIT 200) t)")
def stratified_sample(spark, sf_dir):
    rows = fx.final(spark, sf_dir).withColumn("draw", (c("desig") * 7919) % 10_007)
    return catalog.stratified(rows, c("q") < 1.5, 200, "draw").select("desig")


@query(f"WITH {FINAL}, d AS (SELECT desig, row_number() OVER (ORDER BY (desig*7919) % 10007, desig) AS r FROM final) SELECT desig, r > 300 AS held_out FROM d")
def random_sample(spark, sf_dir):
    """300 rows by an arithmetic draw; the others are the holdout."""
    rows = fx.final(spark, sf_dir).withColumn("draw", (c("desig") * 7919) % 10_007)
    some = rows.orderBy("draw", "desig").limit(300).select("desig")
    rest = rows.join(some, "desig", "left_anti").select("desig")
    return some.withColumn("held_out", F.lit(False)).unionByName(rest.withColumn("held_out", F.lit(True)))


@query(f"WITH {FINAL} SELECT desig % 400 AS name, min(desig) AS desig FROM final GROUP BY ALL")
def drop_duplicates(spark, sf_dir):
    rows = fx.final(spark, sf_dir).withColumn("name", c("desig") % 400)
    return catalog.first_rows(rows, ["name"], ["desig"]).select("name", "desig")


@query(f"WITH {FINAL}, o AS (SELECT desig, expected, row_number() OVER (ORDER BY desig) AS r, row_number() OVER (ORDER BY (desig*7919) % 10007, desig) AS s FROM final) SELECT a.desig, round(b2.expected, 6) AS shuffled FROM o a JOIN o b2 ON a.r = b2.s")
def shuffled_column(spark, sf_dir):
    """One column dealt anew among all rows by an arithmetic draw, as permutation importance does: ranges of rows are numbered apart."""
    rows = fx.final(spark, sf_dir).select("desig", "expected", ((c("desig") * 7919) % 10_007).alias("draw"), F.lit(1).alias("g"), F.lit(1).alias("n"))
    own = evaluate.ranked(rows.select("g", "n", "desig"), "g", "desig", "n").select("desig", "before")
    key = rows.withColumn("key", c("draw") * 10_000_000 + c("desig"))
    dealt = evaluate.ranked(key.select("g", "n", "key", "expected"), "g", "key", "n").select("before", c("expected").alias("shuffled"))
    return rounded(own.join(dealt, "before").select("desig", "shuffled"))
