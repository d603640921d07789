"""Queries of attribution, feature selection, refinement and count fits, and DuckDB SQL written out by hand where it can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycensus.operators import boosting, evaluate, search
from skycensus.plans import fixtures as fx
from skycensus.plans.base import FINAL, query, rounded
from skycensus.plans.model_queries import GROW, IN_TRAINING, frame

c = F.col
SIMPLE = ["a", "e", "h"]


def _seen(x: dict[str, Column]) -> Column:
    """A closed score of three features: falls with magnitude and with the distance at perihelion."""
    return 1 + 14 / (1 + F.exp(x["h"] - 18 + 2 * (x["a"] * (1 - x["e"]) - 2)))


#: The sample is drawn here by arithmetic, as DuckDB has no such hash.
_S = "(1 + 14/(1 + exp({h} - 18 + 2*({a}*(1 - {e}) - 2))))"
_MEANS = ", ".join(f"avg({_S.format(**{f: ('r.' if f in s else 'b.') + f for f in 'aeh'})}) AS v_{s}" for s in ("", "a", "e", "h", "ae", "ah", "eh", "aeh"))


@query(f"""WITH {FINAL}, b AS (SELECT a, e, h FROM final WHERE h IS NOT NULL ORDER BY (desig*7919) % 10007, desig LIMIT 100), v AS (SELECT r.desig, {_MEANS} FROM final r, b GROUP BY r.desig)
 SELECT desig, round(v_, 6) AS base, round(v_aeh, 6) AS score, round((v_a - v_)/3 + (v_ae - v_e)/6 + (v_ah - v_h)/6 + (v_aeh - v_eh)/3, 6) + 0.0 AS phi_a, round((v_e - v_)/3 + (v_ae - v_a)/6 + (v_eh - v_h)/6 + (v_aeh - v_ah)/3, 6) + 0.0 AS phi_e,
 round((v_h - v_)/3 + (v_ah - v_a)/6 + (v_eh - v_e)/6 + (v_aeh - v_ae)/3, 6) + 0.0 AS phi_h FROM v""")  # fmt: skip
def attribution(spark, sf_dir):
    rows = fx.final(spark, sf_dir)
    sample = rows.filter("h is not null").orderBy((c("desig") * 7919) % 10_007, "desig").limit(100).select(*SIMPLE)
    return rounded(search.shapley(rows, _seen, SIMPLE, sample, "desig"))


@query(f"SELECT desig, true AS adds_up, true AS one_base FROM ({IN_TRAINING})")
def attribution_of_fit(spark, sf_dir):
    """Attributions of the fitted count model on three features: whether they add up to its prediction, from one base."""
    rows = frame(spark, sf_dir)
    model = boosting.train(rows, SIMPLE, c("num_opps") - 1, c("fold"), boosting.Loss("poisson"), folds=0, **GROW)
    got = search.model_shapley(rows, model, search.background(rows, SIMPLE, "desig"), "desig")
    fit = boosting.predict(rows, model, ["desig"]).select("desig", F.exp(F.element_at("margins", -1)).alias("fit"))
    ends = got.agg(F.min("base").alias("low"), F.max("base").alias("high"))
    both = got.join(fit, "desig").join(rows.filter("h is not null and num_opps is not null").select("desig"), "desig").crossJoin(F.broadcast(ends))
    return both.select("desig", (F.abs(c("base") + c("phi_a") + c("phi_e") + c("phi_h") - c("fit")) < 1e-9).alias("adds_up"), (c("high") - c("low") < 1e-12).alias("one_base"))


POOL = ["a", "e", "i", "q", "node", "peri", "period", "expected"]


def _pool(spark, sf_dir) -> DataFrame:
    """FINAL with a target that hangs on some of the pool and scatters by desig."""
    return fx.final(spark, sf_dir).withColumn("y", 2 * c("e") + 0.4 * c("q") - 0.01 * c("i") + c("expected") / 10 + (c("desig") * 7877 % 1000) / 500)


_Y = "2*e + 0.4*q - 0.01*i + expected/10 + (desig * 7877 % 1000)/500.0"


@query("WITH " + FINAL + f""", x AS (SELECT desig % 8 AS fold, {_Y} AS y, unnest([{', '.join(repr(f) for f in POOL)}]) AS feature, unnest([{', '.join(POOL)}]) AS v FROM final),
 k AS (SELECT DISTINCT fold AS held FROM x), t AS (SELECT held, feature, regr_slope(y, v) AS b, regr_intercept(y, v) AS a0 FROM x, k WHERE fold <> held GROUP BY held, feature)
 SELECT feature, fold, round(sqrt(avg(pow(y - a0 - b*v, 2))), 6) AS rmse FROM x JOIN t USING (feature) WHERE fold = held GROUP BY feature, fold""")  # fmt: skip
def one_feature_rmse(spark, sf_dir):
    """Held-out rmse of each feature of the pool by itself, as the first step of a selection sees it."""
    got = search.gram(_pool(spark, sf_dir), POOL, c("y"), c("desig") % 8)
    rows = [(f, k, float(x)) for f in POOL for k, x in zip(got.folds, got.held_out([f])[0], strict=True)]
    return rounded(spark.createDataFrame(rows, "feature string, fold bigint, rmse double"))


@query(None)
def feature_selection(spark, sf_dir):
    """The sets found by floating forward selection, with what each size gains and loses and its held-out rmse."""
    best = search.selected(search.gram(_pool(spark, sf_dir), POOL, c("y"), c("desig") % 8), 1, len(POOL))
    sizes = spark.createDataFrame([(k, names, [float(x) for x in scores]) for k, (names, scores) in best.items()], "size bigint, features array<string>, scores array<double>")
    return rounded(evaluate.subset_trace(sizes).withColumns({k: F.array_join(k, ",") for k in ("gained", "lost")}))


@query(None)
def feature_sets(spark, sf_dir):
    """Selected, all and incumbent columns on the same folds held out."""
    products = search.gram(_pool(spark, sf_dir), POOL, c("y"), c("desig") % 8)
    best = min(search.selected(products, 1, len(POOL)).values(), key=lambda x: x[1].mean())[0]
    sets = {"selected": best, "all": POOL, "incumbent": ["a", "e", "i"]}
    rows = [(name, len(some), *[float(x.mean()) for x in products.held_out(some)]) for name, some in sets.items()]
    return rounded(spark.createDataFrame(rows, "columns string, n bigint, rmse double, r2 double"))


def _loss(limit: float) -> Column:
    """Poisson deviance of counts against what a survey of that limiting magnitude sees."""
    m, y = 0.5 + 8 / (1 + F.exp(c("h") - limit)), (c("num_opps") - 1).cast("double")
    return 2 * (F.when(y > 0, y * F.ln(y / m)).otherwise(0.0) - y + m)


_DEV = "2*avg(CASE WHEN y > 0 THEN y*ln(y/(0.5 + 8/(1 + exp(h - {x})))) ELSE 0 END - y + 0.5 + 8/(1 + exp(h - {x})))"
_R = "((sqrt(5.0::DOUBLE) - 1)/2)"


@query(f"""WITH RECURSIVE {FINAL}, d AS (SELECT h, (num_opps - 1)::DOUBLE AS y FROM final WHERE h IS NOT NULL), g AS (SELECT 10.0::DOUBLE + k*1.5 AS x, {_DEV.format(x='(10.0::DOUBLE + k*1.5)')} AS f FROM d, range(9) r(k) GROUP BY k),
 b AS (SELECT x, f, greatest(10.0, x - 1.5) AS lo, least(22.0, x + 1.5) AS hi FROM g ORDER BY f, x LIMIT 1), s0 AS (SELECT lo, hi, hi - {_R}*(hi - lo) AS p, lo + {_R}*(hi - lo) AS q FROM b),
 w AS (SELECT 0 AS step, lo, hi, p, q, {_DEV.format(x='p')} AS fp, {_DEV.format(x='q')} AS fq FROM s0, d GROUP BY ALL UNION ALL
  SELECT step, lo, hi, p, q, CASE WHEN lefty THEN {_DEV.format(x='p')} ELSE any_value(kept) END, CASE WHEN lefty THEN any_value(kept) ELSE {_DEV.format(x='q')} END FROM
  (SELECT step + 1 AS step, CASE WHEN fp < fq THEN lo ELSE p END AS lo, CASE WHEN fp < fq THEN q ELSE hi END AS hi, CASE WHEN fp < fq THEN q - {_R}*(q - lo) ELSE q END AS p, CASE WHEN fp < fq THEN p ELSE p + {_R}*(hi - p) END AS q, CASE WHEN fp < fq THEN fp ELSE fq END AS kept, fp < fq AS lefty FROM w WHERE step < 12) n, d GROUP BY step, lo, hi, p, q, lefty),
 e AS (SELECT lo, hi, (lo + hi)/2 AS x FROM w WHERE step = 12)
 SELECT 0::BIGINT AS step, round(lo, 6) AS low, round(hi, 6) AS high, round(x, 6) AS x, round(f, 6) AS loss FROM b UNION ALL SELECT step::BIGINT, round(lo, 6), round(hi, 6), round((lo + hi)/2, 6), NULL FROM w WHERE step > 0
 UNION ALL SELECT 13, round(lo, 6), round(hi, 6), round(x, 6), round({_DEV.format(x='x')}, 6) FROM e, d GROUP BY lo, hi, x""")  # fmt: skip
def golden_refine(spark, sf_dir):
    trace = search.refined(fx.final(spark, sf_dir), _loss, 10.0, 22.0)
    return rounded(spark.createDataFrame([tuple(r.values()) for r in trace], "step bigint, low double, high double, x double, loss double"))


COUNTS = f"WITH RECURSIVE {FINAL}, v AS (SELECT desig % 3 AS grp, num_opps - 1 AS y FROM final), cnt AS (SELECT grp, y::DOUBLE AS y, count(*)::DOUBLE AS m FROM v GROUP BY ALL), pos AS (SELECT * FROM cnt WHERE y > 0)"
FIT = COUNTS + """, st AS (SELECT grp, sum(m) AS sn, sum(m*y)/sum(m) AS mean, max(y) AS top FROM pos GROUP BY grp), s1 AS (SELECT grp, top, mean, (sqrt(sum(m*pow(y - mean, 2))/sn/mean) - 1)/mean AS a0 FROM pos JOIN st USING (grp) GROUP BY grp, top, mean, sn),
 it AS (SELECT grp, 0 AS k, greatest(mean, 0.1) AS mu, greatest(a0, -0.9/greatest(top, mean)) AS al, 1.0::DOUBLE AS moved FROM s1 UNION ALL
  SELECT grp, k + 1, least(greatest(mu + dm, mu/2), mu*2), greatest(least(greatest(al + da, al - 0.2), al + 0.2), -0.9/top, -0.9/mu), greatest(abs(least(greatest(mu + dm, mu/2), mu*2) - mu), abs(greatest(least(greatest(al + da, al - 0.2), al + 0.2), -0.9/top, -0.9/mu) - al)) FROM
  (SELECT *, CASE WHEN fmm*faa > fma*fma AND fmm < 0 THEN (fma*fa - faa*fm)/(fmm*faa - fma*fma) ELSE fm/abs(fmm) END AS dm, CASE WHEN fmm*faa > fma*fma AND fmm < 0 THEN (fma*fm - fmm*fa)/(fmm*faa - fma*fma) ELSE fa/abs(faa) END AS da FROM
   (SELECT grp, k, mu, al, top, sum(m*(y/(mu*u) - t/(u*u) - r/(u*u))) AS fm, sum(m*(y*(y-1)/t - y*mu/u - mu*(y-mu)/(u*u) + r*mu*mu/(u*u))) AS fa,
    sum(m*(-y*(1+2*al*mu)/(mu*mu*u*u) + 2*al*t/(u*u*u) + r*2*al/(u*u*u) + r*(1+r)/pow(u, 4))) AS fmm, sum(m*(-y/(u*u) - (y*u - 2*t*mu)/(u*u*u) + r*2*mu/(u*u*u) - r*(1+r)*mu*mu/pow(u, 4))) AS fma,
    sum(m*(-y*y*(y-1)/(t*t) + y*mu*mu/(u*u) + 2*mu*mu*(y-mu)/(u*u*u) - r*2*mu*mu*mu/(u*u*u) + r*(1+r)*pow(mu, 4)/pow(u, 4))) AS faa FROM
    (SELECT it.grp, it.k, it.mu, it.al, s1.top, pos.y, pos.m, 1 + it.al*it.mu AS u, 1 + it.al*pos.y AS t, 1/(exp(it.mu/(1 + it.al*it.mu)) - 1) AS r FROM it JOIN s1 ON s1.grp = it.grp JOIN pos ON pos.grp = it.grp WHERE it.k < 40) z GROUP BY grp, k, mu, al, top) h) d),
 fit AS (SELECT it.grp, c.n, mu, al, moved, (z/c.n - exp(-mu/(1+al*mu)))/(1 - exp(-mu/(1+al*mu))) AS infl FROM it JOIN (SELECT grp, sum(m) AS n, sum(CASE WHEN y = 0 THEN m ELSE 0 END) AS z FROM cnt GROUP BY grp) c ON c.grp = it.grp WHERE k = 40)"""


@query(FIT + " SELECT grp, n::BIGINT AS n, round(mu, 6) AS mu, round(al, 6) AS alpha, round(infl, 6) AS inflation, moved < 1e-9 AS converged FROM fit")
def count_law(spark, sf_dir):
    return rounded(search.count_fit(_counts(spark, sf_dir), "grp", "y"))


@query(FIT + " SELECT fit.grp, r.k::BIGINT AS k, coalesce(cnt.m, 0)::BIGINT AS observed, round(n*((1 - infl)*exp(r.k*ln(mu) + (r.k - 1)*ln(1 + al*r.k) - r.k*ln(1 + al*mu) - lgamma(r.k + 1) - mu*(1 + al*r.k)/(1 + al*mu)) + CASE WHEN r.k = 0 THEN infl ELSE 0 END), 5) AS expected FROM fit CROSS JOIN range(0, 17) r(k) LEFT JOIN cnt ON cnt.grp = fit.grp AND cnt.y = r.k")
def count_law_against_observed(spark, sf_dir):
    rows = _counts(spark, sf_dir)
    seen = rows.groupBy("grp", c("y").alias("k")).agg(F.count("*").alias("observed"))
    made = search.count_expected(search.count_fit(rows, "grp", "y"), 16)
    return rounded(made.join(seen, ["grp", "k"], "left").select("grp", "k", F.coalesce("observed", F.lit(0)).alias("observed"), "expected"), 5)


def _counts(spark, sf_dir) -> DataFrame:
    return fx.final(spark, sf_dir).select((c("desig") % 3).alias("grp"), (c("num_opps") - 1).cast("long").alias("y"))


FAMILIES = {"mean": lambda: c("a"), "near": lambda: c("q"), "far": lambda: c("aphelion")}


def _slots(state: search.State) -> Column:
    """Counts that a survey expects of the mean of soft limits at the distances of the slots, each shifted."""
    least = lambda x: F.greatest(x, F.lit(0.01))
    seen = [8 / (1 + F.exp(c("h") + 5 * F.log10(least(FAMILIES[f]()) * least(FAMILIES[f]() - 1)) + d - 20)) for f, d in state]
    return 0.5 + sum(seen[1:], seen[0]) / len(seen)


def _history(spark, sf_dir) -> DataFrame:
    rows = search.slot_search(fx.final(spark, sf_dir), _slots, c("num_opps") - 1, list(FAMILIES), -2.0, 2.0)
    text = lambda s: ", ".join(f"{f}@{d:+.3f}" for f, d in s)
    return spark.createDataFrame([(*[r[k] for k in ("segment", "round", "trial", "move")], text(r["state"]), *[r[k] for k in ("rmse", "deviance", "r2", "accepted")]) for r in rows], "segment bigint, round bigint, trial bigint, move string, state string, rmse double, deviance double, r2 double, accepted boolean")


@query(None)
def slot_search(spark, sf_dir):
    return rounded(_history(spark, sf_dir))


@query(None)
def slot_search_history(spark, sf_dir):
    """Tries, acceptances and the best deviance of each move and of each segment, with the segment's best state."""
    rows = _history(spark, sf_dir)
    best = rows.filter("accepted").groupBy("segment").agg(F.min_by("state", F.struct("deviance", "round", "trial")).alias("state"))
    moves = evaluate.history(rows, "move").select(c("move").alias("part"), "tries", "accepts", "best", F.lit(None).cast("string").alias("state"))
    parts = evaluate.history(rows, "segment").join(best, "segment").select(F.concat(F.lit("segment "), c("segment").cast("string")).alias("part"), "tries", "accepts", "best", "state")
    return rounded(moves.unionByName(parts))
