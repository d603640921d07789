"""Queries of the fitted models. What a fit must hold (gain over a constant, no leakage, coverage) is checked by SQL; its figures by plain loops in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycensus.functions import orbit
from skycensus.operators import boosting, evaluate, observations, search
from skycensus.operators.lineage import cut, spread
from skycensus.plans import fixtures as fx
from skycensus.plans.base import ORB, query, rounded
from skycensus.plans.catalog_queries import comet_elements, label_union
from skycensus.sources.text import fixed_width

c = F.col
FOLDS, LEVEL = 8, 0.006
FEATURES = ["a", "e", "i", "h", "q", "vis_timeavg", "vis_q", "node"]
GROW = {"rounds": 6, "depth": 3, "least": 20}
#: Columns of the extension-difficulty model, and those known without observation statistics.
EXT, EXT_SIMPLE = ["u", "longest_opp_arc", "second_nights", "nights", "num_opps", "num_obs", "arc_length"], ["u", "num_opps", "num_obs", "arc_length"]


def described(rows: DataFrame) -> DataFrame:
    """rows with the features that are worked out from elements and h."""
    seen = orbit.visibility()
    return rows.withColumns({"q": c("a") * (1 - c("e")), "vis_timeavg": seen["vis_timeavg"], "vis_q": seen["vis_q"]})


def frame(spark, sf_dir) -> DataFrame:
    """desig, FEATURES, fold and num_opps, a count that falls with magnitude and distance and scatters by desig; null: not in training."""
    rows = described(spread(fx.orbits(spark, sf_dir), "desig")).withColumn("fold", c("desig") % FOLDS)
    mean = F.exp(1.9 - 0.15 * (c("h") - 16) - 0.3 * (c("a") - 3) + 0.5 * c("e"))
    count = 1 + F.floor(mean * (0.25 + (c("desig") * 7877 % 1000) / 660.0))
    return rows.select("desig", "fold", *FEATURES, F.when(c("desig") % 10 != 3, count).alias("num_opps"))


def trained(rows: DataFrame) -> boosting.Model:
    return boosting.train(rows, FEATURES, c("num_opps") - 1, c("fold"), boosting.Loss("poisson"), folds=FOLDS, **GROW)


def expected(rows: DataFrame) -> DataFrame:
    got = boosting.out_of_fold(rows, trained(rows), "desig", c("fold"), c("num_opps").isNotNull(), "exp_num_opps")
    return got.select("desig", (c("exp_num_opps") + 1).alias("exp_num_opps"))


@query(None)
def oof_poisson(spark, sf_dir):
    rows = frame(spark, sf_dir)
    return rounded(rows.select("desig", "fold", "num_opps").join(expected(rows), "desig"))


IN_TRAINING = f"WITH {ORB} SELECT desig, desig % 8 AS fold FROM orb WHERE h IS NOT NULL AND desig % 10 <> 3"


@query(f"SELECT fold, count(*)::BIGINT AS n, true AS better FROM ({IN_TRAINING}) GROUP BY fold")
def oof_poisson_gain(spark, sf_dir):
    """Per fold whether the deviance of rows held out is below that of the mean of the other folds."""
    rows = frame(spark, sf_dir)
    rows = rows.join(expected(rows), "desig").filter("num_opps is not null").select("fold", (c("num_opps") - 1).alias("y"), (c("exp_num_opps") - 1).alias("m"))
    sums = rows.groupBy("fold").agg(F.sum("y").alias("s"), F.count("*").alias("k"))  # one row a fold
    mean = sums.select(c("fold"), c("s"), c("k")).crossJoin(F.broadcast(sums.agg(F.sum("s").alias("all_s"), F.sum("k").alias("all_k"))))
    mean = mean.select("fold", ((c("all_s") - c("s")) / (c("all_k") - c("k"))).alias("mean"))
    both = rows.join(F.broadcast(mean), "fold")
    mine, plain = evaluate.fold_metrics(both, "fold", "y", ["m"]), evaluate.fold_metrics(both, "fold", "y", ["mean"]).select("fold", c("deviance").alias("plain"))
    return mine.join(plain, "fold").select("fold", "n", (c("deviance") < c("plain")).alias("better"))


@query(f"SELECT desig, true AS unchanged, fold <> 3 AS others_may_move FROM ({IN_TRAINING}) WHERE fold = 3")
def oof_leakage(spark, sf_dir):
    """Predictions of fold 3 with its labels dealt anew, against those with its own labels."""
    rows = frame(spark, sf_dir)
    other = rows.withColumn("num_opps", F.when((c("fold") == 3) & c("num_opps").isNotNull(), 1 + c("desig") * 31 % 40).otherwise(c("num_opps")))
    both = expected(rows).join(expected(other).select("desig", c("exp_num_opps").alias("again")), "desig").join(rows.filter("fold = 3 and num_opps is not null").select("desig"), "desig")
    return both.select("desig", (F.abs(c("exp_num_opps") - c("again")) < 1e-12).alias("unchanged"), F.lit(False).alias("others_may_move"))


def cascaded(rows: DataFrame) -> DataFrame:
    return rows.join(boosting.cascade(rows, FEATURES, "desig", c("fold"), c("num_opps"), c("num_opps") >= 4, LEVEL, folds=FOLDS, **GROW), "desig")


@query(None)
def final_scores(spark, sf_dir):
    """The scores that the ranked lists start from, assembled from the three models."""
    rows = cascaded(frame(spark, sf_dir))
    return rounded(rows.select(
        "desig", "num_opps", "exp_num_opps", "quantile_opps", "prob", orbit.logit(c("prob")).alias("logit"), (c("exp_num_opps") - c("num_opps")).alias("deficit"),
        (c("quantile_opps") - c("num_opps")).alias("delta_q"), orbit.poisson_cdf(c("num_opps") - 1, c("exp_num_opps") - 1).alias("poisson"),
    ))


@query(f"WITH t AS ({IN_TRAINING}) SELECT * FROM (VALUES ('prob'), ('quantile')) m(model), (SELECT count(*)::BIGINT AS n, true AS good FROM t)")
def cascade_checks(spark, sf_dir):
    """Whether prob beats a constant in log loss and the quantile is at its level, within 0.003 and two deviations of so many rows.

    Of a count the share under its quantile is at most the level and the share up to it at least the level; many rows lie on it, so neither alone need be near."""
    rows = cascaded(frame(spark, sf_dir)).filter("num_opps is not null")
    y, p = (c("num_opps") >= 4).cast("int"), F.least(F.greatest(c("prob"), F.lit(1e-15)), F.lit(1 - 1e-15))
    one = rows.agg(F.count("*").alias("n"), F.avg(y).alias("share"), F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("loss"), F.avg((c("num_opps") < c("quantile_opps") - 1e-9).cast("int")).alias("under"), F.avg((c("num_opps") <= c("quantile_opps") + 1e-9).cast("int")).alias("up_to"))
    plain = -(c("share") * F.ln("share") + (1 - c("share")) * F.ln(1 - c("share")))
    slack = 0.003 + 2 * F.sqrt(LEVEL * (1 - LEVEL) / c("n"))
    each = F.array(F.struct(F.lit("prob").alias("model"), "n", (c("loss") < plain).alias("good")), F.struct(F.lit("quantile").alias("model"), "n", ((c("under") <= LEVEL + slack) & (c("up_to") >= LEVEL - slack)).alias("good")))
    return one.select(F.explode(each).alias("r")).select("r.*")


def labelled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(frame of all objects, labelled rows with EXT columns)."""
    every = fx.final(spark, sf_dir)
    labels = label_union(spark, sf_dir).select("desig", c("label").cast("int").alias("label"), "weight")
    return every, labels.join(every.select("desig", *EXT), "desig")


@query(None)
def extension_difficulty(spark, sf_dir):
    every, rows = labelled(spark, sf_dir)
    grow = {"rounds": 4, "depth": 3, "least": 5}
    model, left = boosting.pruned(rows, EXT, **grow)
    simple = boosting.train(left, EXT_SIMPLE, c("label"), F.lit(-1), boosting.Loss("logistic"), c("weight"), folds=0, **grow)
    return boosting.score_or_fallback(every, model, simple, "desig", c("nights").isNull(), "ext")


@query(None)
def quantile_sweep(spark, sf_dir):
    """Separation of known objects at each level of the lower quantile, and whether it is the level to choose."""
    rows = frame(spark, sf_dir)
    levels = [0.003, 0.006, 0.01, 0.02, 0.05, 0.1]
    low = boosting.quantile_levels(rows, FEATURES, "desig", c("num_opps") - 1, c("fold"), levels, folds=FOLDS)
    more = fx.final(spark, sf_dir).select("desig", F.coalesce("ext", F.lit(0.0)).alias("ext"), "arc_length", (c("desig") % 9 == 0).alias("label"))
    each = low.join(rows.select("desig", "a", "num_opps"), "desig").join(more, "desig").withColumn("deficit", c("value") + 1 - c("num_opps"))
    gaps = evaluate.min_gap(each, "level")
    best = evaluate.best_level(gaps, "level").select(c("level").alias("chosen"))
    return rounded(gaps.join(F.broadcast(best), c("level") == c("chosen"), "left").select("level", "n_active", "n_inert", "auc", "min_gap", c("chosen").isNotNull().alias("chosen")))


@query(None)
def permutation_importance(spark, sf_dir):
    rows = frame(spark, sf_dir)
    return boosting.importance(rows, trained(rows), c("num_opps") - 1, c("fold"))


def cascade_of(rows: DataFrame) -> boosting.Cascade:
    return boosting.fitted_cascade(rows, FEATURES, "desig", c("fold"), c("num_opps"), c("num_opps") >= 4, LEVEL, folds=FOLDS, **GROW)[0]


#: Fields of a line of variant orbits: name, first place, width, kind.
VARIANT = [("desig", 1, 9, "bigint"), ("variant", 10, 3, "int"), ("h", 13, 10, "double"), ("epoch", 23, 8, "string"), ("a", 31, 13, "double"), ("e", 44, 11, "double"), ("i", 55, 11, "double"), ("node", 66, 11, "double")]


def variants(spark, sf_dir) -> DataFrame:
    """Each orbit and two beside it, through lines of fixed width with packed epochs, read and described."""
    by, day = c("variant").cast("double"), F.date_from_unix_date(F.floor(c("epoch") - 2440587.5).cast("int"))
    digit = lambda x: F.substr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUV"), x.cast("int") + 1, F.lit(1))
    packed = F.concat(digit(F.floor(F.year(day) / 100)), F.lpad((F.year(day) % 100).cast("string"), 2, "0"), digit(F.month(day)), digit(F.day(day)), F.lit("5"))
    rows = spread(fx.orbits(spark, sf_dir), "desig").withColumn("variant", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    numbers = [F.when(c("h").isNotNull(), F.format_string("%10.4f", c("h"))).otherwise(F.lit(" " * 10)), F.rpad(packed, 8, " "), *[F.format_string(f, x) for f, x in (("%13.7f", c("a") * (1 + by / 500)), ("%11.7f", F.greatest(c("e") + by / 1000, F.lit(0.0))), ("%11.5f", c("i")), ("%11.5f", c("node")))]]
    text = rows.select(F.concat(F.format_string("%9d%3d", c("desig"), c("variant")), *numbers).alias("value"))
    return described(fixed_width(text, VARIANT).withColumn("epoch", observations.packed_day(F.trim("epoch"))))


@query(None)
def variant_scores(spark, sf_dir):
    """Scores of variants of each orbit by the fitted models, and what the variant moves against the orbit itself."""
    return rounded(cascade_of(frame(spark, sf_dir)).score(variants(spark, sf_dir)).select("desig", "variant", "epoch", "a", "e", *boosting.SCORES, orbit.logit(c("prob")).alias("logit")))


@query(f"WITH {ORB} SELECT desig, v.variant::BIGINT AS variant, floor(epoch - 0.5) + 1.0 AS epoch, round(a * (1 + v.variant / 500.0), 7) AS a, true AS in_range, true AS as_the_orbit FROM orb, (VALUES (-1), (0), (1)) v(variant)")
def variant_checks(spark, sf_dir):
    """Variants as read; whether their scores are counts and odds, and whether the one that moves nothing scores as its orbit does."""
    rows = frame(spark, sf_dir)
    models = cascade_of(rows)
    places = {"a": 7, "e": 7, "i": 5, "node": 5, "h": 4}  # those of the lines, as a last bit may decide at the edge of a bin
    plain = described(rows.select("desig", *[F.round(x, n).alias(x) for x, n in places.items()]))
    own = models.score(plain).select("desig", *[c(x).alias(f"own_{x}") for x in boosting.SCORES])
    got = models.score(variants(spark, sf_dir)).join(own, "desig")
    fine = (c("exp_num_opps") >= 1) & c("prob").between(0, 1) & c("quantile_opps").isNotNull() & ~F.isnan("quantile_opps")
    alike = [F.abs(c(x) - c(f"own_{x}")) < 1e-12 for x in boosting.SCORES]
    return got.select("desig", c("variant").cast("bigint").alias("variant"), "epoch", F.round("a", 7).alias("a"), fine.alias("in_range"), ((c("variant") != 0) | (alike[0] & alike[1] & alike[2])).alias("as_the_orbit"))


@query(None)
def comet_scores(spark, sf_dir):
    """Scores of comets by models of the catalog: elements and magnitudes joined, oppositions null but for those listed; such rows have deficits too."""
    shape = fx.final(spark, sf_dir).select("desig", "e", "i", "node")
    comets = described(comet_elements(spark, sf_dir).join(shape, "desig"))
    got = cascade_of(frame(spark, sf_dir)).score(comets)
    low, poisson = c("quantile_opps") - c("num_opps"), orbit.poisson_cdf(c("num_opps") - 1, c("exp_num_opps") - 1)
    return rounded(got.select("desig", "a", "period", "tp", "h", "num_opps", *boosting.SCORES, poisson.alias("poisson"), low.alias("delta_q")))


def solved_by_fit(rows: DataFrame, models: boosting.Cascade) -> DataFrame:
    """The table of shifts of h at which each of the three scores comes down to its target, features and models worked out anew at each trial."""
    targets = {"e": ("exp_num_opps", c("num_opps")), "q": ("quantile_opps", c("num_opps")), "p": ("prob", F.lit(0.5))}
    some = rows.select("desig", "a", "e", "i", "node", "h", "num_opps")
    return evaluate.neutrality_table(some, evaluate.solve_many(some, lambda df: models.score(described(df)), targets, "desig", cut))


@query(None)
def neutrality_of_fit(spark, sf_dir):
    rows = frame(spark, sf_dir)
    return rounded(solved_by_fit(rows, cascade_of(rows)).drop("a", "e", "i", "node"), 12)


@query(None)
def feature_sets_of_fits(spark, sf_dir):
    """Three sets of features by boosted fits on the same folds."""
    rows = frame(spark, sf_dir).filter("h is not null")
    sets = {"all": FEATURES, "elements": ["a", "e", "i", "h"], "incumbent": ["a", "h"]}
    return rounded(search.compared_fits(rows, sets, "desig", c("num_opps") - 1, c("fold"), boosting.Loss("poisson"), folds=FOLDS, **GROW))
