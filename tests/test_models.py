"""Fitted models against plain loops."""

import math
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DIR = "/root/testdata/sf0.01"
c = F.col


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def data(n=500, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[rng.random(n) < 0.05, 1] = np.nan
    mean = np.exp(0.8 + 0.7 * x[:, 0] - 0.5 * (np.nan_to_num(x[:, 1]) > 0.3))
    return x, rng.poisson(mean).astype(float), rng.integers(0, 4, n), rng.integers(1, 4, n).astype(float)


def plain_boost(x, y, fold, w, k, edges, kind, rounds, depth, rate, least):
    """Margins of all rows by the model without fold k, one node after the other."""
    bins = [[0 if math.isnan(v) else 1 + sum(e < v for e in edges[f]) for f, v in enumerate(r)] for r in x]
    mine = [r for r in range(len(y)) if fold[r] != k]
    mean = sum(w[r] * y[r] for r in mine) / sum(w[r] for r in mine)
    m = [math.log(mean) if kind == "poisson" else math.log(mean / (1 - mean))] * len(y)
    for _ in range(rounds):
        g, h = {}, {}
        for r in mine:
            p = math.exp(m[r]) if kind == "poisson" else 1 / (1 + math.exp(-m[r]))
            g[r], h[r] = w[r] * (y[r] - p), w[r] * (p if kind == "poisson" else p * (1 - p))
        score = lambda rows: sum(g[r] for r in rows) ** 2 / (sum(h[r] for r in rows) + 1)  # noqa: B023, E731
        leaves = [list(range(len(y)))]
        for _ in range(depth):
            new = []
            for node in leaves:
                own, best = [r for r in node if fold[r] != k], (1e-9, None, None)
                for f in range(len(edges)):
                    for cut in range(32):
                        left, right = [r for r in own if bins[r][f] <= cut], [r for r in own if bins[r][f] > cut]
                        if min(len(left), len(right)) >= least and (gain := round(score(left) + score(right) - score(own), 9)) > best[0]:
                            best = (gain, f, cut)
                _, f, cut = best
                new += [node, []] if f is None else [[r for r in node if bins[r][f] <= cut], [r for r in node if bins[r][f] > cut]]
            leaves = new
        for node in leaves:
            a, b = sum(g.get(r, 0) for r in node), sum(h.get(r, 0) for r in node)
            value = math.log((a + b + 0.1) / (b + 0.1)) if kind == "poisson" else a / (b + 1)
            for r in node:
                m[r] += rate * value
    return m


@pytest.mark.parametrize("kind", ["poisson", "logistic"])
def test_boosting_equals_plain_loops(spark, kind):
    from skycensus.operators import boosting

    x, y, fold, w = data()
    y = y if kind == "poisson" else (y > 2).astype(float)
    rows = [(k, *[None if math.isnan(v) else float(v) for v in r], float(y[k]), int(fold[k]), float(w[k])) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, y double, f int, wt double").repartition(5)
    names = ["x0", "x1", "x2"]
    model = boosting.train(df, names, c("y"), c("f"), boosting.Loss(kind), c("wt"), folds=4, rounds=6, depth=2, least=10)
    got = {r.id: r.margins for r in boosting.predict(df, model, ["id"]).collect()}
    for k in (0, 3, 4):
        want = plain_boost(x, y, fold, w, k, model.edges, kind, 6, 2, 0.3, 10)
        assert [got[i][k] for i in range(len(y))] == pytest.approx(want, abs=1e-9)


def test_prune_rounds_equal_plain_loops(spark):
    from skycensus.operators import boosting

    x, y, _, w = data(400, 5)
    label = ((y > 2) ^ (np.random.default_rng(1).random(400) < 0.15)).astype(int)
    rows = [(k, *[None if math.isnan(v) else float(v) for v in r], int(label[k]), float(w[k])) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, label int, weight double").repartition(3)
    names, grow = ["x0", "x1", "x2"], {"rounds": 4, "depth": 2, "least": 5, "rate": 0.6}
    model, left = boosting.pruned(df, names, ((0.3, 0.7), (0.2, 2.0)), **grow)
    keep, counts = np.arange(400), []
    for low, high in ((0.3, 0.7), (0.2, 2.0)):
        some = df.filter(c("id").isin([int(k) for k in keep]))
        edges = boosting.bin_edges(some, names)
        m = np.array(plain_boost(x[keep], label[keep], np.full(len(keep), -1), w[keep], 0, edges, "logistic", 4, 2, 0.6, 5))
        p = 1 / (1 + np.exp(-m))
        keep = keep[~(((label[keep] == 1) & (p < low)) | ((label[keep] == 0) & (p > high)))]
        counts.append(len(keep))
    assert {r.id for r in left.select("id").collect()} == set(keep.tolist()) and counts[0] < 400
    assert len(model.trees) == 4


def test_quantile_model_covers_its_level(spark):
    from skycensus.operators import boosting

    rng = np.random.default_rng(0)
    x, f = rng.uniform(0, 4, 6000), rng.integers(0, 4, 6000)
    y = 10 + 3 * np.floor(x) + rng.normal(size=6000)
    df = spark.createDataFrame([(k, float(a), float(b), int(z)) for k, (a, b, z) in enumerate(zip(x, y, f, strict=True))], "id long, x double, y double, f int")
    model = boosting.train(df, ["x"], c("y"), c("f"), boosting.Loss("quantile", 0.05), folds=4, rounds=6, depth=2, least=100, rate=0.5)
    got = {r.id: r.q for r in boosting.out_of_fold(df, model, "id", c("f"), F.lit(True), "q").collect()}
    under = np.array([y[k] < got[k] for k in range(6000)])
    assert abs(under.mean() - 0.05) < 0.02
    swept = boosting.quantile_levels(df, ["x"], "id", c("y"), c("f"), [0.05, 0.5], folds=4, depth=2)
    per = {(r.id, r.level): r.value for r in swept.collect()}
    assert all(per[k, 0.05] < per[k, 0.5] for k in range(6000))
    assert abs(np.mean([y[k] < per[k, 0.5] for k in range(6000)]) - 0.5) < 0.03


def test_model_edges(spark):
    """Nulls everywhere, no rows in training, one constant feature, clashing names."""
    from skycensus.operators import boosting

    df = spark.createDataFrame([(k, 1.0, None if k % 2 else float(k), float(k % 3), k % 2) for k in range(40)], "id long, x double, w double, y double, f int")
    model = boosting.train(df, ["x", "w"], c("y"), c("f"), boosting.Loss("poisson"), folds=2, rounds=2, depth=2, least=3)
    assert all(all(math.isfinite(v) for v in r.margins) for r in boosting.predict(df, model, ["id", "f"]).collect())
    none = boosting.train(df.filter("id < 0"), ["x"], c("y"), c("f"), boosting.Loss("poisson"), folds=2, rounds=1)
    assert len(boosting.predict(df, none, ["id"]).collect()) == 40


def test_importance(spark):
    from skycensus.plans import model_queries

    got = {r.feature: r for r in model_queries.permutation_importance(spark, DIR).collect()}
    assert set(got) == {"none", *model_queries.FEATURES} and got["none"].delta == 0
    assert max(got[x].delta for x in model_queries.FEATURES) == max(got[x].delta for x in ("h", "a", "vis_timeavg", "vis_q")) > 0.01


def test_extension_difficulty(spark):
    from skycensus.plans import model_queries

    rows = model_queries.extension_difficulty(spark, DIR).collect()
    assert len(rows) == 1500 and all(0 <= r.ext <= 1 and r.ext == round(r.ext, 6) for r in rows)


def cascade_frame(spark, n=400):
    x, y, fold, _ = data(n, 8)
    rows = [(k, *[None if math.isnan(v) else float(v) for v in r], 20.0 - float(r[0]), None if k % 9 == 0 else int(y[k]) + 1, int(fold[k])) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, h double, num_opps long, f int").repartition(4)


def test_scores_of_unseen_rows_chain_the_fold_means(spark):
    """Against the models asked one after the other, each by all folds, summed up in plain Python; columns of the scores' names are replaced."""
    from skycensus.operators import boosting

    df, names = cascade_frame(spark), ["x0", "x1", "x2"]
    models, _ = boosting.fitted_cascade(df, names, "id", c("f"), c("num_opps"), c("num_opps") >= 4, 0.05, folds=4, rounds=3, depth=2, least=10)
    new = df.select((c("id") + 1000).alias("id"), "x0", F.lit(None).cast("double").alias("x1"), (c("x2") * 3).alias("x2"), F.lit("old").alias("prob"), F.array("f").alias("more"))
    got = {r.id: r for r in models.score(new).collect()}
    rows, said = new.drop("prob"), {}
    for model, name, back, more in ((models.mean, "exp_num_opps", math.exp, 1), (models.low, "quantile_opps", float, 1), (models.odds, "prob", lambda m: 1 / (1 + math.exp(-m)), 0)):
        said = {r.id: sum(back(m) for m in r.margins[:4]) / 4 + more for r in boosting.predict(rows, model, ["id"]).collect()}
        assert len(said) == 400 and all(getattr(got[k], name) == pytest.approx(v, abs=1e-12) for k, v in said.items())
        rows = rows.join(spark.createDataFrame(list(said.items()), f"id long, {name} double"), "id")
    assert got[1001].more == [df.filter("id = 1").first().f] and set(models.score(new).columns) == {*new.columns, *boosting.SCORES}
    assert models.score(new.limit(0)).count() == 0


def test_joint_solve_equals_solves_one_by_one(spark):
    from skycensus.operators import evaluate
    from skycensus.operators.lineage import cut

    rows = spark.createDataFrame([(k, None if k == 5 else 12.0 + k / 3, float("nan") if k == 6 else 3.0 + k / 20, None if k == 7 else k % 8) for k in range(40)], "id long, h double, a double, n long")
    both = lambda df: df.withColumns({"s1": 1 + 14 / (1 + F.exp(c("h") + c("a") - 21)), "s2": 1 / (1 + F.exp(c("h") - c("a") - 14))})
    targets = {"e": ("s1", c("n")), "p": ("s2", F.lit(0.5))}
    table = evaluate.neutrality_table(rows, evaluate.solve_many(rows, both, targets, "id", cut))
    got = {r.id: r for r in table.collect()}
    for name, (score, target) in targets.items():
        finite = lambda df, score=score: both(df).withColumn("score", F.nanvl(c(score), F.lit(None).cast("double"))).drop("s1", "s2")
        for r in evaluate.solve(rows.withColumn("t", target), finite, "t").collect():
            assert (got[r.id][f"dh_{name}"], got[r.id][f"censored_{name}"], got[r.id][f"invalid_{name}"]) == (r.delta, r.censored, r.invalid)
    assert got[5].invalid_e and got[6].invalid_p and got[7].invalid_e and not got[7].invalid_p and got[6].dh_e is None
    assert len(got) == 40 and any(r.censored_e for r in got.values()) and sum(0 < (r.dh_p or 0) < 15 for r in got.values()) > 5


def test_shifts_of_fitted_scores_end_at_their_targets(spark):
    """The score is over its target one step before the shift and not over it at the shift, where there is one."""
    from skycensus.plans import model_queries

    rows = model_queries.frame(spark, DIR)
    models = model_queries.cascade_of(rows)
    table = model_queries.solved_by_fit(rows, models).toPandas()
    assert len(table) == 1500 and table.invalid_e.sum() > 0
    for name, score, target in (("e", "exp_num_opps", table.num_opps), ("p", "prob", 0.5)):
        inside = (table[f"dh_{name}"] > 0) & (table[f"dh_{name}"] < 15)
        some = table.assign(to=target)[inside]
        assert len(some) > 50
        for shift, over in ((0.0, False), (-15 / 4096, True)):
            moved = spark.createDataFrame(some.assign(h=some.h + some[f"dh_{name}"] + shift)[["desig", "a", "e", "i", "node", "h", "to"]])
            at = models.score(model_queries.described(moved)).toPandas()
            assert ((at[score] > at.to) == over).all()


def test_compared_sets_equal_plain_loops(spark):
    from skycensus.operators import boosting, search

    x, y, fold, _ = data()
    rows = [(k, *[None if math.isnan(v) else float(v) for v in r], float(y[k]), int(fold[k])) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, y double, f int").repartition(3)
    got = {r.columns: r for r in search.compared_fits(df, {"one": ["x0"], "two": ["x0", "x1"]}, "id", c("y"), c("f"), boosting.Loss("poisson"), folds=4, rounds=4, depth=2, least=10).collect()}
    for name, names in (("one", ["x0"]), ("two", ["x0", "x1"])):
        edges, each = boosting.bin_edges(df, names), []
        for k in range(4):
            m = plain_boost(x[:, : len(names)], y, fold, np.ones(len(y)), k, edges, "poisson", 4, 2, 0.3, 10)
            mine = np.flatnonzero(fold == k)
            each.append(np.sqrt(np.mean((y[mine] - np.exp(np.array(m)[mine])) ** 2)))
        assert got[name].rmse == pytest.approx(np.mean(each), abs=1e-9) and (got[name].size, got[name].n) == (len(names), 500)
    assert got["two"].deviance < got["one"].deviance


def test_quantile_of_counts_splits_and_is_at_its_level(spark):
    """Counts whose low quantile is their least one: the trees still part rows of few from rows of many, and each part is at its level."""
    from skycensus.operators import boosting

    rng = np.random.default_rng(4)
    x, f = rng.uniform(0, 4, 8000), rng.integers(0, 4, 8000)
    y = np.where(x < 2, 0, 5) + rng.poisson(3.0, 8000)
    df = spark.createDataFrame([(k, float(a), float(b), int(z)) for k, (a, b, z) in enumerate(zip(x, y, f, strict=True))], "id long, x double, y double, f int")
    model = boosting.train(df, ["x"], c("y"), c("f"), boosting.Loss("quantile", 0.02), folds=4, rounds=2, depth=2, least=100)
    got = {r.id: r.q for r in boosting.out_of_fold(df, model, "id", c("f"), F.lit(True), "q").collect()}
    q = np.array([got[k] for k in range(8000)])
    assert q[x < 1.8].max() < 1 and q[x > 2.2].min() > 4  # a bin is 0.125 wide
    for part in (x < 1.8, x > 2.2):
        assert (y < q - 1e-9)[part].mean() <= 0.03 and (y <= q + 1e-9)[part].mean() >= 0.01


def test_rows_of_one_file_are_dealt(spark):
    """The tables of objects are small files; the work on them goes to all cores."""
    from skycensus.operators import boosting, search
    from skycensus.plans import model_queries

    assert model_queries.frame(spark, DIR).rdd.getNumPartitions() == 8 and model_queries.variants(spark, DIR).rdd.getNumPartitions() == 8
    df = spark.createDataFrame([(k, float(k), float(k % 3), k % 2) for k in range(40)], "id long, x double, y double, f int").coalesce(1)
    model = boosting.train(df, ["x"], c("y"), c("f"), boosting.Loss("poisson"), folds=0, rounds=1, depth=1, least=3)
    assert search.model_shapley(df, model, df.select("x").limit(5), "id").rdd.getNumPartitions() == 8
    assert search.shapley(df, lambda x: x["x"], ["x"], df.select("x").limit(5), "id").rdd.getNumPartitions() == 8


def test_grid_of_h_sorts_a_row_an_object(spark):
    from skycensus.operators import evaluate

    df = spark.createDataFrame([(k, None if k == 3 else 10.0 + k / 7, float(k % 9)) for k in range(300)], "desig long, h double, n double")
    got = evaluate.h_grid(df, lambda r: r.withColumn("score", 40.0 - c("h")), "n")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortAggregate") < plan.index("MapInArrow") < plan.index("Generate")
    for r in got.collect():
        grid = [(k, 5.0 + k * 0.05) for k in range(501)]
        own, want = (None if r.desig == 3 else 10.0 + r.desig / 7), r.desig % 9
        rest = lambda h, want=want: abs(40.0 - h - want)
        best = min(grid, key=lambda x: (rest(x[1]) > 0.5, (0 if own is None else abs(x[1] - own)) if rest(x[1]) <= 0.5 else rest(x[1]), x[0]))
        assert r.h_neutral == pytest.approx(best[1], abs=1e-12) and r.within == (rest(best[1]) <= 0.5)


def test_grid_of_h_takes_every_object(spark):
    from skycensus.plans import evaluate_queries

    got = evaluate_queries.h_grid(spark, DIR).collect()
    keys = [r[0] for r in spark.read.parquet(f"{DIR}/customer.parquet").select("c_custkey").collect()]
    assert sorted(r.desig for r in got) == sorted(keys)
    bare = [r for r in got if r.desig % 37 == 0]  # without h: no change, the first grid h within tolerance
    assert bare and all(r.h_change is None and r.h_neutral is not None for r in bare)


def test_grid_of_h_with_odd_keys(spark):
    """Objects of several rows, without key or without score; a score that no grid h brings within tolerance and that is the same for many."""
    from skycensus.operators import evaluate

    rows = [(1, 12.0, 3.0), (1, 15.02, 24.8), (None, 11.0, 4.0), (2, 20.0, -5.0), (3, 10.0, None), (4, None, 99.0)]
    got = evaluate.h_grid(spark.createDataFrame(rows, "desig long, h double, n double"), lambda r: r.withColumn("score", F.least(F.lit(25.0), 40.0 - c("h"))), "n")
    have = {r.desig: (round(r.h_neutral, 6), r.h_change if r.h_change is None else round(r.h_change, 6), r.within) for r in got.collect()}
    assert have == {1: (15.0, -0.02, True), None: (30.0, 19.0, False), 2: (30.0, 10.0, False), 4: (5.0, None, False)}
