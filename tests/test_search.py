"""Attribution, selection, refinement and count fits against plain loops."""

import math
import os
import sys
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
c = F.col


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def orders(worth, names):
    """Attributions as means over all orders in which features may arrive."""
    phi = dict.fromkeys(names, 0.0)
    for order in permutations(names):
        inside = set()
        for f in order:
            before = worth(frozenset(inside))
            inside.add(f)
            phi[f] += (worth(frozenset(inside)) - before) / math.factorial(len(names))
    return phi


def test_shapley_equals_all_orders(spark):
    from skycensus.operators import search

    rng = np.random.default_rng(2)
    x = [tuple(map(float, r)) for r in rng.normal(size=(60, 3))]
    df = spark.createDataFrame([(k, *r, "extra") for k, r in enumerate(x)] + [(99, None, 1.0, 1.0, None)], "id long, a double, b double, g double, base string")
    sample = df.filter("id < 20").select("a", "b", "g")
    score = lambda f: f["a"] * f["b"] + F.exp(f["g"]) * f["a"]
    plain = lambda a, b, g: a * b + math.exp(g) * a
    got = {r.id: r for r in search.shapley(df, score, ["a", "b", "g"], sample, "id").collect()}
    for k in range(0, 60, 7):
        worth = lambda s, r=x[k]: sum(plain(*[r[j] if f in s else b[j] for j, f in enumerate("abg")]) for b in x[:20]) / 20
        want = orders(worth, "abg")
        assert [got[k][f"phi_{f}"] for f in "abg"] == pytest.approx([want[f] for f in "abg"], abs=1e-9)
        assert got[k].base + sum(want.values()) == pytest.approx(got[k].score, abs=1e-9)
    assert got[99].phi_b is None and got[99].score is None and got[99].base is not None
    nothing = search.shapley(df, score, ["a", "b", "g"], sample.filter("a > 99"), "id").first()
    assert nothing.base is None and nothing.phi_a is None
    assert search.background(df, ["a", "b", "g"], "id", 5).count() == 5 and search.background(df, ["a"], "id").count() == 60


def test_shapley_of_a_fit_equals_all_orders(spark):
    from skycensus.operators import boosting, search

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = rng.poisson(np.exp(0.5 + x[:, 0] * (x[:, 1] > 0)))
    rows = [(k, *map(float, r), float(y[k])) for k, r in enumerate(x)] + [(300, None, 0.1, 0.2, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, g double, y double").repartition(3)
    model = boosting.train(df, ["a", "b", "g"], c("y"), F.lit(-1), boosting.Loss("poisson"), folds=0, rounds=4, depth=2, least=10)
    sample = df.filter("id < 15").select("a", "b", "g")
    got = {r.id: r for r in search.model_shapley(df, model, sample, "id").collect()}
    assert len(got) == 301
    ids = [0, 7, 200, 300]
    value = {r[0]: r[1:4] for r in rows}
    mixes = [(k, s, [value[k][j] if f in s else value[b][j] for j, f in enumerate("abg")]) for k in ids for n in range(4) for s in combinations("abg", n) for b in range(15)]
    frame = spark.createDataFrame([(i, *m) for i, (_, _, m) in enumerate(mixes)], "id long, a double, b double, g double")
    fits = {r.id: math.exp(r.margins[-1]) for r in boosting.predict(frame, model, ["id"]).collect()}
    sums = {}
    for i, (k, s, _) in enumerate(mixes):
        sums[k, frozenset(s)] = sums.get((k, frozenset(s)), 0.0) + fits[i] / 15
    for k in ids:
        want = orders(lambda s, k=k: sums[k, s], "abg")
        assert [got[k][f"phi_{f}"] for f in "abg"] == pytest.approx([want[f] for f in "abg"], abs=1e-9)
        assert got[k].base + sum(want.values()) == pytest.approx(got[k].score, abs=1e-9)


def pool(spark, n=400):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 8))
    x[:, 5] = x[:, 0] + x[:, 1] + 0.1 * x[:, 5]
    y = 2 * x[:, 0] - x[:, 1] + 0.5 * x[:, 2] + 0.1 * x[:, 3] + rng.normal(size=n)
    f = np.arange(n) % 4
    names = [f"x{k}" for k in range(8)]
    rows = [(*map(float, r), float(y[k]), int(f[k])) for k, r in enumerate(x)] + [(None, *[0.0] * 7, 1.0, 0), (*[0.0] * 8, None, 1)]
    df = spark.createDataFrame(rows, ", ".join(f"{z} double" for z in [*names, "y"]) + ", f int").repartition(5)
    return df, names, x, y, f


def test_gram_gives_the_errors_of_plain_fits(spark):
    from skycensus.operators import search

    df, names, x, y, f = pool(spark)
    got = search.gram(df, names, c("y"), c("f"))
    assert got.folds == [0, 1, 2, 3] and got.sums[:, 0, 0].tolist() == [100.0] * 4
    for some in ([0], [1, 5], [0, 1, 2, 3, 4, 5, 6, 7]):
        want = []
        for k in range(4):
            a = np.column_stack([np.ones(len(y)), x[:, some]])
            b = np.linalg.lstsq(a[f != k], y[f != k], rcond=None)[0]
            want.append(np.sqrt(np.mean((y[f == k] - a[f == k] @ b) ** 2)))
        assert got.held_out([names[k] for k in some])[0] == pytest.approx(want, abs=1e-6)


def test_selection_equals_brute_search(spark):
    from skycensus.operators import search

    df, names, *_ = pool(spark)
    products = search.gram(df, names, c("y"), c("f"))
    best = search.selected(products, 1, 8)
    assert sorted(best) == list(range(1, 9))
    score = lambda s: products.held_out(list(s))[0].mean()
    for k, (some, rmse) in best.items():
        assert rmse.mean() == pytest.approx(min(map(score, combinations(names, k))), abs=1e-9), (k, some)
    back = search.selected(products, 2, 8, forward=False)
    assert back[8][0] == names and sorted(back) == list(range(2, 9))
    locked = search.selected(products, 3, 5, fixed=("x7", "x6"))
    assert all({"x7", "x6"} <= set(s) for s, _ in locked.values()) and sorted(locked) == [3, 4, 5]
    one = search.selected(products, 1, 8, floating=False)
    assert all(set(one[k][0]) < set(one[k + 1][0]) for k in range(1, 8))


@pytest.mark.parametrize("ahead", [1, 3, 4])
def test_refine_equals_steps_one_by_one(spark, ahead):
    from skycensus.operators import search

    values = [0.3, 1.7, 2.2, 2.9, 4.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    loss = lambda x: F.abs(c("v") - x) + F.pow(c("v") - x, F.lit(2)) / 7
    plain = lambda x: sum(abs(v - x) + (v - x) ** 2 / 7 for v in values) / 5
    got = search.refined(df, loss, 0.0, 8.0, points=5, steps=9, ahead=ahead)
    best = min((0.0, 2.0, 4.0, 6.0, 8.0), key=plain)
    lo, hi, r = max(0.0, best - 2), min(8.0, best + 2), (math.sqrt(5) - 1) / 2
    assert got[0]["x"] == best and (got[0]["low"], got[0]["high"]) == (lo, hi)
    for k in range(9):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if plain(a) < plain(b) else (a, hi)
        assert (got[k + 1]["low"], got[k + 1]["high"]) == pytest.approx((lo, hi), abs=1e-9)
    assert got[-1]["loss"] == pytest.approx(plain(got[-1]["x"]), abs=1e-9)
    none = search.refined(df.filter("v > 99"), loss, 0.0, 8.0, points=5, steps=3)
    assert none[-1]["loss"] is None


def test_count_fit_is_a_maximum(spark):
    from skycensus.operators import search

    rng = np.random.default_rng(8)
    draws = {"even": rng.poisson(3.0, 4000), "wide": rng.negative_binomial(2, 0.3, 4000), "zeros": np.where(rng.random(4000) < 0.4, 0, rng.poisson(5.0, 4000))}
    rows = [(g, int(v)) for g, y in draws.items() for v in y] + [("one", 0), ("one", 3), ("none", None), ("even", None), ("even", -1)]
    got = {r.grp: r for r in search.count_fit(spark.createDataFrame(rows, "grp string, y int").repartition(4), "grp", "y").collect()}

    def likelihood(y, mu, alpha, w):
        f = lambda k: math.exp(k * math.log(mu) + (k - 1) * math.log(1 + alpha * k) - k * math.log(1 + alpha * mu) - math.lgamma(k + 1) - mu * (1 + alpha * k) / (1 + alpha * mu))
        return sum(n * math.log((1 - w) * f(int(k)) + (w if k == 0 else 0)) for k, n in zip(*np.unique(y, return_counts=True), strict=True))

    for g, y in draws.items():
        r = got[g]
        assert r.converged and r.n == 4000
        top = likelihood(y, r.mu, r.alpha, r.inflation)
        for dm, da, dw in [(d, 0, 0) for d in (-0.02, 0.02)] + [(0, d, 0) for d in (-0.005, 0.005)] + [(0, 0, d) for d in (-0.005, 0.005)] + [(0.02, 0.005, 0.005), (-0.02, 0.005, 0.005)]:
            assert likelihood(y, r.mu + dm, r.alpha + da, r.inflation + dw) < top
    assert abs(got["even"].mu - 3) < 0.15 and abs(got["even"].alpha) < 0.02 and abs(got["zeros"].inflation - 0.4) < 0.03 and got["wide"].alpha > 0.05
    assert got["one"].mu is None and got["one"].n == 2 and "none" not in got
    fits = search.count_fit(spark.createDataFrame(rows, "grp string, y int"), "grp", "y")
    sums = {r.grp: r.s for r in search.count_expected(fits, 60).groupBy("grp").agg(F.sum("expected").alias("s")).collect()}
    assert all(sums[g] == pytest.approx(4000, abs=1) for g in draws)


def test_slot_search_equals_plain_code(spark):
    from skycensus.operators import search

    rng = np.random.default_rng(5)
    x, y = rng.normal(size=200), rng.poisson(4, 200).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (0.5, None)], "x double, y double").repartition(4)
    predict = lambda s: F.exp(sum((d * (c("x") if f == "x" else c("x") * c("x")) for f, d in s), F.lit(1.0)) / len(s))
    got = search.slot_search(df, predict, c("y"), ["x", "square"], -1.0, 1.0, slots=(1, 3), rounds=4, batch=5, segments=2, seed=11)
    assert len(got) == 2 * (1 + 4 * 5) and got == search.slot_search(df, predict, c("y"), ["x", "square"], -1.0, 1.0, slots=(1, 3), rounds=4, batch=5, segments=2, seed=11)

    def plain(s):
        m = np.maximum(np.exp((1 + sum(d * (x if f == "x" else x * x) for f, d in s)) / len(s)), 1e-3)
        dev = 2 * np.mean(np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / m), 0) - y + m)
        return tuple(map(float, (np.sqrt(np.mean((y - m) ** 2)), dev, 1 - np.mean((y - m) ** 2) / np.var(y))))

    now = None
    for segment in range(2):
        for k in range(5):
            rows = [r for r in got if (r["segment"], r["round"]) == (segment, k)]
            for r in rows:
                want = plain(r["state"])
                assert (r["rmse"], r["deviance"], r["r2"]) == pytest.approx(want, abs=1e-9)
                assert r["accepted"] == (k == 0 or (want[0] < now[0]) + (want[1] < now[1]) + (want[2] > now[2]) >= 2)
                assert 1 <= len(r["state"]) <= 3 and all(-1 <= d <= 1 for _, d in r["state"])
            good = [r for r in rows if r["accepted"]]
            now = plain(min(good, key=lambda r: r["deviance"])["state"]) if good else now
    assert {r["move"] for r in got} == {"start", "mutate", "add", "remove", "swap"}
    none = search.scored_states(df.filter("x > 99"), [(("x", 0.1),)], predict, c("y"))
    assert all(math.isnan(v) for v in none[0])


def test_solve_by_equals_solve(spark):
    from skycensus.operators import evaluate

    df = spark.createDataFrame([(k, 10.0 + k / 3, float(k % 9)) for k in range(60)] + [(60, None, 1.0), (61, 12.0, None)], "desig long, h double, t double")
    score = lambda h: 8 / (1 + F.exp(h - 20))
    names = ["desig", "score_at_h", "delta", "censored", "already_neutral", "invalid"]
    one = evaluate.solve_by(df, score, "t").select(*names).orderBy("desig").collect()
    two = evaluate.solve(df, lambda rows: rows.withColumn("score", score(c("h"))), "t").select(*names).orderBy("desig").collect()
    assert one == two and any(r.censored for r in one) and any(r.invalid for r in one)
    both = evaluate.neutrality_table(df, {"e": lambda rows: evaluate.solve_by(rows, score, "t")}, c("t"))
    assert [(r.dh_e, r.h_neutral) for r in both.orderBy("desig").collect()] == [(r.delta, None if r.delta is None or h is None else h + r.delta) for r, h in zip(one, [10.0 + k / 3 for k in range(60)] + [None, 12.0], strict=True)]
