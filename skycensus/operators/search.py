"""Attribution of scores, feature selection, refinement of one parameter and fits of counts, all from few passes over the rows.

What reaches the driver is bounded by the number of features, folds, steps or distinct counts, never by rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycensus.operators.boosting import Loss, Model, out_of_fold, plain, train
from skycensus.operators.evaluate import fold_metrics
from skycensus.operators.lineage import spread

c = F.col


# attribution


def background(df: DataFrame, features: list[str], key: str, n: int = 100) -> DataFrame:
    """The n rows, whole in all features, that a hash of the key puts first: the sample that stands for absent features."""
    return df.select(key, *[c(f).cast("double").alias(f) for f in features]).na.drop().orderBy(F.xxhash64(key), key).limit(n).select(*features)


def weights(n: int) -> dict[int, float]:
    """Shapley weight of a coalition of so many others."""
    return {k: factorial(k) * factorial(n - k - 1) / factorial(n) for k in range(n)}


def shapley(df: DataFrame, score: Callable[[dict[str, Column]], Column], features: list[str], sample: DataFrame, key: str) -> DataFrame:
    """key, base, score and phi_<feature>: exact attributions over all coalitions of a score written as an expression.

    A coalition takes its features from the row and the others from each row of `sample` in turn (bounded: at most some hundred
    rows, sent to all tasks as one row). base is the mean score of the sample; base and all phi add up to score. A row with a null
    feature has null attributions; with an empty sample all but the score are null.
    """
    item = F.struct(*[c(f).cast("double").alias(f) for f in features])
    one = sample.agg(F.array_sort(F.collect_list(item)).alias("_sample"))
    rows = spread(df.select(key, *[c(f).cast("double").alias(f) for f in features]), key).crossJoin(F.broadcast(one))

    def value(inside: tuple[str, ...]) -> Column:
        if len(inside) == len(features):
            return score({f: c(f) for f in features})
        mixed = lambda s, b: s + score({f: c(f) if f in inside else b[f] for f in features})
        return F.aggregate("_sample", F.lit(0.0), mixed) / F.nullif(F.size("_sample"), F.lit(0))

    sets = [s for k in range(len(features) + 1) for s in combinations(features, k)]
    names = {s: f"_v{k}" for k, s in enumerate(sets)}
    rows = rows.withColumns({names[s]: value(s) for s in sets})
    weight = weights(len(features))

    def phi(f: str) -> Column:
        parts = [(c(names[tuple(x for x in features if x in {*s, f})]) - c(names[s])) * weight[len(s)] for s in sets if f not in s]
        return sum(parts[1:], parts[0])

    return rows.select(key, c(names[()]).alias("base"), c(names[tuple(features)]).alias("score"), *[phi(f).alias(f"phi_{f}") for f in features])


def model_shapley(df: DataFrame, model: Model, sample: DataFrame, key: str, most: int = 200, block: int = 256) -> DataFrame:
    """As shapley(), of a fitted model of few features (2^features coalitions) by its tree of all rows; null features count as the model's own bin for them.

    The sample of at most `most` rows goes to the tasks as bins; a task holds `block` rows times the sample at a time. Rows between the same
    cuts of the trees in all features that a coalition takes from them have the same worth, which is worked out once a batch.
    """
    features, n = model.features, len(model.features)
    last = Model(features, model.edges, model.loss, model.base[-1:], model.rate, [(f[-1:], at[-1:], v[-1:]) for f, at, v in model.trees])
    few = pa.Table.from_pylist([r.asDict() for r in sample.select(*plain(features)).limit(most).collect()], pa.schema([(f"_feature_{f}", pa.float64()) for f in features]))
    others = last.bins(few.combine_chunks().to_batches()[0]) if len(few) else np.zeros((1, n), np.uint8)
    weight = weights(n)
    kind = df.select(key).schema[0].dataType.simpleString()

    def predicted(bins: np.ndarray) -> np.ndarray:
        m = last.margins(bins)[:, 0]
        return np.exp(m) if last.loss.name == "poisson" else 1 / (1 + np.exp(-m)) if last.loss.name == "logistic" else m

    marks = [np.unique([at[0, j] for f, at, _ in last.trees for j in np.flatnonzero(f[0] == k) if at[0, j] < 255]) for k in range(n)]

    def value(bins: np.ndarray, inside: np.ndarray) -> np.ndarray:
        if inside.all():
            return predicted(bins)
        parts = [np.where(inside[None, None, :], bins[at : at + block, None, :], others[None, :, :]).reshape(-1, n) for at in range(0, len(bins), block)]
        return np.concatenate([predicted(x).reshape(-1, len(others)).mean(1) for x in parts])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = last.bins(batch)
            between = [np.searchsorted(marks[k], bins[:, k]) for k in range(n)]
            worth = np.zeros((2**n, len(bins)))
            for mask in range(2**n):
                inside, place = np.array([mask >> k & 1 for k in range(n)], bool), np.zeros(len(bins), np.int64)
                for k in np.flatnonzero(inside):
                    place = place * (len(marks[k]) + 1) + between[k]
                _, first, back = np.unique(place, return_index=True, return_inverse=True)
                worth[mask] = value(bins[first], inside)[back]
            phi = [sum(weight[bin(s).count("1")] * (worth[s | 1 << k] - worth[s]) for s in range(2**n) if not s >> k & 1) for k in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(worth[0]), pa.array(worth[-1]), *[pa.array(p) for p in phi]], names=[key, "base", "score", *[f"phi_{f}" for f in features]])

    fields = ", ".join([f"`{key}` {kind}", "base double", "score double", *[f"`phi_{f}` double" for f in features]])
    return spread(df.select(key, *plain(features)), key).mapInArrow(run, fields)


# selection of features


@dataclass
class Gram:
    """Per fold the products of (1, standardised features, y) summed over its rows."""

    features: list[str]
    folds: list[int]
    sums: np.ndarray

    def held_out(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rmse, r2) of each fold by the least-squares plane of the other folds on these features."""
        at = [0, *sorted(1 + self.features.index(f) for f in names)]
        every, rmse, r2 = self.sums.sum(0), [], []
        for own in self.sums:
            rest = every - own
            a = rest[np.ix_(at, at)]
            b = np.linalg.solve(a + 1e-9 * max(a[0, 0], 1.0) * np.eye(len(at)), rest[at, -1])
            sse = max(own[-1, -1] - 2 * b @ own[at, -1] + b @ own[np.ix_(at, at)] @ b, 0.0)
            n = own[0, 0]
            spread = own[-1, -1] - own[0, -1] ** 2 / n
            rmse.append(np.sqrt(sse / n))
            r2.append(1 - sse / spread if spread > 0 else np.nan)
        return np.array(rmse), np.array(r2)


def gram(df: DataFrame, features: list[str], y: Column, fold: Column) -> Gram:
    """The products of all features by fold: one pass for means and deviations, one for the sums. Rows with a null in a feature, y or the fold are left out.

    Tasks send a matrix per fold; these are added up on executors, and the driver gets one per fold.
    """
    rows = df.select(*plain(features), y.cast("double").alias("_y"), fold.cast("long").alias("_fold")).na.drop()
    one = rows.agg(*[F.struct(F.avg(f"_feature_{f}").alias("m"), F.stddev_pop(f"_feature_{f}").alias("s")).alias(str(k)) for k, f in enumerate(features)]).first()
    mean, spread = np.array([x.m or 0.0 for x in one]), np.array([x.s or 1.0 for x in one])
    width = len(features) + 2

    def packed(sums: dict):
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["fold", "sums"])

    def products(batches):
        sums = {}
        for batch in batches:
            x = np.column_stack([batch.column(k).to_numpy() for k in range(len(features) + 1)])
            z = np.column_stack([np.ones(len(x)), (x[:, :-1] - mean) / spread, x[:, -1]])
            at = batch["_fold"].to_numpy()
            for f in np.unique(at):
                mine = z[at == f]
                sums[int(f)] = sums.get(int(f), 0) + mine.T @ mine
        yield from packed(sums)

    def added(batches):
        sums = {}
        for batch in batches:
            for f, x in zip(batch["fold"].to_pylist(), batch["sums"].to_pylist(), strict=True):
                sums[f] = sums.get(f, 0) + np.frombuffer(x, float).reshape(width, width)
        yield from packed(sums)

    schema = "fold bigint, sums binary"
    got = sorted((r.fold, np.frombuffer(r.sums, float).reshape(width, width)) for r in rows.mapInArrow(products, schema).repartition("fold").mapInArrow(added, schema).collect())
    return Gram(features, [f for f, _ in got], np.array([x for _, x in got]))


def selected(products: Gram, least: int, most: int, fixed: tuple[str, ...] = (), forward: bool = True, floating: bool = True) -> dict[int, tuple[list[str], np.ndarray]]:
    """size: (features, rmse by fold), the best set found of each size from least to most.

    A step adds (or, backward, removes) the feature that leaves the lowest mean rmse; floating, steps back follow while they beat
    what was found of that size before. `fixed` stay in every set. Ties go to the feature named first. No pass over rows.
    """
    names, seen = products.features, {}

    def score(some: frozenset) -> tuple[float, np.ndarray]:
        if some not in seen:
            rmse = products.held_out([f for f in names if f in some])[0]
            seen[some] = (round(float(rmse.mean()), 12), rmse)
        return seen[some]

    def step(now: frozenset, add: bool, but: str | None = None) -> tuple[frozenset, str] | None:
        moves = [f for f in names if (f not in now if add else f in now and f not in fixed) and f != but]
        made = [(now | {f} if add else now - {f}, f) for f in moves]
        return min(made, key=lambda m: score(m[0])[0], default=None)

    now, best = frozenset(fixed) if forward else frozenset(names), {}
    end = most if forward else max(least, len(fixed))
    if now:
        best[len(now)] = now
    while len(now) != end:
        move = step(now, forward)
        if not move:
            break
        now, last = move
        if len(now) not in best or score(now)[0] < score(best[len(now)])[0]:
            best[len(now)] = now
        while floating and len(now) != end:
            back = step(now, not forward, last)
            if not back or not back[0] or len(back[0]) not in best or score(back[0])[0] >= score(best[len(back[0])])[0]:
                break
            now = best[len(back[0])] = back[0]
    return {k: ([f for f in names if f in s], score(s)[1]) for k, s in sorted(best.items()) if least <= k <= most}


# refinement of one parameter


def compared_fits(df: DataFrame, sets: dict[str, list[str]], key: str, y: Column, fold: Column, loss: Loss, **grow) -> DataFrame:
    """(columns, size, n, rmse, deviance, r2) of a boosted fit on each set of features, means over the folds held out; a training per set, the same folds."""
    out = None
    for name, features in sets.items():
        model = train(df, features, y, fold, loss, **grow)
        got = out_of_fold(df, model, key, fold, y.isNotNull(), "m").join(df.select(key, y.alias("y"), fold.alias("fold")).filter("y is not null"), key)
        one = fold_metrics(got, "fold", "y", ["m"]).agg(F.sum("n").alias("n"), *[F.avg(x).alias(x) for x in ("rmse", "deviance", "r2")])
        one = one.select(F.lit(name).alias("columns"), F.lit(len(features)).alias("size"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def refined(df: DataFrame, loss: Callable[[float], Column], low: float, high: float, points: int = 9, steps: int = 12, ahead: int = 4) -> list[dict]:
    """The least mean loss on a grid of points over low .. high, then golden-section steps in the bracket around it.

    One pass reads the whole grid; each later pass reads every probe that the next `ahead` steps may ask for (under 2^(ahead + 1)
    means of one scan), so `steps` steps take steps / ahead passes. Rows whose loss is null don't count. Returned: a dict
    (step, low, high, x, loss) for the grid's best (step 0), each bracket after its step (loss null) and the middle of the last.
    """
    ratio, known = (5.0**0.5 - 1.0) / 2.0, {}

    def read(xs: list[float]) -> None:
        xs = [x for x in dict.fromkeys(xs) if x not in known]
        if xs:
            known.update(zip(xs, df.agg(*[F.avg(loss(x)).alias(str(k)) for k, x in enumerate(xs)]).first(), strict=True))

    def below(a: float, b: float) -> bool:
        return known[a] is not None and (known[b] is None or known[a] < known[b])

    def after(state: tuple, left: bool) -> tuple:
        lo, hi, x, y = state
        return (lo, y, y - ratio * (y - lo), x) if left else (x, hi, y, x + ratio * (hi - x))

    width = (high - low) / (points - 1)
    grid = [low + k * width for k in range(points)]
    read(grid)
    best = min(grid, key=lambda x: (known[x] is None, known[x]))
    lo, hi = max(low, best - width), min(high, best + width)
    trace = [{"step": 0, "low": lo, "high": hi, "x": best, "loss": known[best]}]
    state = (lo, hi, hi - ratio * (hi - lo), lo + ratio * (hi - lo))
    for k in range(steps):
        if k % ahead == 0:
            layer, probes = [state], [*state[2:]]
            for _ in range(min(ahead, steps - k) - 1):
                layer = [after(s, left) for s in layer for left in (True, False)]
                probes += [x for s in layer for x in s[2:]]
            read(probes)
        state = after(state, below(state[2], state[3]))
        trace.append({"step": k + 1, "low": state[0], "high": state[1], "x": (state[0] + state[1]) / 2, "loss": None})
    read([trace[-1]["x"]])
    trace.append({"step": steps + 1, "low": state[0], "high": state[1], "x": trace[-1]["x"], "loss": known[trace[-1]["x"]]})
    return trace


# counts


def count_fit(df: DataFrame, group: str, count: str, rounds: int = 40) -> DataFrame:
    """group, n, mu, alpha, inflation, converged: a zero-inflated generalised Poisson law fitted by likelihood to the counts of each group.

    ln f(y) = y ln mu + (y - 1) ln(1 + alpha y) - y ln(1 + alpha mu) - ln y! - mu (1 + alpha y) / (1 + alpha mu). The share of
    zeros over those of f is fitted exactly by the inflation, so mu and alpha come from the counts over zero alone: Newton steps
    over rows per distinct count, inside one expression. Null and negative counts are left out; a group needs two distinct counts over zero,
    else mu is null. inflation is negative where there are fewer zeros than f has; `converged`: a last step under 1e-9.
    """
    per = df.select(group, c(count).cast("long").alias("y")).filter("y >= 0").groupBy(group, "y").agg(F.count("*").alias("m"))
    one = per.groupBy(group).agg(F.sum("m").alias("n"), F.sum(F.when(c("y") == 0, c("m")).otherwise(0)).alias("zeros"), F.array_sort(F.collect_list(F.when(c("y") > 0, F.struct(c("y").cast("double").alias("y"), c("m").cast("double").alias("m"))))).alias("ys"))
    total = lambda f: F.aggregate("ys", F.lit(0.0), lambda s, r: s + r["m"] * f(r["y"]))
    one = one.withColumns({"_some": total(lambda y: F.lit(1.0)), "_most": F.array_max(F.transform("ys", lambda r: r["y"]))})
    one = one.withColumn("_mean", total(lambda y: y) / F.nullif("_some", F.lit(0.0)))
    one = one.withColumn("_alpha", (F.sqrt(total(lambda y: (y - c("_mean")) * (y - c("_mean"))) / F.nullif("_some", F.lit(0.0)) / c("_mean")) - 1) / c("_mean"))
    state = lambda mu, alpha, moved: F.struct(mu.alias("mu"), alpha.alias("alpha"), moved.alias("moved"))
    lowest = -0.9 / F.greatest(c("_most"), c("_mean"))

    def let(values: dict[str, Column], f: Callable) -> Column:
        """f of values worked out once."""
        return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f), F.lit(0))

    def slopes(mu: Column, alpha: Column) -> Column:
        """Sums of the first and second derivatives (m, a, mm, ma, aa) over counts above zero, without the truncation."""
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("m", "a", "mm", "ma", "aa")])

        def add(s, r):
            y, w, up, t = r["y"], r["m"], 1 + alpha * mu, 1 + alpha * r["y"]
            parts = {
                "m": y / (mu * up) - t / (up * up),
                "a": y * (y - 1) / t - y * mu / up - mu * (y - mu) / (up * up),
                "mm": -y * (1 + 2 * alpha * mu) / (mu * mu * up * up) + 2 * alpha * t / (up * up * up),
                "ma": -y / (up * up) - (y * up - 2 * t * mu) / (up * up * up),
                "aa": -y * y * (y - 1) / (t * t) + y * mu * mu / (up * up) + 2 * mu * mu * (y - mu) / (up * up * up),
            }
            return F.struct(*[(s[k] + w * v).alias(k) for k, v in parts.items()])

        return F.aggregate("ys", zero, add)

    def newton(s: Column, _: Column) -> Column:
        mu, alpha, n = s["mu"], s["alpha"], c("_some")
        up = 1 + alpha * mu
        values = {"s": slopes(mu, alpha), "r": 1 / (F.exp(mu / up) - 1), "gm": 1 / (up * up), "ga": -mu * mu / (up * up), "gmm": -2 * alpha / (up * up * up), "gma": -2 * mu / (up * up * up), "gaa": 2 * mu * mu * mu / (up * up * up)}

        def whole(v):
            cut = lambda x, y, xy: n * (v["r"] * v[xy] - v["r"] * (1 + v["r"]) * v[x] * v[y])
            h = {"m": v["s"]["m"] - n * v["r"] * v["gm"], "a": v["s"]["a"] - n * v["r"] * v["ga"], "mm": v["s"]["mm"] - cut("gm", "gm", "gmm"), "ma": v["s"]["ma"] - cut("gm", "ga", "gma"), "aa": v["s"]["aa"] - cut("ga", "ga", "gaa")}
            return let(h, lambda d: moved(d))

        def moved(d):
            det = d["mm"] * d["aa"] - d["ma"] * d["ma"]
            peak = (det > 0) & (d["mm"] < 0)  # elsewhere each parameter climbs by its own curvature
            dm = F.when(peak, (d["ma"] * d["a"] - d["aa"] * d["m"]) / det).otherwise(d["m"] / F.abs(d["mm"]))
            da = F.when(peak, (d["ma"] * d["m"] - d["mm"] * d["a"]) / det).otherwise(d["a"] / F.abs(d["aa"]))
            to = {"mu": F.least(F.greatest(mu + dm, mu / 2), mu * 2), "alpha": F.greatest(F.least(F.greatest(alpha + da, alpha - 0.2), alpha + 0.2), lowest, -0.9 / mu)}
            return let(to, lambda t: state(t["mu"], t["alpha"], F.greatest(F.abs(t["mu"] - mu), F.abs(t["alpha"] - alpha))))

        return let(values, whole)

    enough = F.size("ys") >= 2
    start = state(F.greatest(c("_mean"), F.lit(0.1)), F.greatest(c("_alpha"), lowest), F.lit(1.0))
    fit = one.withColumn("_fit", F.when(enough, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, newton)))
    none = F.exp(-c("_fit.mu") / (1 + c("_fit.alpha") * c("_fit.mu")))
    return fit.select(group, "n", c("_fit.mu").alias("mu"), c("_fit.alpha").alias("alpha"), ((c("zeros") / c("n") - none) / (1 - none)).alias("inflation"), (c("_fit.moved") < 1e-9).alias("converged"))


def count_expected(fits: DataFrame, most: int) -> DataFrame:
    """fits with k from 0 to most and `expected`, the rows that the fitted law of count_fit() has at k."""
    rows = fits.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(most)).cast("array<bigint>")))
    up, t, y = 1 + c("alpha") * c("mu"), 1 + c("alpha") * c("k"), c("k")
    logs = F.aggregate(F.sequence(F.lit(0), y), F.lit(0.0), lambda s, j: s + F.when(j > 1, F.ln(j)).otherwise(0.0))
    f = F.when(t > 0, F.exp(y * F.ln("mu") + (y - 1) * F.ln(t) - y * F.ln(up) - logs - c("mu") * t / up)).when(t <= 0, 0.0)
    return rows.withColumn("expected", c("n") * ((1 - c("inflation")) * f + F.when(y == 0, c("inflation")).otherwise(0.0)))


# search over slots

State = tuple[tuple[str, float], ...]


def drawn(rng: np.random.Generator, families: list[str], low: float, high: float, slots: tuple[int, int]) -> State:
    """A state of random slots (family, shift)."""
    return tuple((families[rng.integers(len(families))], float(rng.uniform(low, high))) for _ in range(rng.integers(slots[0], slots[1] + 1)))


def moved(rng: np.random.Generator, state: State, families: list[str], low: float, high: float, slots: tuple[int, int], spread: float) -> tuple[str, State]:
    """(move, state): up to three slots shifted, one added, one removed, or one of another family in its place; a move that the bounds forbid is not drawn."""
    moves = {"mutate": 0.55, "add": 0.15 * (len(state) < slots[1]), "remove": 0.15 * (len(state) > slots[0]), "swap": 0.15 * (len(families) > 1)}
    move = str(rng.choice(list(moves), p=np.array(list(moves.values())) / sum(moves.values())))
    out, at = list(state), int(rng.integers(len(state)))
    if move == "mutate":
        for k in rng.choice(len(out), rng.integers(1, min(3, len(out)) + 1), replace=False):
            out[k] = (out[k][0], float(np.clip(out[k][1] + rng.normal(0, spread), low, high)))
    elif move == "add":
        out += drawn(rng, families, low, high, (1, 1))
    elif move == "remove":
        del out[at]
    else:
        others = [f for f in families if f != out[at][0]]
        out[at] = (others[rng.integers(len(others))], float(rng.uniform(low, high)))
    return move, tuple(out)


def scored_states(df: DataFrame, states: list[State], predict: Callable[[State], Column], y: Column) -> list[tuple[float, float, float]]:
    """(rmse, mean Poisson deviance, r2) of each state's prediction, not under 1e-3, from one pass for all; rows whose y or prediction is null don't count."""
    made = df.withColumns({"_y": y.cast("double"), **{f"_m{k}": predict(s) for k, s in enumerate(states)}})
    named = made.withColumns({f"_m{k}": F.when(c(f"_m{k}") > 1e-3, c(f"_m{k}")).when(c(f"_m{k}").isNotNull(), 1e-3) for k in range(len(states))})
    sums = []
    for k in range(len(states)):
        m, use = c(f"_m{k}"), c("_y").isNotNull() & c(f"_m{k}").isNotNull()
        error = F.when(use, (c("_y") - m) * (c("_y") - m))
        dev = F.when(use, 2 * (F.when(c("_y") > 0, c("_y") * F.ln(c("_y") / m)).otherwise(0.0) - c("_y") + m))
        sums += [F.avg(error).alias(f"e{k}"), F.avg(dev).alias(f"d{k}"), F.var_pop(F.when(use, c("_y"))).alias(f"v{k}")]
    r = named.agg(*sums).first()
    none = float("nan")
    return [(r[f"e{k}"] ** 0.5, r[f"d{k}"], 1 - r[f"e{k}"] / r[f"v{k}"] if r[f"v{k}"] else none) if r[f"e{k}"] is not None else (none, none, none) for k in range(len(states))]


def slot_search(df: DataFrame, predict: Callable[[State], Column], y: Column, families: list[str], low: float, high: float, slots: tuple[int, int] = (1, 4), rounds: int = 6, batch: int = 8, segments: int = 2, spread: float = 0.3, seed: int = 0) -> list[dict]:
    """The history of a seeded search: from a random state of each segment, `batch` moves a round, all scored in one pass over the rows.

    A trial is accepted if it beats the state at the round's start on two of rmse, deviance and r2; the accepted one of the least
    deviance (of equals the first) is where the next round starts. What reaches the driver are three numbers a trial.
    """
    rng, out = np.random.default_rng(seed), []
    for segment in range(segments):
        state = drawn(rng, families, low, high, slots)
        (now,) = scored_states(df, [state], predict, y)
        out.append({"segment": segment, "round": 0, "trial": 0, "move": "start", "state": state, "rmse": now[0], "deviance": now[1], "r2": now[2], "accepted": True})
        for k in range(1, rounds + 1):
            trials = [moved(rng, state, families, low, high, slots, spread) for _ in range(batch)]
            scores, kept = scored_states(df, [s for _, s in trials], predict, y), None
            for t, ((move, s), x) in enumerate(zip(trials, scores, strict=True)):
                good = (x[0] < now[0]) + (x[1] < now[1]) + (x[2] > now[2]) >= 2
                out.append({"segment": segment, "round": k, "trial": t, "move": move, "state": s, "rmse": x[0], "deviance": x[1], "r2": x[2], "accepted": good})
                if good and (kept is None or x[1] < kept[1][1]):
                    kept = (s, x)
            state, now = kept or (state, now)
    return out
