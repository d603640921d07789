"""Gradient boosting on Spark: the models of all folds, and one of all rows, grow in the same passes.

Model k < folds is trained on the rows of every fold but k, the last model on all. A pass over the rows makes, in numpy on
batches, histograms of slopes by model, node, feature and bin; Spark deals them by (model, node), a task adds up those of its
nodes and returns the best split of each, so the driver sees one row per node. A level of all trees is one job, and a round of
depth d is d jobs. Rows hold bins (one byte per feature) and margins; margins are brought up to date from the trees in each pass and written
every CUT rounds, so a lost executor costs no more than its partitions of these rounds.

A row's own label never moves the margin that predicts it out of fold: folds, bins (of features alone) and the sums of model k
leave fold k out. Null features have a bin of their own, below all others. Rows without label or weight are predicted only. Equal gains go to the
first feature and lowest cut.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycensus.operators.lineage import cut, spread

BINS, CUT = 32, 5
SCORES = ["exp_num_opps", "quantile_opps", "prob"]
c = F.col


@dataclass(frozen=True)
class Loss:
    """poisson (margin: log of the mean), logistic (log odds) or quantile (the level's value itself)."""

    name: str
    level: float = 0.5

    def slopes(self, y: np.ndarray, w: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slope and curvature for each row and model."""
        y, w = y[:, None], w[:, None]
        if self.name == "poisson":
            mean = np.exp(np.clip(m, -30, 30))
            return w * (y - mean), w * mean
        if self.name == "logistic":
            p = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
            return w * (y - p), w * p * (1 - p)
        # counts often lie on their quantile: those are under it as well, or a quantile that is the least count would find no split
        return w * (self.level - (y <= m)), w + 0 * m

    def response(self, m: np.ndarray) -> np.ndarray:
        return np.exp(m) if self.name == "poisson" else 1 / (1 + np.exp(-m)) if self.name == "logistic" else m

    def leaf(self, g: float, h: float) -> float:
        """What a leaf adds to the margin; the quantile's leaves come from sketches instead."""
        if self.name == "poisson":
            return float(np.log((g + h + 0.1) / (h + 0.1)))
        return float(g / (h + 1.0))


@dataclass
class Model:
    features: list[str]
    edges: list[np.ndarray]
    loss: Loss
    base: np.ndarray
    rate: float
    #: A tree: features [models, nodes], cuts [models, nodes], values [models, leaves]; right where bin > cut.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, len(self.features)), np.uint8)
        for k, (name, edges) in enumerate(zip(self.features, self.edges, strict=True)):
            x = batch[f"_feature_{name}"].to_numpy(zero_copy_only=False).astype(float)
            out[:, k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(edges, np.nan_to_num(x, nan=0.0), side="left"))
        return out

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.repeat(self.base[None, :], len(bins), axis=0)
        for tree in self.trees:
            out += self.rate * values(tree, bins)
        return out

    def unseen(self, batch: pa.RecordBatch) -> np.ndarray:
        """Mean of the responses of the fold models, for rows that none of them was trained on; without folds that of the one model."""
        made = self.loss.response(self.margins(self.bins(batch)))
        return (made[:, :-1] if made.shape[1] > 1 else made).mean(axis=1)


def leaves(feature: np.ndarray, cuts: np.ndarray, bins: np.ndarray, depth: int) -> np.ndarray:
    """Place of each row at this depth, from 0, by model. A node compares whole columns of bytes, which takes less than to gather a byte for each row."""
    across, out = np.ascontiguousarray(bins.T), np.zeros((len(feature), len(bins)), np.int64)
    for k in range(len(feature)):
        at = np.zeros(len(bins), np.uint8 if depth < 8 else np.int64)
        for level in range(depth):
            right, first = np.zeros(len(bins), bool), 2**level - 1
            for node in range(2**level):
                right |= (at == node) & (across[feature[k, first + node]] > int(cuts[k, first + node]))
            at = 2 * at + right
        out[k] = at
    return np.ascontiguousarray(out.T)


def values(tree: tuple, bins: np.ndarray) -> np.ndarray:
    feature, cuts, value = tree
    return value[np.arange(len(feature))[None, :], leaves(feature, cuts, bins, int(np.log2(value.shape[1])))]


def plain(features: list[str]) -> list[Column]:
    """The features as doubles under names that clash with no others."""
    return [c(f).cast("double").alias(f"_feature_{f}") for f in features]


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of the bins of each feature, quantiles of its values without labels: one pass, bins - 1 numbers a feature."""
    marks = [k / bins for k in range(1, bins)]
    one = df.agg(*[F.percentile_approx(c(f).cast("double"), marks, 10_000).alias(f"_{k}") for k, f in enumerate(features)]).first()
    return [np.unique(np.array([x for x in (one[k] or []) if x is not None and not np.isnan(x)], float)) for k in range(len(features))]


def _lists(m: np.ndarray) -> pa.Array:
    """The rows of m as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).ravel()))


def _batch(batch: pa.RecordBatch, n: int, models: int):
    """fold, y, w, bins and margins of a batch of rows."""
    bins = np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(batch.num_rows, n)
    margins = batch["margins"].values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, models) if batch.num_rows else np.zeros((0, models))
    return batch["fold"].to_numpy(), batch["y"].to_numpy(), batch["w"].to_numpy(), bins, margins


def _histograms(rows: DataFrame, loss: Loss, fresh: list, tree: tuple, depth: int, rate: float, n: int, models: int, bins: int) -> DataFrame:
    """(node, sums): per partition and node (model * nodes + place) the sums of slope, curvature and rows by feature and bin."""
    nodes, width = 2**depth, bins + 1

    def run(batches):
        sums = np.zeros((models * nodes, 3, n, width))
        for batch in batches:
            fold, y, w, b, m = _batch(batch, n, models)
            for t in fresh:
                m = m + rate * values(t, b)
            g, h = loss.slopes(y, w, m)
            at = leaves(tree[0], tree[1], b, depth)
            for k in range(models):
                mine = np.flatnonzero(fold != k)
                at_k, b_k, g_k, h_k = at[mine, k] * width, b.T[:, mine], g[mine, k], h[mine, k]
                for f in range(n):
                    place = at_k + b_k[f]
                    for j, x in enumerate((g_k, h_k, None)):
                        sums[k * nodes : (k + 1) * nodes, j, f] += np.bincount(place, x, nodes * width).reshape(nodes, width)
        some = np.flatnonzero(sums[:, 2, 0].sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([sums[k].tobytes() for k in some], pa.binary())], names=["node", "sums"])

    return rows.mapInArrow(run, "node bigint, sums binary")


def _best(sums: np.ndarray, least: int) -> tuple[int, int, np.ndarray]:
    """Feature, cut and the sums (slope, curvature) left and right of the best split; all go left where none gains."""
    left = sums.cumsum(axis=2)[:, :, :-1]
    every = sums.sum(axis=2)[:, :, None]
    right = every - left
    score = lambda x: x[0] ** 2 / (x[1] + 1.0)
    gain = np.round(score(left) + score(right) - score(every), 9)
    gain[(left[2] < least) | (right[2] < least)] = 0
    f, at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[f, at] <= 1e-9:
        return 0, 255, np.array([every[0, 0, 0], every[1, 0, 0], 0.0, 0.0])
    return int(f), int(at), np.array([left[0, f, at], left[1, f, at], right[0, f, at], right[1, f, at]])


def _splits(histograms: DataFrame, n: int, bins: int, least: int) -> list:
    """(node, feature, cut, sums) of every node, the histograms of all partitions added up on the executors."""

    def run(batches):
        now, total, out = None, None, []
        for batch in batches:
            for node, sums in zip(batch["node"].to_pylist(), batch["sums"].to_pylist(), strict=True):
                if node != now:
                    out += [(now, *_best(total, least))] if now is not None else []
                    now, total = node, 0
                total = total + np.frombuffer(sums, float).reshape(3, n, bins + 1)
        out += [(now, *_best(total, least))] if now is not None else []
        if out:
            node, f, at, s = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(f), pa.array(at), pa.array([x.tolist() for x in s], pa.list_(pa.float64()))], names=["node", "feature", "cut", "sums"])

    return histograms.repartition("node").sortWithinPartitions("node").mapInArrow(run, "node bigint, feature bigint, cut bigint, sums array<double>").collect()


def _leaf_quantiles(rows: DataFrame, fresh: list, tree: tuple, depth: int, rate: float, n: int, models: int, levels: list[float]) -> dict[tuple[int, int], list[float]]:
    """Quantiles of the residuals in each leaf of each model by mergeable sketches: one row per leaf and model."""

    def run(batches):
        for batch in batches:
            fold, y, _, b, m = _batch(batch, n, models)
            for t in fresh:
                m = m + rate * values(t, b)
            at = leaves(tree[0], tree[1], b, depth)
            keep = fold[:, None] != np.arange(models)[None, :]
            k = np.broadcast_to(np.arange(models), at.shape)
            yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(at[keep]), pa.array((y[:, None] - m)[keep])], names=["model", "leaf", "rest"])

    each = rows.mapInArrow(run, "model bigint, leaf bigint, rest double")
    got = each.groupBy("model", "leaf").agg(F.percentile_approx("rest", levels, 10_000).alias("q")).collect()
    return {(r["model"], r["leaf"]): r["q"] for r in got}


def train(df: DataFrame, features: list[str], y: Column, fold: Column, loss: Loss, weight: Column | None = None, folds: int = 8, rounds: int = 10, depth: int = 3, rate: float = 0.3, least: int = 20, bins: int = BINS) -> Model:
    """The model of all folds. `least`: rows that a leaf needs; for a quantile level it should be 1 / level and more."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    named = df.select(*plain(features), y.cast("double").alias("y"), fold.cast("long").alias("fold"), w.alias("w")).filter("y is not null and w > 0 and fold is not null")
    named = spread(named, *named.columns)
    models, n = folds + 1, len(features)
    model = Model(features, bin_edges(df, features, bins), loss, np.zeros(models), rate)
    if loss.name == "quantile":
        one = named.agg(*[F.percentile_approx(F.when(c("fold") != k, c("y")), loss.level, 10_000).alias(str(k)) for k in range(models)]).first()
        model.base = np.array([x or 0.0 for x in one], float)
    else:
        per = {r["fold"]: (r["a"], r["b"]) for r in named.groupBy("fold").agg(F.sum(c("w") * c("y")).alias("a"), F.sum("w").alias("b")).collect()}
        mean = np.array([sum(a for f, (a, _) in per.items() if f != k) / max(sum(b for f, (_, b) in per.items() if f != k), 1e-12) for k in range(models)])
        mean = np.clip(mean, 1e-6, 1 - 1e-6 if loss.name == "logistic" else 1e12)
        model.base = np.log(mean) if loss.name == "poisson" else np.log(mean / (1 - mean))

    def prepare(batches):
        for batch in batches:
            b = model.bins(batch)
            m = _lists(np.repeat(model.base[None, :], len(b), axis=0))
            yield pa.RecordBatch.from_arrays([batch["fold"], batch["y"], batch["w"], pa.array([x.tobytes() for x in b], pa.binary()), m], names=["fold", "y", "w", "bins", "margins"])

    schema = "fold bigint, y double, w double, bins binary, margins array<double>"
    rows, fresh = cut(named.mapInArrow(prepare, schema)), []
    for k in range(rounds):
        feature, cuts, value = np.zeros((models, 2**depth - 1), np.int64), np.full((models, 2**depth - 1), 255), np.zeros((models, 2**depth))
        for level in range(depth):
            made = _splits(_histograms(rows, loss, fresh, (feature, cuts), level, rate, n, models, bins), n, bins, least)
            for r in made:
                m, at = divmod(r["node"], 2**level)
                feature[m, 2**level - 1 + at], cuts[m, 2**level - 1 + at] = r["feature"], r["cut"]
                if level == depth - 1 and loss.name != "quantile":
                    value[m, 2 * at : 2 * at + 2] = loss.leaf(*r["sums"][:2]), loss.leaf(*r["sums"][2:])
        if loss.name == "quantile":
            for (m, at), q in _leaf_quantiles(rows, fresh, (feature, cuts), depth, rate, n, models, [loss.level]).items():
                value[m, at] = q[0] / (rate if k == rounds - 1 else 1.0)  # the last step is a whole one: short of it no leaf is at its level
        model.trees.append((feature, cuts, value))
        fresh.append(model.trees[-1])
        if len(fresh) == CUT and k < rounds - 1:
            done = list(fresh)

            def moved(batches, done=done):
                for batch in batches:
                    _, _, _, b, m = _batch(batch, n, models)
                    for t in done:
                        m = m + rate * values(t, b)
                    yield pa.RecordBatch.from_arrays([batch[x] for x in ("fold", "y", "w", "bins")] + [_lists(m)], names=["fold", "y", "w", "bins", "margins"])

            rows, fresh = cut(rows.mapInArrow(moved, schema)), []
    return model


def predict(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep and margins, those of the fold models and at the end that of all rows; features may be null."""
    n = len(keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches):
        for batch in batches:
            made = model.margins(model.bins(batch))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(n)], _lists(made)], names=[*keep, "margins"])

    return df.select(*keep, *plain(model.features)).mapInArrow(run, f"{fields}, margins array<double>")


def response(loss: Loss, margin: Column) -> Column:
    return F.exp(margin) if loss.name == "poisson" else 1 / (1 + F.exp(-margin)) if loss.name == "logistic" else margin


def out_of_fold(df: DataFrame, model: Model, key: str, fold: Column, trained: Column, name: str) -> DataFrame:
    """(key, name): for trained rows the prediction of the model that left their fold out, for others that of all rows."""
    rows = predict(df.withColumns({"_fold": fold.cast("int"), "_trained": F.coalesce(trained, F.lit(False))}), model, [key, "_fold", "_trained"])
    own = F.when(c("_trained") & c("_fold").isNotNull(), F.get("margins", c("_fold"))).otherwise(F.element_at("margins", -1))
    return rows.select(key, response(model.loss, own).alias(name))


@dataclass(frozen=True)
class Cascade:
    """The three models in a row: each sees what those before it say."""

    mean: Model
    low: Model
    odds: Model

    def score(self, df: DataFrame) -> DataFrame:
        """df with exp_num_opps, quantile_opps and prob of rows that stood in no training, in one pass; columns of these names are replaced.

        Features are read by name and may be null; all three scores are the means of the fold models."""
        keep = [x for x in df.columns if x not in SCORES]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

        def run(batches):
            for batch in batches:
                mean = self.mean.unseen(batch) + 1
                batch = batch.append_column("_feature_exp_num_opps", pa.array(mean))
                low = self.low.unseen(batch) + 1
                batch = batch.append_column("_feature_quantile_opps", pa.array(low))
                made = [pa.array(x) for x in (mean, low, self.odds.unseen(batch))]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], *made], names=[*keep, *SCORES])

        return df.select(*keep, *plain(self.mean.features)).mapInArrow(run, f"{fields}, " + ", ".join(f"{x} double" for x in SCORES))


def fitted_cascade(df: DataFrame, features: list[str], key: str, fold: Column, count: Column, past: Column, level: float = 0.006, **grow) -> tuple[Cascade, DataFrame]:
    """The models, and key, exp_num_opps, quantile_opps, prob: count less one by its mean and low quantile, then whether it is past the threshold.

    Each model sees the out-of-fold output of those before it, with the same folds. Rows whose count is null are predicted only."""
    had, y = count.isNotNull(), count - 1
    mean = train(df, features, y, fold, Loss("poisson"), **grow)
    rows = df.join(out_of_fold(df, mean, key, fold, had, "exp_num_opps").withColumn("exp_num_opps", c("exp_num_opps") + 1), key)
    few = {**grow, "least": max(grow.get("least", 20), round(1 / level)), "rounds": max(1, grow.get("rounds", 10) // 3), "depth": 2}
    low = train(rows, [*features, "exp_num_opps"], y, fold, Loss("quantile", level), **few)
    rows = rows.join(out_of_fold(rows, low, key, fold, had, "quantile_opps").withColumn("quantile_opps", c("quantile_opps") + 1), key)
    odds = train(rows, [*features, "exp_num_opps", "quantile_opps"], F.when(had, past.cast("int")), fold, Loss("logistic"), **grow)
    got = out_of_fold(rows, odds, key, fold, had, "prob")
    return Cascade(mean, low, odds), rows.select(key, "exp_num_opps", "quantile_opps").join(got, key)


def cascade(df: DataFrame, features: list[str], key: str, fold: Column, count: Column, past: Column, level: float = 0.006, **grow) -> DataFrame:
    """The scores of fitted_cascade() alone."""
    return fitted_cascade(df, features, key, fold, count, past, level, **grow)[1]


def pruned(rows: DataFrame, features: list[str], bounds: tuple[tuple[float, float], ...] = ((0.15, 0.88), (0.04, 2.0)), **grow) -> tuple[Model, DataFrame]:
    """The classifier of rows (features, label, weight, ...) after its prune rounds, and the rows that are left.

    A round drops rows of label 1 scored under its low bound and rows of label 0 scored over its high one by the model
    trained on them, and trains again."""
    none = F.lit(-1)  # no folds: every model would be the same, one is enough

    def fit(some: DataFrame) -> Model:
        return train(some, features, c("label"), none, Loss("logistic"), c("weight"), folds=0, **grow)

    model, left = fit(rows), rows
    for low, high in bounds:
        # the label goes with the key: an object may stand once in each class
        scored = predict(left, model, left.columns).withColumn("_p", response(model.loss, F.element_at("margins", -1)))
        wrong = ((c("label") == 1) & (c("_p") < low)) | ((c("label") == 0) & (c("_p") > high))
        left = cut(scored.filter(~wrong).drop("margins", "_p"))
        model = fit(left)
    return model, left


def score_or_fallback(df: DataFrame, model: Model, simple: Model, key: str, missing: Column, name: str) -> DataFrame:
    """(key, name): the model's probability rounded to 6, where `missing` that of the simple one."""
    p = lambda m: response(m.loss, F.element_at("margins", -1))
    one = predict(df.withColumn("_missing", missing), model, [key, "_missing"]).select(key, "_missing", p(model).alias("_p"))
    two = predict(df, simple, [key]).select(key, p(simple).alias("_s"))
    return one.join(two, key).select(key, F.round(F.when(c("_missing"), c("_s")).otherwise(c("_p")), 6).alias(name))


def quantile_levels(df: DataFrame, features: list[str], key: str, y: Column, fold: Column, levels: list[float], folds: int = 8, depth: int = 3, least: int = 40, bins: int = BINS) -> DataFrame:
    """(key, level, value): out-of-fold lower quantiles at all levels from one tree per fold model.

    The trees are grown once, on the mean; the sketches of their leaves are then read at every level in one pass."""
    shape = train(df, features, y, fold, Loss("poisson"), folds=folds, rounds=1, depth=depth, rate=1.0, least=least, bins=bins)
    feature, cuts, _ = shape.trees[0]
    models, n = folds + 1, len(features)
    blank = Model(features, shape.edges, shape.loss, np.zeros(models), 1.0)
    named = df.select(*plain(features), y.cast("double").alias("y"), fold.cast("long").alias("fold")).filter("y is not null and fold is not null")

    def prepare(batches):
        for batch in batches:
            b = blank.bins(batch)
            yield pa.RecordBatch.from_arrays([batch["fold"], batch["y"], pa.array(np.ones(len(b))), pa.array([x.tobytes() for x in b], pa.binary()), _lists(np.zeros((len(b), models)))], names=["fold", "y", "w", "bins", "margins"])

    rows = named.mapInArrow(prepare, "fold bigint, y double, w double, bins binary, margins array<double>")
    found = _leaf_quantiles(rows, [], (feature, cuts), depth, 1.0, n, models, levels)
    read = [Model(features, shape.edges, Loss("quantile", x), np.zeros(models), 1.0, [(feature, cuts, np.array([[found.get((m, at), [0.0] * len(levels))[k] for at in range(2**depth)] for m in range(models)]))]) for k, x in enumerate(levels)]
    out = None
    for m in read:
        part = out_of_fold(df, m, key, fold, y.isNotNull(), "value").select(key, F.lit(m.loss.level).alias("level"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def importance(df: DataFrame, model: Model, y: Column, fold: Column, seed: int = 0, block: int = 4096) -> DataFrame:
    """(feature, deviance, delta): mean Poisson deviance out of fold with each feature dealt anew among the rows of a block, less that as it is.

    One pass: a block's rows are permuted in place for every feature in turn, and only sums leave the task. The feature 'none' is the deviance as it is.
    A block is up to `block` neighbouring rows; which rows are neighbours hangs on the files read."""
    names = ["none", *model.features]
    rows = df.select(*plain(model.features), y.cast("double").alias("_y"), fold.cast("int").alias("_fold")).filter("_y is not null and _fold is not null")

    def run(batches):
        sums, n = np.zeros(len(names)), 0
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                batch = whole.slice(start, block)
                bins, y, own = model.bins(batch), batch["_y"].to_numpy(), batch["_fold"].to_numpy()
                order = np.random.default_rng(seed).permutation(len(y))
                for k in range(len(names)):
                    b = bins.copy()
                    if k:
                        b[:, k - 1] = b[order, k - 1]
                    m = np.maximum(np.exp(model.margins(b)[np.arange(len(y)), own]), 1e-3)
                    sums[k] += 2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / m), 0) - y + m).sum()
                n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums), pa.array(np.full(len(names), n))], names=["feature", "sum", "n"])

    per = rows.mapInArrow(run, "feature string, sum double, n bigint").groupBy("feature").agg((F.sum("sum") / F.sum("n")).alias("deviance"))
    whole = per.filter("feature = 'none'").select(c("deviance").alias("_plain"))  # one row
    return per.crossJoin(F.broadcast(whole)).select("feature", "deviance", (c("deviance") - c("_plain")).alias("delta"))
