"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lowers the text, maps homoglyphs and digit substitutions to one letter each and every other mark to
a blank. Lexicon entries, learned from labels, are whole words (two letters and more) or word beginnings (4 to 6
letters); their weights are smoothed log odds. A hit inside an exception phrase does not count. The sum of weights is normalised by length and
turned into a score by a fitted logistic. Null and empty texts have no hits and score low. Without labels
the lexicon is empty and every score is 0.
"""

from __future__ import annotations

import itertools
import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycensus.llm.common import cut, held_out, map_texts, table, training_rows

#: The lexicon is learned from at most so many labelled rows.
TRAIN_ROWS = 4000
SHORTEST_START, LONGEST_START = 4, 6
#: An entry is in so many toxic texts at least, and at most in this share of clean ones among all that hold it.
LEAST, IMPURE = 3, 0.05
#: Look-alikes of Latin letters, and digits and marks that stand for letters.
LOOKALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}


class Fold(dict):
    """A table for str.translate, filled as characters come up; l and i fold together, as 1 stands for both."""

    def __missing__(self, code: int):
        c = chr(code)
        if 0xFF01 <= code <= 0xFF5E:
            c = chr(code - 0xFEE0).lower()
        c = DIGITS.get(LOOKALIKE.get(c, c), LOOKALIKE.get(c, c))
        self[code] = got = "i" if c in "l|" else c if c.isalpha() else None if code in (0x200B, 0x200C, 0x200D, 0xAD) else " "
        return got


_FOLD = Fold()


def fold(text: str | None) -> str:
    return f" {(text or '').lower().translate(_FOLD)} "


def entries(words) -> set[str]:
    """Candidate entries: ' word ' for whole words of two letters and more, ' start' for beginnings of 4 to 6 letters."""
    out = {f" {w} " for w in words if len(w) > 1}
    for w in words:
        out.update(" " + w[:n] for n in range(SHORTEST_START, min(LONGEST_START, len(w)) + 1))
    return out


def machine(weights: dict[str, float], exceptions=()) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for e, w in weights.items():
        found.add_word(e, (e, w))
    for e in exceptions:
        found.add_word(e, (e, None))
    found.make_automaton()
    return found


def hits(found, folded: str) -> tuple[float, float]:
    """Sum of the weights that no exception covers, and the length norm."""
    got, spared = [], []
    if len(found):
        for end, (e, w) in found.iter(folded):
            (spared if w is None else got).append((end - len(e) + 2, end, w))
    at = {}
    for a, b, w in got:  # the heaviest entry at each place
        if not any(x <= a and b <= y for x, y, _ in spared):
            at[a] = max(w, at.get(a, 0.0))
    return sum(at.values()), (1 + folded.count(" ") / 8) ** 0.25


def spread(rows: DataFrame, make) -> DataFrame:
    """(doc_id, y, item) for each item of make(folded text)."""

    def run(batches):
        for batch in batches:
            for d, y, t in zip(*(batch[c].to_pylist() for c in ("doc_id", "y", "text")), strict=True):
                items = sorted(make(fold(t)))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(items), pa.int64()), pa.array([y] * len(items), pa.int32()), pa.array(items, pa.string())], names=["doc_id", "y", "item"])

    return rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id bigint, y int, item string")


def cover(able: dict[str, tuple[frozenset, int]], n_bad: int, n_good: int) -> dict[str, float]:
    """Weights of few entries (toxic texts that hold it, number of clean ones) that cover the toxic texts; log odds."""
    odds = lambda e: math.log((len(able[e][0]) + 0.5) / (n_bad + 1)) - math.log((able[e][1] + 0.5) / (n_good + 1))
    weights, left = {}, frozenset().union(*(k for k, _ in able.values()))
    alive = sorted(able, key=lambda e: (-len(able[e][0]), -len(e), e))
    while alive := [e for e in alive if len(able[e][0] & left) >= LEAST]:
        e = max(alive, key=lambda e: (len(able[e][0] & left), len(able[e][0]), e[-1] == " ", len(e), e))
        weights[e] = odds(e)
        left -= able[e][0]
    # entries that appear on their own strength too: as pure, and in a fiftieth of the toxic texts
    for e, (bad, good) in able.items():
        if e[-1] == " " and len(bad) >= max(8, n_bad / 50) and good == 0 and not any(e.startswith(x) for x in weights):
            weights[e] = odds(e)
    return weights


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    w, b = 1.0, -2.0
    for _ in range(50):  # ridge Newton steps
        p = 1 / (1 + np.exp(-np.clip(w * x + b, -35, 35)))
        r, d = p - y, p * (1 - p)
        grad = np.array([(r * x).sum() + 0.01 * w, r.sum() + 0.01 * b])
        hess = np.array([[(d * x * x).sum() + 0.01, (d * x).sum()], [(d * x).sum(), d.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        w, b = w - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(w), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = TRAIN_ROWS) -> dict:
    """Lexicon, exceptions and logistic from at most `bound` labelled texts.

    Texts stay on the executors: the driver gets the entries that at least LEAST toxic and hardly any clean texts hold,
    phrases that only clean texts hold, and one sum per text.
    """
    rows = cut(training_rows(docs, labels, label, bound).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.least(F.greatest("y", F.lit(0)), F.lit(1)).alias("y"), "text"))
    n_bad, n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    held = spread(rows, lambda t: entries(set(t.split()))).groupBy("item").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"), F.collect_list(F.when(F.col("y") == 1, F.col("doc_id"))).alias("ids"))
    held = held.filter((F.col("bad") >= LEAST) & (F.col("good") <= IMPURE * (F.col("bad") + F.col("good"))))
    able = {r["item"]: (frozenset(r["ids"]), r["good"]) for r in sorted(held.select("item", "good", "ids").collect(), key=lambda r: r["item"])}
    weights = cover(able, n_bad, n - n_bad)

    def phrases(text: str) -> set[str]:
        words = text.split()
        return {f" {a} {b} " for a, b in itertools.pairwise(words) if f" {a} " in weights}

    spared = spread(rows, phrases).groupBy("item").agg(F.sum("y").alias("bad"), F.count("*").alias("n")).filter((F.col("bad") == 0) & (F.col("n") >= LEAST))
    exceptions = sorted(r["item"] for r in spared.select("item").collect())
    kept: list = []

    def sums(texts):
        if not kept:
            kept.append(machine(weights, exceptions))
        return {"x": pa.array([s / norm for s, norm in (hits(kept[0], fold(t)) for t in texts)], pa.float64())}

    got = sorted(map(tuple, map_texts(rows, ["doc_id", "y"], "text", sums, "x double").collect()))
    w, b = logistic(np.array([x for *_, x in got] or [0.0]), np.array([y for _, y, _ in got] or [0.0], dtype=float))
    return {"weights": weights, "exceptions": exceptions, "w": w, "b": b}


def score(docs: DataFrame, keep: list[str], model: dict) -> DataFrame:
    """keep plus score."""
    kept: list = []

    def make(texts):
        if not kept:
            kept.append(machine(model["weights"], model["exceptions"]))
        out = []
        for t in texts:
            s, norm = hits(kept[0], fold(t))
            out.append(1 / (1 + math.exp(-max(-35, min(35, model["w"] * s / norm + model["b"])))) if model["weights"] else 0.0)
        return {"score": pa.array(out, pa.float64())}

    return map_texts(docs, keep, "text", make, "score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, ["doc_id"], fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic stay."""
    columns = ["doc_id", "lang", "source", "n_chars", "text"]
    scored = score(docs, columns, fit(docs, table(spark, sf_dir, "labels")))
    return scored.filter("score < 0.5").select("doc_id", "text", "lang", "source", "n_chars")
