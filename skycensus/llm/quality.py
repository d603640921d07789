"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features of a text are hashed counts of its words and of its runs of two and three words; added to these are
word shapes (case and marks kept, letters collapsed) and shape pairs that say whether a word was seen before.
They are scaled to length one, and a score is the logistic of a sparse dot product. Null and empty texts score by the intercept. With no labels every
score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycensus.llm.common import held_out, map_texts, table, training_rows

BITS = 18
#: The classifier is fitted on at most so many labelled rows.
TRAIN_ROWS = 4000
_LETTERS = re.compile(r"[^\W\d_]+")


def _shape(word: str) -> str:
    mark = lambda m: "A" if (s := m[0]).isupper() and len(s) > 1 else "C" if s[0].isupper() else "a"
    return re.sub(r"\d+", "0", _LETTERS.sub(mark, word))


@lru_cache(200_000)
def _codes(word: str) -> tuple[int, int]:
    return zlib.crc32(word.encode()), zlib.crc32(b"\x01" + _shape(word).encode())


def _mix(code: np.ndarray) -> np.ndarray:
    """32 bits of each 64-bit code, that depend on all of them."""
    return (code ^ code >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text; index 0 is the intercept."""
    words = (text or "").split()
    if not words:
        return np.array([0]), np.array([1.0])
    codes = np.array([_codes(w) for w in words], dtype=np.uint64)
    _, first = np.unique(codes[:, 0], return_index=True)
    seen = np.ones(len(words), dtype=np.uint64)
    seen[first] = 0
    same = np.concatenate(([0], codes[1:, 0] == codes[:-1, 0])).astype(np.uint64)
    shape = codes[:, 1]
    marks = seen + 2 * same + 5
    pairs = (shape[:-1] * np.uint64(0x9E3779B1) + shape[1:] * np.uint64(31) + marks[1:] * np.uint64(0x85EBCA6B)) & np.uint64(0xFFFFFFFF)
    word = codes[:, 0]
    two = _mix(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])
    three = _mix(two[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[2:])
    every = np.concatenate((word, two, three, shape, pairs, marks))
    at, n = np.unique((every * np.uint64(2654435761) >> np.uint64(8)) % np.uint64((1 << BITS) - 1) + np.uint64(1), return_counts=True)
    value = n / np.sqrt((n * n).sum())
    return np.concatenate(([0], at.astype(np.int64))), np.concatenate(([1.0], value))


def ftrl(rows: list[tuple], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.0005) -> np.ndarray:
    """Weights after so many passes over rows of (label, indices, values), in a seeded order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(3)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            y, at, x = rows[k]
            w = weights(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(z, n).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = TRAIN_ROWS) -> np.ndarray:
    """Fit on a bounded sample: executors hash the texts, the driver gets the sparse rows alone."""

    def make(texts):
        rows = [features(t) for t in texts]
        return {"at": pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), "x": pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))}

    got = map_texts(training_rows(docs, labels, label, bound), ["doc_id", "y"], "text", make, "at array<int>, x array<float>").toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), got["y"].to_pylist(), range(got.num_rows), strict=True))
    at, x = got["at"], got["x"]
    return ftrl([(y, at[k].values.to_numpy(), x[k].values.to_numpy().astype(float)) for _, y, k in rows])


def score(docs: DataFrame, keep: list[str], weights: np.ndarray) -> DataFrame:
    """keep plus score."""

    def make(texts):
        return {"score": pa.array([1 / (1 + np.exp(-np.clip(float(weights[at] @ x), -35, 35))) for at, x in map(features, texts)], pa.float64())}

    return map_texts(docs, keep, "text", make, "score double")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, ["doc_id"], fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of quality stay."""
    columns = ["doc_id", "lang", "source", "n_chars", "text"]
    scored = score(docs, columns, fit(docs, table(spark, sf_dir, "labels")))
    return scored.filter("score >= 0.3").select("doc_id", "text", "lang", "source", "n_chars")
