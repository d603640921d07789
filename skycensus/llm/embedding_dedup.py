"""Embedding near-duplicates by collision counting over many one-dimensional projections.

Rows are compared only under equal labels (of any type) and equal dimensions. Equal vectors become one class first, and
a class is dealt with its vector once for each pair of runs, nothing else but ids and counts moves. Runs are stretches of
the order along a first line; runs farther apart there than a link can reach are not compared. In a pair of runs the rows
are sorted along each of 48 seeded lines, a window around each query is cut out of every sorted line, and the windows that
a pair shares are counted. A pair at the threshold falls short of the count with a chance of MISS; the pairs that reach it are
verified by cosine in double precision. A label's cost grows with the square of its rows, by blocks of bounded size, at a bit a
line and pair. Vectors that are null, empty, zero or
hold null or non-finite parts, and rows with a null label or id, link with nothing and are their own component. Rows
that repeat a vec_id are rows of their own. Lengths are taken after scaling by the largest part, so neither large nor small ones overflow.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycensus.llm.common import BROADCAST_ROWS, HOT_ROWS, components, cut, runs, table, whole_groups, with_group
from skycensus.llm.simhash import stars

COSINE = 0.93
LINES, MISS = 48, 1e-8
RUN = 4096
QUERIES = 256


class Plan:
    """Seeded lines, window and the count that a pair at the threshold reaches."""

    def __init__(self, dims: int, cosine: float = COSINE, seed: int = 11):
        make = np.random.default_rng(seed)
        first = make.normal(size=dims)
        self.first = first / np.linalg.norm(first)
        self.lines = make.normal(size=(dims, LINES))
        #: Two vectors of length one at the threshold are so far apart, so on a line of length one never farther.
        self.far = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
        self.reach = 1.8 * self.far
        p = math.erf(1.8 / math.sqrt(2))  # a pair at the threshold falls into one window
        self.least, total = 0, 0.0
        while (total := total + math.comb(LINES, self.least) * p**self.least * (1 - p) ** (LINES - self.least)) <= MISS:
            self.least += 1

    def pairs(self, a: np.ndarray, b: np.ndarray, same: bool):
        """Blocks of places (i, j) of rows of a and b (length one) that share at least `least` windows; same: b is a, i < j.

        Each line is sorted. `before[r]` marks, a bit a row, the rows of b under rank r, so the window of a query is one exclusive
        or of two of its rows, and counts of 64 pairs at once are kept as bits of equal weight over words."""
        words = -(-len(b) // 64)
        counts = np.zeros((LINES.bit_length(), len(a), words), np.uint64)
        at, bit = np.arange(len(b)) // 64, np.uint64(1) << (np.arange(len(b)) % 64).astype(np.uint64)
        on_a, on_b = (a @ self.lines).T, (b @ self.lines).T
        for line in range(LINES):
            order = np.argsort(on_b[line], kind="stable")
            placed = on_b[line][order]
            before = np.zeros((len(b) + 1, words), np.uint64)
            before[np.arange(1, len(b) + 1), at[order]] = bit[order]
            np.bitwise_xor.accumulate(before, axis=0, out=before)
            low, high = np.searchsorted(placed, on_a[line] - self.reach), np.searchsorted(placed, on_a[line] + self.reach, "right")
            carry = before[high] ^ before[low]
            for plane in counts[: (line + 1).bit_length()]:
                both = plane & carry
                plane ^= carry
                carry = both
        enough = np.full((len(a), words), ~np.uint64(0))
        for k, plane in enumerate(counts):
            enough = plane & enough if self.least >> k & 1 else plane | enough
        for start in range(0, len(a), QUERIES):
            some = enough[start : start + QUERIES]
            i, w = np.nonzero(some)
            x, y = np.nonzero(np.unpackbits(some[i, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i, j = i[x] + start, w[x] * 64 + y
            up = i < j if same else slice(None)
            yield i[up], j[up]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest part first."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def flat(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def near(df: DataFrame, cosine: float = COSINE, size: int = RUN) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of df (vec_id, embedding, label)."""
    part = df.schema["embedding"].dataType.elementType.simpleString()
    kind = "float" if part == "float" else "double"
    value = F.expr(f"transform(embedding, x -> cast(x as {kind}))")
    fine = f"vec_id is not null and label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < {kind}('infinity')) and exists(v, x -> x <> 0)"
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), value.alias("v"))
    rows = rows.withColumn("ok", F.coalesce(F.expr(fine), F.lit(False)))
    # a vector goes by 128 bits of hash, so that only one row of each class carries it; -0.0 is 0.0
    plain = F.expr("transform(v, x -> x + 0.0)")
    named = rows.withColumn("h", F.when(F.col("ok"), F.struct(F.xxhash64("label", plain).alias("h1"), F.xxhash64(F.lit(7), "label", plain).alias("h2"))))
    classes = cut(named.filter("ok").groupBy("h").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")))
    classes = classes.withColumnRenamed("id", "least").withColumn("id", F.monotonically_increasing_id())  # ids may repeat; over a checkpoint this number stays

    def project(batches):
        for batch in batches:
            n = batch["v"].value_lengths().to_numpy(zero_copy_only=False)
            at = np.zeros(len(n))
            for dims in np.unique(n):
                mine = np.nonzero(n == dims)[0]
                at[mine] = unit(flat(batch["v"].take(pa.array(mine)), dims)) @ Plan(dims, cosine).first
            names = ["label", "dims", "at", "id", "n", "v"]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(n.astype(np.int32)), pa.array(at), batch["id"], batch["n"], batch["v"]], names=names)

    placed = classes.select("label", "id", "n", "v").mapInArrow(project, f"label string, dims int, at double, id bigint, n bigint, v array<{kind}>")
    # parallel vectors have one place on the line; a trace of the id parts them
    placed = placed.withColumn("at", F.col("at") + F.pmod(F.xxhash64("id"), F.lit(1 << 20)) * 2.0**-50)
    far = Plan(1, cosine).far
    dealt = runs(placed, ["label", "dims"], "at", size, [F.min("at").alias("low"), F.max("at").alias("high")], f"a.low - b.high <= {far} and b.low - a.high <= {far}")
    keys = ["label", "dims", "lo", "hi"]

    def compare(batches):
        plans: dict[int, Plan] = {}
        for t, starts in whole_groups(batches, keys):
            for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
                g = t.slice(s, e - s)
                if g.num_rows < 2:
                    continue
                dims, side = g["dims"][0].as_py(), g["side"].to_numpy()
                if dims not in plans:
                    plans[dims] = Plan(dims, cosine)
                every, mixed = unit(flat(g["v"], dims)), bool(side.any())
                a, b = (np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]) if mixed else (np.arange(len(every)),) * 2
                ids, n, found = g["id"].to_numpy(), g["n"].to_numpy(), []
                count = np.zeros(len(ids), np.int64)
                for i, j in plans[dims].pairs(every[a], every[b], not mixed):
                    i, j = a[i], b[j]
                    for k in range(0, len(i), 50_000):
                        p, q = i[k : k + 50_000], j[k : k + 50_000]
                        linked = np.einsum("ij,ij->i", every[p], every[q]) >= cosine
                        p, q = p[linked], q[linked]
                        np.add.at(count, p, n[q])
                        np.add.at(count, q, n[p])
                        low = stars(len(ids), p, q)  # one edge a row instead of all pairs
                        v = np.nonzero(low != np.arange(len(ids)))[0]
                        found.append(np.stack((v, low[v])))
                if found:
                    v, w = np.concatenate(found, 1)
                    root = ids[stars(len(ids), v, w)]
                    at = np.nonzero(count)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(root[at]), pa.array(count[at])], names=["a", "b", "n"])

    found = dealt.select(*keys, "side", "id", "n", "v").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a bigint, b bigint, n bigint")
    found = cut(found)
    linked = found.groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "id")
    of = classes.select("h", "id", "least", "n").join(linked, "id", "left").join(components(found.select("a", "b")).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    of = with_group(cut(of), "root", F.min("least").alias("component_id")).select("h", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    # rows of vectors that are repeated most are joined by broadcast; unusable ones, all without h, take no part
    every = classes.agg(F.sum("n")).first()[0] or 0
    of, usable = cut(of), named.filter("ok").select("vec_id", "h")
    many = F.col("n") > max(HOT_ROWS, every // BROADCAST_ROWS)
    hot = F.broadcast(of.filter(many).drop("n"))
    out = usable.join(hot, "h").unionByName(usable.join(hot, "h", "left_anti").join(of.filter(~many).drop("n"), "h")).drop("h")
    out = out.unionByName(named.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "embeddings"))
