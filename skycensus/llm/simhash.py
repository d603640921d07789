"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are 64-bit majorities over the XXH64 (seed 42) of 4-word shingles, repeats included. Distinct
fingerprints are dealt under shared masked patterns, the top nodes of the index: with d differing bits allowed, two of
d + 2 blocks of bits stay equal, so each pair within d bits meets under a pattern (exact). Below a pattern the
fingerprints are sorted by Gray rank and gathered in nodes of 16 that hold the bits all members share. Going down a pair
of nodes, the differences on shared bits add up, and a pair of groups whose sum is over d is left out whole. A pattern
of many fingerprints is cut into runs of the Gray order, and pairs of runs whose shared bits differ too much are not
dealt, so no task holds a whole hot group. Null and empty texts have
fingerprint zero, linked like any other; rows with a null id get the class but never name it.
"""

from __future__ import annotations

import itertools
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycensus.llm.common import components, cut, map_texts, runs, table, whole_groups, with_group

WORDS, BITS = 4, 4
#: Fingerprints under one pattern that one task compares at once.
RUN = 2048
LEAF = 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    parts = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only the six blanks part words
    if not parts:
        return 0
    total, count = np.zeros(64, dtype=np.int64), max(1, len(parts) - words + 1)
    for at in range(0, count, 8192):
        some = parts[at : at + 8192 + words - 1]
        shingles = map(b" ".join, zip(*(some[k:] for k in range(words)), strict=False)) if len(some) >= words else [b" ".join(some)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=">u8")
        total += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep plus fp, a signed long."""
    return map_texts(docs, keep, "text", lambda texts: {"fp": pa.array([fingerprint(t) for t in texts], pa.int64())}, "fp bigint")


def _masks(bits: int) -> list[int]:
    """Masks of two of bits + 2 blocks of the 64: if at most `bits` bits differ, two blocks are equal."""
    edges = [round(64 * k / (bits + 2)) for k in range(bits + 3)]
    blocks = [((1 << b) - (1 << a)) for a, b in itertools.pairwise(edges)]
    return [x | y for x, y in itertools.combinations(blocks, 2)]


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each unsigned fingerprint in the reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(s))
    return fp


def levels(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask of the bits all members share, their values) of the rows themselves, then of nodes of LEAF of the level below, up to one level of at most LEAF nodes."""
    out = [(np.full(len(fp), 2**64 - 1, np.uint64), fp)]
    every = some = fp
    while len(out) == 1 or len(every) > LEAF:
        at = np.arange(0, len(every), LEAF)
        every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
        out.append((~(every ^ some), every))
    return out


def near_pairs(a: np.ndarray, b: np.ndarray, bits: int, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of a and b, both in Gray order, whose fingerprints differ in at most `bits` bits; same: b is a, i < j.

    A pair of nodes carries the differences on the bits that both share; a pair of children adds those on the bits that
    become shared below, and the whole pair of groups goes once the sum is over `bits`.
    """
    up_a, up_b = levels(a), levels(b)
    top = max(len(up_a), len(up_b))  # the lower tree is topped up by single nodes
    for up in (up_a, up_b):
        while len(up) < top:
            m, v = up[-1]
            at = np.arange(0, len(v), LEAF)
            every, some = np.bitwise_and.reduceat(v & m, at), np.bitwise_or.reduceat(v | ~m, at)
            up.append((~(every ^ some), every))
    (ma, va), (mb, vb) = up_a[-1], up_b[-1]
    x, y = (g.ravel() for g in np.indices((len(va), len(vb))))
    shared = ma[x] & mb[y]
    sums = np.bitwise_count((va[x] ^ vb[y]) & shared)
    todo, out = [(top - 1, x, y, shared, sums)], []
    while todo:
        level, x, y, shared, sums = todo.pop()
        ok = (sums <= bits) & (x <= y) if same else sums <= bits
        x, y, shared, sums = x[ok], y[ok], shared[ok], sums[ok]
        if level == 0:
            keep = x < y if same else slice(None)
            out.append((x[keep], y[keep]))
            continue
        (ma, va), (mb, vb) = up_a[level - 1], up_b[level - 1]
        for at in range(0, len(x), 2048):
            s = slice(at, at + 2048)
            i = (x[s, None, None] * LEAF + np.arange(LEAF)[:, None] + np.zeros(LEAF, int)).ravel()
            j = (y[s, None, None] * LEAF + np.zeros(LEAF, int)[:, None] + np.arange(LEAF)).ravel()
            ok = (i < len(va)) & (j < len(vb))
            i, j = i[ok], j[ok]
            over, before = np.repeat(shared[s], LEAF * LEAF)[ok], np.repeat(sums[s], LEAF * LEAF)[ok]
            now = ma[i] & mb[j]
            todo.append((level - 1, i, j, now, before + np.bitwise_count((va[i] ^ vb[j]) & now & ~over)))
    if not out:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For places 0..n-1 under links i-j: the smallest place of each one's component."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = np.minimum(new, new[new])
        if (new == low).all():
            return low
        low = new


def ranked(fps: DataFrame) -> DataFrame:
    """fp and rank, its place in Gray order (as a signed long in the same order)."""

    def run(batches):
        for batch in batches:
            fp = batch["fp"].to_numpy()
            rank = gray_rank(fp.view(np.uint64)) ^ np.uint64(1 << 63)
            yield pa.RecordBatch.from_arrays([batch["fp"], pa.array(rank.view(np.int64))], names=["fp", "rank"])

    return fps.select("fp").mapInArrow(run, "fp bigint, rank bigint")


def links(fps: DataFrame, bits: int = BITS, size: int = RUN) -> DataFrame:
    """From distinct fingerprints (fp): edges (a, b) that join all within `bits` bits of each other."""
    signed = [m - (1 << 64) if m >> 63 else m for m in _masks(bits)]
    marks = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(signed)])
    rows = ranked(fps).select("fp", "rank", F.explode(marks).alias("p")).select("fp", "rank", "p.mask", "p.value")
    node = [F.bit_and("fp").alias("every"), F.bit_or("fp").alias("some")]
    near = f"bit_count((a.every ^ b.every) & ~(a.every ^ a.some) & ~(b.every ^ b.some)) <= {bits}"
    dealt = runs(rows, ["mask", "value"], "rank", size, node, near)
    keys = ["mask", "value", "lo", "hi"]

    def compare(batches):
        for t, starts in whole_groups(batches, keys):
            n = np.diff(np.append(starts, t.num_rows))
            if (n < 2).all():
                continue
            group = np.repeat(np.arange(len(starts)), n)
            fp = t["fp"].to_numpy().view(np.uint64)
            side, mixed = t["side"].to_numpy(), (t["lo"].to_numpy() != t["hi"].to_numpy())[starts]
            order = np.lexsort((t["rank"].to_numpy(), side, group))
            fp, side = fp[order], side[order]
            found_i, found_j = [], []
            leaf = np.where(mixed[group] | (n[group] > LEAF), -1, group)  # a group of one leaf is compared in it, all groups at once
            for d in range(1, LEAF):
                i = np.nonzero((leaf[:-d] == leaf[d:]) & (leaf[d:] >= 0) & (np.bitwise_count(fp[:-d] ^ fp[d:]) <= bits))[0]
                found_i.append(i)
                found_j.append(i + d)
            for g in np.nonzero((mixed | (n > LEAF)) & (n > 1))[0]:
                a, b = starts[g], starts[g] + n[g]
                half = a + int((side[a:b] == 0).sum())
                i, j = near_pairs(fp[a:half], fp[half:b], bits) if mixed[g] else near_pairs(fp[a:b], fp[a:b], bits, True)
                found_i.append(i + a)
                found_j.append(j + (half if mixed[g] else a))
            low = stars(len(fp), np.concatenate(found_i), np.concatenate(found_j))
            v = np.nonzero(low != np.arange(len(fp)))[0]
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array(fp[v].view(np.int64)), pa.array(fp[low[v]].view(np.int64))], names=["a", "b"])

    return dealt.select(*keys, "side", "fp", "rank").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a bigint, b bigint").distinct()


def rooted(per: DataFrame, bits: int = BITS) -> DataFrame:
    """per, which has each fp once, plus the root fp of its class."""
    found = components(links(per.select("fp"), bits)).withColumnRenamed("root", "top")
    return per.join(found, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("top", "fp")).drop("node", "top")


def classes(docs: DataFrame, id_col: str = "doc_id", bits: int = BITS) -> DataFrame:
    """id_col, fp and component_id (smallest id of the class) for each row of docs."""
    rows = cut(fingerprints(docs, [id_col]))
    found = rooted(cut(rows.groupBy("fp").agg(F.min(id_col).alias("least"))), bits)
    named = with_group(cut(found), "root", F.min("least").alias("component_id"))
    return rows.join(named.select("fp", "component_id"), "fp")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: the smallest id, of equal ids the smallest text hash (nulls last in both).

    Ids may be null or repeat. A row is named by its id, text hash and the other columns, so only rows alike
    in all columns share a name, and those are of one class.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    name = F.to_json(F.struct("doc_id", F.md5(F.encode("text", "utf-8")).alias("text"), "lang", "source", "n_chars"))
    named = docs.select(*columns, name.alias("row"))
    first = F.struct(F.isnull("doc_id").alias("a"), F.col("doc_id").alias("b"), F.isnull("text").alias("c"), F.col("row").alias("row"))
    per = cut(fingerprints(named.withColumn("first", first), ["first"]).groupBy("fp").agg(F.min("first").alias("first")))
    kept = rooted(per).groupBy("root").agg(F.min("first").alias("first")).select("first.row")
    return named.join(kept, "row", "left_semi").dropDuplicates(["row"]).select(*columns)
