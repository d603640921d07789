"""Benchmark decontamination by winnowing, in DataFrame functions only.

A-Z are lower-cased; words are runs of digits, a-z and characters beyond ASCII. A window is 10 consecutive words of an item, or a
whole item of fewer words. For windows of t words, k-grams of k = ceil(t / 2) words are hashed, and of every t - k + 1
consecutive ones the least hash is the fingerprint, noted once for a run of neighbouring windows with the same least hash.
Equal windows have equal k-grams and so the same fingerprint: each shared window shows as a shared fingerprint, whatever stands around
it. Fingerprints of documents are joined with those of the benchmark before anything is shuffled; each hit is extended to the windows
of its run, which are compared word by word. Documents with equal texts share one result, so hits are combined over copies.

Null and empty texts have no words and no hits. Items without words have no windows; equal item_ids count once, a null
item_id counts as the item "". Equal documents each get their row. A row of the result lists all items of a
document and so grows with the benchmark; nothing else is gathered by document but the places of its hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skycensus.llm.chat_format import let
from skycensus.llm.common import BROADCAST_ROWS, cut, small, table

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), "")


def winnow(w: Column, size: int) -> Column:
    """Array of (fp, a, b): runs of windows a..b of `size` words with the same least hash; windows count from 0.

    Fewer than `size` words: null.
    """
    k = (size + 1) // 2
    many = size - k + 1

    def grams(h: Column) -> Column:
        return h if k == 1 else F.transform(F.slice(h, 1, F.size(h) - k + 1), lambda _, i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    def least(g: Column) -> Column:
        return g if many == 1 else F.transform(F.slice(g, 1, F.size(g) - many + 1), lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, many)]))

    def runs(m: Column) -> Column:
        starts = F.filter(F.transform(m, lambda x, i: F.when((i == 0) | (x != F.get(m, i - 1)), F.struct(x.alias("fp"), i.alias("a")))), lambda s: s.isNotNull())
        ends = lambda s: F.transform(s, lambda x, j: F.struct(x["fp"].alias("fp"), x["a"].alias("a"), (F.coalesce(F.get(s, j + 1)["a"], F.size(m)) - 1).alias("b")))
        return let(starts, ends)

    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) >= size, let(let(let(hashed, grams), least), runs))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(size, win, fp, items): each distinct window, its fingerprint and the sorted ids of the items that hold it."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).filter("size(w) > 0").distinct()
    rows = rows.withColumn("size", F.least(F.size("w"), F.lit(WINDOW)))
    found = F.coalesce(*[F.when(F.col("size") == t, winnow(F.col("w"), t)) for t in range(1, WINDOW + 1)])
    runs = rows.select("item", "w", "size", F.inline(found))
    each = runs.select("item", "size", "fp", "w", F.explode(F.sequence("a", "b")).alias("i")).select("item", "size", "fp", F.array_join(F.slice("w", F.col("i") + 1, F.col("size")), " ").alias("win"))
    return each.groupBy("size", "win", "fp").agg(F.array_sort(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per distinct text that holds a window: key, n_hit, items (distinct, sorted).

    `windows` as benchmark_windows returns them, already cut.
    """
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most WINDOW numbers
    marks = cut(windows.select("size", "fp").distinct())
    few = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = None
    rows = docs.filter(F.col("text").isNotNull()).select(F.sha2(F.col("text"), 256).alias("key"), words(F.col("text")).alias("w"))
    for t in sizes:
        runs = rows.select("key", "w", winnow(F.col("w"), t).alias("runs")).select("key", "w", F.inline_outer("runs"))  # outer: no filter that works the runs out twice
        mark = marks.filter(F.col("size") == t).drop("size")
        span = ["key", "fp", "a", "b", F.slice("w", F.col("a") + 1, F.col("b") - F.col("a") + t).alias("w")]  # the words of its windows
        met = runs.join(F.broadcast(mark), "fp").select(*span) if few else runs.select(*span).join(mark, "fp")
        places = met.select("key", "fp", "a", "w", F.explode(F.sequence("a", "b")).alias("i")).select("key", "fp", "i", F.lit(t).alias("size"), F.array_join(F.slice("w", F.col("i") - F.col("a") + 1, F.lit(t)), " ").alias("win"))
        found = places if found is None else found.unionByName(places)
    if found is None:
        return docs.sparkSession.createDataFrame([], "key string, n_hit bigint, items array<string>")
    same = found.join(small(windows), ["size", "win", "fp"]).select("key", F.struct(F.col("i").alias("a"), (F.col("i") + F.col("size")).alias("b")).alias("at"), "items")
    per = same.groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("bigint").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["reach"], x["b"]).alias("reach"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["reach"], x["a"]))).alias("n"))
    return per.select("key", F.aggregate("at", start, step, lambda s: s["n"]).alias("n_hit"), "items")


def decontaminate(docs: DataFrame, items: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_words, n_hit, hit_items (sorted, distinct) and contaminated for every row of docs."""
    found = small(cut(hits(docs, cut(benchmark_windows(items)))))
    rows = docs.select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(keep)], F.size(words(F.col("text"))).cast("bigint").alias("n_words"), F.sha2(F.col("text"), 256).alias("key"))
    joined = rows.join(found, "key", "left")
    n = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select(*[F.col(f"__{k}").alias(c) for k, c in enumerate(keep)], "n_words", n.alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("hit_items"), (n > 0).alias("contaminated"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return done.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated",
    )


#: Windows of all documents against those of all items, without fingerprints.
OP11_SQL = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS row_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS t FROM item WHERE len(w) > 0),
wanted AS (
  SELECT DISTINCT item, t, array_to_string(w[i:i + t - 1], ' ') AS win
  FROM (SELECT item, w, t, unnest(range(1, len(w) - t + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT t FROM sized),
held AS (
  SELECT row_id, t, i, array_to_string(w[i:i + t - 1], ' ') AS win
  FROM (SELECT row_id, w, t, unnest(range(1, len(w) - t + 2)) AS i FROM doc, sizes WHERE len(w) >= t)),
met AS (SELECT row_id, t, i, item FROM held JOIN wanted USING (t, win)),
hit AS (
  SELECT row_id, count(*) AS n_hit
  FROM (SELECT DISTINCT row_id, unnest(range(i, i + t)) AS place FROM met) GROUP BY row_id),
named AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT row_id, item FROM met) GROUP BY row_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (row_id) LEFT JOIN named USING (row_id)
"""
