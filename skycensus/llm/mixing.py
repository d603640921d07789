"""Mixing sources to target weights by nested hash-threshold histograms.

A source's target is full copies of it plus a rest of whole words. The rest is met by a threshold on a hash of the
document (id, source and text): sizes are summed by source and leading hash bits, the bucket where the running sum passes
the rest is refined by the next bits, and so on; documents under the threshold are taken once more. Rows alike in id, source and text
share a hash and can be exchanged: of those at the threshold as many are taken as fit. What is then left of the rest, less than the
document at the threshold, is filled from the next FINISH documents in hash order that fit, one after the other. Nothing is
sorted but histograms of at most 4096 buckets a source and these documents.
Null texts and texts of blanks have size 0. One row per source is gathered for the targets, in one task. Empty input gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skycensus.llm.common import cut, map_texts, small, table

WEIGHTS, BUDGET, MOST = (3, 1, 2), 1.5, 2.0
LEVELS, LEVEL_BITS = 4, 12
#: Documents past the threshold, of each source, that fill what is left.
FINISH = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, row (a name that rows alike in id, source and text share), size (words), key."""
    count = lambda texts: {"size": pa.array([len((t or "").encode().split()) for t in texts], pa.int64())}
    rows = map_texts(docs.withColumn("row", row_name()), ["doc_id", "source", "row"], "text", count, "size bigint")
    return rows.withColumn("key", key_of())


def key_of() -> Column:
    """48 bits of the name."""
    return F.conv(F.substring("row", 1, 12), 16, 10).cast("long")


def row_name() -> Column:
    hashed = [F.coalesce(F.md5(F.encode(c, "utf-8")), F.lit("null")) for c in ("source", "text")]
    return F.md5(F.encode(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), *hashed), "utf-8"))


def targets(rows: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """source, source_size, target: shares of the budget by weight, each at most `most` times its source."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.encode("source", "utf-8").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    # the level at which shares stop growing: sources fill up in the order of room per weight
    room = most * F.col("source_size")
    order = Window.orderBy(room / F.col("weight"), F.encode("source", "utf-8").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) * budget - F.coalesce(F.sum(room).over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("full", room <= F.col("level") * F.col("weight"))
    least = F.min(F.when(~F.col("full"), F.struct(room / F.col("weight"), F.col("level").alias("level"))))
    return per.withColumn("stop", least.over(every)["level"]).select("source", "source_size", F.when(F.col("full"), room).otherwise(F.col("stop") * F.col("weight")).alias("target"))


def refine(rows: DataFrame, state: DataFrame) -> DataFrame:
    """source, rest, lead: the key at which the running size passes the rest, and what is then left of it.

    A source whose rest holds all its rows is left out.
    """
    state = state.select("source", "rest", F.lit(0).cast("long").alias("lead"))
    for level in range(LEVELS):
        shift = 12 * LEVELS - LEVEL_BITS * (level + 1)
        here = rows.select("source", "size", F.shiftright("key", shift).alias("bucket"))
        inside = here.join(small(state).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("bucket", LEVEL_BITS) == F.col("lead")))
        hist = inside.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        run = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        # the first bucket that takes the sum past the rest is refined; if none does, all are under the threshold
        hist = hist.withColumn("past", run).withColumn("stop", F.col("past") > F.col("rest"))
        found = hist.groupBy("source").agg(
            F.min(F.when(F.col("stop"), F.struct("bucket", (F.col("rest") - F.col("past") + F.col("n")).alias("rest")))).alias("b"),
            F.max("bucket").alias("last"), F.max("rest").alias("rest"),
        )
        state = cut(found.select("source", F.coalesce("b.rest", "rest").alias("rest"), F.coalesce("b.bucket", F.col("last") + 1).alias("lead")))
    return state


def matched(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows with the columns of their source's row in state."""
    return rows.join(small(state).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def plan(rows: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """(limits, picks) of rows as `sizes` gives them, already cut.

    limits: source, source_size, target, whole (full copies), lead (rows whose key is below are taken once more).
    picks: row, more (how many of the rows of that name are taken once more).
    """
    goal = targets(rows, weights, budget, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("whole", full.cast("long"))
    goal = cut(goal.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + F.lit(1e-6)).cast("double")))
    sized = rows.filter("size > 0")
    state = refine(sized, goal)
    limits = cut(goal.join(small(state.select(F.col("source").alias("_s"), "lead", F.col("rest").alias("left"))), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("lead", F.coalesce("lead", F.lit(0))))
    at = matched(sized, limits.select("source", "lead", "left"))
    # at the threshold: the rows of one name, as many as fit
    tie = at.filter("key = lead").groupBy("source", "row").agg(F.count("*").alias("n"), F.min("size").alias("size"), F.min("left").alias("left"))
    tie = tie.withColumn("first", F.row_number().over(Window.partitionBy("source").orderBy("row"))).filter("first = 1")
    tie = cut(tie.select("source", "row", F.least("n", F.floor(F.col("left") / F.col("size"))).cast("long").alias("more"), "size"))
    spent = tie.select(F.col("source").alias("_s"), (F.col("more") * F.col("size")).alias("spent"))
    rest = cut(limits.join(small(spent), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "lead", (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left")))
    near = matched(sized.select("source", "row", "key", "size"), rest).filter("key > lead and size <= left")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("key", "row"))).filter(F.col("place") <= FINISH)
    lists = near.groupBy("source").agg(F.max("left").alias("left"), F.sort_array(F.collect_list(F.struct("place", "row", "size"))).alias("docs"))
    start = F.struct(F.col("left"), F.expr("cast(array() as array<string>)").alias("rows"))
    step = lambda acc, d: F.when(d["size"] <= acc["left"], F.struct((acc["left"] - d["size"]).alias("left"), F.concat(acc["rows"], F.array(d["row"])).alias("rows"))).otherwise(acc)
    filled = lists.select(F.explode(F.aggregate("docs", start, step, lambda acc: acc["rows"])).alias("row")).groupBy("row").agg(F.count("*").alias("more"))
    picks = cut(tie.filter("more > 0").select("row", "more").unionByName(filled))
    return limits.select("source", "source_size", "target", "whole", "lead"), picks


def taken_once_more(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """rows plus once (0 or 1): `more` of the rows of each picked name. rows must come from files or a checkpoint, as partitions have to stay as they are.

    A name's rows are counted by partition and numbered within each, so a name of many rows has many tasks.
    """
    parts = rows.withColumn("_part", F.spark_partition_id())
    named = parts.join(small(picks), "row")
    before = F.sum("n").over(Window.partitionBy("row").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = named.groupBy("row", "more", "_part").agg(F.count("*").alias("n"))
    quota = cut(counts.select("row", "_part", (F.col("more") - F.coalesce(before, F.lit(0))).alias("quota")))
    number = F.row_number().over(Window.partitionBy("row", "_part").orderBy(F.lit(0)))
    some = named.drop("more").join(small(quota), ["row", "_part"]).withColumn("once", (number <= F.col("quota")).cast("long"))
    rest = parts.join(small(picks), "row", "left_anti").withColumn("once", F.lit(0).cast("long"))
    return rest.select(*rows.columns, "once").unionByName(some.select(*rows.columns, "once"))


def copies(rows: DataFrame, limits: DataFrame, picks: DataFrame, most: float = MOST) -> DataFrame:
    """rows (source, row, key, ...) plus source_size, target and copies, how often the mix takes each."""
    got = matched(taken_once_more(rows, picks), limits)
    n = F.col("whole") + F.greatest("once", (F.col("key") < F.col("lead")).cast("long"))
    return got.withColumn("copies", F.least(n, F.lit(int(most)))).drop("whole", "lead", "once")


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """doc_id, source, row, size, source_size, target, copies for every row of docs."""
    rows = cut(sizes(docs))
    return copies(rows, *plan(rows, weights, budget, most), most).drop("key")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


#: The same mix, one document at a time: in hash order up to the first that doesn't fit, then among the next 4096 those that do. Equal rows count as documents of their own.
OP7_SQL = r"""
WITH RECURSIVE rows AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, 'null'), coalesce(md5(source), 'null'), coalesce(md5(text), 'null'))), 1, 12))::BIGINT AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source::BLOB NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM per),
o AS (SELECT *, 2.0::DOUBLE * source_size AS room, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM w),
l AS (SELECT *, (budget - coalesce(sum(room) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
    FROM o WINDOW p AS (ORDER BY room / weight, source::BLOB NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, (SELECT arg_min(level, room / weight) FROM l WHERE room > level * weight) AS stop FROM l),
t AS (SELECT source, source_size, CASE WHEN room <= level * weight THEN room ELSE stop * weight END AS target FROM s),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
placed AS (SELECT r.*, row_number() OVER (PARTITION BY source ORDER BY key, copy) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY doc_id) AS copy FROM rows WHERE size > 0) r),
summed AS (SELECT p.*, floor(g.target - g.whole * g.source_size + 1e-6)::BIGINT AS rest, sum(p.size) OVER (PARTITION BY p.source ORDER BY p.pos)::BIGINT AS past FROM placed p JOIN g ON p.source IS NOT DISTINCT FROM g.source),
halt AS (SELECT source, min(pos) AS pos, min(key) AS key, arg_min(rest - past + size, pos) AS spare FROM summed WHERE past > rest GROUP BY source),
late AS (SELECT p.source, p.size, row_number() OVER (PARTITION BY p.source ORDER BY p.pos) AS n, p.pos FROM placed p JOIN halt h ON p.source IS NOT DISTINCT FROM h.source AND p.key > h.key AND p.size <= h.spare),
entered AS (SELECT source, pos, 0::BIGINT AS n, spare FROM halt
    UNION ALL
    SELECT e.source, min(l.pos), min(l.n), e.spare - arg_min(l.size, l.n)
    FROM entered e JOIN late l ON l.source IS NOT DISTINCT FROM e.source AND l.n > e.n AND l.n <= 4096 AND l.size <= e.spare GROUP BY e.source, e.n, e.spare),
once AS (SELECT s.source, s.key, count(*) AS n FROM summed s LEFT JOIN halt h ON s.source IS NOT DISTINCT FROM h.source WHERE h.pos IS NULL OR s.pos < h.pos GROUP BY s.source, s.key
    UNION ALL SELECT p.source, p.key, count(*) FROM entered e JOIN placed p ON p.source IS NOT DISTINCT FROM e.source AND p.pos = e.pos WHERE e.n > 0 GROUP BY p.source, p.key),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY doc_id) AS copy FROM rows)
SELECT doc_id, size, source_size, round(target, 3) AS target, (size * least(whole + CASE WHEN copy <= coalesce(o.n, 0) THEN 1 ELSE 0 END, 2))::BIGINT AS taken
FROM numbered r JOIN g ON r.source IS NOT DISTINCT FROM g.source LEFT JOIN (SELECT source, key, sum(n) AS n FROM once GROUP BY source, key) o ON r.source IS NOT DISTINCT FROM o.source AND r.key = o.key
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; documents without words stay once. docs as read from files."""
    limits, picks = plan(cut(sizes(docs)))
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", row_name().alias("row")).withColumn("key", key_of())
    got = copies(rows, limits, picks)
    words = F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    got = got.withColumn("copies", F.when(~words, 1).otherwise(F.col("copies")).cast("int"))
    got = got.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return got.select("doc_id", "text", "lang", "source", "n_chars")
