"""What the text operators share: tables, checkpoints, arrow mapping, components."""

from __future__ import annotations

import itertools
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table with at most this many narrow rows may be broadcast.
BROADCAST_ROWS = 50_000
#: Rows of a key beyond which its rows stay where they are and its one aggregate row is broadcast.
HOT_ROWS = 100_000
WORD = r"[ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only where none is set and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this session wrote, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """Hint a broadcast if df, already cut, has few rows; else leave it to a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def with_group(rows: DataFrame, key: str, *made: Column, hot: int | None = None) -> DataFrame:
    """rows plus the aggregates `made` over all rows of their key (not null).

    The aggregates are combined before the shuffle. Keys of more than `hot` rows and of more than one in BROADCAST_ROWS
    of all are fewer than BROADCAST_ROWS: these are joined by broadcast, so no task gets a whole hot key.
    """
    per = cut(rows.groupBy(key).agg(*made, F.count("*").alias("__n")))
    every, most = per.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).first()
    least = max(HOT_ROWS if hot is None else hot, every // BROADCAST_ROWS)
    if most <= least:
        return rows.join(per.drop("__n"), key)
    many, few = F.broadcast(per.filter(F.col("__n") > least).drop("__n")), per.filter(F.col("__n") <= least).drop("__n")
    return rows.join(many, key).unionByName(rows.join(many, key, "left_anti").join(few, key))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text divides by 5; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def map_texts(df: DataFrame, keep: list[str], text: str, make, schema: str) -> DataFrame:
    """Apply make(list of texts) -> dict of columns to each arrow slice; the columns of keep pass through."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = make(part.column(part.num_columns - 1).to_pylist())
                cols = [part.column(k) for k in range(len(keep))] + list(made.values())
                yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in cols], names=[*keep, *made])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{fields}, {schema}" if keep else schema)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most `bound` labelled ids, one row each, none of them held out.

    Ids are picked by hash order from the narrow labels table; repeated labels of an id count once (the
    largest), null labels and ids not at all. Of the rows that repeat an id the least text is taken.
    """
    picked = (
        labels.filter(~held_out() & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def components(edges: DataFrame, hot: int | None = None) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of the component.

    Alternating large-star and small-star steps. Every step is a grouped minimum, brought back to the rows by
    `with_group`, so that a hot node has many tasks; lineage is cut after each step. Rounds go on until nothing changes.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = now.select(F.col("v").alias("k"), F.col("u").alias("n")).unionByName(now.select(F.col("u").alias("k"), F.col("v").alias("n")))
        large = with_group(both, "k", F.min(F.least("n", "k")).alias("m"), hot=hot).filter("n > k")
        large = cut(large.select(F.col("n").alias("v"), F.col("m").alias("u")).distinct())
        ends = F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))
        now = cut(with_group(large, "v", F.min("u").alias("m"), hot=hot).select(F.inline(ends)).filter("v <> u").distinct())
    roots = now.groupBy("v").agg(F.min("u").alias("root"))
    tops = roots.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return roots.select(F.col("v").alias("node"), "root").unionByName(tops)


def runs(rows: DataFrame, keys: list[str], order: str, size: int, node: list[Column], near: str) -> DataFrame:
    """rows dealt for comparison within keys: adds lo, hi and side, each pair of near runs of a key once.

    A key of at most `size` rows is one run, the pair (0, 0). A larger one is cut at quantiles of `order`, and again,
    until every run is that small, so runs are stretches of the sorted order. `node` sums up a run; a pair of runs is
    dealt only where `near` holds between the sums a and b, and a run meets itself. Rows need distinct orders.
    """
    big = cut(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > size).drop("n"))
    plain = lambda df: df.select("*", *[F.lit(0).cast("bigint").alias(c) for c in ("lo", "hi")], F.lit(0).alias("side"))
    if big.isEmpty():
        return plain(rows)
    hot, at = cut(rows.join(small(big), keys).withColumn("run", F.lit(0).cast("bigint"))), [*keys, "run"]
    marks = [k / 64 for k in range(1, 64)]
    while True:
        over = cut(hot.groupBy(*at).agg(F.count("*").alias("n"), F.percentile_approx(order, marks, 2000).alias("cuts")).filter(F.col("n") > size))
        if over.isEmpty():
            break
        many = F.least(F.lit(64), F.ceil(F.col("n") / (0.9 * size)).cast("int"))  # as few runs as are needed
        over = over.select(*at, F.transform(F.sequence(F.lit(1), many - 1), lambda k: F.get("cuts", F.round(k * 64 / many).cast("int") - 1)).alias("cuts"))
        above = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col(order))), F.lit(0))
        hot = cut(hot.join(small(over), at, "left").withColumn("run", F.col("run") * 64 + F.when(F.isnull("cuts"), 0).otherwise(above)).drop("cuts"))
    nodes = cut(hot.groupBy(*at).agg(*node))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    met = nodes.alias("a").join(nodes.alias("b"), [*same, F.expr(f"a.run = b.run or (a.run < b.run and {near})")])
    ends = F.array(F.struct(F.col("a.run").alias("run"), F.lit(0).alias("side")), F.when(F.col("a.run") < F.col("b.run"), F.struct(F.col("b.run").alias("run"), F.lit(1).alias("side"))))
    pairs = met.select(*[f"a.{k}" for k in keys], F.col("a.run").alias("lo"), F.col("b.run").alias("hi"), F.explode(F.array_compact(ends)).alias("end")).select(*keys, "end.run", "lo", "hi", "end.side")
    return plain(rows.join(small(big), keys, "left_anti")).unionByName(hot.join(pairs, at).drop("run"))


def whole_groups(batches, keys: list[str]):
    """From arrow batches sorted by keys: (table of whole groups, first row of each group)."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        t = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if t is None or not t.num_rows:
            return
        t = t.combine_chunks()
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            v = t[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.nonzero(new)[0]
        end = t.num_rows if batch is None else int(starts[-1])
        held = None if batch is None else t.slice(end)
        if end:
            yield t.slice(0, end), starts[starts < end]
