"""Chat formatting from an event log, in DataFrame functions only.

An event is (conv_id, message, seq, kind, role, text, at, cut). `delta` adds its text; `regenerate` discards what the
message had and starts again from its own text; `edit` puts its text in place of the `cut` code points that come after the
first `at` of what the message has by then; places past the end of that add at the end and cut nothing of what is streamed later.
Runs of deltas between edits are joined as one. Negative and null places count as 0. The log of a
conversation is dealt by message, so a hot conversation has many tasks, and folded by seq; its messages come in the order of
their key. Null text or role: empty. Null conv_id: a conversation of its own. Events repeated with the same seq of a message count as
often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skycensus.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: A backslash goes after the first character of any control string inside a text.
CONTROL = r"(<)(\|im_(?:start|end)\|>|/?s>|<?/?SYS>>)|(\[)(/?INST\])"
CHUNK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(CONTROL), F.lit(r"$1$3\\$2$4"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def fold(events: DataFrame) -> DataFrame:
    """One row per message: conv_id, message, role, text, folded from its part of the conversation's log, by seq."""
    again = F.max(F.when(F.col("kind") == "regenerate", F.col("seq")))
    part = F.struct("seq", (F.col("kind") == "edit").alias("edit"), F.coalesce("text", F.lit("")).alias("text"), *[F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)).alias(x) for x in ("at", "cut")])
    grouped = events.groupBy("conv_id", "message").agg(F.coalesce(again, F.min("seq")).alias("base"), F.max("role").alias("role"), F.sort_array(F.collect_list(part)).alias("parts"))
    live = F.filter("parts", lambda p: p["seq"] >= F.col("base"))
    splice = lambda t, p: F.concat(F.substr(t, F.lit(1), p["at"]), p["text"], F.substr(t, p["at"] + p["cut"] + 1, F.lit(2**31 - 1)))
    run = lambda parts, after, to: F.array_join(F.transform(F.slice(parts, after + 2, to - after - 1), lambda p: p["text"]), "")  # noqa: E731  deltas between two places

    def replay(parts: Column) -> Column:
        edits = F.filter(F.transform(parts, lambda p, k: F.when(p["edit"], k)), lambda k: k.isNotNull())
        steps = let(edits, lambda e: F.transform(e, lambda k, j: F.struct(run(parts, F.coalesce(F.get(e, j - 1), F.lit(-1)), k).alias("run"), F.get(parts, k).alias("edit"))))
        text = F.aggregate(steps, F.lit(""), lambda t, s: let(F.concat(t, s["run"]), lambda x: splice(x, s["edit"])))
        return F.concat(text, run(parts, F.coalesce(F.array_max(edits), F.lit(-1)), F.size(parts)))

    return grouped.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), let(live, replay).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start from 1, length, in code points)."""
    head = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n"))
    body = escape(F.col("text"))
    rows = messages.select("conv_id", F.struct("message", (F.col("role") == "assistant").alias("loss"), head.alias("head"), body.alias("body")).alias("m"))
    tail = CLOSE + "\n"
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    start = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def step(acc, m):
        begin, size = acc["at"] + F.length(m["head"]), F.length(m["body"])
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        return F.struct((begin + size + len(tail)).alias("at"), F.when(m["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("ms", lambda m: F.concat(m["head"], m["body"], F.lit(tail))), "")
    return one.select("conv_id", text.alias("formatted"), F.aggregate("ms", start, step, lambda a: a["spans"]).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) read from a formatted conversation."""
    turns = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda t: t != "")

    def one(t):
        at = F.instr(t, "\n")
        body = F.substr(t, at + 1, F.length(t) - at - len(CLOSE) - 1)
        return F.struct(F.url_decode(F.substr(t, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, one)


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped span by span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))), "")


def events_of(rows: DataFrame) -> DataFrame:
    """The event log that stands for finished turns.

    Texts are streamed in chunks of 256 code points. A third of the turns have an earlier draft that is regenerated; in a
    fifth the first 40 code points come in reverse and are put right by an edit at the end; equal rows are messages of their own.
    """
    text = F.coalesce("text", F.lit(""))
    base = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    base = base.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    message = F.struct("turn", "role", F.xxhash64("text").alias("key"), "copy").alias("message")
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / CHUNK).cast("int"))
    redone = F.coalesce(F.pmod(F.col("turn"), 3) == 1, F.lit(False))
    edited = F.coalesce(F.pmod(F.col("turn"), 5) == 2, F.lit(False)) & (F.length("text") > 0)
    first = F.substr("text", F.lit(1), F.lit(40))
    sent = F.when(edited, F.concat(F.reverse(first), F.substr("text", F.lit(41), F.lit(2**31 - 1)))).otherwise(F.col("text"))

    def event(seq: Column, kind: str, text: Column, at: Column, cut: Column) -> Column:
        return F.struct(seq.cast("int").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"), at.cast("int").alias("at"), cut.cast("int").alias("cut"))

    no = F.lit(0)
    chunks = let(sent, lambda t: F.transform(F.sequence(F.lit(1), n), lambda k: event(k + 1, "delta", F.substr(t, (k - 1) * CHUNK + 1, F.lit(CHUNK)), no, no)))
    draft = F.array(event(no, "delta", F.reverse(first), no, no), event(F.lit(1), "regenerate", F.lit(""), no, no))
    fix = F.array(event(n + 2, "edit", first, no, F.length(first)))
    none = F.slice(fix, 1, 0)
    log = F.concat(F.when(redone, draft).otherwise(none), chunks, F.when(edited, fix).otherwise(none))
    return base.select("conv_id", message, "role", F.explode(log).alias("e")).select("conv_id", "message", "e.seq", "e.kind", "role", "e.text", "e.at", "e.cut")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{hard}'), (-1L, 1L, 'assistant', '{hard}') AS t(conv_id, turn, role, text)")
    done = render(fold(events_of(rows.union(extra))))
    flat = lambda turns: F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    done = done.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat("turns"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
