"""Quality rules: a table of thresholds compiled into one projection, in DataFrame functions only.

Words are runs without the six ASCII blanks. A rule is a measure and the range it has to stay in; a text is
kept if its base counts pass and all rules hold. Null and empty texts have no words and fail the base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skycensus.llm.chat_format import let
from skycensus.llm.common import WORD, table

WINDOW = 8
#: Frequent words of the four languages.
STOP_WORDS = "the of and to in is that it for was on are as with his they at be this from have or by de la le et les des un une du que en el los las y se por con para der die und den von zu das mit sich auf für ist im dem nicht ein eine".split()
#: Name, measure over the base columns, least, most (null: no bound).
RULES = [
    ("mean_word_chars", "word_chars / n_words", 2.0, 20.0),
    ("symbol_ratio", "n_symbols / n_words", None, 0.4),
    ("stop_word_ratio", "n_stop_words / n_words", 0.01, None),
    ("dup_line_ratio", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
    ("mark_ratio", "n_bang_words / n_words", None, 0.5),
]


def n_repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that the text holds at least twice."""
    n = F.size(words)

    def count(h: Column) -> Column:
        dup = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))

        def starts(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            marked = F.transform(s, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"]))
            return F.array_sort(F.array_compact(marked))

        def covered(d: Column) -> Column:
            return F.aggregate(F.transform(d, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(d, k + 1) - i, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(F.sort_array(dup), starts), covered))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    hashed = let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)
    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(hashed)


def base(docs: DataFrame, keep: list[str]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, text.alias("t"), F.array_remove(F.split(text, WORD), "").alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    stop = F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))
    return rows.select(
        *keep, F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("w")).alias("n_repeat_words"), F.size(stop).alias("n_stop_words"),
        F.size(lines).alias("n_lines"), F.regexp_count("t", F.lit(r"![ \t-\r]|!$")).alias("n_bang_words"),
    )


def judge(docs: DataFrame, keep: list[str], rules=RULES) -> DataFrame:
    """keep, the base counts, base_failed and kept."""
    rows = base(docs, keep)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    holds = F.lit(True)
    for _, measure, least, most in rules:
        x = F.expr(measure.replace("/ n_words", "/ greatest(n_words, 1)"))
        holds &= (F.lit(True) if least is None else x >= least) & (F.lit(True) if most is None else x <= most)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & holds)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(table(spark, sf_dir, "documents"), ["doc_id"]).select(*names)
