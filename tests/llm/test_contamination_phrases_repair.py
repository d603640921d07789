"""Decontamination, collocations and conversation repair against brute force and their SQL."""

import hashlib
import heapq
import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

DIR = "/root/testdata/sf0.01"


def against_sql(spark, name):
    from skycensus.llm.registry import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({SQL[name]})").fetchall()
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == Counter(want) and want


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_collocations"])
def test_query_equals_sql(spark, name):
    against_sql(spark, name)


# decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items):
    doc, hit, found = words(text), set(), set()
    for item, item_text in items:
        w = words(item_text)
        t = min(10, len(w))
        for i in range(len(w) - t + 1 if w else 0):
            for j in range(len(doc) - t + 1):
                if doc[j : j + t] == w[i : i + t]:
                    hit.update(range(j, j + t))
                    found.add("" if item is None else str(item))
    return len(doc), len(hit), sorted(found)


def test_decontamination_brute_force(spark):
    from skycensus.llm.decontamination import decontaminate

    rng = np.random.default_rng(4)
    say = lambda n, v=6: " ".join(f"w{x}" for x in rng.integers(0, v, n))
    items = [(k, say(int(n))) for k, n in enumerate(rng.integers(1, 30, 12))]
    items += [(100, "a " * 40), (101, items[3][1]), (102, None), (103, " ., "), (None, say(12)), (104, "É ñandú 日本 x"), (105, items[5][1].upper()), (9, "one two three four five six seven eight nine ten eleven twelve")]
    pick = lambda: str(items[int(rng.integers(0, 12))][1])
    docs = [(k, say(int(rng.integers(0, 60)), 9) + (" " + pick() if k % 3 == 0 else "") + " " + say(4)) for k in range(40)]
    docs += [(50, "a " * 500), (51, None), (52, ""), (53, "x é ñandÚ É ñandú 日本 X y"), (53, docs[0][1]), (None, docs[3][1]), (None, None), (54, "one two three four five six seven eight nine TEN; eleven two"), (55, "one two three four five six seven eight nine eleven ten twelve")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "2 as w", "3 as n_words", "4 as items").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as size", "2 as win")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.hit_items), r.contaminated) for r in decontaminate(df, bench, ["doc_id"]).collect())
    want = Counter()
    for i, text in docs:
        n, hit, names = brute_hits(text, items)
        want[i, n, hit, tuple(names), hit > 0] += 1
    assert got == want
    none = decontaminate(df, bench.limit(0), ["doc_id", "key"]).collect()
    assert len(none) == len(docs) and not any(r.contaminated or r.n_hit or r.hit_items for r in none)
    assert decontaminate(df.limit(0), bench, ["doc_id"]).count() == 0


# collocations


def brute_phrases(docs, least, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    many = {(x, p): a for (x, p), a in f.items() if len(p) > 1 and a >= least}
    out: dict = {}
    for (lang, p), a in many.items():
        if any(x == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in many.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)}


def test_collocations_brute_force(spark):
    from skycensus.llm.collocations import collocations, frequent, phrase_counts

    rng = np.random.default_rng(2)
    base = ["the", "Of", "é", "日本", "x'y", "a b", "zz"]
    docs = []
    for k in range(120):
        w = [base[int(x)] for x in rng.integers(0, 7, int(rng.integers(0, 50)))]
        docs.append((["en", "fr", None, "und", "fr"][k % 5], "".join(x + str(rng.choice([" ", "\t ", ", ", "\n", "  ", ". "], p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.05])) for x in w)))
    docs += [("en", None), ("en", ""), (None, "..."), ("en", "a a " * 5000), ("en", "only once"), ("de", "ab" * 30_000 + " c")] + [("en", "go to the shop now, ok")] * 30
    df = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 as word", "2 as n", "3 as phrase", "4 as rank").repartition(5)
    cols = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    for least, top in ((3, 10_000), (25, 7)):
        assert {tuple(r[c] for c in cols) for r in collocations(df, least, top).collect()} == brute_phrases(docs, least, top)
    assert collocations(df.limit(0)).count() == 0
    _, phrases, _ = frequent(df, 10)
    wanted = phrases.select("lang", "phrase").checkpoint()
    many = {(r.lang, r.phrase): r.n for r in phrase_counts(df, wanted, 9).collect()}  # many small tries
    assert many == {(r.lang, r.phrase): r.n for r in phrases.collect()} and len(many) > 40


class Task:
    """Stands for a table: keeps the function that would run over its batches, to run it here."""

    def __init__(self, spark):
        self.sparkSession, self.run = spark, None

    def filter(self, *_):
        return self

    select = coalesce = distinct = filter

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_candidates_of_a_task_in_little_memory(spark):
    """A task that meets 600,000 phrases sends each once, in small batches, and remembers them in a few bytes each."""
    import tracemalloc

    import pyarrow as pa

    from skycensus.llm.collocations import BUCKETS, SLICE, candidates

    rng = np.random.default_rng(9)
    rows = [(x, " ".join(f"W{v}" for v in rng.integers(0, 2000, 50_000))) for x in ("de", "en", "en2")]
    run = candidates(Task(spark), [b"\xff" * (BUCKETS // 8)] * 3).run
    batch = lambda x, text: pa.RecordBatch.from_arrays([pa.array([x]), pa.array([text.encode()])], names=["lang", "text"])
    most = sum(made.num_rows for made in run(iter([batch("de", "a b")])))  # loads the bitmaps
    tracemalloc.start()
    for made in run(batch(*row) for row in rows):
        most = max(most, made.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and most <= 1 << 16
    rows.append(("en", rows[1][1][:100_000].rsplit(" ", 1)[0] + " new"))
    sent, want = Counter(), set()
    for made in run(batch(x, text + "." + "z" * SLICE) for x, text in rows):  # each row is a slice
        sent.update(zip(*[c.to_pylist() for c in made.columns], strict=True))
    for x, text in rows:
        w = text.lower().split()
        want |= {(x, " ".join(w[i : i + k])) for k in range(2, 6) for i in range(len(w) - k + 1)}
    assert set(sent) == want and max(sent.values()) == 1 and len(want) > 550_000


def test_full_buckets_are_those_counted(spark):
    """Counts of buckets, dealt as arrays, against a plain count; few rows a task leave Spark."""
    from skycensus.llm.collocations import BUCKETS, Slice, Windows, bucket, full_buckets

    rng = np.random.default_rng(3)
    docs = [(x, " ".join(f"w{int(v)}" for v in rng.zipf(1.3, 400) % 500) + ". b") for x in ("en", "fr", None) for _ in range(40)]
    every = [b"\xff" * (BUCKETS // 8)] * 3
    df = spark.createDataFrame(docs, "lang string, text string").repartition(7)
    for sizes in (range(2, 3), range(3, 6)):
        n = Counter()
        for x, text in docs:
            w = Windows(Slice(x or "und", [text.encode()]), every)
            for k in range(2, sizes[-1] + 1):
                places = w.level(k, False)
                if k in sizes:
                    n.update(bucket(w.h[k][places]).tolist())
        bits = np.unpackbits(np.frombuffer(full_buckets(df, sizes, every, 20), np.uint8), bitorder="little")
        want = {b for b, k in n.items() if k >= 20}
        assert set(np.flatnonzero(bits).tolist()) == want and len(want) > 20


def brute_counts(docs, least):
    f = Counter()
    for lang, text in docs:
        for piece in text.lower().split("."):
            w = piece.split()
            f.update((lang or "und", " ".join(w[i : i + k])) for k in range(2, 6) for i in range(len(w) - k + 1))
    return {p: n for p, n in f.items() if n >= least}


def test_passes_do_not_grow_with_candidates(spark, monkeypatch):
    """240,000 candidates took three tries, each a pass over the texts, and more of them more; now there are five passes for any number."""
    from skycensus.llm import collocations

    rng, passes, real = np.random.default_rng(12), [], collocations.over_slices
    docs = [(x, " ".join(f"w{v}" for v in rng.integers(0, 3000, 1000))) for x in ("de", "en", None) for _ in range(20)]
    monkeypatch.setattr(collocations, "over_slices", lambda *a: passes.append(a) or real(*a))
    _, phrases, _ = collocations.frequent(spark.createDataFrame(docs, "lang string, text string").repartition(4), 1)
    want = brute_counts(docs, 1)
    assert {(r.lang, r.phrase): r.n for r in phrases.collect()} == want and len(want) > 230_000
    assert len(passes) == 5


def test_candidates_of_one_hash_are_counted_apart(spark):
    """Cut to few bits, hashes are shared by most candidates, by some, by none: the counts are the same."""
    from skycensus.llm.collocations import BUCKETS, frequent_phrases

    rng = np.random.default_rng(13)
    docs = [(x, " ".join(f"é{int(v)}" for v in rng.zipf(1.4, 60) % 40) + ". ô b") for x in ("en", "fr", None) for _ in range(20)]
    df, want = spark.createDataFrame(docs, "lang string, text string").repartition(3), brute_counts(docs, 4)
    for bits in (8, 14, 64):
        got = frequent_phrases(df, [b"\xff" * (BUCKETS // 8)] * 3, 4, bits).collect()
        assert {(r.lang, r.phrase): r.n for r in got} == want and len(got) == len(want) > 100


def test_sums_of_a_task_are_given_in_parts(monkeypatch):
    """A task that meets more hashes than it holds gives its sums more than once, and what is left at the end."""
    from pyspark.sql import SparkSession

    from skycensus.llm import collocations

    rng = np.random.default_rng(14)
    docs = [("en", " ".join(f"w{v}" for v in rng.integers(0, 9, 500))) for _ in range(40)]
    monkeypatch.setattr(collocations, "HELD", 300)
    df = SparkSession.getActiveSession().createDataFrame(docs, "lang string, text string").coalesce(2)
    monkeypatch.setattr(collocations, "SLICE", 2000)
    counts = collocations.hash_counts(df, [b"\xff" * (collocations.BUCKETS // 8)] * 3, 20)
    assert sorted(r.n for r in counts.collect()) == sorted(brute_counts(docs, 20).values())


def test_buckets_grow_with_the_words(spark):
    from skycensus.llm.collocations import BUCKETS, PER_BUCKET, Slice, Windows, buckets_for, full_buckets

    assert buckets_for(0) == buckets_for(BUCKETS) == BUCKETS and all(n <= PER_BUCKET * buckets_for(n) for n in (10**9, 10**10))
    docs = [("en", "a b c d e. x")] * 9 + [("en", "b a")] * 2
    df, every = spark.createDataFrame(docs, "lang string, text string"), [b"\xff" * (BUCKETS // 8)]
    for _ in range(2):
        every.append(full_buckets(df, range(len(every) + 1, 3 if len(every) < 2 else 6), every, 9, 4 * BUCKETS))
    assert [len(x) for x in every[1:]] == [BUCKETS // 2] * 2 and [sum(map(int.bit_count, x)) for x in every[1:]] == [4, 6]
    w = Windows(Slice("en", [b"b a. a b c d e f"]), every)
    assert [w.level(k, True).tolist() for k in range(2, 6)] == [[2, 3, 4, 5], [2, 3, 4], [2, 3], [2]]


def test_texts_come_in_small_batches(spark):
    """What of the texts crosses to a task's Python at once is bounded; the session is left as it was."""
    from skycensus.llm.collocations import arrow_batches, frequent

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    df = spark.range(400).selectExpr("'en' as lang", "cast(repeat('a b ', 12500) as binary) as text").coalesce(1)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    with arrow_batches(spark):
        assert df.mapInArrow(sizes, "n long").groupBy().max("n").first()[0] < 6 << 20
    frequent(spark.createDataFrame([("en", "a b")], "lang string, text string"), 1)
    assert spark.conf.get(name) == before


def test_score_beyond_64_bits():
    """The widest step of the score, in the SQL that the plan uses."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    a, n, x = 3 * 10**12, 9 * 10**12, 4 * 10**12
    got = spark.sql(f"select cast(cast({a} as decimal(19,0)) * cast({n} as decimal(19,0)) as decimal(34,0)) * cast(1000 as decimal(4,0)) as up, cast({x} as decimal(19,0)) * cast({x} as decimal(19,0)) as low").selectExpr("cast(up as decimal(38,0)) div cast(low as decimal(38,0))").first()[0]
    assert got == 1000 * a * n // (x * x)


# repair

STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def best_repair(rows):
    """(cost, audit, lines) of rows (role, text, fault) by search in order of (cost, audit)."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, audit, list(lines)
        new, name = STEP["a" if state == 2 else "u"][state], "assistant" if state == 2 else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", at, new, (*lines, name + ":")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, lines))
            if fault in (None, "truncated"):
                more = 5 * (fault == "truncated")
                if state in STEP.get(role[:1], {}):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, STEP[role[:1]][state], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, new, (*lines, f"{name}:{text}")))


def brute_repair(data):
    out = Counter()
    for conv in {r[0] for r in data}:
        rows = []
        for c, turn, role, text in data:
            if c != conv:
                continue
            name = lambda x: " " if x is None else str(x)
            hit = zlib.crc32(f"{name(c)}:{name(turn)}".encode()) % 20
            role, text = name(role), name(text)
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            rows += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty, n = set(), [], Counter()
        for _, role, text in rows:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            n[fault] += 1
            faulty.append((role, text, fault))
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, lines = best_repair(faulty)
        out[conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()] += 1
    return out


def test_repair_query(spark):
    from skycensus.llm.registry import QUERIES

    data = duckdb.connect().execute(f"select conv_id, turn, role, text from '{DIR}/conversations.parquet'").fetchall()
    cols = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = Counter(tuple(r[c] for c in cols) for r in QUERIES["op13_conversation_repair"](spark, DIR).collect())
    assert got == brute_repair(data)


@pytest.mark.parametrize("hot", [None, 5])
def test_repair_hard_rows(spark, hot):
    """Nulls, ties, repeated rows, odd roles, a hot conversation over many tasks, a row repeated often."""
    from skycensus.llm.conversation_repair import digests, repair

    rng = np.random.default_rng(8)
    roles, texts = ["user", "assistant", "system", "user", "assistant", None, "", "uncle", "Tool"], ["Yes.", "no", "", " \n", None, "ok!", "why?\n", "Yes.", "é", "a.b "]
    data = [(int(c), None if t == 7 else int(t), roles[int(r)], texts[int(x)] + (str(t) if x == 8 else "")) if texts[int(x)] is not None else (int(c), int(t), roles[int(r)], None) for c, t, r, x in zip(rng.integers(0, 60, 500), rng.integers(-3, 12, 500), rng.integers(0, 9, 500), rng.integers(0, 10, 500), strict=True)]
    data += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None)]
    data += [(1000, k, roles[int(rng.integers(0, 3))], f"t{int(rng.integers(0, 300))}" + str(rng.choice([".", "", "!"], p=[0.7, 0.2, 0.1]))) for k in range(600)]
    data += [(1001, 5, "user", "same.")] * 50 + [(1001, 6, "assistant", "x.")]
    drop = next(k for k in range(2000, 3000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    data += [(drop, 0, "user", "gone.")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as key", "2 as n", "3 as part", "4 as fault").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    done = repair(df, hot)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert done.filter("conv_id = 1000").count() > 1  # the hot one lies in several pieces
    got = Counter(tuple(r) for r in digests(done).collect())
    assert got == brute_repair(data)
    assert any(r[0] == drop and r[7] == "" and r[8] == hashlib.sha256(b"").hexdigest() for r in got)
    assert digests(repair(df.limit(0))).count() == 0


def test_repair_blocks_equal_search():
    from skycensus.llm.conversation_repair import AT, KINDS, all_joined, parsed

    rng = np.random.default_rng(1)
    fault = {0: None, 1: "blank", 3: "truncated"}
    rows = [[int(x) for x in rng.integers(0, len(KINDS), n)] for n in list(range(1, 18)) * 6 + [33, 70, 129]]
    for kinds, cells in zip(rows, parsed(rows), strict=True):
        want = best_repair([(KINDS[k][0] or "x", "", fault[KINDS[k][1]]) for k in kinds])
        assert min(cells[AT[0, q]] for q in (0, 3)) == want[:2]
    two = parsed([rows[-1][:50], rows[-1][50:]])
    assert all_joined(two) == parsed([rows[-1]])[0]
