"""Operators of the llm subpackage against brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.01"
DOCS = [(1, "a b c\n\nA ▁ x", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "word " * 30_000, "en", "s", 1), (4, "word " * 30_000, "en", "s", 1), (None, "É\tno\u00a0break", "fr", None, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as size", "2 as key", "3 as score")


def rows(sql):
    return duckdb.connect().execute(sql).fetchall()


def out(spark, name):
    from skycensus.llm.registry import QUERIES

    return QUERIES[name](spark, DIR).toPandas()


def test_sentencepiece_round_trip_and_plain_encoding(spark, docs):
    import sentencepiece

    from skycensus.llm.sentencepiece_dropout import MODEL, Pieces, decode, encode

    got = encode(docs, ["doc_id"]).collect()
    assert all(r.lossless or r.ids is None for r in got)
    back = {r.doc_id: r.text for r in decode(encode(docs, ["doc_id"]), ["doc_id"]).collect()}
    assert back == {d[0]: d[1] for d in DOCS}
    plain, lib = Pieces(MODEL, 0.0, 0, 1), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for (text,) in rows(f"select text from '{DIR}/documents.parquet' limit 150"):
        assert plain.encode(text) == lib.encode(text)
    assert Pieces(MODEL, 0.3, 1, 4).encode(text) != Pieces(MODEL, 0.3, 2, 4).encode(text)


def test_dropout_draws_each_occurrence():
    from skycensus.llm.sentencepiece_dropout import MODEL, Pieces

    p, word = Pieces(MODEL, 0.3, 1, 4), "▁internationalisation"
    text = " ".join(["internationalisation"] * 400)
    keys = p.keys([text], np.array([400])).tolist()
    one = [p.word(word, k) for k in keys]
    assert p.encode(text) == [i for ids in one for i in ids] == p.encode(text)
    assert len({tuple(ids) for ids in one}) > 40 and p.decode(p.encode(text)) == text
    assert len({tuple(p.encode(f"{text[:41]} {k}")[:8]) for k in range(60)}) > 10


def test_dropout_of_many_words_equals_the_agenda():
    """Every word of 60 texts, and hard ones, as the agenda merges it alone with the same key."""
    import re

    from skycensus.llm.sentencepiece_dropout import BLANK, MODEL, Pieces

    texts = [t for (t,) in rows(f"select text from '{DIR}/documents.parquet' limit 60")]
    texts += ["", " ", "  a  ", "a\u2581b", "\u2581", " \u2581 \u2581\u2581x", "x" * 39 + " " + "ab" * 20 + " " + "internationalisation" * 9, "日本語 😀😀 ñandú", "the the the " * 50]
    for rate, seed in ((0.1, 7), (0.5, 1), (1.0, 2), (0.0, 0)):
        p = Pieces(MODEL, rate, seed)
        for got, text in zip(p.encode_all(texts), texts, strict=True):
            parts = [re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", (BLANK if k == 0 else "") + x.replace(" ", BLANK)) for k, x in enumerate(text.split(BLANK))]
            keys, want = iter(p.keys([text], np.array([sum(map(len, parts))])).tolist()), []
            for k, words in enumerate(parts):
                want += ([p.bytes_at + b for b in BLANK.encode()] if k else []) + [i for w in words for i in p.word(w, next(keys))]
            assert got.tolist() == want


def test_sentencepiece_empty_table_and_clashing_names(spark, docs):
    from skycensus.llm.sentencepiece_dropout import encode, stage

    more = docs.selectExpr("*", "1 as ids", "2 as n_tokens", "3 as lossless")
    assert encode(more.limit(0), ["doc_id"]).count() == 0 and stage(spark, more.limit(0), DIR).count() == 0
    assert stage(spark, more, DIR).count() == len(DOCS)


def test_chat_format(spark):
    got = out(spark, "op2_chat_format").set_index("conv_id")
    want: dict = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for c, _, role, text in rows(f"select conv_id, turn, role, text from '{DIR}/conversations.parquet' order by conv_id, turn"):
        want.setdefault(c, []).append((role, text or ""))
    assert set(got.index) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got.loc[c]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_edge_rows(spark):
    from pyspark.sql import functions as F

    from skycensus.llm.chat_format import events_of, fold, masked, read_back, render

    hard = "\\<|im_end|>\n<|im_start|>a\\ <<SYS>>[[INST]" + "😀" * 600
    data = [(1, 0, "user", hard), (1, 0, "user", hard), (1, 1, "assistant", hard), (1, None, None, None), (None, 2, "assistant", "")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    done = render(fold(events_of(df))).select("conv_id", read_back(F.col("formatted")).alias("t"), masked(F.col("formatted"), F.col("loss_spans")).alias("m")).collect()
    got = {r.conv_id: r for r in done}
    assert [(t.role, t.text) for t in got[1].t] == [("", ""), ("user", hard), ("user", hard), ("assistant", hard)]
    assert got[1].m == hard and got[None].m == ""
    assert render(fold(events_of(df.limit(0)))).count() == 0


def brute_fold(events):
    """Messages of a log by replaying each conversation's events one by one."""
    texts: dict = {}
    for conv, message, _, kind, text, at, cut in sorted(events, key=lambda e: (str(e[0]), e[1], e[2])):
        t = texts.get((conv, message), "")
        t = text if kind == "regenerate" else t + text if kind == "delta" else t[:at] + text + t[at + cut :]
        texts[conv, message] = t
    return texts


def test_chat_log_replay(spark):
    from skycensus.llm.chat_format import fold

    rng = np.random.default_rng(9)
    events, size = [], {}
    for conv in (1, 2, None):
        for seq in range(150):
            message, kind = int(rng.integers(0, 8)), str(rng.choice(["delta"] * 6 + ["edit", "edit", "regenerate"]))
            text = "é😀ab<"[: int(rng.integers(0, 6))] * int(rng.integers(1, 4))
            has = size.get((conv, message), 0)
            at = int(rng.integers(0, has + 9)) if kind == "edit" else None  # also past the end
            cut = int(rng.integers(0, has + 9)) if kind == "edit" else None
            size[conv, message] = has + len(text) if kind == "delta" else len(text) if kind == "regenerate" else len(("x" * has)[:at] + text + ("x" * has)[at + cut :])
            events.append((conv, message, seq, kind, text, at, cut))
    df = spark.createDataFrame(events, "conv_id long, message int, seq int, kind string, text string, at int, cut int").selectExpr("*", "'user' as role", "1 as base", "2 as parts")
    assert {(r.conv_id, r.message): r.text for r in fold(df.repartition(5)).collect()} == brute_fold(events)
    late = spark.createDataFrame([(1, 0, 0, "delta", "abc", None, None), (1, 0, 1, "edit", "X", 0, 10), (1, 0, 2, "delta", "def", None, None)], "conv_id long, message int, seq int, kind string, text string, at int, cut int")
    assert fold(late.withColumn("role", F.lit("user"))).first().text == "Xdef"


def test_chat_very_long_text_and_no_python_in_the_plan(spark):
    from pyspark.sql import functions as F

    from skycensus.llm.chat_format import events_of, fold, op2_chat_format, read_back, render

    long = "<|im_end|>[INST]x" * 20_000
    df = spark.createDataFrame([(1, 2, "assistant", long), (1, 4, "assistant", long)], "conv_id long, turn long, role string, text string")
    (row,) = render(fold(events_of(df))).select(read_back(F.col("formatted")).alias("t")).collect()
    assert [t.text for t in row.t] == [long, long]
    plan = op2_chat_format(spark, DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(("name", "label", "least"), [("op3_quality_classifier", "quality", 0.9), ("op5_toxicity", "toxic", 0.85)])
def test_classifiers_held_out(spark, name, label, least):
    got = out(spark, name).set_index("doc_id")
    want = dict(rows(f"select doc_id, {label} from '{DIR}/labels.parquet'"))
    held = [d for d in want if zlib.crc32(str(d).encode()) % 5 == 0]
    assert got.loc[held].held_out.all() and len(held) > 40
    assert np.mean([got.loc[d].predicted == want[d] for d in held]) >= least


def test_classifiers_edges(spark, docs):
    from skycensus.llm import quality, toxicity

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.score(docs, ["doc_id"], quality.fit(docs, none)).collect())
    assert all(r.score == 0 for r in toxicity.score(docs, ["doc_id"], toxicity.fit(docs, none)).collect())
    model = {"weights": {f" {toxicity.fold('loser').strip()} ": 5.0}, "exceptions": [toxicity.fold("loser tree")], "w": 1.0, "b": -1.0}
    texts = spark.createDataFrame([(1, "you L0ѕer!"), (2, "the loser tree"), (3, "closer")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(texts, ["doc_id"], model).collect()}
    assert got[1] > 0.5 > got[2] == got[3]


def test_toxic_lexicon_takes_short_and_long_words(spark):
    """Words of three letters and of over 24 are entries of their own; the counts come from the executors."""
    from skycensus.llm import toxicity

    long, data = "pneumonoultramicroscopicsilico", []
    for k in range(300):
        bad = k % 3 == 0
        data.append((k, f"plain words here {k} " + (("zug" if k % 2 else long) if bad else "pneumonoultra something") + " more plain text", int(bad)))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    assert {" zug ", f" {toxicity.fold(long).strip()} "} <= set(model["weights"])
    got = {r.doc_id: r.score for r in toxicity.score(df, ["doc_id"], model).collect()}
    assert all((got[d] >= 0.5) == bool(y) for d, _, y in data)
    folded = [toxicity.fold(t) for _, t, _ in data]  # every weight against a plain count over the texts it was learned from
    learnt = [k for k, (d, _, _) in enumerate(data) if zlib.crc32(str(d).encode()) % 5]
    n_bad = sum(data[k][2] for k in learnt)
    for e, w in model["weights"].items():
        bad = sum(e in folded[k] for k in learnt if data[k][2])
        good = sum(e in folded[k] for k in learnt if not data[k][2])
        assert w == pytest.approx(np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (len(learnt) - n_bad + 1)))


def test_matching_against_plain_search():
    from skycensus.llm import toxicity

    weights, spare = {" bad ": 2.0, " wor": 1.5, " worst ": 3.0}, [" bad luck "]
    found = toxicity.machine(weights, spare)
    rng = np.random.default_rng(3)
    for _ in range(200):
        text = toxicity.fold(" ".join(rng.choice(["bad", "luck", "worst", "world", "b4d", "ok"], rng.integers(0, 12))))
        at: dict = {}
        for e, w in weights.items():
            for k in range(len(text)):
                if text.startswith(e, k) and not any(text.startswith(x, s) and s <= k and k + len(e) <= s + len(x) for x in spare for s in range(len(text))):
                    at[k] = max(w, at.get(k, 0))
        assert toxicity.hits(found, text)[0] == pytest.approx(sum(at.values()))


def test_training_rows_take_an_id_once(spark):
    from skycensus.llm.common import training_rows

    df = spark.createDataFrame([(k % 3 + 1, f"text {k:03}") for k in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 2, 3)], "doc_id long, quality int")
    want = [(k, f"text {k - 1:03}", k % 2) for k in (1, 2, 3) if zlib.crc32(str(k).encode()) % 5]
    assert sorted(tuple(r) for r in training_rows(df, labels, "quality", 10).collect()) == want and want


def test_quality_sees_word_order(spark):
    from skycensus.llm import quality

    rng = np.random.default_rng(4)
    names = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    data = []
    for k in range(600):  # good texts walk the list of words in order, bad ones have the same words shuffled
        words = [names[(7 * k + j) % 300] for j in range(60)]
        data.append((k, " ".join(rng.permutation(words) if k % 2 else words), 1 - k % 2))
    df = spark.createDataFrame(data, "doc_id long, text string, quality int")
    got = {r.doc_id: r.score for r in quality.score(df, ["doc_id"], quality.fit(df, df.select("doc_id", "quality"))).collect()}
    held = [(got[d] >= 0.5) == y for d, _, y in data if zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(held) > 80 and np.mean(held) > 0.95


def test_license_scan(spark):
    from skycensus.llm.license_scan import TEMPLATES, align, scan_licenses

    found = set(out(spark, "op4_license_scan").doc_id)
    assert found == {r[0] for r in rows(f"select doc_id from '{DIR}/documents.parquet' where regexp_matches(text, '(Released under the MIT|icensed under)')")}
    mit = TEMPLATES["MIT"].split()
    noisy = " ".join(w for k, w in enumerate(mit) if k % 11) + " tail"
    df = spark.createDataFrame([(1, "x y " + noisy + " " + noisy), (2, "nothing here"), (3, None), (4, "")], "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in scan_licenses(df, ["doc_id"]).collect()} == {(1, "MIT")}
    assert align(list("abcdef"), list("xabdefy")) == [(0, 1), (1, 2), (3, 3), (4, 4), (5, 5)]


def test_license_scan_over_whole_texts(spark):
    from skycensus.llm.license_scan import TEMPLATES, _WORD, align, scan, scan_licenses

    mit = TEMPLATES["MIT"].split()
    wide = " ".join(f"{w} fill{k} more{k}" for k, w in enumerate(mit))
    long = "lorem " * 20_000 + wide + " ipsum" * 20_000
    df = spark.createDataFrame([(1, wide), (2, long), (3, wide + " " + long), (3, wide + " " + long), (None, wide)], "doc_id long, text string").selectExpr("*", "1 as license", "2 as found")
    got = sorted(map(tuple, scan_licenses(df, ["doc_id"]).filter("license = 'MIT'").select("doc_id", "coverage").collect()), key=str)
    assert got == sorted([(1, 1.0), (2, 1.0), (3, 1.0), (3, 1.0), (None, 1.0)], key=str)
    assert scan_licenses(df.limit(0), ["doc_id"]).count() == 0
    rng = np.random.default_rng(5)  # against a longest common subsequence, which no alignment is over
    for name, text in TEMPLATES.items():
        t = _WORD.findall(text.lower())
        for _ in range(5):
            words = [w for w in t if rng.random() > 0.1]
            noisy = [x for w in words for x in [w, *(f"n{k}" for k in range(rng.integers(0, 4)))]]
            table = np.zeros((len(t) + 1, len(noisy) + 1), int)
            for i, a in enumerate(t):
                for j, b in enumerate(noisy):
                    table[i + 1, j + 1] = table[i, j] + 1 if a == b else max(table[i, j + 1], table[i + 1, j])
            assert 0.9 * table[-1, -1] <= len(align(t, noisy)) <= table[-1, -1], name
            found = scan(noisy, t, 0.5)
            assert found and found[0] <= table[-1, -1] / len(t) + 1e-9


def test_license_scan_leaves_prose_alone(spark):
    """Words of a license scattered over a long text, in order, are no license; a license among them is one."""
    from skycensus.llm.license_scan import TEMPLATES, scan_licenses

    fill = "and so the band of the town played in a park for all of the summer "
    album = "The album was released in 1990. " + fill * 20 + "They were under contract. " + fill * 20 + "He works in the city. " + fill * 5 + "She has a driver license. "
    mit = TEMPLATES["MIT"].split()
    spread = " ".join(f"{w} {fill}" for w in mit)
    df = spark.createDataFrame([(1, album), (2, spread), (3, fill * 2000), (4, album + TEMPLATES["MIT-line"] + album), (5, spread + TEMPLATES["MIT"] + spread)], "doc_id long, text string")
    assert {(r.doc_id, r.license, r.coverage) for r in scan_licenses(df, ["doc_id"]).collect()} == {(4, "MIT-line", 1.0), (5, "MIT", 1.0)}


def brute_components(ids, links):
    low = {i: i for i in ids}

    def top(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        low[b] = a
    return {i: top(i) for i in ids}


def brute_embeddings(data):
    ok = {i: np.array(v, float) for i, v, lab in data if lab is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label, links = {i: lab for i, _, lab in data}, []
    for lab in set(label.values()):
        ids = [i for i in ok if label[i] == lab]
        if ids:
            unit = np.stack([ok[i] / np.linalg.norm(ok[i]) for i in ids])
            links += [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1)), strict=True)]
    n = Counter(x for p in links for x in p)
    return {i: (n[i], c) for i, c in brute_components([d[0] for d in data], links).items()}


def test_embeddings(spark):
    from skycensus.llm.embedding_dedup import near

    got = out(spark, "op6_embedding_dedup")
    want = brute_embeddings(rows(f"select vec_id, embedding, label from '{DIR}/embeddings.parquet'"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.itertuples()} == want
    rng = np.random.default_rng(1)
    heart = rng.normal(size=64)
    data = [(k, (heart + rng.normal(size=64) * 0.2).tolist(), 1) for k in range(1500)] + [(2000 + k, heart.tolist(), 1) for k in range(50)]
    data += [(3000, [0.0] * 64, 1), (3001, None, 1), (3002, [float("nan")] * 64, 1), (3003, heart.tolist(), None), (3004, [], 1), (3005, [None] * 64, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    want = brute_embeddings([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v] or None, lab) for i, v, lab in data])
    assert {r.vec_id: (r.n_links, r.component_id) for r in near(df).collect()} == want
    assert near(df.limit(0)).count() == 0


def test_embeddings_edges(spark):
    """String labels, extra columns, nearly parallel vectors far beyond the square root of a double, repeated ids, long dimensions apart."""
    from skycensus.llm.embedding_dedup import near

    big = [1e200, 2e200, 3e200]
    data = [(1, big, "a"), (2, [x * (1 + 1e-9) for x in big], "a"), (3, [-x for x in big], "a"), (3, [1e-200, 0.0, 0.0], "a"), (4, big, "b"), (5, [1.0, 2.0], "a"), (6, [2.0, 4.0], "a"), (6, [2.0, 4.0], "a"), (None, big, "a"), (7, [float("inf"), 1.0], "a")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label string").selectExpr("*", "1 as n", "2 as id", "3 as at", "4 as side")
    got = sorted(map(tuple, near(df).collect()), key=str)
    want = [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (3, 0, 3, True), (4, 0, 4, True), (5, 2, 5, True), (6, 2, 5, False), (6, 2, 5, False), (None, 0, None, True), (7, 0, 7, True)]
    assert got == sorted(want, key=str)


def test_embedding_collisions_are_counted_exactly():
    """Pairs from the sorted lines against windows compared one by one; sizes around a word of 64 bits, ties, one row."""
    from skycensus.llm.embedding_dedup import LINES, Plan, unit

    rng, plan = np.random.default_rng(3), Plan(16)
    for n, m in ((130, 200), (64, 64), (1, 65), (300, 1)):
        hearts = rng.normal(size=(9, 16))
        a, b = (unit(hearts[rng.integers(0, 9, k)] + rng.normal(size=(k, 16)) * 0.25) for k in (n, m))
        b[: m // 4] = b[0]
        for other, same in ((b, False), (a, True)):
            count = sum((np.abs((a @ plan.lines)[:, None, k] - (other @ plan.lines)[None, :, k]) <= plan.reach).astype(int) for k in range(LINES))
            want = {(i, j) for i, j in zip(*np.nonzero(count >= plan.least), strict=True) if not same or i < j}
            got = [(i, j) for block in plan.pairs(a, other, same) for i, j in zip(*block, strict=True)]
            assert len(got) == len(set(got)) and set(got) == want


def test_embeddings_repeated_most(spark, monkeypatch):
    """A vector over the bound of hot rows is joined by broadcast; all its rows come back, unusable ones too."""
    from skycensus.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "HOT_ROWS", 10)
    data = [(k, [1.0, 0.0], 1) for k in range(30)] + [(100, [0.0, 1.0], 1), (101, [0.001, 1.0], 1), (102, None, 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == brute_embeddings(data) and got[7] == (29, 0) and got[101] == (1, 100)


def test_embeddings_over_many_runs(spark):
    from skycensus.llm.embedding_dedup import near

    rng = np.random.default_rng(6)
    hearts = rng.normal(size=(40, 24))
    data = [(k, (hearts[k % 40] + rng.normal(size=24) * 0.17).tolist(), 1) for k in range(2500)]
    want = brute_embeddings(data)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), size=100).collect()}
    lost = sum(want[k][0] - got[k][0] for k in want)
    assert lost == 0 and got == want and sum(n for n, _ in want.values()) > 10_000


def test_mixing(spark, docs):
    from skycensus.llm.mixing import OP7_SQL, mix

    got = out(spark, "op7_source_mixing").sort_values("doc_id")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = con.execute(f"select * from ({OP7_SQL}) order by doc_id").df()
    assert (got[want.columns].to_numpy() == want.to_numpy()).all()
    assert (got.taken <= 2 * got["size"]).all() and abs(got.taken.sum() / (1.5 * got["size"].sum()) - 1) < 0.1
    assert mix(docs).count() == len(DOCS) and mix(docs.limit(0)).count() == 0


def test_mixing_stage_meets_each_target(spark):
    from skycensus.llm.mixing import stage, targets

    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    data = [(s, None if k % 3 == 0 else k, words(k, 9000 if k == 200 else 1 + k % 30), "en", 1) for s in ("a", "b", None) for k in range(500)]
    df = spark.createDataFrame(data, "source string, doc_id long, text string, lang string, n_chars long")
    sized = spark.createDataFrame([(d[0], len(d[2].split())) for d in data], "source string, size long")
    want = {r.source: r.target for r in targets(sized).collect()}
    got, most = Counter(), Counter()
    for r in stage(spark, df, DIR).select("source", "text").collect():
        got[r.source] += len(r.text.split())
        most[r.source, r.text] += 1
    for s in want:  # no document that could be taken once more fits what is left
        left = [len(d[2].split()) for d in data if d[0] == s and most[s, d[2]] < want[s] / sum(len(x[2].split()) for x in data if x[0] == s)]
        assert 0 <= want[s] - got[s] < min(left, default=1), (s, want[s], got[s])


def test_mixing_of_equal_rows(spark):
    """Rows alike in all columns: as many are taken as their source's target holds, in query and stage alike, also where the threshold lies on them."""
    from skycensus.llm.mixing import cut, mix, sizes, stage

    data = [(1, "w " * 10, "en", "c", 1)] * 400 + [(k, f"t{k} " * 7, "en", "a", 1) for k in range(50)] + [(k, f"u{k} " * 30, "en", "b", 1) for k in range(100)] + [(None, None, None, None, None)] * 5
    df = cut(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(7))
    got = mix(df).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("copies").alias("most"), F.max("size").alias("size"), F.count("*").alias("n")).collect()
    per = {r.source: r for r in got}
    assert per["c"].n == 400 and all(0 <= r.target - r.taken <= r.size and r.most <= 2 for r in got)
    again = {r.source: r.taken for r in mix(df).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()}
    assert again == {s: r.taken for s, r in per.items()}
    mixed = {r.source: r.n for r in stage(spark, df, DIR).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert mixed["c"] == per["c"].taken // 10 and mixed[None] == 5 and sizes(df).count() == len(data)


def test_sharding(spark, docs):
    from skycensus.llm.sharding import Tree, pack, shard

    got = out(spark, "op8_sharding")
    assert set(got["shard"]) == set(range(24)) and (got.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s))))).all()
    by = got.groupby("shard")["size"].sum()
    assert by.max() <= 1.1 * by.mean()
    text = dict(rows(f"select doc_id, text from '{DIR}/documents.parquet'"))
    assert len({(text[d], s) for d, s in zip(got.doc_id, got["shard"], strict=True)}) == len(set(text.values()))
    tree = Tree()
    for k in [5, 3, 9]:
        tree.add((k, k))
    assert [tree.take(4), tree.take(4), tree.take(4), tree.take(1)] == [(5, 5), (9, 9), None, (3, 3)]
    assert pack([(6, "a"), (5, "b"), (4, "c"), (5, "d")], 10)[1] == 2
    assert shard(docs).count() == len(DOCS) and shard(docs.limit(0)).count() == 0


def test_sharding_keeps_a_group_that_fits_whole(spark):
    from skycensus.llm.sharding import shard

    data = [(k, f"text {k} " + "x" * 60) for k in range(2400)] + [(10_000 + k, "y" * 66) for k in range(75)]  # the group is 0.72 of a shard
    got = shard(spark.createDataFrame(data, "doc_id long, text string")).toPandas()
    assert got[got.doc_id >= 10_000]["shard"].nunique() == 1
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 24 and by.max() <= 1.1 * by.mean()


def test_sharding_of_a_text_over_a_whole_shard(spark):
    """Of 60 % of all rows one text: it takes as few shards as hold it, every other group stays whole, sizes are near equal."""
    from skycensus.llm.sharding import shard

    data = [(k if k % 2 else 1, "z" * 60) for k in range(3600)] + [(10_000 + k, f"text {k // 3} " + "x" * (20 + k // 3 % 50)) for k in range(2400)]
    got = shard(spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as key", "2 as shard", "3 as part")).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert len(got) == len(data) and len(by) == 24 and by.max() <= 1.06 * by.mean()
    few = got[got["text_crc32"] == zlib.crc32(b"z" * 60)]
    share = got["size"].sum() / 24
    assert few["shard"].nunique() <= few["size"].sum() / share + 2
    rest = got[got.doc_id >= 10_000]
    assert (rest.assign(group=(rest.doc_id - 10_000) // 3).groupby("group")["shard"].nunique() == 1).all()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])


def brute_best_fit(items, capacity):
    rooms = []
    for size in sorted(items, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= size]
        if fit:
            rooms[min(fit, key=lambda k: (rooms[k], k))] -= size
        else:
            rooms.append(capacity - size)
    return sorted(rooms)


def test_best_fit_against_a_plain_search():
    from skycensus.llm.sharding import pack, pack_counts

    rng = np.random.default_rng(8)
    for _ in range(60):
        items = [int(x) for x in rng.integers(1, 60, rng.integers(1, 120))]
        capacity = int(rng.integers(60, 130))
        want = brute_best_fit(items, capacity)
        bins, n = pack([(s, k) for k, s in enumerate(items)], capacity)
        assert n == len(want) and sorted(capacity - sum(items[k] for k in bins if bins[k] == b) for b in range(n)) == want
        counts = sorted(Counter(items).items(), reverse=True)
        runs, n = pack_counts(counts, capacity)
        assert sorted(capacity - sum(counts[k][0] * m for k, _, m, c in runs if c == b) for b in range(n)) == want


def brute_repeats(words):
    win = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    n = Counter(win)
    return len({k + j for k, w in enumerate(win) if n[w] > 1 for j in range(8)})


def test_quality_rules(spark, docs):
    from skycensus.llm.quality_rules import judge

    got = out(spark, "op9_quality_rules").set_index("doc_id")
    for d, text in rows(f"select doc_id, text from '{DIR}/documents.parquet'"):
        words = [w.decode() for w in text.encode().split()]
        lines = [x for x in text.split("\n") if x.encode().split()]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), brute_repeats(words))
        assert tuple(got.loc[d][["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want, d
    good = [d for (d,) in rows(f"select doc_id from '{DIR}/labels.parquet' where quality = 1")]
    fine = got.loc[good]
    assert fine[~fine.base_failed].kept.mean() > 0.98
    assert judge(docs, ["doc_id"]).filter("kept").count() == 0
    assert [r.n_repeat_words for r in judge(docs, ["doc_id"]).filter("doc_id = 4").collect()] == [30_000] * 2


def brute_fp(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


@pytest.mark.parametrize("hot", [None, 3])
def test_components_with_hot_nodes(spark, hot):
    from skycensus.llm.common import components, with_group

    draw = random.Random(3)
    links = [(7, k) for k in range(100, 400)] + [(999, k) for k in range(400, 700)] + [(999, 5)]  # a low and a high hub
    links += [(k, k + 1) for k in range(1000, 1040)] + [(draw.randrange(2000, 2400), draw.randrange(2000, 2400)) for _ in range(250)] + [(1, 1)]
    draw.shuffle(links)
    nodes = sorted({n for a, b in links if a != b for n in (a, b)})
    got = components(spark.createDataFrame(links, "a long, b long"), hot=hot).collect()
    assert len(got) == len(nodes) and {r.node: r.root for r in got} == brute_components(nodes, [x for x in links if x != (1, 1)])
    rows = spark.createDataFrame([(k if k < 5 else 9, k) for k in range(50)], "key int, x long")
    got = with_group(rows, "key", F.min("x").alias("least"), hot=hot).select("key", "x", "least").collect()
    assert sorted(map(tuple, got)) == [(k if k < 5 else 9, k, min(k, 5)) for k in range(50)]
    assert with_group(rows.limit(0), "key", F.min("x").alias("least"), hot=hot).count() == 0


def test_simhash(spark, docs):
    from skycensus.llm.simhash import classes, links

    got = out(spark, "op10_simhash").set_index("doc_id")
    fps = {d: brute_fp(t) for d, t in rows(f"select doc_id, text from '{DIR}/documents.parquet'")}
    ids = sorted(fps)
    near = brute_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert {d: (f"{fps[d]:016x}", near[d]) for d in ids} == {d: (r.fingerprint, r.component_id) for d, r in got.iterrows()}
    assert classes(docs).count() == len(DOCS) and classes(docs.limit(0)).count() == 0
    rng = np.random.default_rng(2)
    many = {0} | {sum(1 << int(b) for b in rng.choice(20, 6, replace=False)) for _ in range(3000)}
    found = {frozenset((r.a, r.b)) for r in links(spark.createDataFrame([(x,) for x in many], "fp long"), 4, 256).collect()}
    order = sorted(many)
    x = np.array(order, dtype=np.uint64)
    pairs = [(order[i], order[j]) for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x) <= 4, 1)), strict=True)]
    assert brute_components(order, [tuple(p) for p in found]) == brute_components(order, pairs)


def test_simhash_stage_keeps_each_class_once(spark):
    from skycensus.llm.simhash import stage

    one, two, three = (" ".join(f"{w}{k}" for k in range(60)) for w in ("ash", "birch", "cedar"))
    data = [(None, one, "en", "s", 1), (None, one, "en", "s", 1), (None, one, "de", "s", 1), (7, two, "en", "s", 1), (7, three, "en", "s", 1), (9, three, "en", "s", 1), (None, two, "en", "s", 1), (8, None, "en", "s", 0), (None, "", None, None, 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((tuple(r)[:2] for r in stage(spark, df.repartition(4), DIR).collect()), key=str)
    assert got == sorted([(None, one), (7, two), (7, three), (8, None)], key=str)
    assert stage(spark, df.limit(0), DIR).count() == 0


def brute_features(text):
    """Counts of hashed words, runs of two and three words, shapes, shape pairs and marks, with plain integers."""
    from skycensus.llm.quality import BITS, _shape

    m, words, out = 2**64 - 1, (text or "").split(), Counter()
    mix = lambda c: ((c ^ c >> 29) * 0xBF58476D1CE4E5B9 & m) >> 32
    word = [zlib.crc32(w.encode()) for w in words]
    shape = [zlib.crc32(b"\x01" + _shape(w).encode()) for w in words]
    two = [mix((a * 0x9E3779B97F4A7C15 + b) & m) for a, b in zip(word, word[1:], strict=False)]
    three = [mix((a * 0x9E3779B97F4A7C15 + b) & m) for a, b in zip(two, word[2:], strict=False)]
    mark = [(w in word[:k]) + 2 * (k > 0 and word[k - 1] == w) + 5 for k, w in enumerate(word)]
    pairs = [(a * 0x9E3779B1 + b * 31 + c * 0x85EBCA6B) & 0xFFFFFFFF for a, b, c in zip(shape, shape[1:], mark[1:], strict=False)]
    for x in word + two + three + shape + pairs + mark:
        out[((x * 2654435761 & m) >> 8) % ((1 << BITS) - 1) + 1] += 1
    norm = sum(n * n for n in out.values()) ** 0.5
    return {0: 1.0} | {k: n / norm for k, n in out.items()}


def brute_ftrl(data, epochs=4, alpha=0.5, beta=1.0, l1=0.0005, l2=0.0005):
    z, n = Counter(), Counter()

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - np.sign(z[k]) * l1) / ((beta + n[k] ** 0.5) / alpha + l2)

    order = np.random.default_rng(3)
    for _ in range(epochs):
        for r in order.permutation(len(data)):
            y, x = data[r]
            p = 1 / (1 + np.exp(-sum(weight(k) * v for k, v in x.items())))
            for k, v in x.items():
                g, w = (p - y) * v, weight(k)
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / alpha * w
                n[k] += g * g
    return {k: weight(k) for k in z}


def test_quality_against_plain_loops(spark):
    from skycensus.llm.quality import features, fit, score

    labelled = rows(f"select doc_id, text, quality from '{DIR}/documents.parquet' join '{DIR}/labels.parquet' using (doc_id) where length(text) < 600 order by doc_id limit 70")
    for _, text, _ in [*labelled, (0, "", 0), (0, "one", 0), (0, "Aa1 " * 40 + "x" * 3000, 0)]:
        at, x = features(text)
        want = brute_features(text)
        assert set(at.tolist()) == set(want) and np.allclose([want[k] for k in at.tolist()], x)
    df = spark.createDataFrame(labelled, "doc_id long, text string, quality int")
    learnt = [(y, {k: np.float32(v).astype(float) for k, v in brute_features(t).items()}) for d, t, y in labelled if zlib.crc32(str(d).encode()) % 5]
    want = brute_ftrl(learnt)
    model = fit(df, df.select("doc_id", "quality"))
    assert all(model[k] == pytest.approx(w, abs=1e-5) for k, w in want.items()) and np.count_nonzero(model) == sum(w != 0 for w in want.values())
    for r in score(df, ["doc_id"], model).collect():
        text = next(t for d, t, _ in labelled if d == r.doc_id)
        assert r.score == pytest.approx(1 / (1 + np.exp(-sum(want.get(k, 0) * v for k, v in brute_features(text).items()))), abs=1e-4)


def test_empty_tables_and_clashing_names(spark, docs):
    from skycensus.llm import license_scan, quality, quality_rules, simhash, toxicity

    more = docs.selectExpr("*", "1 as y", "2 as fp", "3 as found", "4 as x", "5 as w", "6 as t", "7 as rank", "8 as license")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for df, n in ((more, len(DOCS)), (more.limit(0), 0)):
        assert quality.score(df, ["doc_id"], quality.fit(df, labels)).count() == n
        assert toxicity.score(df, ["doc_id"], toxicity.fit(df, labels)).count() == n
        assert quality_rules.judge(df, ["doc_id"]).count() == n and simhash.classes(df).count() == n
        assert license_scan.scan_licenses(df, ["doc_id"]).count() == 0


def test_rules_keep_what_plain_code_keeps(spark):
    """kept of every document against the thresholds applied in plain code to plain counts."""
    from skycensus.llm.quality_rules import STOP_WORDS

    got = out(spark, "op9_quality_rules").set_index("doc_id")
    for d, text in rows(f"select doc_id, text from '{DIR}/documents.parquet'"):
        words = [w.decode() for w in text.encode().split()]
        lines = [x for x in text.split("\n") if x.encode().split()]
        n = max(1, len(words))
        bang = sum(c == "!" and (k + 1 == len(text) or text[k + 1] in " \t\n\v\f\r") for k, c in enumerate(text))
        failed = len(words) < 20 or 100 * brute_repeats(words) > 30 * len(words)
        rules = [2 <= sum(map(len, words)) / n <= 20, sum(c in "#*$%&|<>" for c in text) / n <= 0.4, sum(w.lower() in STOP_WORDS for w in words) / n >= 0.01, (len(lines) - len(set(lines))) / max(1, len(lines)) <= 0.5, bang / n <= 0.5]
        assert (got.loc[d].base_failed, got.loc[d].kept) == (failed, not failed and all(rules)), d


def test_pipeline_stages(spark):
    """Each stage's rows against a plain check of its decision on what the stage before it kept."""
    import corpus_pipeline
    from skycensus.llm import quality, toxicity
    from skycensus.llm.common import cut, table
    from skycensus.llm.mixing import targets
    from skycensus.llm.sentencepiece_dropout import MODEL, Pieces

    docs, labels, kept = table(spark, DIR, "documents"), table(spark, DIR, "labels"), []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "simhash near-dedup", "mixing to target weights", "sentencepiece encoding"]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(docs)
        docs = cut(stage(spark, docs, DIR))
    kept.append(docs)
    assert all(set(df.columns) == {"doc_id", "text", "lang", "source", "n_chars"} for df in kept[:5])
    ids = [Counter(r.doc_id for r in df.select("doc_id").collect()) for df in kept]
    bad = {r.doc_id for r in toxicity.score(kept[0], ["doc_id"], toxicity.fit(kept[0], labels)).filter("score >= 0.5").collect()}
    assert bad and set(ids[1]) == set(ids[0]) - bad
    low = {r.doc_id for r in quality.score(kept[1], ["doc_id"], quality.fit(kept[1], labels)).filter("score < 0.3").collect()}
    assert low and set(ids[2]) == set(ids[1]) - low
    fps = {r.doc_id: brute_fp(r.text) for r in kept[2].collect()}
    order = sorted(fps)
    x = np.array([fps[d] for d in order], dtype=np.uint64)
    links = [(order[i], order[j]) for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x) <= 4, 1)), strict=True)]
    assert set(ids[3]) == set(brute_components(order, links).values()) and max(ids[3].values()) == 1
    sized = {r.doc_id: (r.source, len(r.text.encode().split())) for r in kept[3].collect()}
    goal = {r.source: r.target for r in targets(spark.createDataFrame(list(sized.values()), "source string, size long")).collect()}
    took = Counter()
    for d, n in ids[4].items():
        took[sized[d][0]] += n * sized[d][1]
    assert max(ids[4].values()) <= 2
    for s, target in goal.items():
        assert target - max(n for t, n in sized.values() if t == s) <= took[s] <= target, s
    p = Pieces(MODEL, 0.1, 7)
    assert ids[5] == ids[4]
    text = {r.doc_id: r.text for r in kept[4].collect()}
    for r in kept[5].collect():
        assert r.lossless and p.decode(r.ids) == text[r.doc_id] and r.n_tokens == len(r.ids) and r.ids == p.encode(text[r.doc_id])


def test_pipeline_run_with_null_and_repeated_ids(spark, tmp_path):
    """A clean document stays whatever its id; repeats of one text leave one of them."""
    import corpus_pipeline

    base = rows(f"select text from '{DIR}/documents.parquet' join '{DIR}/labels.parquet' using (doc_id) where quality = 1 and toxic = 0 and lang = 'en' and length(text) between 400 and 2000 order by doc_id limit 6")
    texts = [t for (t,) in base]
    data = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (8, texts[4]), (None, texts[4])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    real = spark.read.parquet(f"{DIR}/documents.parquet").select(*docs.columns)
    real.unionByName(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DIR}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    with_stage = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        with_stage = stage(spark, with_stage, str(tmp_path))
    assert sorted((str(r.doc_id), r.text) for r in with_stage.collect()) == sorted([("None", texts[0]), ("None", texts[1]), ("7", texts[2]), ("7", texts[3]), ("8", texts[4])])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.filter("not lossless").isEmpty() and got.count() > 500
