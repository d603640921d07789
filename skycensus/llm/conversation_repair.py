"""Conversation structure repair by weighted interval parsing.

A repaired conversation has role initials (s?(ua)+)?. The repair grammar in Chomsky normal form has a nonterminal N_pq for each
two states of that form (0 start, 1 after s, 2 after u, 3 after a): N_pq -> N_pr N_rq, and N_pq -> row by keep (cost 0), rerole to user
or assistant (1) or delete (2; the one way for a blank row or a duplicate); an undeleted truncated row costs 5 more. Every row's cell is
closed under inserts of an empty user or assistant turn (5) on both sides. A cell holds the least (cost, audit), the audit being
the initials D, I, K, R of the edits in order. Two audits of equal cost over the same rows are never one the beginning of the other
(the longer one would have more inserts), so the lesser one stays the lesser when something follows: cells can be joined.

Cells are filled bottom-up by span length, all splits of all spans, for blocks of BLOCK rows, all blocks of a length at once in
numpy, a cell packed in one integer. As nonterminals name both states, any one split gives the cell of a longer span: blocks are
joined in pairs, then pairs of pairs, to pieces of PIECE rows and to conversations.

Rows are dealt by ranges of (conversation, turn, role, text), so a hot conversation is many pieces in many tasks. Equal rows of one turn are
summed up beforehand; copies beyond the first are always deleted, and their D's follow the row's letter (no order of audits changes by that).
What one task gets of a whole conversation are its cells and, for the digest, its repaired text as a stream of pieces.

Rows come by turn, nulls first, then role and text. A null conv_id is one conversation; null role or text count as one space,
so such a text is blank. Repeated rows of a turn are duplicates. A conversation without rows after damage keeps its row of zeros.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycensus.llm.common import cut, table, with_group

BLOCK, PIECE, PIECE_CHARS = 16, 4096, 8 << 20
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
USER, ASSISTANT = "user", "assistant"
#: State after a row with this initial, by state before it.
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Nonterminals that can be reached: only 0 leads to 0, only 0 and 1 to 1.
PAIRS = [(p, q) for p in range(4) for q in range(4) if (q > 1 or p == q or (p, q) == (0, 1))]
AT = {x: k for k, x in enumerate(PAIRS)}
RULES = [(AT[p, q], AT[p, r], AT[r, q]) for p, q in PAIRS for r in range(4) if (p, r) in AT and (r, q) in AT]
TARGET, LEFT, RIGHT = map(np.array, zip(*RULES, strict=True))
FIRST = np.flatnonzero(np.diff(TARGET, prepend=-1))
LETTERS = "DIKR"
OK, BLANK, DUPLICATE, CUT_OFF = range(4)
#: A packed cell: cost << 54 | 24 letters of 2 bits, first one highest << 6 | number of letters; NONE: no derivation.
MOST, CODE = 24, (1 << 48) - 1
NONE = 100 << 54
Cell = tuple[int, str]


def joined(a: dict[int, Cell], b: dict[int, Cell]) -> dict[int, Cell]:
    """Cells of two neighbouring spans as the cells of both; what else a cell carries is added up, too."""
    out: dict[int, Cell] = {}
    for t, l, r in RULES:  # noqa: E741
        if l in a and r in b:
            made = tuple(x + y for x, y in zip(a[l], b[r], strict=True))
            if t not in out or made[:2] < out[t][:2]:
                out[t] = made
    return out


def all_joined(cells: list[dict]) -> dict:
    """Spans joined two by two, by growing length."""
    while len(cells) > 1:
        cells = [joined(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0]


#: What inserts alone lead to.
CLOSURE: dict[int, Cell] = {AT[x]: (INSERT * n, "I" * n) for x, n in {(0, 0): 0, (1, 1): 0, (2, 2): 0, (3, 3): 0, (0, 2): 1, (1, 2): 1, (2, 3): 1, (3, 2): 1, (0, 3): 2, (1, 3): 2}.items()}


def leaf(initial: str, fault: int) -> dict[int, Cell]:
    """Cells of one row, closed under inserts."""
    ways = [((p, p), (DELETE, "D")) for p in range(4)]
    if fault in (OK, CUT_OFF):
        more = TRUNCATED if fault == CUT_OFF else 0
        ways += [((p, q), (more, "K")) for p, q in STEP.get(initial, {}).items()]
        ways += [((p, q), (more + REROLE, "R")) for to in "ua" for p, q in STEP[to].items()]
    best: dict[int, Cell] = {}
    for x, cell in ways:
        best[AT[x]] = min(best.get(AT[x], cell), cell)
    return joined(joined(CLOSURE, best), CLOSURE)


def packed(cell: Cell | None) -> int:
    if cell is None:
        return NONE
    code = sum(LETTERS.index(x) << (2 * (MOST - 1 - k)) for k, x in enumerate(cell[1]))
    return cell[0] << 54 | code << 6 | len(cell[1])


def unpacked(x: int) -> Cell:
    return x >> 54, "".join(LETTERS[x >> (6 + 2 * (MOST - 1 - k)) & 3] for k in range(x & 63))


KINDS = [(i, f) for i in ("s", "u", "a", "") for f in (OK, BLANK, CUT_OFF)]
LEAVES = np.array([[packed(c.get(k)) for k in range(len(PAIRS))] for c in (leaf(*x) for x in KINDS)], np.int64)
KIND_AT = {(i, f): k for k, (i, f) in enumerate(KINDS)} | {(i, DUPLICATE): k for k, (i, f) in enumerate(KINDS) if f == BLANK}


def cells_of(kinds: np.ndarray) -> np.ndarray:
    """Packed cells of whole blocks, kinds[block, row], by all splits of all spans."""
    rows = kinds.shape[1]
    spans = {(i, 1): LEAVES[kinds[:, i]] for i in range(rows)}
    for size in range(2, rows + 1):
        for i in range(rows - size + 1):
            a = np.stack([spans[i, m] for m in range(1, size)])[:, :, LEFT]
            b = np.stack([spans[i + m, size - m] for m in range(1, size)])[:, :, RIGHT]
            cost = np.minimum((a >> 54) + (b >> 54), NONE >> 54)
            n = a & 63
            code = (a >> 6 & CODE) | ((b >> 6 & CODE) >> (2 * np.minimum(n, 31)))
            both = cost << 54 | code << 6 | np.minimum(n + (b & 63), 63)
            spans[i, size] = np.minimum.reduceat(both.min(axis=0), FIRST, axis=1)
    return spans[0, rows]


def parsed(pieces: list[list[int]]) -> list[dict[int, Cell]]:
    """Cells of pieces, given by the kinds of their rows."""
    blocks: dict[int, list] = {}
    for k, kinds in enumerate(pieces):
        for at in range(0, len(kinds), BLOCK):
            part = kinds[at : at + BLOCK]
            blocks.setdefault(len(part), []).append((k, at, part))
    done: list[dict[int, dict]] = [{} for _ in pieces]
    for some in blocks.values():
        made = cells_of(np.array([x[2] for x in some])).tolist()
        for (k, at, _), cells in zip(some, made, strict=True):
            done[k][at] = {t: unpacked(x) for t, x in enumerate(cells) if x < NONE}
    return [all_joined([d[at] for at in sorted(d)]) if d else CLOSURE for d in done]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, key (never null), turn, role, text, n: distinct rows after damage and how many there are; n = 0: dropped."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    role = F.when(hit == 0, "").when(hit == 4, USER).otherwise(part("role"))
    text = F.when(hit <= 1, "").when(hit == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    n = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    return rows.select("conv_id", part("conv_id").alias("key"), "turn", role.alias("role"), text.alias("text"), n.alias("n")).groupBy("conv_id", "key", "turn", "role", "text").agg(F.sum("n").alias("n"))


def with_faults(rows: DataFrame, hot: int | None = None) -> DataFrame:
    """Adds fault, of the first of the equal rows."""
    same = F.sha2(F.concat_ws(":", F.length("key"), "key", F.length("role"), "role", "text", F.when(F.col("n") == 0, "-")), 256)
    when = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"))
    rows = with_group(rows.withColumn("same", same), "same", F.min(when).alias("first"), hot=hot)
    fault = F.when(~F.col("text").rlike(r"[^ \t-\r]"), BLANK).when(when > F.col("first"), DUPLICATE).when(F.col("text").rlike(r"[.!?][ \t-\r]*\z"), OK).otherwise(CUT_OFF)
    return rows.select("conv_id", "key", "turn", "role", "text", "n", fault.cast("int").alias("fault"))


PIECES = (
    "key string, conv_id bigint, part bigint, no bigint, roles array<string>, texts array<string>, ns array<bigint>, faults array<int>, costs array<bigint>, audits array<string>, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, first_turn bigint, last_turn bigint, first string, last string"
)
LEGAL = ("su", "ua", "au")


def _piece(key, conv_id, part: int, no: int, rows: list[tuple]) -> dict:
    """The columns of a piece but its cells; rows (turn, role, text, n, fault)."""
    live = [r for r in rows if r[3]]
    starts = [r[1][:1] for r in live]
    turns = sorted({r[0] for r in live if r[0] is not None})
    return {
        "key": key, "conv_id": conv_id, "part": part, "no": no, "roles": [r[1] for r in live], "texts": [r[2] for r in live], "ns": [r[3] for r in live], "faults": [r[4] for r in live],
        "blank": sum(r[3] for r in live if r[4] == BLANK), "duplicate": sum(r[3] - (r[4] != DUPLICATE) for r in live if r[4] != BLANK), "truncated": sum(r[4] == CUT_OFF for r in live),
        "illegal": sum(a + b not in LEGAL for a, b in itertools.pairwise(starts)) + sum(r[3] - 1 for r in live), "turns": len(turns),
        "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "first": starts[0] if live else None, "last": starts[-1] if live else None,
    }


def pieces(rows: DataFrame) -> DataFrame:
    """PIECES of rows with faults."""
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    names = [x.split()[0] for x in PIECES.split(", ")]

    def closed(made: list[dict]) -> pa.RecordBatch:
        kinds = [[KIND_AT[(r[:1] if r[:1] in STEP else "", f)] for r, f in zip(p["roles"], p["faults"], strict=True)] for p in made]
        for p, cells in zip(made, parsed(kinds), strict=True):
            p |= {"costs": [cells.get(k, (None, None))[0] for k in range(len(PAIRS))], "audits": [cells.get(k, (None, None))[1] for k in range(len(PAIRS))]}
        schema = {"string": pa.string(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
        return pa.RecordBatch.from_pylist(made, pa.schema([(n, schema[x.split()[1]]) for n, x in zip(names, PIECES.split(", "), strict=True)]))

    def run(batches):
        part, now, held, no, size, done, waiting = TaskContext.get().partitionId(), None, [], 0, 0, [], 0
        for batch in batches:
            for key, conv_id, *row in zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)], strict=True):
                if now is not None and (key != now[0] or len(held) >= PIECE or size >= PIECE_CHARS):
                    done.append(_piece(*now, part, no, held))
                    waiting += len(held)
                    no, held, size = no + 1, [], 0
                    if waiting >= PIECE:
                        yield closed(done)
                        done, waiting = [], 0
                now = (key, conv_id)
                held.append(tuple(row))
                size += len(row[2])
        if now is not None:
            yield closed([*done, _piece(*now, part, no, held)])

    dealt = rows.select("key", "conv_id", "turn", "role", "text", "n", "fault").repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, PIECES)


def choices(parts: DataFrame) -> DataFrame:
    """(key, part, no, enter, leave): the states between which the best parse of its conversation takes each piece."""
    cells = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "no", "costs", "audits"))).alias("all"))

    def run(batches):
        for batch in batches:
            out = []
            for key, every in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = [{t: (c, a, (PAIRS[t],)) for t, (c, a) in enumerate(zip(p["costs"], p["audits"], strict=True)) if c is not None} for p in every]
                whole = all_joined(spans)
                best = min(whole[AT[0, q]] for q in (0, 3) if AT[0, q] in whole)
                out += [(key, p["part"], p["no"], *pair) for p, pair in zip(every, best[2], strict=True)]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] + [pa.int64()] * 4, strict=True)], names=["key", "part", "no", "enter", "leave"])

    return cells.mapInArrow(run, "key string, part bigint, no bigint, enter bigint, leave bigint")


def repaired(audit: str, state: int, roles: list[str], texts: list[str], ns: list[int], faults: list[int]) -> tuple[list[str], int, str]:
    """(lines `role:text`, cost, audit with the copies) of one piece entered in this state."""
    lines, cost, out, rows = [], 0, [], iter(zip(roles, texts, ns, faults, strict=True))
    for x in audit:
        role, text = (ASSISTANT if state == 2 else USER), ""
        n = 1
        if x != "I":
            had, text, n, fault = next(rows)
            role = had if x == "K" else role
            cost += (TRUNCATED if fault == CUT_OFF and x != "D" else 0) + DELETE * (n - 1)
        cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[x]
        if x != "D":
            lines.append(f"{role}:{text}")
            state = STEP[role[:1]][state]
        out.append(x + "D" * (n - 1))
    return lines, cost, "".join(out)


RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def repair(rows: DataFrame, hot: int | None = None) -> DataFrame:
    """(key, conv_id, part, no, lines, cost, audit, ...): the repaired pieces of every conversation, in order of part and no."""
    parts = cut(pieces(with_faults(damaged(rows), hot)))
    met = parts.drop("costs").withColumn("cells", F.col("audits")).drop("audits").join(choices(parts), ["key", "part", "no"])
    stats = ["blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first", "last"]

    def run(batches):
        for batch in batches:
            t = batch.to_pydict()
            done = [repaired(c[AT[e, l]], e, r, x, n, f) for c, e, l, r, x, n, f in zip(*[t[k] for k in ("cells", "enter", "leave", "roles", "texts", "ns", "faults")], strict=True)]
            made = [pa.array([d[0] for d in done], pa.list_(pa.string())), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep))] + made, names=[*keep, "lines", "cost", "audit"])

    keep = ["key", "conv_id", "part", "no", *stats]
    kinds = {x.split()[0]: x for x in PIECES.split(", ")}
    fields = ", ".join(kinds[k] for k in keep)
    return met.select(*keep, "cells", "enter", "leave", "roles", "texts", "ns", "faults").mapInArrow(run, f"{fields}, lines array<string>, cost bigint, audit string")


def digests(done: DataFrame) -> DataFrame:
    """RESULT from repaired pieces, read as a stream."""

    def run(batches):
        now, out = None, []

        def row(s: dict) -> tuple:
            gaps = 0 if s["least"] is None else s["most"] - s["least"] + 1 - s["turns"]
            return (s["conv_id"], gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], "".join(s["audit"]), s["sha"].hexdigest())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

        for batch in batches:
            for p in batch.to_pylist():
                if now is None or now["key"] != p["key"]:
                    if now:
                        out.append(row(now))
                    now = {"key": p["key"], "conv_id": p["conv_id"], "least": None, "most": None, "last": None, "turns": 0, "audit": [], "sha": hashlib.sha256(), "any": False} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
                for k in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                    now[k] += p[k]
                if p["first_turn"] is not None:
                    now["turns"] -= p["first_turn"] == now["most"]  # a turn on both sides of the seam
                    now["least"], now["most"] = p["first_turn"] if now["least"] is None else now["least"], p["last_turn"]
                if p["first"] is not None:
                    now["illegal"] += now["last"] is not None and now["last"] + p["first"] not in LEGAL
                    now["last"] = p["last"]
                now["audit"].append(p["audit"])
                for line in p["lines"]:
                    now["sha"].update((("\n" if now["any"] else "") + line).encode())
                    now["any"] = True
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if now:
            yield batch_of([*out, row(now)])

    return done.repartition("key").sortWithinPartitions("key", "part", "no").mapInArrow(run, RESULT)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repair(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
