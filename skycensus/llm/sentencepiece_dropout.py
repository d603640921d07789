"""Encoding and decoding with a merge-type piece vocabulary, with seeded merge-dropout.

The agenda holds adjacent pairs by score, best and leftmost first. A candidate merge is skipped when a keyed
hash of (seed, text, place of the word, piece, places of both sides) falls under the dropout rate, so each
occurrence of a word is drawn by itself, and alike in each run. Words of the vocabulary never go past a blank, so texts are
encoded word by word. Null text: null ids and text. Empty text: no ids. Decoding gives back every text: a
literal piece blank is written as bytes.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycensus.llm.common import map_texts, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Words under so many characters are merged many at once.
SHORT, TABLE_BITS = 40, 18
#: Symbols: none to merge with, merged into another, a character of no piece. A table slot that holds no pair.
NONE, DEAD, STRANGE, EMPTY = 2**31 - 1, -2, -3, -9
_64 = 2**64 - 1


class Pieces:
    def __init__(self, path: str, rate: float, seed: int, variants: int = 0):
        """`variants` is not used any more: the draws of a word are not bounded."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.bytes_at = model.piece_to_id("<0x00>")
        usable = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.rank = {names[i]: (-model.get_score(i), i) for i in usable}
        self.out = [names[i].replace(BLANK, " ").encode() for i in range(n)]
        for b in range(256):
            self.out[self.bytes_at + b] = bytes([b])
        self.blank = np.array([self.bytes_at + b for b in BLANK.encode()], np.int32)
        self._pair_table(names, usable)
        self.rate, self.seed = min(int(rate * 2**64), _64), seed

    def _pair_table(self, names: list[str], usable: list[int]) -> None:
        """Symbols are the pieces by rank, then the characters that are no piece."""
        order = sorted(usable, key=lambda i: self.rank[names[i]])
        self.id_at = np.array(order, np.int32)
        number = {names[i]: r for r, i in enumerate(order)}
        for c in {c for i in order for c in names[i]} - number.keys():
            number[c] = len(number)
        self.symbols = len(number)
        # an open hash table of the pairs that merge: code of the pair, place in the ranking of what it makes
        self.table, self.merged = np.full(1 << TABLE_BITS, EMPTY, np.int64), np.zeros(1 << TABLE_BITS, np.int32)
        codes = {number[a] * self.symbols + number[b]: r for r, i in enumerate(order) for k in range(1, len(names[i])) if (a := names[i][:k]) in number and (b := names[i][k:]) in number}
        for code, at in zip(codes, self.slot(np.array(list(codes), np.int64)).tolist(), strict=True):
            while self.table[at] != EMPTY:
                at = (at + 1) & (len(self.table) - 1)
            self.table[at], self.merged[at] = code, codes[code]
        self.symbol_of = np.full(0x110000, STRANGE, np.int32)
        for c, r in number.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = r

    def keys(self, texts: list[str], n: np.ndarray) -> np.ndarray:
        """A key for each of the n words of each text."""
        if not self.rate:
            return np.zeros(n.sum(), np.uint64)
        seeds = np.fromiter((xxhash.xxh64_intdigest(t, self.seed) for t in texts), np.uint64, len(texts))
        place = np.arange(1, n.sum() + 1, dtype=np.uint64) - np.repeat(np.cumsum(n) - n, n).astype(np.uint64)
        k = np.repeat(seeds, n) + place * np.uint64(0x9E3779B97F4A7C15)
        k = (k ^ k >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        k = (k ^ k >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return k ^ k >> np.uint64(31)

    def word(self, word: str, keyed: int) -> list[int]:
        """Merge the characters of one word by the agenda; its key is mixed with each candidate."""
        sym, n = list(word), len(word)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list = []

        def propose(i: int, j: int) -> None:
            if i >= 0 and j < n and (found := self.rank.get(sym[i] + sym[j])):
                if self.rate:
                    mixed = (keyed ^ (i * 0x9E3779B97F4A7C15 + j * 0xC2B2AE3D27D4EB4F + found[1] * 0x165667B19E3779F9 & _64)) * 0xFF51AFD7ED558CCD & _64
                    if (mixed ^ mixed >> 32) * 0xC4CEB9FE1A85EC53 & _64 < self.rate:
                        return
                heapq.heappush(agenda, (found[0], i, j, len(sym[i]), len(sym[j])))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, i, j, a, b = heapq.heappop(agenda)
            if len(sym[i]) != a or len(sym[j]) != b or right[i] != j:
                continue
            sym[i], sym[j] = sym[i] + sym[j], ""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            propose(left[i], i)
            propose(i, right[i])
        ids: list[int] = []
        for s in sym:
            if s:
                found = self.rank.get(s)
                ids += [found[1]] if found else [self.bytes_at + b for b in s.encode()]
        return ids

    def pairs(self, a: np.ndarray, b: np.ndarray, keyed: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Place in the ranking of the merge of symbols a and b, that start at i and j; NONE if there is none or it is skipped."""
        code = a.astype(np.int64) * self.symbols + b
        code[(a < 0) | (b < 0)] = -1
        slot = self.slot(code)
        out = np.full(code.shape, NONE, np.int32)
        todo = np.nonzero(self.table[slot] != EMPTY)  # only these can be pairs
        slot, code = slot[todo], code[todo]
        while len(code):
            hit = self.table[slot] == code
            at, r = tuple(t[hit] for t in todo), self.merged[slot[hit]]
            if self.rate:
                place = [x[at] if x.shape == out.shape else np.broadcast_to(x, out.shape)[at] for x in (keyed, i, j)]
                piece = self.id_at[r].astype(np.uint64) * np.uint64(0x165667B19E3779F9)
                mixed = (place[0] ^ (place[1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place[2].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + piece)) * np.uint64(0xFF51AFD7ED558CCD)
                stays = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xC4CEB9FE1A85EC53) >= np.uint64(self.rate)
                at, r = tuple(t[stays] for t in at), r[stays]
            out[at] = r
            slot = (slot + 1) & (len(self.table) - 1)  # the next slot, as others may have pushed a pair on
            left = ~hit & (self.table[slot] != EMPTY)
            todo, slot, code = tuple(t[left] for t in todo), slot[left], code[left]
        return out

    def slot(self, code: np.ndarray) -> np.ndarray:
        return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def many(self, chars: np.ndarray, start: np.ndarray, size: np.ndarray, keyed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short words at once, as word() gives them, and how many each has: each round pops every word's best candidate."""
        n, wide = len(start), int(size.max())
        place = np.arange(wide + 1)
        inside = place[:-1] < size[:, None]
        code = np.where(inside, chars[np.minimum(start[:, None] + place[:-1], len(chars) - 1)], 0)
        sym = np.full((n, wide + 1), -1, np.int32)
        sym[:, :-1] = np.where(inside, self.symbol_of[code], -1)
        right, left = np.tile(np.minimum(place + 1, wide), (n, 1)), np.tile(place - 1, (n, 1))
        best = np.full((n, wide + 1), NONE, np.int32)
        best[:, :wide] = self.pairs(sym[:, :-1], sym[:, 1:], keyed[:, None], place[:-1], place[1:])
        live = np.arange(n)
        while len(live):
            i = best[live].argmin(1)
            r = best[live, i]
            live, i, r = live[go := r < NONE], i[go], r[go]
            j = right[live, i]
            stop, h = right[live, j], left[live, i]
            sym[live, i], right[live, i], left[live, stop] = r, stop, i
            sym[live, j], best[live, j] = DEAD, NONE
            best[live, i] = self.pairs(r, sym[live, stop], keyed[live], i, stop)
            k = np.nonzero(h >= 0)[0]
            best[live[k], h[k]] = self.pairs(sym[live[k], h[k]], r[k], keyed[live[k]], h[k], i[k])
        held = (sym >= 0) | (sym == STRANGE)
        strange = (sym >= len(self.id_at)) | (sym == STRANGE)  # characters that are no piece fall back to bytes
        ids, count = np.where(strange, -1, self.id_at[np.clip(sym, 0, len(self.id_at) - 1)])[held], held.sum(1)
        if strange.any():
            raw = [chr(c).encode() for c in code[strange[:, :-1]].tolist()]
            long = np.ones(len(ids), np.int64)
            long[ids < 0] = [len(x) for x in raw]
            ids = np.repeat(ids, long)
            ids[ids < 0] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + self.bytes_at
            count = np.add.reduceat(long, np.cumsum(count) - count)
        return ids.astype(np.int32), count

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; every occurrence of a word is drawn by itself."""
        # a literal blank sign parts a text into bodies; words begin where a blank sign follows another character
        split = [[(BLANK if k == 0 else "") + part.replace(" ", BLANK) for k, part in enumerate(t.split(BLANK))] for t in texts]
        bodies = [x for xs in split for x in xs]
        body = np.cumsum([0, *map(len, bodies)])
        chars = np.frombuffer("".join(bodies).encode("utf-32-le"), np.uint32)
        blank = chars == ord(BLANK)
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[body[:-1][np.diff(body) > 0]] = True
        start = np.nonzero(begins)[0]
        size = np.diff(np.append(start, len(chars)))
        word_of = np.searchsorted(start, body)  # first word of each body
        text_of = word_of[np.cumsum([0, *map(len, split)])]
        keyed = self.keys(texts, np.diff(text_of))
        count, found = np.zeros(len(start), np.int64), []
        order = np.argsort(size, kind="stable")
        short = order[: int((size < SHORT).sum())]
        for a in range(0, len(short), 8192):
            some = short[a : a + 8192]
            ids, count[some] = self.many(chars, start[some], size[some], keyed[some])
            found.append((some, ids))
        for k in order[len(short) :].tolist():
            ids = np.array(self.word(chars[start[k] : start[k] + size[k]].tobytes().decode("utf-32-le"), int(keyed[k])), np.int32)
            count[k] = len(ids)
            found.append((np.array([k]), ids))
        ends = np.cumsum(count)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for some, ids in found:
            n = count[some]
            flat[np.repeat(ends[some] - n, n) + np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)] = ids
        cut, out, at = np.append(0, ends)[word_of], [], 0
        for xs in split:
            parts = [flat[cut[k] : cut[k + 1]] for k in range(at, at + len(xs))]
            out.append(parts[0] if len(parts) == 1 else np.concatenate([x for p in parts for x in (self.blank, p)][1:]))
            at += len(xs)
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.out.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")[1:]


@lru_cache(4)
def pieces(path: str, rate: float, seed: int, variants: int) -> Pieces:
    return Pieces(path, rate, seed, variants)


def encode(df: DataFrame, keep: list[str], text: str = "text", model: str = MODEL, rate: float = 0.1, seed: int = 7, variants: int = 4) -> DataFrame:
    """keep plus n_tokens, ids and lossless (the ids decode to the text; null for a null text)."""

    def make(texts):
        p, known, at = pieces(model, rate, seed, variants), [t for t in texts if t], 0
        done: list = []
        while at < len(known):  # a million characters at once, or one text
            to, chars = at + 1, len(known[at])
            while to < len(known) and chars + len(known[to]) <= 1_000_000:
                chars, to = chars + len(known[to]), to + 1
            done += p.encode_all(known[at:to])
            at = to
        found = iter(done)
        ids = [None if t is None else next(found) if t else np.zeros(0, np.int32) for t in texts]
        same = [None if t is None else (p.decode(i) if t else "") == t for t, i in zip(texts, ids, strict=True)]
        return {"n_tokens": pa.array([0 if i is None else len(i) for i in ids], pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32())), "lossless": pa.array(same, pa.bool_())}

    return map_texts(df, keep, text, make, "n_tokens bigint, ids array<int>, lossless boolean")


def decode(df: DataFrame, keep: list[str], ids: str = "ids", model: str = MODEL) -> DataFrame:
    """keep plus text; null ids give null."""

    def make(rows):
        p = pieces(model, 0.0, 0, 1)
        return {"text": pa.array([None if r is None else p.decode(r) if len(r) else "" for r in rows], pa.string())}

    return map_texts(df, keep, ids, make, "text string")


def op1_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, ["doc_id", "source"]).filter(F.coalesce("lossless", F.lit(True)))
