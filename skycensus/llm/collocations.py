"""Phrase collocation mining: level-wise candidates, counted by 64-bit numbers, those that share a number by broadcast double-array tries.

A-Z are lower-cased, texts are cut into pieces at `.,;:!?` and line ends, pieces into words at blanks and tabs; all is counted
within a lang (null: `und`). Spark shuffles counts only:

1. words are counted; 2. pairs of words that are both frequent are counted by hash bucket; 3. so are runs of 3 to 5 words whose
pairs all lie in full buckets. A bucket holds at least the count of each of its phrases, so (Apriori) a phrase with a
bucket or a part under the least count can't be frequent: what is left is a safe superset. Full buckets are kept as bitmaps
of BUCKETS bits (8 MB) or, for large tables, a bit for every PER_BUCKET words; with more phrases than buckets they let more
candidates through, never fewer. Spark deals the counts of a slice of texts as arrays by shards of SHARD buckets to be summed.
4. The distinct phrases left are the candidates, a table; a task remembers by number those it has sent, up to SENT. 5. Runs that are
candidates are counted by their hash, in one pass however many there are: a task adds up to HELD of them and gives them as arrays
by PARTS of the hashes' range to be summed. A hash that one candidate has alone counts that candidate. 6. Candidates that share their
hash, hardly ever any, are cut into tries of about TRIE_PHRASES, so a broadcast is bounded; for each trie the corpus is passed once:
numpy moves the states of all text positions on, word by word, counts the accepting states of a task in one array, and Spark deals the
arrays by shards of COUNTS to be summed. No count comes from the buckets.

Words are encoded by dictionary inside each slice of the texts, so no vocabulary is broadcast. Products in scores are decimals of
38 digits. Null and empty texts have no words; repeated rows count as often as they occur; only lang and text are read, so other columns
may have any name. A table without words gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skycensus.llm.common import cut, small, table

LEAST, LONGEST, TOP = 100, 5, 2000
BUCKETS = 1 << 26
#: Buckets whose counts go to the sum in one row; places among them have 16 bits.
SHARD = 1 << 16
#: Words for which there is a bucket, where that makes more than BUCKETS.
PER_BUCKET = 8
#: Parts of the range of hashes in which counts of phrases are summed, and hashes that a task adds up before it gives them.
PARTS, HELD = 1 << 12, 1 << 20
TRIE_PHRASES = 1 << 17
#: A word's number in a trie is two digits to this base.
DIGIT = 1024
#: Words and phrases that a task remembers to have sent: 12 bytes a phrase, some 200 a word.
SENT, SENT_WORDS = 1 << 21, 1 << 18
#: Words of texts that a task looks through for candidates, where that makes more tasks than there are cores.
TASK_WORDS = 1 << 25
#: Counts of a trie that go to the sum in one row.
COUNTS = 512
#: Bytes of text that a task works on at once (a longer text: by itself), bytes that it takes from and rows that it gives to Spark at once.
SLICE, BATCH, GIVEN = 8 << 20, "4m", 1 << 16
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Per byte: 0 within a word, 1 between words, 2 between pieces.
KIND = bytes(2 if b in b".,;:!?\n\x0b\x0c\r" else 1 if b in b" \t" else 0 for b in range(256))


def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    """The XXH64 that Spark's xxhash64(lang, word) gives."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


class Slice:
    """Texts of one lang as numbers: ids (word of each position, a place in `words`), piece (number of its piece)."""

    def __init__(self, lang: str, texts: list[bytes]):
        raw = b"\n".join(texts)
        kind = np.frombuffer(raw.translate(KIND), np.uint8)
        word = np.zeros(len(raw) + 2, np.int8)
        word[1:-1] = kind == 0
        edge = np.diff(word)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        del word, edge
        at = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=at[1:])
        letters = np.frombuffer(raw.translate(LOWER), np.uint8)[kind == 0]
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(letters)).dictionary_encode()
        self.lang, self.words = lang, coded.dictionary
        self.ids = coded.indices.to_numpy(zero_copy_only=False)
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), starts).astype(np.int32)

    def within(self, size: int) -> np.ndarray:
        """Whether `size` words from each position lie in one piece."""
        n = len(self.ids) - size + 1
        return self.piece[:n] == self.piece[size - 1 :] if n > 0 else np.zeros(0, bool)

    def hashes(self) -> np.ndarray:
        """Of the distinct words."""
        return word_hashes(self.lang, self.words)

    def phrases(self, places: np.ndarray, size: int) -> pa.Array:
        return pc.binary_join_element_wise(*[self.words.take(pa.array(self.ids[places + j])) for j in range(size)], " ")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    """From batches of (lang, text as bytes); at most a few slices' texts are held."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            total += len(text)
            for x in [lang] if size[lang] >= SLICE else list(held) if total >= 4 * SLICE else []:
                yield Slice(x, held.pop(x))
                total -= size.pop(x)
    for x in list(held):
        yield Slice(x, held.pop(x))


@contextmanager
def arrow_batches(spark: SparkSession) -> Iterator[None]:
    """Texts go to the tasks' Python in batches of about BATCH bytes (by default up to 64 MB, which both sides hold); afterwards as before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BATCH)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def over_slices(docs: DataFrame, make: Callable[[Iterator[Slice]], Iterator[dict]], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for made in make(slices(batches)):
            cols = list(made.values())
            for at in range(0, len(cols[0]), GIVEN):
                part = [x[at : at + GIVEN] for x in cols]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in part], names=names)

    rows = docs.filter("text <> ''").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def bucket(h: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    return (h >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def bitmap(rows: DataFrame) -> bytes:
    """The buckets of rows (bucket) as BUCKETS bits, put together on the executors in parts of 4 KB."""
    b = F.col("bucket") + 1
    parts = rows.groupBy(F.bitmap_bucket_number(b).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(b)).alias("bits"))
    out = bytearray(BUCKETS // 8)
    for part, bits in parts.toLocalIterator():
        out[(part - 1) * 4096 : part * 4096] = bits
    return bytes(out)


def full(bits: bytes, h: np.ndarray) -> np.ndarray:
    b = bucket(h, 8 * len(bits))
    return (np.frombuffer(bits, np.uint8)[b >> 3] >> (b & 7)) & 1 == 1


class Windows:
    """Which runs of words of a slice may be frequent by the bitmaps known so far: of words, pairs, longer runs."""

    def __init__(self, s: Slice, bitmaps: list[bytes]):
        self.s, self.maps = s, bitmaps
        word = s.hashes()
        self.h = {1: word[s.ids]}
        self.may = {1: full(bitmaps[0], word)[s.ids]}

    def level(self, size: int, checked: bool) -> np.ndarray:
        """Places of runs of `size` words all of whose parts may be frequent; checked: by their own bucket, too."""
        n = max(0, len(self.s.ids) - size + 1)
        self.h[size] = mix(self.h[size - 1][:n], self.h[1][size - 1 :][:n])
        if size > 2:
            del self.h[size - 1], self.may[size - 2]
        may = self.s.within(size) & self.may[size - 1][:n] & self.may[size - 1][1 : n + 1]
        places = np.flatnonzero(may)
        if checked:
            places = places[full(self.maps[min(size, 3) - 1], self.h[size][places])]
            may = np.zeros(n, bool)
            may[places] = True
        self.may[size] = may
        return places


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""

    def make(parts):
        for s in parts:
            yield {"lang": pa.array([s.lang] * len(s.words)), "word": s.words, "n": np.bincount(s.ids, minlength=len(s.words))}

    return over_slices(docs, make, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def packed(shard: np.ndarray, **cols: np.ndarray) -> dict[str, pa.Array]:
    """A row for each of the sorted shards, with the values that it has in each column as bytes."""
    of, first = np.unique(shard, return_index=True)
    edges = np.append(first, len(shard)).astype(np.int32)
    pack = lambda x: pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(edges * np.int32(x.itemsize)), pa.py_buffer(x)])
    return {"shard": of.astype(np.int64), **{name: pack(x) for name, x in cols.items()}}


def by_shard(of: np.ndarray, n: np.ndarray) -> dict[str, pa.Array]:
    """Counts n of distinct, sorted buckets as a row for each shard: places in the shard and their counts, in 2 and 4 bytes."""
    return packed(of // SHARD, places=(of % SHARD).astype(np.uint16), counts=n.astype(np.uint32))


def buckets_for(words: int) -> int:
    return max(BUCKETS, 1 << (words // PER_BUCKET).bit_length())


def full_buckets(docs: DataFrame, sizes: range, bitmaps: list[bytes], least: int, buckets: int = BUCKETS) -> bytes:
    """Bitmap of the buckets of at least `least` runs of words of these sizes."""
    known = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def make(parts):
        for s in parts:
            w = Windows(s, known.value)
            for size in range(2, sizes[-1] + 1):
                places = w.level(size, size not in sizes)
                if size in sizes:
                    yield by_shard(*np.unique(bucket(w.h[size][places], buckets).astype(np.uint32), return_counts=True))

    def add(batches):
        """Full buckets of each shard, from its rows of all tasks in a stream sorted by shard."""
        now, total = None, None
        found = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], names=["shard", "bits"])
        for batch in batches:
            for shard, places, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard != now:
                    if now is not None:
                        yield found()
                    now, total = shard, np.zeros(SHARD, np.int64)
                total[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint32)
        if now is not None:
            yield found()

    shards = over_slices(docs, make, "shard bigint, places binary, counts binary").repartition("shard").sortWithinPartitions("shard")
    out = bytearray(buckets // 8)
    for shard, bits in shards.mapInArrow(add, "shard bigint, bits binary").collect():  # `buckets` bits in all
        out[shard * SHARD // 8 : (shard + 1) * SHARD // 8] = bits
    return bytes(out)


class Sent:
    """The phrases that a task has sent, told apart by number, not by hash: a phrase is the number of its beginning and that of its last word."""

    def __init__(self):
        self.word: dict[tuple[str, str], int] = {}
        #: By size of phrase: sorted keys (beginning, last word), and the number of each.
        self.keys = {size: np.zeros(0, np.int64) for size in range(2, LONGEST + 1)}
        self.numbers = {size: np.zeros(0, np.int32) for size in range(2, LONGEST + 1)}

    def __len__(self) -> int:
        return sum(map(len, self.keys.values()))

    def words(self, lang: str, words: list[str]) -> list[int]:
        return [self.word.setdefault((lang, w), len(self.word)) for w in words]

    def add(self, size: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of these distinct, sorted keys, and which of them are new."""
        known, numbers = self.keys[size], self.numbers[size]
        at = np.searchsorted(known, keys)
        old = np.zeros(len(keys), bool)
        inner = at < len(known)
        old[inner] = known[at[inner]] == keys[inner]
        out = np.empty(len(keys), np.int32)
        out[old] = numbers[at[old]]
        out[~old] = np.arange(len(known), len(known) + np.count_nonzero(~old), dtype=np.int32)
        self.keys[size] = np.insert(known, at[~old], keys[~old])
        self.numbers[size] = np.insert(numbers, at[~old], out[~old])
        return out, ~old


def candidates(docs: DataFrame, bitmaps: list[bytes], tasks: int = 1) -> DataFrame:
    """(lang, phrase), distinct: all that the bitmaps let through, so all frequent phrases among them; in `tasks` tasks, or one a core if that is more."""
    context = docs.sparkSession.sparkContext
    known = context.broadcast(bitmaps)

    def make(parts):
        sent = Sent()
        for s in parts:
            w = Windows(s, known.value)
            sent = sent if len(sent) < SENT and len(sent.word) < SENT_WORDS else Sent()
            places = w.level(2, True)
            some = np.unique(s.ids[np.concatenate([places, places + 1])])
            number = np.zeros(len(s.words), np.int64)
            number[some] = sent.words(s.lang, s.words.take(pa.array(some)).to_pylist())
            code = number[s.ids]  # of phrases by number
            for size in range(2, LONGEST + 1):
                places = w.level(size, True) if size > 2 else places
                keys, first, back = np.unique(code[places] << 32 | number[s.ids[places + size - 1]], return_index=True, return_inverse=True)
                numbers, new = sent.add(size, keys)
                code[places] = numbers[back]
                for at in np.split(places[first[new]], range(GIVEN, np.count_nonzero(new), GIVEN)):
                    yield {"lang": pa.array([s.lang] * len(at), pa.string()), "phrase": s.phrases(at, size)}

    shards = docs.coalesce(max(tasks, context.defaultParallelism))  # a phrase leaves a task once: few tasks
    return over_slices(shards, make, "lang string, phrase string").distinct()


def numbered(phrases: DataFrame, bits: int = 64) -> DataFrame:
    """(lang, phrase) with h, the first `bits` bits of the hash that Windows gives such a run of words."""

    def hashes(lang: str, some: pa.Array) -> np.ndarray:
        parts = pc.split_pattern(some, " ")
        first, size = parts.offsets.to_numpy()[:-1], np.diff(parts.offsets.to_numpy())
        coded = parts.flatten().dictionary_encode()
        word = word_hashes(lang, coded.dictionary)[coded.indices.to_numpy()]
        h = word[first]
        for j in range(1, LONGEST):
            more = size > j
            h[more] = mix(h[more], word[first[more] + j])
        return h >> np.uint64(64 - bits)

    def run(batches):
        for batch in batches:
            coded, h = batch["lang"].dictionary_encode(), np.zeros(batch.num_rows, np.uint64)
            for k, lang in enumerate(coded.dictionary.to_pylist()):
                at = np.flatnonzero(coded.indices.to_numpy() == k)
                h[at] = hashes(lang, batch["phrase"].take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["phrase"], pa.array(h.view(np.int64))], names=["lang", "phrase", "h"])

    return phrases.select("lang", "phrase").mapInArrow(run, "lang string, phrase string, h bigint")


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts, of such parts."""
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")  # merges runs
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


def hash_counts(docs: DataFrame, bitmaps: list[bytes], least: int, bits: int = 64) -> DataFrame:
    """(h, n) of the hashes that at least `least` runs of words have which the bitmaps let through."""
    known = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def make(parts):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        given = lambda h, n: packed(h >> np.uint64(64 - (PARTS.bit_length() - 1)), hashes=h, counts=n)
        for s in parts:
            w = Windows(s, known.value)
            for size in range(2, LONGEST + 1):
                places = w.level(size, True)
                held.append(np.unique(w.h[size][places] >> np.uint64(64 - bits), return_counts=True))
            held = [summed(held)]
            if len(held[0][0]) >= HELD:
                yield given(*held.pop())
        if held:
            yield given(*held.pop())

    def add(batches):
        """Sums of each part, from its rows of all tasks in a stream sorted by part."""
        now, held = None, []

        def found():
            h, n = summed(held)
            return pa.RecordBatch.from_arrays([pa.array(h[n >= least].view(np.int64)), pa.array(n[n >= least])], names=["h", "n"])

        for batch in batches:
            for shard, hashes, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard != now:
                    if held:
                        yield found()
                    now, held = shard, []
                held.append((np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.int64)))
        if held:
            yield found()

    shards = over_slices(docs, make, "shard bigint, hashes binary, counts binary").repartition("shard").sortWithinPartitions("shard")
    return shards.mapInArrow(add, "h bigint, n bigint")


def frequent_phrases(docs: DataFrame, bitmaps: list[bytes], least: int, bits: int = 64, tasks: int = 1) -> DataFrame:
    """(lang, phrase, n) of the phrases of at least `least` occurrences, written."""
    wanted = cut(numbered(candidates(docs, bitmaps, tasks), bits))
    shared = cut(wanted.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h"))
    counts = wanted.join(hash_counts(docs, bitmaps, least, bits), "h")
    if shared.isEmpty():
        return cut(counts.select("lang", "phrase", "n"))
    apart = cut(counts.join(shared, "h", "left_anti").select("lang", "phrase", "n"))
    return apart.unionByName(phrase_counts(docs, cut(wanted.join(shared, "h", "left_semi").select("lang", "phrase"))).filter(F.col("n") >= least))


class Trie:
    """Double array over [lang, word, ...] by digits: the child of state s for digit d is t = base[s] + d if check[t] = s."""

    def __init__(self, langs: list[str], phrases: list[str]):
        self.langs, self.phrases = pa.array(langs, pa.string()), pa.array(phrases, pa.string())
        names, parts = sorted(set(langs)), [p.split(" ") for p in phrases]
        self.words = pa.array(sorted({w for p in parts for w in p}), pa.string())
        number = {w: k for k, w in enumerate(self.words.to_pylist())}
        lang = {x: k for k, x in enumerate(names)}
        if max(len(names), len(number)) > DIGIT * DIGIT:
            raise ValueError("too many words for one trie")
        signs = np.full((len(phrases), LONGEST + 1), -1, np.int64)
        for k, p in enumerate(parts):
            signs[k, 0] = lang[langs[k]]
            signs[k, 1 : len(p) + 1] = [number[w] for w in p]
        node, parents, digits, last, count = np.zeros(len(phrases), np.int64), [], [], np.zeros(len(phrases), np.int64), 1
        for depth in range(2 * (LONGEST + 1)):  # nodes by level: distinct (parent, digit)
            sign = signs[:, depth // 2]
            live = np.flatnonzero(sign >= 0)
            digit = sign[live] // DIGIT if depth % 2 == 0 else sign[live] % DIGIT
            key, back = np.unique(node[live] * DIGIT + digit, return_inverse=True)
            parents.append(key // DIGIT)
            digits.append(key % DIGIT)
            node[live] = last[live] = count + back
            count += len(key)
        parent, digit = np.concatenate(parents), np.concatenate(digits)
        base, size = self._place(parent, digit, count)
        state = np.zeros(count, np.int64)
        state[1:] = base[parent] + digit
        self.base, self.check, self.phrase = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[state] = base
        self.check[state[1:]] = state[parent]
        self.phrase[state[last]] = np.arange(len(phrases))
        self.start = {x: int(state[node_of]) for x, node_of in zip(names, self._langs(parents, digits, lang, names), strict=True)}

    @staticmethod
    def _langs(parents, digits, lang, names) -> list[int]:
        """Node of each lang: two digits below the root."""
        out, n = [], len(parents[0])
        for x in names:
            top = 1 + int(np.searchsorted(digits[0], lang[x] // DIGIT))
            below = np.flatnonzero((parents[1] == top) & (digits[1] == lang[x] % DIGIT))
            out.append(1 + n + int(below[0]))
        return out

    @staticmethod
    def _place(parent: np.ndarray, digit: np.ndarray, count: int) -> tuple[np.ndarray, int]:
        """A base for every node so that no two children share a slot: large families first, at the first fit; only children fill the gaps."""
        order = np.argsort(parent, kind="stable")
        of, first, size = np.unique(parent[order], return_index=True, return_counts=True)
        base, used, low = np.zeros(count, np.int64), np.zeros(4 * DIGIT + len(parent), bool), DIGIT
        for k in np.argsort(-size, kind="stable"):
            if size[k] < 2:
                break
            d = np.sort(digit[order[first[k] : first[k] + size[k]]])
            while True:
                if len(used) < low + 4 * DIGIT:
                    used = np.concatenate([used, np.zeros(len(used), bool)])
                tries = low + np.flatnonzero(~used[low : low + 512])
                fits = tries[~used[(tries - d[0])[:, None] + d[None, :]].any(1)] if len(tries) else tries
                if len(fits):
                    break
                low += 512
            base[of[k]] = fits[0] - d[0]
            used[fits[0] - d[0] + d] = True
            if size[k] < 8 and not len(tries) > 64:
                low += 256
        single = np.flatnonzero(size == 1)
        used = np.concatenate([used, np.zeros(len(single) + 1, bool)])
        free = DIGIT + np.flatnonzero(~used[DIGIT:])[: len(single)]
        base[of[single]] = free - digit[order[first[single]]]
        top = max(int(np.flatnonzero(used)[-1]) if used.any() else 0, int(free[-1]) if len(free) else 0)
        return base, top + DIGIT + 1

    def count(self, s: Slice, counts: np.ndarray) -> None:
        """Add the phrases of a slice to counts: all positions' states move on together, a word at a time."""
        start = self.start.get(s.lang)
        if start is None or not len(s.ids):
            return
        sign = pc.fill_null(pc.index_in(s.words, value_set=self.words), -1).to_numpy(zero_copy_only=False)[s.ids].astype(np.int64)
        digits = (sign // DIGIT, sign % DIGIT)
        places, state = np.arange(len(s.ids)), np.full(len(s.ids), start, np.int64)
        for depth in range(LONGEST):
            at = places + depth
            ok = at < len(s.ids)
            ok[ok] = (sign[at[ok]] >= 0) & (s.piece[at[ok]] == s.piece[places[ok]])
            places, state = places[ok], state[ok]
            for digit in digits:
                to = self.base[state] + digit[places + depth]
                moved = self.check[to] == state
                places, state = places[moved], to[moved]
            found = self.phrase[state]
            counts += np.bincount(found[found >= 0], minlength=len(counts))


def phrase_counts(docs: DataFrame, wanted: DataFrame, bound: int = TRIE_PHRASES) -> DataFrame:
    """(lang, phrase, n) of the wanted (lang, phrase), already cut; one pass over docs for each trie."""
    spark, done = docs.sparkSession, None
    tries = -(-wanted.count() * 9 // (8 * bound)) or 1  # hash parts of about 8/9 of the bound
    for k in range(tries):
        part = wanted.filter(F.pmod(F.xxhash64("phrase"), F.lit(tries)) == k).toArrow()
        if not part.num_rows:
            continue
        known = spark.sparkContext.broadcast(Trie(part["lang"].to_pylist(), part["phrase"].to_pylist()))

        def make(parts, known=known):
            trie = known.value
            counts = np.zeros(-(-len(trie.phrases) // COUNTS) * COUNTS, np.int64)
            for s in parts:
                trie.count(s, counts)
            shards = counts.reshape(-1, COUNTS)
            some = np.flatnonzero(shards.any(axis=1))
            yield {"shard": some, "counts": pa.array([x.tobytes() for x in shards[some]], pa.binary())}

        def add(batches, known=known):
            """Sums of each shard over all tasks, as a stream of rows sorted by shard."""
            trie, now, total = known.value, None, None

            def found():
                at = now * COUNTS + np.flatnonzero(total)
                return pa.RecordBatch.from_arrays([trie.langs.take(pa.array(at)), trie.phrases.take(pa.array(at)), pa.array(total[total > 0])], names=["lang", "phrase", "n"])

            for batch in batches:
                for shard, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if shard != now:
                        if now is not None:
                            yield found()
                        now, total = shard, np.zeros(COUNTS, np.int64)
                    total += np.frombuffer(counts, np.int64)
            if now is not None:
                yield found()

        shards = over_slices(docs, make, "shard bigint, counts binary").repartition("shard").sortWithinPartitions("shard")
        one = cut(shards.mapInArrow(add, "lang string, phrase string, n bigint"))
        known.destroy()
        done = one if done is None else done.unionByName(one)
    return done if done is not None else spark.createDataFrame([], "lang string, phrase string, n bigint")


def frequent(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals): (lang, word, n) and (lang, phrase, n) of at least `least` occurrences, (lang, n) of all words."""
    with arrow_batches(docs.sparkSession):
        counts = cut(word_counts(docs))
        words, totals = counts.filter(F.col("n") >= least), counts.groupBy("lang").agg(F.sum("n").alias("n"))
        top = F.shiftrightunsigned(F.xxhash64("lang", "word"), 64 - (BUCKETS.bit_length() - 1))
        maps = [bitmap(words.select(top.alias("bucket")))]
        size = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        buckets = buckets_for(size)
        maps.append(full_buckets(docs, range(2, 3), maps, least, buckets))
        maps.append(full_buckets(docs, range(3, LONGEST + 1), maps, least, buckets))
        phrases = frequent_phrases(docs, maps, least, tasks=size // TASK_WORDS)
    return words, phrases, totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first `top` phrases."""
    words, phrases, totals = frequent(docs, least)
    rows = phrases.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    known = phrases.unionByName(words.withColumnRenamed("word", "phrase"))
    text = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    cuts = rows.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", text(F.lit(1), F.col("k")).alias("first"), text(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    side = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(small(cut(totals)), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("up", (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("low", wide("l") * wide("r"))
    best = cuts.withColumn("score", F.expr("cast(up as decimal(38,0)) div cast(low as decimal(38,0))"))
    best = best.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    inner = F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda at: F.array_join(F.slice("w", at, size), " ")))
    longer = rows.filter("size(w) > 2").select("lang", F.explode(F.array_distinct(F.flatten(inner))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("m.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "m.l", "m.r", "n", F.col("m.score").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: Every run of 1 to 5 words counted by itself.
OP12_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
cut AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
run AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, w[i:i + k - 1] AS w
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cut, range(1, 6) AS r(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, any_value(w) AS w, count(*) AS n FROM run GROUP BY lang, k, phrase),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, w, n AS a FROM f WHERE k > 1 AND n >= 100),
halves AS (
  SELECT lang, k, phrase, a, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
scored AS (
  SELECT h.lang, h.phrase, h.a, h.j, x.n AS l, y.n AS r, t.n,
         CAST((1000::HUGEINT * h.a * t.n) // (x.n::HUGEINT * y.n) AS BIGINT) AS score
  FROM halves h JOIN f x ON x.lang = h.lang AND x.k = h.j AND x.phrase = h.first
  JOIN f y ON y.lang = h.lang AND y.k = h.k - h.j AND y.phrase = h.rest JOIN total t ON t.lang = h.lang),
least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (
  SELECT s.* FROM least_cut s WHERE NOT EXISTS (
    SELECT 1 FROM cand c WHERE c.lang = s.lang AND len(c.phrase) > len(s.phrase) AND 100 * c.a >= 100 * s.a AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""
