"""Phrase collocation mining: phrases of some words whose words stand together more often than chance has it.

Phrases are counted level by level, those of k words in pass k, the longest ones together. Each task counts in a burst trie: hash
containers of phrases hang below a shallow trie of word ids; a container that grows too large bursts into
one container per next word. When a task holds too many phrases, its largest subtrees are spilled whole, as
sorted runs, cut by bucket of the first two words; the pieces of a bucket meet in one partition, are merged
there and added up. Every count is exact.

A phrase can be frequent only if its parts are. Pass k leaves out occurrences whose first or last k - 1
words are surely not frequent, which a bitmap of the hashes of the frequent phrases of the pass
before tells: its size is bounded, and a collision lets a phrase in for counting, never out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscan.llm.common import durable, mix64, small_batches

LEAST = 100
WORDS = 5
#: Phrases from so many words on are counted in one pass: few are left by then.
TOGETHER = 4
TOP = 2000
#: Phrases in a container before it bursts, phrases in a task before subtrees are spilled, words a task remembers.
BURST, HELD, KNOWN = 4096, 600_000, 700_000
#: Levels of the trie above the containers.
DEPTH = 2
#: Bytes of text that are cut into words at a time.
PIECE = 4 << 20
#: Bits of a bitmap: 16 a phrase, between these bounds (8 KB and 128 MB).
LEAST_BITS, MOST_BITS, BITS_EACH = 16, 30, 16
SLICES = 64
#: Bytes of a bitmap that the driver fetches by one job.
FETCHED = 16 << 20
#: Buckets of prefixes per shuffle partition, and phrases of a bucket that are added up together.
BUCKETS, MERGED = 1, 2_000_000

#: Upper case becomes lower case; everything that ends a piece becomes a full stop, which is in no word.
_FOLD = bytes(
    ord(".") if chr(i) in ".,;:!?\n\x0b\x0c\r" else i + 32 if 65 <= i <= 90 else i for i in range(256)
)
_STOP = b"."
_BLANK = b" "

# A piece of a sorted run: the phrases of one bucket of prefixes, parted by line feeds, and their counts, both compressed.
_RUN = pa.schema([
    ("bucket", pa.int32()), ("lang", pa.string()), ("text_size", pa.int64()), ("text", pa.binary()), ("n", pa.int64()), ("counts", pa.binary()),
])
RUN_SCHEMA = "bucket int, lang string, text_size long, text binary, n long, counts binary"
_COUNT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
COUNT_SCHEMA = "lang string, phrase string, f long"
_SLICE = pa.schema([("slice", pa.int32()), ("at", pa.int64())])


class _Words(dict):
    """Numbers of the words of one language in a task; 0 is the end of a piece."""

    def __init__(self, lang: str, bitmap: np.ndarray | None):
        super().__init__({_STOP: 0})
        self.seed = xxhash.xxh64_intdigest(lang.encode())
        self.bitmap = bitmap
        self.words: list[bytes] = [_STOP]
        self.hashes, self.frequent = np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=bool)

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.words)
        self.words.append(word)
        return at

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        fresh = self.words[len(self.hashes) :]
        if fresh:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in fresh), np.uint64, len(fresh))
            marked = np.ones(len(fresh), dtype=bool) if self.bitmap is None else _among(_phrase_hash(hashes[:, None]), self.bitmap)
            self.hashes, self.frequent = np.concatenate([self.hashes, hashes]), np.concatenate([self.frequent, marked])
        return ids


def _phrase_hash(hashes: np.ndarray) -> np.ndarray:
    """One number per row of word hashes."""
    out = np.full(len(hashes), hashes.shape[1], dtype=np.uint64)
    for i in range(hashes.shape[1]):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[:, i])
    return out


def _among(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _keys(grams: np.ndarray) -> list[bytes]:
    """Each row of word numbers as bytes, four a word."""
    return np.ascontiguousarray(grams.astype(">u4")).view(f"V{4 * grams.shape[1]}").ravel().tolist()


class BurstTrie:
    """Counts of phrases of word numbers.

    A node is a container, a dict from the rest of a phrase (four bytes a word) to its count, or a branch:
    a dict from the next word to a node, marked by standing in ``branches``.
    """

    def __init__(self, burst: int = BURST, depth: int = DEPTH):
        self.burst, self.depth = burst, depth
        self.root: dict = {}
        self.branches: set[int] = set()
        self.size = 0

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """Rows of ``grams`` are distinct and in order."""
        self._add(self.root, 0, grams, counts)

    def _add(self, node: dict, level: int, grams: np.ndarray, counts: np.ndarray) -> None:
        if id(node) in self.branches:
            first = np.concatenate([[0], np.flatnonzero(np.diff(grams[:, 0])) + 1, [len(grams)]])
            words = _keys(grams[first[:-1], :1])
            for word, lo, hi in zip(words, first[:-1].tolist(), first[1:].tolist()):
                child = node.get(word)
                if child is None:
                    child = node[word] = {}
                self._add(child, level + 1, grams[lo:hi, 1:], counts[lo:hi])
            return
        had, get = len(node), node.get
        for key, count in zip(_keys(grams), counts.tolist()):
            node[key] = get(key, 0) + count
        self.size += len(node) - had
        if len(node) > self.burst and level < self.depth and grams.shape[1] > 1:
            self._split(node)

    def _split(self, node: dict) -> None:
        children: dict[bytes, dict] = {}
        for phrase, count in node.items():
            children.setdefault(phrase[:4], {})[phrase[4:]] = count
        node.clear()
        node.update(children)
        self.branches.add(id(node))

    def _containers(self, node: dict, before: bytes) -> Iterator[tuple[bytes, dict]]:
        if id(node) not in self.branches:
            yield before, node
            return
        for word, child in node.items():
            yield from self._containers(child, before + word)

    def _weigh(self, node: dict) -> int:
        return sum(map(self._weigh, node.values())) if id(node) in self.branches else len(node)

    def _forget(self, node: dict) -> None:
        if id(node) in self.branches:
            self.branches.discard(id(node))
            for child in node.values():
                self._forget(child)

    @staticmethod
    def _entries(containers: list[tuple[bytes, dict]]) -> tuple[np.ndarray, np.ndarray]:
        words, counts = [], []
        for before, phrases in containers:
            rest = np.frombuffer(b"".join(phrases), dtype=">u4").reshape(len(phrases), -1)
            ahead = np.broadcast_to(np.frombuffer(before, dtype=">u4"), (len(phrases), len(before) // 4))
            words.append(np.concatenate([ahead, rest], axis=1))
            counts.append(np.fromiter(phrases.values(), np.int64, len(phrases)))
        return np.concatenate(words).astype(np.int64), np.concatenate(counts)

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Takes the largest subtrees out, whole, until at most ``keep`` phrases are left: their phrases and counts."""
        if self.size <= keep or not self.size:
            return None
        if id(self.root) not in self.branches:
            out = self._entries([(b"", self.root)])
            self.root, self.size = {}, 0
            return out
        gone = []
        for weight, word in sorted(((self._weigh(c), w) for w, c in self.root.items()), reverse=True):
            if self.size <= keep:
                break
            child = self.root.pop(word)
            gone += self._containers(child, word)
            self._forget(child)
            self.size -= weight
        return self._entries(gone)


class _Counter:
    """Counts the phrases of ``k`` to ``last`` words of one language and hands on sorted runs.

    ``words`` marks the hashes of frequent words, ``parts`` those of frequent phrases of ``k - 1`` words.
    """

    def __init__(self, lang: str, k: int, last: int, buckets: int, words: np.ndarray | None, parts: np.ndarray | None):
        self.lang, self.k, self.last, self.buckets, self.marks, self.parts = lang, k, last, buckets, words, parts
        self.tries = {size: BurstTrie() for size in range(k, last + 1)}
        self.words = _Words(lang, words)
        self.total = 0
        self.waiting: list[bytes] = []
        self.waiting_bytes = 0

    def add(self, text: bytes, keep: int) -> Iterator[pa.RecordBatch]:
        if len(text) > PIECE:
            tail: list[bytes] = []
            at = 0
            while at < len(text):
                end = _cut(text, at)
                # the last words of a part are counted again with the next, as phrases start in them
                tokens = tail + _tokens(text[at:end])
                self._count(tokens, len(tail))
                tail, at = tokens[len(tokens) - min(self.last - 1, len(tokens)) :], end
                yield from self._runs(keep)
            return
        self.waiting.append(text)
        self.waiting_bytes += len(text)
        if self.waiting_bytes >= PIECE:
            self._count_waiting()
            yield from self._runs(keep)

    def _count_waiting(self) -> None:
        if self.waiting:
            self._count(_tokens(_STOP.join(self.waiting)))
            self.waiting, self.waiting_bytes = [], 0

    def _count(self, tokens: list[bytes], old: int = 0) -> None:
        """Phrases that end behind the first ``old`` tokens, which were there before."""
        k, words = self.k, self.words
        ids = words.numbers(tokens)
        if k == 1:
            self.total += int((ids > 0).sum())
        if len(ids) < k:
            return
        last = len(ids) - k + 1
        may = words.frequent[ids]
        ok = may[:last].copy()
        for i in range(1, k):
            ok &= may[i : last + i]
        if self.parts is not None:
            ok = self._frequent_parts(ids, ok)
        for size, trie in self.tries.items():
            if size > k:  # all phrases of k words in it may be frequent
                ok = ok[:-1] & ok[1:]
            start = np.flatnonzero(ok)
            start = start[start >= old - size + 1]
            if len(start):
                trie.add(*_distinct(ids[start[:, None] + np.arange(size)]))

    def _frequent_parts(self, ids: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """Where the first and the last k - 1 words of the phrase may be frequent."""
        start = np.flatnonzero(ok)
        places = np.zeros(len(ids) + 1, dtype=bool)
        places[start] = places[start + 1] = True
        places = np.flatnonzero(places)
        good = np.zeros(len(ids) + 1, dtype=bool)
        good[places] = _among(_phrase_hash(self.words.hashes[ids[places[:, None] + np.arange(self.k - 1)]]), self.parts)
        return ok & good[: len(ok)] & good[1 : len(ok) + 1]

    def _runs(self, keep: int) -> Iterator[pa.RecordBatch]:
        if len(self.words) > KNOWN:
            yield from self.finish()
            return
        keep //= len(self.tries)
        for trie in self.tries.values():
            yield from self._run(trie.spill(keep // 2 if trie.size > keep else keep))

    def finish(self) -> Iterator[pa.RecordBatch]:
        self._count_waiting()
        for trie in self.tries.values():
            yield from self._run(trie.spill(0))
        self.words = _Words(self.lang, self.marks)
        if self.total:
            yield _batch([self._piece(0, "", np.array([self.total]))])
            self.total = 0

    def _piece(self, bucket: int, text: str, counts: np.ndarray) -> tuple:
        data, numbers = text.encode(), counts.astype("<i8").tobytes()
        return bucket, self.lang, len(data), pa.compress(data, "zstd", asbytes=True), len(counts), pa.compress(numbers, "zstd", asbytes=True)

    def _run(self, entries: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        """The phrases of spilled subtrees, by bucket of their first two words, in the order of their words."""
        if entries is None:
            return
        grams, counts = entries
        used, at = np.unique(grams, return_inverse=True)
        text = pa.array([self.words.words[i] for i in used.tolist()], pa.binary())
        order = pc.sort_indices(text).to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        at = at.reshape(grams.shape)
        bucket = (_phrase_hash(self.words.hashes[grams[:, :2]]) % np.uint64(self.buckets)).astype(np.int64)
        rows = np.lexsort([*place[at].T[::-1], bucket])
        text, bucket, at, counts = text.cast(pa.string()), bucket[rows], at[rows], counts[rows]
        first = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(rows)]]).tolist()
        pieces = []
        for lo, hi in zip(first[:-1], first[1:]):
            phrases = pc.binary_join_element_wise(*[text.take(pa.array(at[lo:hi, c])) for c in range(grams.shape[1])], " ")
            pieces.append(self._piece(int(bucket[lo]), "\n".join(phrases.to_pylist()), counts[lo:hi]))
        yield _batch(pieces)


def _batch(pieces: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*pieces), _RUN)], schema=_RUN)


def _unpacked(size: int, text: bytes, n: int, counts: bytes) -> pa.Table:
    phrases = pc.split_pattern(pa.array([pa.decompress(text, size, "zstd", asbytes=True)], pa.binary()), b"\n").values.cast(pa.string())
    numbers = np.frombuffer(pa.decompress(counts, 8 * n, "zstd", asbytes=True), dtype="<i8")
    return pa.table([phrases, pa.array(numbers)], names=["phrase", "f"])


def _merge_kernel(least: int):
    """Counts of phrases from the pieces of runs, in a stream sorted by bucket and language; the empty phrase holds the words of a language."""

    def added(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("phrase").aggregate([("f", "sum")]).rename_columns({"f_sum": "f"}).select(["phrase", "f"])

    def finish(lang: str, parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = added(parts)
        table = table.filter(pc.or_(pc.greater_equal(table["f"], least), pc.equal(table["phrase"], "")))
        for batch in table.to_batches():
            names = pa.array([lang]).take(pa.array(np.zeros(batch.num_rows, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([names, batch["phrase"], batch["f"]], schema=_COUNT)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], 0
        for batch in batches:
            for bucket, lang, *piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, lang) != now:
                    if now is not None:
                        yield from finish(now[1], parts)
                    now, parts, held = (bucket, lang), [], 0
                parts.append(_unpacked(*piece))
                held += len(parts[-1])
                if held > MERGED:
                    parts = [added(parts)]
                    held = len(parts[0]) // 2  # at least as many new ones before it is done again
        if now is not None:
            yield from finish(now[1], parts)

    return kernel


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and how often each is there."""
    if grams.shape[1] < 3:
        packed = grams[:, 0] if grams.shape[1] == 1 else (grams[:, 0] << 32) + grams[:, 1]
        found, counts = np.unique(packed, return_counts=True)
        return (found[:, None] if grams.shape[1] == 1 else np.stack([found >> 32, found & 0xFFFFFFFF], axis=1)), counts
    grams = grams[np.lexsort(grams.T[::-1])]
    first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]).any(axis=1)]))
    return grams[first], np.diff(np.append(first, len(grams)))


def _tokens(text: bytes) -> list[bytes]:
    """Words, and a full stop where a piece ends."""
    return text.translate(_FOLD).replace(_STOP, b" . ").split()


def _cut(text: bytes, at: int) -> int:
    """Where the part that starts at ``at`` ends: behind a word, at most a word beyond ``PIECE`` bytes."""
    if at + PIECE >= len(text):
        return len(text)
    back = max(text.rfind(c, at, at + PIECE) for c in (b" ", b"\n", b"\t"))
    if back > at:
        return back
    ahead = [x for x in (text.find(c, at + PIECE) for c in (b" ", b"\n", b"\t")) if x >= 0]
    return min(ahead, default=len(text))


def _count_kernel(k: int, last: int, buckets: int, words, parts):
    """``words`` and ``parts`` are broadcast bitmaps or None."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, bits = (None if x is None else np.frombuffer(x.value, dtype=np.uint8) for x in (words, parts))
        counters: dict[str, _Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                own = counters.get(lang) or counters.setdefault(lang, _Counter(lang, k, last, buckets, marks, bits))
                yield from own.add(text.as_py(), HELD // len(counters))
        for own in counters.values():
            yield from own.finish()

    return kernel


def _bitmap_kernel(bits: int):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds: dict[str, int] = {}
            hashes: dict[int, list] = {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                seed = seeds.get(lang) or seeds.setdefault(lang, xxhash.xxh64_intdigest(lang.encode()))
                words = phrase.encode().split(_BLANK)
                hashes.setdefault(len(words), []).append([xxhash.xxh64_intdigest(w, seed) for w in words])
            for rows in hashes.values():
                at = (_phrase_hash(np.array(rows, dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                per = (1 << bits) // SLICES
                yield pa.RecordBatch.from_arrays([pa.array(at // per, pa.int32()), pa.array(at % per)], schema=_SLICE)

    return kernel


def _slice_kernel(bits: int):
    """The bytes of each slice of the bitmap, from a stream sorted by slice."""
    per = (1 << bits) // SLICES

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            slices, at = batch.column("slice").to_numpy(), batch.column("at").to_numpy()
            for s in np.unique(slices).tolist():
                marks = out.setdefault(s, np.zeros(per, dtype=bool))
                marks[at[slices == s]] = True
                if len(out) > 1 and s == max(out):
                    for done in sorted(out)[:-1]:
                        yield _packed(done, out.pop(done))
        for s in sorted(out):
            yield _packed(s, out[s])

    return kernel


def _packed(s: int, marks: np.ndarray) -> pa.RecordBatch:
    data = np.packbits(marks, bitorder="little").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([data], pa.binary())], names=["slice", "data"])


def phrase_bitmap(phrases: DataFrame, count: int):
    """A broadcast bitmap of ``(lang, phrase)``: 16 bits a phrase, 128 MB at most; put together by slices of hashes."""
    bits = min(MOST_BITS, max(LEAST_BITS, (count * BITS_EACH).bit_length()))
    marks = phrases.select("lang", "phrase").mapInArrow(_bitmap_kernel(bits), "slice int, at long")
    packed = marks.repartition(min(SLICES, max(1, count >> 16)), "slice").sortWithinPartitions("slice").mapInArrow(_slice_kernel(bits), "slice int, data binary")
    per = (1 << bits) // SLICES // 8
    whole = bytearray((1 << bits) // 8)
    # a job per partition that is fetched, so as few as the bitmap's size allows, however many the shuffle has
    for row in packed.coalesce(max(1, len(whole) // FETCHED)).toLocalIterator():  # at most 64 rows, at most 128 MB together
        whole[row.slice * per : row.slice * per + per] = row.data
    return phrases.sparkSession.sparkContext.broadcast(bytes(whole))


def frequent_phrases(docs: DataFrame, words: int = WORDS, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, size, f)`` of the phrases of up to ``words`` words that stand ``least`` times or more, and ``(lang, n)``.

    Words are parted by blanks and tabs, pieces by ``.,;:!?`` and line ends; upper case A-Z counts as
    lower case. A null text is empty, a null language ``und``. ``n`` counts all words of a language.
    """
    if words < 1 or least < 1:
        raise ValueError("words and least must be positive")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.col(text_col).cast("string").alias("text"),
    ).where(F.length("text") > 0)
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, totals, marks, parts = [], None, None, None
    for k in range(1, min(words, TOGETHER) + 1):
        runs = rows.mapInArrow(_count_kernel(k, words if k == TOGETHER else k, buckets, marks, parts), RUN_SCHEMA)
        merged = runs.repartition("bucket").sortWithinPartitions("bucket", "lang").mapInArrow(_merge_kernel(least), COUNT_SCHEMA)
        level = durable(merged.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f"), f"phrases{k}")
        if k == 1:
            totals = level.where("phrase = ''").select("lang", F.col("f").alias("n"))
            level = level.where("phrase != ''")
        if parts is not None:
            parts.destroy()
        count = level.count()
        if not count:
            break
        found.append(level)
        if k == 1:
            marks = phrase_bitmap(level, count)
        elif k < min(words, TOGETHER):
            parts = phrase_bitmap(level, count)
    if not found:
        return spark.createDataFrame([], "lang string, phrase string, size int, f long"), totals
    out = found[0]
    for level in found[1:]:
        out = out.union(level)
    return out, totals


def collocations(
    docs: DataFrame, words: int = WORDS, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's phrases of 2 to ``words`` words, best first.

    ``a`` counts the phrase, ``l`` and ``r`` its parts at the cut with the lowest score
    ``floor(1000 a n / (l r))``, the first such cut. A phrase goes if one that is longer by some words around
    it stands as often. At most ``top`` of a language are listed, by score, then ``a``, then phrase in byte
    order. Products are decimals of 38 digits. Rows that repeat count again, columns besides language and
    text are not read; an empty table, or one without frequent phrases, gives no rows.
    """
    counts, totals = frequent_phrases(docs, words, least, lang_col, text_col)
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    part = lambda first, last: F.array_join(F.slice("words", first, last), " ")
    candidates = counts.where("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", "size", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    scored = scored.withColumn("above", whole("a") * whole("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("below", whole("l") * whole("r"))
    scored = scored.withColumn("score", F.expr("above div below").cast("long"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a part stands at least as often as what it is part of, so one word more on either side is enough to look at
    longer = candidates.where("size > 2").select("lang", F.col("f").alias("longer"), F.explode(
        F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(covered, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)"
    ranked = kept.withColumn("place", F.expr(order)).where(F.col("place") <= top)  # each task keeps its own first ones
    return ranked.select("lang", F.col("place").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
