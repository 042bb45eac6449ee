"""N-gram Jaccard join: documents whose word-shingle sets overlap enough, without comparing all pairs.

A document's set holds its distinct shingles of ``SHINGLE`` words (ASCII lower case, words parted by ASCII
white space). Documents with equal sets form one class. Shingles are ordered rare first, by counts over
all documents; two sets with Jaccard similarity ``T`` or more must then share one of their first
``n - ceil(T n) + 1`` shingles, so only those are joined. Length and positional filters drop pairs when
they are formed, a suffix filter (a lower bound of the Hamming distance of the sets, from bitmaps of
their tokens' parities) before the sets are fetched, and each remaining pair is verified once on the
whole sets.

Shingles are known by 64-bit hashes of their words, sets by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termscan.llm.common import drop_between, durable, link_groups, mix64, shared, small_batches, written

SHINGLE = 5
#: The similarity as a fraction, 80 of 100.
T_NUM, T_DEN = 4, 5
#: Counters of one of the two rows of the frequency sketch: fixed, so what is broadcast (4 MB) is bounded.
SKETCH_BITS = 18
#: The sketch travels in slices, added up in two steps of at most FAN_IN partial slices.
SLICES, FAN_IN = 16, 512
#: Longs of the bitmap from which the suffix filter bounds how far two sets differ.
WORDS = 8
#: Documents up to which a list of ids is broadcast (8 MB); a longer one is joined by a shuffle.
SMALL = 1_000_000
_CHUNK = 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _chunks(raw: np.ndarray):
    """Pieces of a long text, cut at white space."""
    at = 0
    while at < len(raw):
        to = at + _CHUNK
        if to < len(raw):
            while to < len(raw) and not (gap := _SPACE[raw[to : to + _CHUNK]]).any():
                to += _CHUNK
            to = to + int(gap.argmax()) if to < len(raw) else len(raw)
        yield raw[at:to]
        at = to


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text."""
    found = []
    for piece in _chunks(np.frombuffer(text, np.uint8)):
        space = np.empty(len(piece) + 2, bool)
        space[0] = space[-1] = True
        space[1:-1] = _SPACE[piece]
        edge = np.flatnonzero(space[1:] != space[:-1])
        start, end = edge[::2], edge[1::2]
        up, down = _power(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((_LOWER[piece].astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
        found.append(mix64((total[end] - total[start]) * down[start]))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes; a text with fewer words has one, without words none."""
    words = word_hashes(text)
    width = min(size, len(words))
    if not width:
        return words
    total = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        total = mix64(total * np.uint64(_BASE) + words[j : len(words) - width + 1 + j])
    return np.unique(total)


def _texts(batch: pa.RecordBatch):
    ids, texts = batch.column(0).to_pylist(), batch.column(1)
    for i in range(len(ids)):
        t = texts[i]
        yield ids[i], (t.as_buffer().to_pybytes() if t.is_valid else b"")


def _counters(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), ((h >> np.uint64(8)) & mask).astype(np.int64)


def _set_key(h: np.ndarray) -> int:
    """A 64-bit hash of a whole set, whatever its order; signed, as Spark's longs are."""
    return int(mix64(np.array([np.add.reduce(mix64(h ^ np.uint64(_BASE))) + np.uint64(len(h))], np.uint64)).view(np.int64)[0])


def _parities(h: np.ndarray) -> bytes:
    """For each of 64 * WORDS parts of the token space, whether the set has an odd number of tokens there.

    A token in only one of two sets changes one bit, so two sets differ in as many tokens as bits at least.
    """
    odd = np.bincount((h >> np.uint64(4)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _profile(batches):
    """Rows of kind 0 for documents, of kind 1 for slices of the counts of this task's shingles."""
    names = ["kind", "id", "n", "node", "parts"]
    sketch = np.zeros((2, 1 << SKETCH_BITS), np.int64)
    rows = 0
    for batch in batches:
        ids, n, node, parts, sets = [], [], [], [], [np.empty(0, np.uint64)]
        for doc, text in _texts(batch):
            h = shingle_set(text)
            sets.append(h)
            ids.append(doc)
            n.append(len(h))
            node.append(_set_key(h))
            parts.append(_parities(h))
        rows += len(ids)
        for k, at in enumerate(_counters(np.concatenate(sets))):
            sketch[k] += np.bincount(at, minlength=1 << SKETCH_BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(n, pa.int64()),
             pa.array(node, pa.int64()), pa.array(parts, pa.binary())], names)
    if rows:
        cut = sketch.reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([1] * SLICES, pa.int32()), pa.array(range(SLICES), pa.int64()), pa.array([0] * SLICES, pa.int64()),
             pa.array([0] * SLICES, pa.int64()), pa.array([_pack(x) for x in cut], pa.binary())], names)


def _pack(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, length: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=8 * length, codec="zstd", asbytes=True), "<i8")


def _added(key, table):
    length = (2 << SKETCH_BITS) // SLICES
    total = np.zeros(length, np.int64)
    for blob in table.column("parts"):
        total += _unpack(blob.as_py(), length)
    return pa.table({"id": pa.array([key[0].as_py()], pa.int64()), "parts": pa.array([_pack(total)], pa.binary())})


def frequencies(slices: DataFrame) -> np.ndarray:
    """The summed sketch: two rows of counters, a size that does not depend on the data."""
    step = slices.select("id", "parts", F.expr(f"monotonically_increasing_id() % {FAN_IN}").alias("lot"))
    for keys in (["id", "lot"], ["id"]):
        step = step.groupBy(*keys).applyInArrow(_added, "id long, parts binary")
    length = (2 << SKETCH_BITS) // SLICES
    total = np.zeros((SLICES, length), np.int64)
    for row in step.collect():
        total[row.id] = _unpack(bytes(row.parts), length)
    return np.minimum(total.reshape(2, -1), np.iinfo(np.int32).max).astype(np.int32)


def rare_first(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set in the one order all documents share: lower count first, then by hash."""
    one, two = _counters(h)
    return h[np.lexsort((h, np.minimum(counts[0][one], counts[1][two])))]


def prefix_length(n: int) -> int:
    return n - -(-T_NUM * n // T_DEN) + 1 if n else 0


def _prefixes(sketch):
    def run(batches):
        counts = sketch.value
        seen: set[int] = set()  # copies within a task are sent once
        for batch in batches:
            key, node, meta = [], [], []
            for _, text in _texts(batch):
                h = shingle_set(text)
                name = _set_key(h)
                if not len(h) or name in seen:
                    continue
                seen.add(name)
                first = rare_first(h, counts)[: prefix_length(len(h))].view(np.int64)
                key.append(first)
                node.append(np.full(len(first), name, np.int64))
                meta.append((np.int64(len(h)) << np.int64(31)) + np.arange(len(first), dtype=np.int64))
            if key:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (key, node, meta)], ["key", "node", "meta"])

    return run


def _admissible(left: str, right: str):
    """Length and positional filter on the sides of a pair that shares a prefix shingle."""
    n = {s: F.shiftright(F.col(f"{s}.meta"), 31) for s in (left, right)}
    rest = {s: n[s] - F.col(f"{s}.meta").bitwiseAND((1 << 31) - 1) for s in (left, right)}
    need = T_NUM * (n[left] + n[right])
    return (
        (T_DEN * F.least(n[left], n[right]) >= T_NUM * F.greatest(n[left], n[right]))
        & ((T_NUM + T_DEN) * F.least(rest[left], rest[right]) >= need)
    )


def _bits(parts: str) -> list:
    """The bitmap's longs, from its bytes."""
    return [F.conv(F.hex(F.substring(parts, 8 * k + 1, 8)), 16, -10).cast("long").alias(f"bits{k}") for k in range(WORDS)]


def _bounded(left: str, right: str):
    """Suffix filter: whether the bitmaps allow a Hamming distance as small as the threshold needs."""
    n = F.shiftright(F.col(f"{left}.meta"), 31) + F.shiftright(F.col(f"{right}.meta"), 31)
    apart = sum((F.bit_count(F.col(f"{left}.bits{k}").bitwiseXOR(F.col(f"{right}.bits{k}"))) for k in range(1, WORDS)),
                F.bit_count(F.col(f"{left}.bits0").bitwiseXOR(F.col(f"{right}.bits0"))))
    return (T_NUM + T_DEN) * apart <= (T_DEN - T_NUM) * n


def _sets(batches):
    for batch in batches:
        found = (shingle_set(text) for _, text in _texts(batch))
        out = [(_set_key(h), h.tobytes()) for h in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["node", "set"])


def _verified(batches):
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append((T_NUM + T_DEN) * both >= T_NUM * (len(x) + len(y)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs``.

    Null and empty texts, and texts of white space alone, have no shingles and stay alone. A repeated
    row or a repeated id gives one row each; rows with a null id get a null component. Ties need no
    rule: the component is the smallest id. Only the two named columns are read, so other columns may
    have any name. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    before = written()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    seen = durable(texts.mapInArrow(_profile, "kind int, id long, n long, node long, parts binary"), "profile")
    each = seen.where("kind = 0")
    classes = durable(each.where("n > 0").groupBy("node").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("parts").alias("parts")), "classes")
    counts = spark.sparkContext.broadcast(frequencies(seen.where("kind = 1")))
    # most prefix shingles are of one document only: they go where they are first brought together
    members = shared(texts.mapInArrow(_prefixes(counts), "key long, node long, meta long"))
    members = members.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key")))

    bounds = classes.select("node", *_bits("parts"))
    sides = classes.select("node", (F.col("n") * (1 << 31)).alias("meta"), *_bits("parts"))

    def verify(pairs: DataFrame) -> DataFrame:
        near = pairs.join(sides.toDF("a", *[f"l{c}" for c in sides.columns[1:]]), "a")
        near = near.join(sides.toDF("b", *[f"r{c}" for c in sides.columns[1:]]), "b")
        near = near.select("a", "b", *[F.struct(*[F.col(s + c).alias(c) for c in sides.columns[1:]]).alias(s) for s in "lr"])
        near = durable(near.where(_bounded("l", "r")).select("a", "b"), "near")
        wanted = near.select("a").union(near.select("b")).toDF("node").distinct()
        ids = durable(wanted.join(classes, "node").select(F.col("rep").alias("id")).distinct(), "wanted")
        if ids.count() <= SMALL:
            ids = F.broadcast(ids)
        rows = texts.join(ids, "id").select("id", "text")
        sets = durable(rows.mapInArrow(_sets, "node long, set binary").dropDuplicates(["node"]), "sets")
        return near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").mapInArrow(
            _verified, "a long, b long, linked boolean")

    place = F.col("meta").bitwiseAND((1 << 31) - 1)  # few rare shingles of its own: near the middle of its group
    label = link_groups(members, verify, _admissible, place, bounds, _bounded)
    best = label.join(classes, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    best = label.join(best, "component").select("node", "component_id")
    own = classes.join(best, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    groups = durable(each.join(own, "node", "left").select(
        "id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    ), "found")
    drop_between(before, written() - 1)
    return groups.withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; all columns stay.

    Rows without words, and rows with a null id, all stay. Of rows that repeat an id, all stay if that
    id is kept.
    """
    kept = jaccard_groups(docs, id_col, text_col).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__kept")).distinct()
    return docs.join(kept, docs[id_col] == F.col("__kept"), "left").where(F.col("__kept").isNotNull() | docs[id_col].isNull()).drop("__kept")
