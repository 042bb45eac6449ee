"""Line dedup: of lines that are nearly the same, anywhere in the table, the first one stays.

A line's set holds every run of ``WIDTH`` characters of its lower-case form, or all of it if it is shorter.
MinHash by one permutation in ``BINS`` bins gives a signature; bands of two bins find pairs with high
recall, and pairs that agree in less than ``AGREE`` bins are not looked at: at similarity 4/5 one pair in 300
is missed, at 9/10 fewer than one in 10,000. Of the pairs that are left in groups of many lines, those whose
sizes and bitmaps (parities of the sets in parts of the hash range) rule the similarity out are not formed, which loses none. The exact
Jaccard similarity of the two whole sets decides, and distributed union-find keeps one line per component.

Shingles are hashed, signed and compared in Arrow tasks, many lines at a time; all the rest are joins and
groupings. (With built-in functions alone the shingles of every character took more than twice the CPU time that
the operator is allowed; see the README.)

Lines are parted by line feeds. Lines of white space alone are left as they are. Equal lines are known
by 64-bit hashes, and their copies go without a comparison.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termscan.llm.common import drop_between, durable, light, link_groups, mix64, shared, small_batches, written

#: Jaccard similarity from which lines count as the same, as a fraction.
T_NUM, T_DEN = 4, 5
WIDTH = 9
BANDS, ROWS = 8, 2
BINS = BANDS * ROWS
#: Bins in which signatures must agree.
AGREE = 6
VALUES = [f"bin{i}" for i in range(BINS)]
#: Longs of the bitmap that bounds from below in how many shingles two lines differ.
PARITIES = 8
BITS = [f"bits{i}" for i in range(PARITIES)]
#: Characters that are hashed at a time; longer lines go in pieces that overlap by ``WIDTH - 1``.
CHARS = 1 << 20
#: Lines whose signatures a task remembers, about 400 bytes each.
MEMORY = 150_000
#: What the expression ``\\s`` matches.
_SPACES = " \t\n\x0b\f\r"
#: Lines of one document whose marks share a long.
MARKS = 62
#: Documents up to which a list of ids is broadcast (16 MB); a longer one is joined by a shuffle.
SMALL = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Stands behind the end of lines that are shorter than a shingle; no character has this number.
_END = 0x110000


def _blocks(lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of shingles and the numbers of their lines, in blocks of about ``CHARS`` characters; lines stay in order."""
    codes, owners, held = [], [], 0
    for k, line in enumerate(lines):
        own = np.frombuffer(line.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(own) < WIDTH:
            own = np.append(own, np.full(WIDTH - len(own), _END, np.uint32))
        for at in range(0, max(1, len(own) - WIDTH + 1), CHARS):
            part = own[at : at + CHARS + WIDTH - 1]
            codes.append(part)
            owners.append((k, len(part)))
            held += len(part)
            if held >= CHARS:
                yield _hashed(codes, owners)
                codes, owners, held = [], [], 0
    if codes:
        yield _hashed(codes, owners)


def _hashed(codes: list[np.ndarray], owners: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    c = np.concatenate(codes).astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(c) - WIDTH + 1, np.uint64)
    for j in range(WIDTH):
        h = h * _BASE + c[j : len(c) - WIDTH + 1 + j]
    numbers, sizes = np.array(owners, np.int64).T
    line = np.repeat(numbers, sizes)[: len(h)]
    # a run must end within its own part
    ends = np.cumsum(sizes)
    whole = np.arange(len(h)) + WIDTH <= np.repeat(ends, sizes)[: len(h)]
    return mix64(h[whole]), line[whole]


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted hashes of each line's distinct shingles."""
    found: list[list[np.ndarray]] = [[] for _ in lines]
    for h, line in _blocks(lines):
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        for k, part in zip(line[first].tolist(), np.split(h, first[1:])):
            found[k].append(part)
    return [np.unique(np.concatenate(x)) for x in found]


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of ``BINS`` numbers for each line: the smallest hash in each part of the hash range; sizes; bitmaps.

    An empty bin borrows from the next that is not empty. The size of a line's set is 0 where the line is cut into blocks,
    as its bitmap counts a shingle once per block then. Hashes lose the few bits that tell the lines apart.
    """
    none = np.uint64((1 << 64) - 1)
    least = np.full((len(lines), BINS), none)
    sizes, blocks = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)
    odd = np.zeros((len(lines), PARITIES), np.uint64)
    lost = np.uint64(len(lines).bit_length())
    for h, line in _blocks(lines):
        np.minimum.at(least.reshape(-1), line * BINS + (h >> np.uint64(60)).astype(np.int64), h)
        distinct = np.sort((line.astype(np.uint64) << (np.uint64(64) - lost)) | (h >> lost))
        distinct = distinct[np.concatenate([[True], distinct[1:] != distinct[:-1]])]
        own = (distinct >> (np.uint64(64) - lost)).astype(np.int64)
        part = distinct & np.uint64(64 * PARITIES - 1)
        np.bitwise_xor.at(odd.reshape(-1), own * PARITIES + (part >> np.uint64(6)).astype(np.int64), np.uint64(1) << (part & np.uint64(63)))
        first, last = int(line[0]), int(line[-1]) + 1
        count = np.bincount(own - first, minlength=last - first)
        sizes[first:last] += count
        blocks[first:last] += count > 0
    for _ in range(BINS):
        empty = least == none
        if not empty.any():
            break
        least = np.where(empty, np.roll(least, -1, axis=1), least)
    return least, np.where(blocks > 1, 0, sizes), odd


_PLACED = [("node", pa.int64()), ("doc", pa.int64()), ("version", pa.int64()), ("line_no", pa.int32())]
_SIGNED = pa.schema([*_PLACED, *[(v, pa.int32()) for v in VALUES], ("size", pa.int64()), *[(b, pa.int64()) for b in BITS]])
SIGNED_SCHEMA = "node long, doc long, version long, line_no int, " + ", ".join([*[f"{v} int" for v in VALUES], "size long", *[f"{b} long" for b in BITS]])


def _name(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per line that is not blank; a line that a task has met already is not hashed again."""
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        rows, fresh = [], {}
        for doc, version, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "version", "text"))):
            for no, line in enumerate(text.split("\n")):
                if line.strip(_SPACES):
                    node = _name(line)
                    rows.append((node, doc, version, no))
                    if node not in known:
                        fresh.setdefault(node, line)
        if not rows:
            continue
        if len(known) > MEMORY:
            keep = {r[0] for r in rows}
            known = {k: v for k, v in known.items() if k in keep}
        least, sizes, odd = signatures(list(fresh.values()))
        known.update(zip(fresh, zip((least >> np.uint64(29)).astype(np.int64).astype(np.int32), np.column_stack([sizes, odd.view(np.int64)]))))
        marks, sets = (np.stack(x) for x in zip(*(known[r[0]] for r in rows)))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _SIGNED)] + [pa.array(x[:, i]) for x in (marks, sets) for i in range(x.shape[1])]
        yield pa.RecordBatch.from_arrays(columns, schema=_SIGNED)


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = dict.fromkeys([*batch.column("la").to_pylist(), *batch.column("lb").to_pylist()])
        lines.update(zip(lines, shingle_sets(list(lines))))
        linked = []
        for x, y in zip(batch.column("la").to_pylist(), batch.column("lb").to_pylist()):
            both = len(np.intersect1d(lines[x], lines[y], assume_unique=True))
            linked.append((T_NUM + T_DEN) * both >= T_NUM * (len(lines[x]) + len(lines[y])))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def _near(left: str, right: str) -> Column:
    """Whether two signatures agree in enough bins."""
    return sum(((F.col(f"{left}.{v}") == F.col(f"{right}.{v}")).cast("int") for v in VALUES), F.lit(0)) >= AGREE


def _bounded(left: str, right: str) -> Column:
    """Whether sizes and bitmaps allow the similarity: each bit that differs stands for a shingle that only one of the sets has.

    Of the bands that two lines share, only the first brings them together.
    """
    n, m = F.col(f"{left}.size"), F.col(f"{right}.size")
    apart = sum((F.bit_count(F.col(f"{left}.{b}").bitwiseXOR(F.col(f"{right}.{b}"))) for b in BITS), F.lit(0))
    sized = (T_DEN * F.least(n, m) >= T_NUM * F.greatest(n, m)) & ((T_NUM + T_DEN) * apart <= (T_DEN - T_NUM) * (n + m))
    same = [sum(((F.col(f"{left}.{v}") == F.col(f"{right}.{v}")).cast("int") for v in VALUES[b * ROWS : (b + 1) * ROWS]), F.lit(0)) == ROWS for b in range(BANDS)]
    band = F.coalesce(*[F.when(x, F.lit(b)) for b, x in enumerate(same)])
    return (F.col(f"{left}.band") == band) & ((n == 0) | (m == 0) | sized)


def first_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, version, line_no)`` of the lines that stay: the first of each component of similar lines.

    ``version`` is a hash of the whole text, so that rows that repeat an id are told apart.
    """
    small_batches(docs.sparkSession)
    before = written()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))
    place = F.struct("doc", "version", "line_no")
    each = texts.mapInArrow(_signed, SIGNED_SCHEMA)
    classes = each.groupBy("node").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), *[F.min(v).alias(v) for v in (*VALUES, "size", *BITS)])
    classes = durable(classes, "lines")

    bands = F.array(*[F.xxhash64(F.lit(b), *VALUES[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])
    # most bands are of one line only: they go where they are first brought together
    members = shared(classes.select(F.posexplode(bands).alias("band", "key"), "node"))
    members = members.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key")))
    members = members.join(classes.select("node", "copies", *VALUES), "node")

    def verify(pairs: DataFrame) -> DataFrame:
        rows = 2 * pairs.count()
        nodes = pairs.select("a").union(pairs.select("b")).toDF("node").distinct()
        wanted = durable(classes.join(light(nodes, rows), "node").select("node", "first.*"), "wanted")
        ids = wanted.select("doc", "version").distinct()
        if ids.count() <= SMALL:
            ids = F.broadcast(ids)
        found = texts.join(ids, ["doc", "version"])
        found = found.select("doc", "version", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        found = found.join(light(wanted, rows), ["doc", "version", "line_no"]).dropDuplicates(["node"])
        found = durable(found.select("node", "line"), "compared")
        compared = pairs.join(found.toDF("a", "la"), "a").join(found.toDF("b", "lb"), "b")
        return compared.select("a", "b", "la", "lb").mapInArrow(_verified, "a long, b long, linked boolean")

    # the line that others were made from tends to have the most copies
    label = link_groups(members, verify, _near, -F.col("copies"), classes.select("node", "size", *BITS), _bounded)
    own = classes.select("node", "first").join(label, "node", "left")
    stay = durable(own.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first")).select("first.*"), "stay")
    drop_between(before, written() - 1)
    return stay


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that stay in ``text``, and ``n_lines, n_kept`` added (replacing such columns).

    A line is kept where it stands first: by id, then by place. Blank lines all stay, and so do the line
    feeds between the lines that stay. A text of which nothing stays becomes empty, a null text stays
    null; the row stays in either case. Rows with a null id stay as they are and their lines are not
    compared. Equal rows keep the same lines. An empty table gives no rows.
    """
    chunk = F.floor(F.col("line_no") / MARKS).cast("int")
    kept = first_lines(docs, id_col, text_col).groupBy("doc", "version", chunk.alias("chunk")).agg(
        F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("line_no", F.lit(MARKS)).cast("int"))).alias("marks"))
    kept = kept.groupBy("doc", "version").agg(F.map_from_entries(F.collect_list(F.struct("chunk", "marks"))).alias("__map"))
    last = F.array_max(F.map_keys("__map"))
    kept = kept.select("doc", "version", F.transform(
        F.sequence(F.lit(0), last), lambda c: F.coalesce(F.element_at("__map", c), F.lit(0).cast("long"))).alias("__marks"))
    text = F.col(text_col).cast("string")
    rows = docs.withColumns({"__doc": F.col(id_col).cast("long"), "__version": F.xxhash64(F.coalesce(text, F.lit("")))})
    rows = rows.join(kept.toDF("__doc", "__version", "__marks"), ["__doc", "__version"], "left")
    marks = F.coalesce(F.col("__marks"), F.array().cast("array<bigint>"))
    split = F.split(text, "\n", -1)
    stays = lambda line, i: ~F.regexp_like(line, F.lit(r"\S")) | (
        F.getbit(F.coalesce(F.get(marks, F.floor(i / MARKS).cast("int")), F.lit(0).cast("long")), F.pmod(i, F.lit(MARKS)).cast("int")) == 1)
    left = F.when(F.col("__doc").isNull(), split).otherwise(F.filter(split, stays))
    rows = rows.withColumns({"__left": left, "n_lines": F.coalesce(F.size(split), F.lit(0)).cast("long")})
    rows = rows.withColumn("n_lines", F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
    rows = rows.withColumn("n_kept", F.when(text.isNull(), F.lit(0)).otherwise(F.size("__left")).cast("long"))
    rows = rows.withColumn(text_col, F.when(text.isNotNull(), F.array_join("__left", "\n")))
    return rows.select(*docs.columns, *[c for c in ("n_lines", "n_kept") if c not in docs.columns])
