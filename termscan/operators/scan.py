"""Forward scans: how much would each candidate term add to a model?

A candidate is compared with a model through moments only (Frisch, Waugh and Lovell): its sum of
squares, sum, and products with the model's columns and the outcome. Tasks add the moments up with
matrix products over their own row blocks; pair terms a*b come out of X' diag(v) X and are never
written down. Partial moments meet by term, get summed and scored there, and only the best row of
a task goes on.

Every task takes its columns relative to their means in its first row block, so that a mean far from
zero costs no digits. With a = r + a' and b = s + b' the product is rs + rb' + sa' + a'b': its moments
about rs follow from those of a', b' and a'b'. Partial moments about different values are moved to
a common one when they meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscan.errors import SampleMismatch
from termscan.functions.solve import COLLINEAR, check_samples, cholesky_or_fail
from termscan.functions.tdist import t_pvalue
from termscan.operators.tiles import TASK_BYTES, Y_BLOCK, TileSet, cores, matrix, read_row_blocks, record_batch

# A term is (a, -1), a single column, or (a, b) with a < b, a product of two.
Term = tuple[int, int]
SINGLE = -1

# A sum of squares below this share of what was added up to get it is zero but for rounding.
ROUNDING = 1e-14
# Pair moments up to this size are added up inside each task.
LOCAL_PAIR_BYTES = 256e6
# Correlations of a model with a condition number below this lose no digits that matter.
WELL_CONDITIONED = 1e4
# Rows that one task streams for a pair of term blocks before another task takes over.
SEGMENT_ROWS = 262_144


@dataclass(frozen=True)
class ModelState:
    """The current model of one trait: scaled columns with their centred cross products."""

    terms: tuple[Term, ...] = ()
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    gram: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    xy: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def keep(self, terms: Sequence[Term]) -> ModelState:
        at = [self.terms.index(t) for t in terms]
        return ModelState(tuple(terms), self.centre[at], self.scale[at], self.gram[np.ix_(at, at)], self.xy[at])


@dataclass(frozen=True)
class Candidate:
    """The winner of a scan, with the moments that extend the model state."""

    term: Term
    t_value: float
    df: int
    mean: float
    squares: float  # about the mean
    with_model: np.ndarray
    with_y: float
    extended: ModelState | None = None  # the model with the term, where it is known already

    def extend(self, state: ModelState, n: int) -> ModelState:
        if self.extended is not None:
            return self.extended
        sd = float(np.sqrt(self.squares / n))
        k = len(state.terms)
        gram = np.zeros((k + 1, k + 1))
        gram[:k, :k] = state.gram
        gram[k, :k] = gram[:k, k] = self.with_model / sd
        gram[k, k] = n
        return ModelState(
            (*state.terms, self.term),
            np.append(state.centre, self.mean),
            np.append(state.scale, sd),
            gram,
            np.append(state.xy, self.with_y / sd),
        )


@dataclass(frozen=True)
class _Columns:
    """Distinct model columns of all traits in one scan, and where each trait finds its own."""

    terms: tuple[Term, ...]
    centre: np.ndarray
    scale: np.ndarray
    at: tuple[tuple[int, ...], ...]
    traits: tuple[int, ...]
    y_mean: np.ndarray
    y_scale: np.ndarray
    width: int

    @property
    def blocks(self) -> list[int]:
        """Term blocks that the model columns come from."""
        return sorted({i // self.width for term in self.terms for i in term if i != SINGLE})

    @staticmethod
    def of(ts: TileSet, states: Mapping[str, ModelState]) -> _Columns:
        # The same term may have been centred differently by two traits, so both are kept apart.
        keys: dict[tuple, int] = {}
        at = []
        for state in states.values():
            at.append(tuple(keys.setdefault((t, c, s), len(keys)) for t, c, s in zip(state.terms, state.centre, state.scale)))
        traits = tuple(ts.traits.index(t) for t in states)
        return _Columns(
            tuple(k[0] for k in keys),
            np.array([k[1] for k in keys], dtype=float),
            np.array([k[2] for k in keys], dtype=float),
            tuple(at),
            traits,
            ts.y_mean[list(traits)],
            ts.y_scale[list(traits)],
            ts.width,
        )

    def values(self, tiles: Mapping[int, np.ndarray]) -> np.ndarray:
        """Scaled model columns, then scaled outcomes, for one row block."""
        y = (tiles[Y_BLOCK][:, list(self.traits)] - self.y_mean) / self.y_scale
        if not self.terms:
            return y
        w = self.width
        cols = []
        for a, b in self.terms:
            col = tiles[a // w][:, a % w]
            cols.append(col if b == SINGLE else col * tiles[b // w][:, b % w])
        return np.concatenate([(np.stack(cols, 1) - self.centre) / self.scale, y], axis=1)


# Moments of a key's terms, one column per term, and what they share: rows and sums of v.
_PARTIAL = pa.schema([("a", pa.int32()), ("j", pa.int32()), ("m", pa.binary()), ("shared", pa.binary())])
PARTIAL_SCHEMA = "a int, j int, m binary, shared binary"
# Rows of a partial: reference value, sizes added up, squares and sum about it, then products with v.
HEAD = 4


def _reference(x: np.ndarray) -> np.ndarray:
    """Column means, exact where a column is constant."""
    return x[0] + (x - x[0]).mean(0)


def _shared(v: np.ndarray) -> np.ndarray:
    return np.append(float(len(v)), v.sum(0))


def _single_sums(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squares, sums and products with v of columns that are relative to their references."""
    return np.concatenate([np.square(x).sum(0)[None], x.sum(0)[None], v.T @ x])


def _single_moments(ref: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return np.concatenate([ref[None], sums[:1], sums])


def _pair_sums(left: np.ndarray, right: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Sums of a²b², a²b, ab², ab and vab over relative columns, shape (4 + columns of v, left, right)."""
    p, q, left2, right2 = left.shape[1], right.shape[1], np.square(left), np.square(right)
    stacked = np.concatenate([left] + [left * v[:, [c]] for c in range(v.shape[1])], axis=1)
    rest = (stacked.T @ right).reshape(v.shape[1] + 1, p, q)
    return np.concatenate([(left2.T @ right2)[None], (left2.T @ right)[None], (left.T @ right2)[None], rest])


def _pair_moments(r: np.ndarray, s: np.ndarray, left: np.ndarray, right: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Moments of all products about the products of their references, from the sums of single columns and of pairs."""
    r, s, left, right = r[:, None], s[None, :], left[:, :, None], right[:, None, :]
    aabb, aab, abb, ab = sums[:4]
    parts = [np.square(r) * right[0], np.square(s) * left[0], aabb, 2 * r * s * ab, 2 * r * abb, 2 * s * aab]
    squares, size = sum(parts), sum(np.abs(x) for x in parts)
    total = r * right[1] + s * left[1] + ab
    return np.concatenate([(r * s)[None], size[None], squares[None], total[None], r * right[2:] + s * left[2:] + sums[4:]])


def _pair_records(i: int, j: int, moments: np.ndarray, shared: np.ndarray, width: int) -> list[tuple]:
    """One record per left term, so that summing up is spread over many keys."""
    first = i * width
    last = moments.shape[1] - 1 if i == j else moments.shape[1]
    return [(first + a, j, np.ascontiguousarray(moments[:, a, :]).tobytes(), shared.tobytes()) for a in range(last)]


def _local_kernel(cols: _Columns, n_blocks: int, pairs: bool):
    blocks = range(n_blocks)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref: dict[int, np.ndarray] = {}
        single: dict[int, np.ndarray] = {}
        pair: dict[tuple[int, int], np.ndarray] = {}
        shared = 0.0
        for _, tiles in read_row_blocks(batches, blocks):
            v = cols.values(tiles)
            shared = shared + _shared(v)
            if not ref:
                ref = {i: _reference(tiles[i]) for i in blocks}
            # With pairs all columns are needed at once; else one tile at a time.
            x = {i: tiles[i] - ref[i] for i in blocks} if pairs else {}
            for i in blocks:
                own = x[i] if pairs else tiles[i] - ref[i]
                m = _single_sums(own, v)
                single[i] = single[i] + m if i in single else m
                for j in range(i, n_blocks) if pairs else ():
                    m = _pair_sums(own, x[j], v)
                    pair[i, j] = pair[i, j] + m if (i, j) in pair else m
        for i, m in single.items():
            yield record_batch([(SINGLE, i, _single_moments(ref[i], m).tobytes(), shared.tobytes())], _PARTIAL)
        for (i, j), m in pair.items():
            moments = _pair_moments(ref[i], ref[j], single[i], single[j], m)
            yield record_batch(_pair_records(i, j, moments, shared, cols.width), _PARTIAL)

    return kernel


_FRAME_SCHEMA = "row_block long, n_rows int, x binary"
_FRAME = pa.schema([("row_block", pa.int64()), ("n_rows", pa.int32()), ("x", pa.binary())])


def _frame_kernel(cols: _Columns):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row_block, tiles in read_row_blocks(batches, cols.blocks):
            v = cols.values(tiles)
            yield record_batch([(row_block, len(v), np.ascontiguousarray(v).tobytes())], _FRAME)

    return kernel


class _Meeting:
    """Sums over the row blocks of two term blocks that meet in a task."""

    def __init__(self, i: int, j: int):
        self.i, self.j = i, j
        self.refs: tuple[np.ndarray, np.ndarray] | None = None
        self.shared = self.left = self.right = self.pair = 0.0

    def add(self, left: np.ndarray, right: np.ndarray, v: np.ndarray) -> None:
        if self.refs is None:
            self.refs = (_reference(left), _reference(right))
        a, b = left - self.refs[0], right - self.refs[1]
        self.shared = self.shared + _shared(v)
        self.left = self.left + _single_sums(a, v)
        self.right = self.right + _single_sums(b, v)
        self.pair = self.pair + _pair_sums(a, b, v)

    def records(self, width: int) -> pa.RecordBatch:
        moments = _pair_moments(*self.refs, self.left, self.right, self.pair)
        return record_batch(_pair_records(self.i, self.j, moments, self.shared, width), _PARTIAL)


def _meet_kernel(width: int):
    """Pair moments of two term blocks from a stream sorted by key, row block and role."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, met, v, left = None, None, None, None
        for batch in batches:
            ii, jj = batch.column("i").to_pylist(), batch.column("j").to_pylist()
            seg, role = batch.column("segment").to_pylist(), batch.column("role").to_pylist()
            rows, data = batch.column("n_rows").to_pylist(), batch.column("x")
            for r in range(batch.num_rows):
                if (ii[r], jj[r], seg[r]) != key:
                    if met is not None:
                        yield met.records(width)
                    key, met = (ii[r], jj[r], seg[r]), _Meeting(ii[r], jj[r])
                x = matrix(data[r].as_buffer(), rows[r])
                if role[r] == 0:
                    v = x
                    continue
                if role[r] == 1:
                    left = x
                    if key[0] != key[1]:
                        continue
                met.add(left, x, v)
        if met is not None:
            yield met.records(width)

    return kernel


def _meeting_pairs(ts: TileSet, cols: _Columns) -> DataFrame:
    """Partial pair moments when they do not fit into one task: each two term blocks meet in a task."""
    frame = ts.columns(cols.blocks).mapInArrow(_frame_kernel(cols), _FRAME_SCHEMA)
    return _meeting_rows(ts, frame).mapInArrow(_meet_kernel(ts.width), PARTIAL_SCHEMA)


def _meeting_rows(ts: TileSet, frame: DataFrame, wanted: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """The tiles of each two term blocks (or of the ``wanted`` pairs of blocks) side by side, each after its rows of ``frame``.

    Tiles are copied to the pairs of blocks they belong to, the frame's columns to every pair, and one
    shuffle brings them together. Tasks stream over row blocks, so a task holds two tiles and one
    block of moments; long tables are split into segments of rows.
    """
    last = ts.n_blocks - 1
    segments = max(1, -(-ts.n_samples // SEGMENT_ROWS))
    segment = F.pmod(F.hash("row_block"), F.lit(segments)).alias("segment")
    model = (
        frame.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("i"))
        .select("*", F.explode(F.sequence("i", F.lit(last))).alias("j"))
        .select("i", "j", segment, "row_block", F.lit(0).alias("role"), "n_rows", "x")
    )
    data = ts.blocks.select("row_block", "n_rows", F.posexplode("x").alias("block", "x"))
    left = data.select("*", F.explode(F.sequence("block", F.lit(last))).alias("j")).select(
        F.col("block").alias("i"), "j", segment, "row_block", F.lit(1).alias("role"), "n_rows", "x"
    )
    right = (
        data.filter(F.col("block") > 0)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"))
        .select("i", F.col("block").alias("j"), segment, "row_block", F.lit(2).alias("role"), "n_rows", "x")
    )
    met = model.unionByName(left).unionByName(right)
    pairs = ts.n_blocks * (ts.n_blocks + 1) // 2
    if wanted is not None and len(wanted) < pairs:
        # a bit per pair of blocks: 256 KB at most, as the numbers of tile pairs are kept on the driver only up to two millions
        some = met.sparkSession.createDataFrame([(int(i), int(j)) for i, j in wanted], "i int, j int")
        met = met.join(F.broadcast(some), ["i", "j"], "left_semi").select(*met.columns)
        pairs = max(1, len(wanted))
    tasks = min(pairs * segments, max(cores(met), _tasks(8.0 * ts.n_samples * ts.width * 2 * pairs)))
    return met.repartition(tasks, "i", "j", "segment").sortWithinPartitions("i", "j", "segment", "row_block", "role")


@dataclass(frozen=True)
class _TraitSpec:
    """What scoring needs to know about one trait."""

    trait: int
    at: tuple[int, ...]
    y_at: int
    low: np.ndarray
    low_xy: np.ndarray
    rest_y: float
    df: int
    closed: frozenset[Term]


def _specs(ts: TileSet, cols: _Columns, states: Mapping[str, ModelState], closed: Mapping[str, frozenset[Term]]) -> list[_TraitSpec]:
    out = []
    for i, (trait, state) in enumerate(states.items()):
        k = len(state.terms)
        low = cholesky_or_fail(state.gram)
        low_xy = np.linalg.solve(low, state.xy) if k else np.zeros(0)
        yy = float(ts.n_samples)  # the outcome is scaled by its own deviation
        df = check_samples(ts.n_samples, k + 2)
        out.append(
            _TraitSpec(i, cols.at[i], len(cols.terms) + i, low, low_xy, yy - float(low_xy @ low_xy), df, frozenset(closed.get(trait, ())))
        )
    return out


def _score(m: np.ndarray, n: int, spec: _TraitSpec, y_scale: float) -> dict[str, np.ndarray]:
    size, xx = m[1], m[2]
    g = m[3:][list(spec.at)]
    gy = m[3 + spec.y_at]
    w = np.linalg.solve(spec.low, g) if len(spec.at) else g
    rest = xx - np.square(w).sum(0)
    xy = gy - (w.T @ spec.low_xy if len(spec.at) else 0.0)
    ok = (xx > ROUNDING * size) & (rest > COLLINEAR * xx)
    with np.errstate(divide="ignore", invalid="ignore"):
        beta = xy / rest
        sse = np.maximum(spec.rest_y - xy * beta, 1e-15 * n)
        se = np.sqrt(sse / spec.df / rest)
        t = beta / se
    ok &= np.isfinite(t)
    return {"ok": ok, "t": np.where(ok, t, np.nan), "beta": beta * y_scale, "se": se * y_scale}


def _closed_mask(a: int, first_b: int, count: int, closed: frozenset[Term]) -> np.ndarray:
    """Candidates of one key that are not open: repeated pairs, model terms, skipped terms."""
    mask = np.zeros(count, dtype=bool)
    if a != SINGLE:
        mask |= first_b + np.arange(count) <= a
    for ta, tb in closed:
        at = (ta if a == SINGLE else tb) - first_b
        mine = tb == SINGLE if a == SINGLE else (ta == a and tb != SINGLE)
        if mine and 0 <= at < count:
            mask[at] = True
    return mask


def _moved(m: np.ndarray, shared: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """The same moments about another reference value."""
    d = m[0] - ref
    more = 2 * d * m[3] + shared[0] * np.square(d)
    size = m[1] + 2 * np.abs(d * m[3]) + shared[0] * np.square(d)
    return np.concatenate([ref[None], size[None], (m[2] + more)[None], (m[3] + shared[0] * d)[None], m[HEAD:] + np.outer(shared[1:], d)])


def _centred(m: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Mean, sizes added up, squares about the mean, products with v about the mean."""
    d = m[3] / shared[0]
    return np.concatenate([(m[0] + d)[None], m[1][None], (m[2] - m[3] * d)[None], m[HEAD:] - np.outer(shared[1:], d)])


def _summed(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Moments about the mean, summed per key of a sorted stream."""
    key, acc, shared = None, None, None
    for batch in batches:
        a, j, m, c = batch.column("a").to_pylist(), batch.column("j").to_pylist(), batch.column("m"), batch.column("shared")
        for r in range(batch.num_rows):
            part = np.frombuffer(m[r].as_buffer(), dtype=np.float64).reshape(depth, -1)
            own = np.frombuffer(c[r].as_buffer(), dtype=np.float64)
            if (a[r], j[r]) == key:
                moved = _moved(part, own, acc[0])
                acc, shared = np.concatenate([acc[:1], acc[1:] + moved[1:]]), shared + own
            else:
                if key is not None:
                    yield *key, _centred(acc, shared)
                key, acc, shared = (a[r], j[r]), part, own
    if key is not None:
        yield *key, _centred(acc, shared)


_BEST = pa.schema(
    [("trait", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("t", pa.float64()), ("abs_t", pa.float64()), ("m", pa.binary())]
)
BEST_SCHEMA = "trait int, a int, b int, t double, abs_t double, m binary"


def _best_kernel(specs: list[_TraitSpec], depth: int, n: int, width: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for a, j, m in _summed(batches, depth):
            for spec in specs:
                t = _score(m, n, spec, 1.0)["t"]
                t[_closed_mask(a, j * width, m.shape[1], spec.closed)] = np.nan
                if np.isnan(t).all():
                    continue
                at = int(np.nanargmax(np.abs(t)))
                term = (j * width + at, SINGLE) if a == SINGLE else (a, j * width + at)
                # Equal t: single terms first, then in term order.
                rank = (-abs(t[at]), term[1] != SINGLE, term)
                if spec.trait not in best or rank < best[spec.trait][0]:
                    best[spec.trait] = (rank, term, float(t[at]), m[:, at].copy())
        records = [(s, term[0], term[1], t, abs(t), m.tobytes()) for s, (_, term, t, m) in best.items()]
        if records:
            yield record_batch(records, _BEST)

    return kernel


_ALL = pa.schema(
    [
        ("trait", pa.int32()),
        ("a", pa.int32()),
        ("b", pa.int32()),
        ("df", pa.int64()),
        ("estimate", pa.float64()),
        ("std_error", pa.float64()),
        ("t_value", pa.float64()),
        ("collinear", pa.bool_()),
    ]
)
ALL_SCHEMA = "trait int, a int, b int, df long, estimate double, std_error double, t_value double, collinear boolean"


def _all_kernel(specs: list[_TraitSpec], depth: int, n: int, width: int, y_scale: np.ndarray):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, j, m in _summed(batches, depth):
            b = j * width + np.arange(m.shape[1])
            for spec in specs:
                s = _score(m, n, spec, float(y_scale[spec.trait]))
                open_ = ~_closed_mask(a, j * width, m.shape[1], spec.closed)
                count = int(open_.sum())
                first = b[open_] if a == SINGLE else np.full(count, a)
                second = np.full(count, SINGLE) if a == SINGLE else b[open_]
                ok = s["ok"][open_]
                hide = lambda x: pa.array(x[open_], mask=~ok)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(count, spec.trait), pa.int32()),
                        pa.array(first, pa.int32()),
                        pa.array(second, pa.int32()),
                        pa.array(np.full(count, spec.df), pa.int64()),
                        hide(s["beta"]),
                        hide(s["se"]),
                        hide(s["t"]),
                        pa.array(~ok),
                    ],
                    schema=_ALL,
                )

    return kernel


def _tasks(n_bytes: float) -> int:
    return max(1, int(n_bytes / TASK_BYTES))


def _scored(ts: TileSet, cols: _Columns, pairs: bool, score, schema: str) -> tuple[DataFrame, bool]:
    """Moments of all terms, added up per term and scored, and whether one task did it all.

    A table that fits one task is scored there. Otherwise partial moments meet by term; pair
    moments that are too many for a task come from tasks of their own.
    """
    local = _local_kernel(cols, ts.n_blocks, pairs)
    depth = HEAD + len(cols.terms) + len(cols.traits)
    n_wide = ts.n_blocks * ts.width
    set_bytes = depth * 8.0 * (n_wide * n_wide / 2 if pairs else n_wide)
    fits = not pairs or set_bytes <= LOCAL_PAIR_BYTES
    if fits and ts.n_parts == 1 and ts.written is None:
        return ts.blocks.mapInArrow(lambda batches: score(local(batches)), schema), True
    if fits:
        partials = ts.blocks.mapInArrow(local, PARTIAL_SCHEMA)
    else:
        singles = ts.blocks.mapInArrow(_local_kernel(cols, ts.n_blocks, False), PARTIAL_SCHEMA)
        partials = singles.unionByName(_meeting_pairs(ts, cols))
    sets = ts.n_parts if fits else -(-ts.n_samples // SEGMENT_ROWS)
    keys = ts.n_blocks * (ts.n_terms if pairs else 1)
    tasks = min(keys, max(_tasks(sets * set_bytes), cores(partials) if sets * set_bytes > TASK_BYTES else 1))
    return partials.repartition(tasks, "a", "j").sortWithinPartitions("a", "j").mapInArrow(score, schema), False


def best_candidates(
    ts: TileSet, states: Mapping[str, ModelState], closed: Mapping[str, frozenset[Term]], pairs: bool
) -> dict[str, Candidate]:
    """The open candidate with the largest |t| for each trait, all traits in one pass over the tiles."""
    cols = _Columns.of(ts, states)
    specs = _specs(ts, cols, states, closed)
    depth = HEAD + len(cols.terms) + len(cols.traits)
    scored, at_once = _scored(ts, cols, pairs, _best_kernel(specs, depth, ts.n_samples, ts.width), BEST_SCHEMA)
    if not at_once:
        rank = F.struct(-F.col("abs_t"), F.col("b") != SINGLE, F.col("a"), F.col("b"))
        scored = scored.groupBy("trait").agg(F.min_by(F.struct("a", "b", "t", "m"), rank).alias("w")).select("trait", "w.*")
    names = list(states)
    out = {}
    for row in scored.collect():  # one row per trait
        spec, m = specs[row.trait], np.frombuffer(bytes(row.m), dtype=np.float64)
        out[names[row.trait]] = Candidate((row.a, row.b), row.t, spec.df, m[0], m[2], m[3:][list(spec.at)], m[3 + spec.y_at])
    return out


def scan_table(
    ts: TileSet, states: Mapping[str, ModelState], closed: Mapping[str, frozenset[Term]] | None = None, pairs: bool = False
) -> DataFrame:
    """Every open candidate of every trait: ``(phenotype, a, b, df, estimate, std_error, t_value, collinear)``."""
    taken = {t: frozenset(s.terms) | (closed or {}).get(t, frozenset()) for t, s in states.items()}
    cols = _Columns.of(ts, states)
    specs = _specs(ts, cols, states, taken)
    depth = HEAD + len(cols.terms) + len(cols.traits)
    kernel = _all_kernel(specs, depth, ts.n_samples, ts.width, cols.y_scale)
    rows, _ = _scored(ts, cols, pairs, kernel, ALL_SCHEMA)
    names = F.array(*[F.lit(t) for t in states])
    return rows.select(names[F.col("trait")].alias("phenotype"), *[f for f in rows.columns if f != "trait"])


_CROSS_SCHEMA = "i int, j int, v double"
_CROSS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])


def _cross_kernel(source, blocks: Sequence[int]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = 0.0
        for _, tiles in read_row_blocks(batches, blocks):
            v = source.values(tiles)
            v = np.concatenate([np.ones((len(v), 1)), v], axis=1)
            acc = acc + v.T @ v
        if not np.isscalar(acc):
            k = len(acc)
            i, j = np.divmod(np.arange(k * k), k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(acc.ravel())], schema=_CROSS
            )

    return kernel


def _cross_products(ts: TileSet, cols: _Columns) -> np.ndarray:
    """Sums of products of [1, model columns, outcomes]: k x k numbers, added up in Spark."""
    return _added_up(ts.columns(cols.blocks).mapInArrow(_cross_kernel(cols, cols.blocks), _CROSS_SCHEMA), 1 + len(cols.terms) + len(cols.traits))


def _added_up(products: DataFrame, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for r in products.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return out


def _cross_of(ts: TileSet, vectors) -> np.ndarray:
    """Sums of products of 1 and vectors that are made from columns row by row."""
    blocks = vectors.cols.blocks
    return _added_up(ts.columns(blocks).mapInArrow(_cross_kernel(vectors, blocks), _CROSS_SCHEMA), 1 + vectors.weights.shape[1])


def _rss_kernel(cols: _Columns, beta: np.ndarray, shift: np.ndarray):
    k = len(cols.terms)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(len(cols.traits))
        for _, tiles in read_row_blocks(batches, cols.blocks):
            v = cols.values(tiles)
            acc += np.square(v[:, k:] - shift - v[:, :k] @ beta).sum(0)
        t = np.arange(len(acc))
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(t, pa.int32()), pa.array(acc)], schema=_CROSS)

    return kernel


def residual_squares(ts: TileSet, states: Mapping[str, ModelState], betas: Mapping[str, np.ndarray], shifts: Mapping[str, float]) -> dict[str, float]:
    """Sums of squared residuals in scaled units, by a pass of their own so that nothing cancels."""
    cols = _Columns.of(ts, states)
    beta = np.zeros((len(cols.terms), len(cols.traits)))
    for i, trait in enumerate(states):
        beta[list(cols.at[i]), i] = betas[trait]
    shift = np.array([shifts[t] for t in states])
    summed = ts.columns(cols.blocks).mapInArrow(_rss_kernel(cols, beta, shift), _CROSS_SCHEMA).groupBy("i").agg(F.sum("v").alias("v"))
    names = list(states)
    return {names[r.i]: r.v for r in summed.collect()}


def measure(ts: TileSet, terms: Mapping[str, Sequence[Term]], near: Mapping[str, ModelState] | None = None) -> dict[str, ModelState]:
    """Exactly centred model states of given terms; ``near`` supplies known centres and scales."""
    if near is None:
        raw = {t: ModelState(tuple(v), np.zeros(len(v)), np.ones(len(v))) for t, v in terms.items()}
        near = _recentred(ts, raw)
    return _recentred(ts, {t: near[t] for t in terms})


def _recentred(ts: TileSet, states: Mapping[str, ModelState]) -> dict[str, ModelState]:
    cols = _Columns.of(ts, states)
    cross, n = _cross_products(ts, cols), ts.n_samples
    if round(cross[0, 0]) != n:
        raise SampleMismatch(f"outcomes for {n} samples, but terms for {cross[0, 0]:.0f}")
    out = {}
    for i, (trait, s) in enumerate(states.items()):
        at = [1 + c for c in cols.at[i]]
        y = 1 + len(cols.terms) + i
        mean = cross[0, at] / n
        gram = cross[np.ix_(at, at)] - n * np.outer(mean, mean)
        xy = cross[at, y] - n * mean * cross[0, y] / n
        sd = np.sqrt(np.maximum(np.diag(gram) / n, 0.0))
        sd = np.where(sd > 0, sd, 1.0)
        out[trait] = ModelState(s.terms, s.centre + mean * s.scale, s.scale * sd, gram / np.outer(sd, sd), xy / sd)
    return out


def forward_scan_long(long: DataFrame, basis: DataFrame, n_basis: int, n: int) -> DataFrame:
    """The scan of single terms in plain DataFrame operators.

    ``long(sample, term_id, value)``; ``basis(sample, yr, q1..qk)`` has orthonormal columns that are
    orthogonal to a constant, and the outcome without its part in them. Values are centred by the
    moments themselves. The join keeps whichever side Spark measures as small in memory.
    """
    q = [f"q{i + 1}" for i in range(n_basis)]
    x, yr = F.col("value"), F.col("yr")
    sums = (
        long.join(basis, "sample")
        .groupBy("term_id")
        .agg(
            F.var_pop(x).alias("var"),
            F.avg(x).alias("mean"),
            F.sum(x * yr).alias("xy"),
            F.sum(yr).alias("y1"),
            F.sum(yr * yr).alias("yy"),
            *[F.sum(x * F.col(c)).alias(c) for c in q],
        )
    )
    xx = F.col("var") * n
    used = sum((F.col(c) * F.col(c) for c in q), F.lit(0.0))
    df = check_samples(n, n_basis + 2)
    scored = sums.select(
        "term_id",
        xx.alias("xx"),
        (xx - used).alias("rest"),
        (F.col("xy") - F.col("mean") * F.col("y1")).alias("xy"),
        F.col("yy"),
    ).filter((F.col("xx") > 0) & (F.col("rest") > COLLINEAR * F.col("xx")))
    beta = F.col("xy") / F.col("rest")
    se = F.sqrt((F.col("yy") - F.col("xy") * beta) / df / F.col("rest"))
    return scored.select("term_id", F.lit(df).cast("long").alias("df"), beta.alias("estimate"), se.alias("std_error")).withColumn(
        "t_value", F.col("estimate") / F.col("std_error")
    )


def best_term(scan: DataFrame, order: Sequence[str] = ("term_id",)) -> DataFrame:
    """The row with the smallest p-value: the largest |t|, as all share their degrees of freedom."""
    return scan.filter(F.col("t_value").isNotNull() & ~F.isnan("t_value")).orderBy(F.abs("t_value").desc(), *order).limit(1)


def with_p_values(scan: DataFrame) -> DataFrame:
    return scan.withColumn("p_value", t_pvalue(F.col("t_value"), F.col("df")))


def model_columns(long: DataFrame, terms: Sequence[Term], outcomes: DataFrame) -> DataFrame:
    """``(sample, y, m1..mk)``: the outcome next to the columns of a few terms, one shuffle by sample."""
    ids = sorted({i for t in terms for i in t if i != SINGLE})
    pick = lambda i: F.max(F.when(F.col("term_id") == i, F.col("value")))
    columns = [(pick(a) if b == SINGLE else pick(a) * pick(b)).alias(f"m{k + 1}") for k, (a, b) in enumerate(terms)]
    if not columns:
        return outcomes.select("sample", "y")
    chosen = long.filter(F.col("term_id").isin(ids)).groupBy("sample").agg(*columns)
    return outcomes.select("sample", "y").join(chosen, "sample")


def orthonormal_basis(columns: DataFrame, k: int) -> tuple[DataFrame, int]:
    """``(sample, yr, q1..qk)`` and the number of samples, from ``(sample, y, m1..mk)``.

    The centred k x k cross products come from Spark; their Cholesky factor turns the columns into
    orthonormal ones by a projection. Nearly dependent columns take a second round.
    """
    names = [f"m{i + 1}" for i in range(k)]
    cols = ["y", *names]
    cov = [
        F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)
    ]
    current, n = columns, 0
    for _ in range(2):
        row = current.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"a{i}") for i, c in enumerate(cols)], *cov).first()
        n = int(row.n)
        c = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) * n
        low = cholesky_or_fail(c[1:, 1:])
        inv = np.linalg.inv(low) if k else low
        part = inv @ c[1:, 0]
        centred = [F.col(x) - F.lit(float(row[f"a{i}"])) for i, x in enumerate(cols)]
        q = [sum((F.lit(float(inv[i, j])) * centred[j + 1] for j in range(i + 1)), F.lit(0.0)) for i in range(k)]
        yr = centred[0] - sum((F.lit(float(part[i])) * q[i] for i in range(k)), F.lit(0.0))
        current = current.select("sample", yr.alias("y"), *[q[i].alias(names[i]) for i in range(k)])
        scale = np.sqrt(np.diag(c)[1:])
        if k < 2 or np.linalg.cond(c[1:, 1:] / np.outer(scale, scale)) < WELL_CONDITIONED:
            break
    return current.select("sample", F.col("y").alias("yr"), *[F.col(m).alias(f"q{i + 1}") for i, m in enumerate(names)]), n
