"""Scans of a growing model by running moments, and pair scans that skip what cannot win.

A table keeps, for every term and outcome, what is left of the term's sum of squares and of its product
with the outcome once the model's columns are taken out. When the model gains a column, only the
direction is new that it adds to those before it: one unit vector, made from the model's columns row by
row. One pass adds up the terms' products with it, and the table moves on: rest - (x.q)^2, xy - (x.q)(q.y).
A column that leaves gives back its direction in the same way. So the work and the shuffle of an iteration
do not depend on how many columns the model has.

Pairs are skipped by tile pair (two blocks of terms). With S the samples where both columns of a product
are not zero, a product x and a residual r have |x.r| <= |x| |r on S|, and what a new direction q takes
from x is at most |x| |q on S| long. Both sums over S are at most those over the samples of either column,
which are one number per term. So

    t^2 <= df B / (1 - B),   B = k min(e_i, e_j) / |r|^2,   1/k' = 1/k - min(q_i, q_j)

where k is the largest |x|^2 / rest of the tile pair as last looked at, e and q are the largest energies
of residual and direction on the columns of a tile. A tile pair whose bound is below the |t| of a term that
is known to be open is left as it is; the directions it missed are made up for when it is looked at again.
Columns with few values other than zero, such as rare variants, are what this leaves out; among dense
columns nothing is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscan.functions.solve import COLLINEAR, cholesky_or_fail
from termscan.operators import scan
from termscan.operators.scan import ROUNDING, SINGLE, Candidate, ModelState, Term
from termscan.operators.tiles import DURABLE_BYTES, TASK_BYTES, TileSet, cores, matrix, read_row_blocks, record_batch
from termscan.session import DurableTable

#: Best terms of an outcome that are looked at again before tile pairs are skipped.
SEEDS = 16
#: Pairs of blocks from which bounds are worth two small passes more.
WORTH = 10
#: Tile pairs up to which the driver keeps their numbers; beyond, all are looked at.
KEPT_TILES = 2_000_000
#: Iterations after which the table is written down, so that plans and lineage stay the same size.
WRITTEN = 8
#: Bounds give way by this much for rounding.
SLACK = 1e-9

# Rows of the table: mean, sizes added up, squares; then per outcome the rest, then per outcome the product.
BASE = 3
STATE, LAYER, BEST, TILE = 0, 1, 2, 3
SCHEMA = "kind int, a int, j int, trait int, value double, m binary, shared binary"
_ROWS = pa.schema([
    ("kind", pa.int32()), ("a", pa.int32()), ("j", pa.int32()), ("trait", pa.int32()), ("value", pa.float64()), ("m", pa.binary()), ("shared", pa.binary()),
])


@dataclass(frozen=True)
class Direction:
    """A unit vector that a model of one outcome gained (sign -1) or lost (+1), as weights of scaled columns."""

    trait: int
    terms: tuple[Term, ...]
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    with_y: float
    sign: int


def directions(trait: int, old: Sequence[Term], new: Sequence[Term], union: ModelState) -> list[Direction]:
    """From one model to another: terms that leave, one by one, then those that enter. ``union`` has the columns of both."""
    out, now = [], list(old)

    def step(rest: list[Term], term: Term, sign: int) -> None:
        at = [union.terms.index(t) for t in (*rest, term)]
        low = cholesky_or_fail(union.gram[np.ix_(at, at)])
        unit = np.zeros(len(at))
        unit[-1] = 1.0
        weights = np.linalg.solve(low.T, unit)
        out.append(Direction(trait, (*rest, term), union.centre[at], union.scale[at], weights, float(weights @ union.xy[at]), sign))

    for term in [t for t in old if t not in new]:
        now.remove(term)
        step(now, term, 1)
    for term in [t for t in new if t not in old]:
        step(now, term, -1)
        now.append(term)
    return out


@dataclass(frozen=True)
class _Vectors:
    """Directions and residuals of all outcomes by row, from the columns of a row block."""

    cols: scan._Columns
    weights: np.ndarray

    @staticmethod
    def of(ts: TileSet, steps: Sequence[Direction], residuals: Mapping[str, ModelState]) -> _Vectors:
        names = [ts.traits[s.trait] for s in steps]
        states = {f"{k}": ModelState(s.terms, s.centre, s.scale, np.zeros((0, 0)), np.zeros(0)) for k, s in enumerate(steps)}
        states |= {f"r{k}": s for k, s in enumerate(residuals.values())}
        keys: dict[tuple, int] = {}
        at = [[keys.setdefault((t, c, v), len(keys)) for t, c, v in zip(s.terms, s.centre, s.scale)] for s in states.values()]
        traits = tuple(ts.traits.index(t) for t in (*names, *residuals))
        cols = scan._Columns(
            tuple(k[0] for k in keys), np.array([k[1] for k in keys], dtype=float), np.array([k[2] for k in keys], dtype=float),
            (), traits, ts.y_mean[list(traits)], ts.y_scale[list(traits)], ts.width)
        weights = np.zeros((len(keys) + len(traits), len(traits)))
        for k, s in enumerate(steps):
            weights[at[k], k] = s.weights
        for k, s in enumerate(residuals.values(), len(steps)):
            weights[len(keys) + k, k] = 1.0
            if s.terms:
                weights[at[k], k] = -np.linalg.solve(s.gram, s.xy)
        return _Vectors(cols, weights)

    def values(self, tiles: Mapping[int, np.ndarray]) -> np.ndarray:
        return self.cols.values(tiles) @ self.weights


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return record_batch(rows, _ROWS)


def _layer_rows(i: int, j: int, ref: np.ndarray, sums: np.ndarray, shared: np.ndarray, width: int) -> list[tuple]:
    """One record per left term: reference values, then products with each direction about them."""
    moments = np.concatenate([ref[None], sums])
    first, last = i * width, moments.shape[1] - 1 if i == j else moments.shape[1]
    return [(LAYER, first + a, j, -1, 0.0, np.ascontiguousarray(moments[:, a, :]).tobytes(), shared.tobytes()) for a in range(last)]


class _Products:
    """Sums over row blocks of a tile pair's products with directions."""

    def __init__(self) -> None:
        self.refs: tuple[np.ndarray, np.ndarray] | None = None
        self.left = self.right = self.both = self.shared = 0.0

    def add(self, left: np.ndarray, right: np.ndarray, v: np.ndarray) -> None:
        if self.refs is None:
            self.refs = scan._reference(left), scan._reference(right)
        a, b = left - self.refs[0], right - self.refs[1]
        self.left, self.right, self.shared = self.left + v.T @ a, self.right + v.T @ b, self.shared + v.sum(0)
        stacked = np.concatenate([a * v[:, [c]] for c in range(v.shape[1])], axis=1)
        self.both = self.both + (stacked.T @ b).reshape(v.shape[1], a.shape[1], b.shape[1])

    def rows(self, i: int, j: int, width: int) -> list[tuple]:
        r, s = self.refs[0][:, None], self.refs[1][None, :]
        sums = r * self.right[:, None, :] + s * self.left[:, :, None] + self.both
        return _layer_rows(i, j, r * s, sums, self.shared, width)


def _layer_kernel(vectors: _Vectors, n_blocks: int, since: Mapping[tuple[int, int], int]):
    """Products of single terms with the newest directions, and of the tile pairs in ``since`` with theirs from a number on."""
    width = vectors.cols.width

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs: dict[int, np.ndarray] = {}
        single: dict[int, np.ndarray] = {}
        pair: dict[tuple[int, int], _Products] = {}
        shared = 0.0
        newest = since[SINGLE, SINGLE]
        for _, tiles in read_row_blocks(batches, range(n_blocks)):
            v = vectors.values(tiles)
            shared = shared + v[:, newest:].sum(0)
            for i in range(n_blocks):
                if i not in refs:
                    refs[i] = scan._reference(tiles[i])
                single[i] = single.get(i, 0.0) + v[:, newest:].T @ (tiles[i] - refs[i])
            for (i, j), first in since.items():
                if i != SINGLE:
                    pair.setdefault((i, j), _Products()).add(tiles[i], tiles[j], v[:, first:])
        for i, sums in single.items():
            yield _batch([(LAYER, SINGLE, i, -1, 0.0, np.concatenate([refs[i][None], sums]).tobytes(), np.asarray(shared).tobytes())])
        for (i, j), own in pair.items():
            yield _batch(own.rows(i, j, width))

    return kernel


def _frame_kernel(vectors: _Vectors):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row_block, tiles in read_row_blocks(batches, vectors.cols.blocks):
            v = vectors.values(tiles)
            yield record_batch([(row_block, len(v), np.ascontiguousarray(v).tobytes())], scan._FRAME)

    return kernel


def _meet_kernel(width: int, since: Mapping[tuple[int, int], int]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, met, v, left = None, None, None, None
        for batch in batches:
            ii, jj = batch.column("i").to_pylist(), batch.column("j").to_pylist()
            seg, role = batch.column("segment").to_pylist(), batch.column("role").to_pylist()
            rows, data = batch.column("n_rows").to_pylist(), batch.column("x")
            for r in range(batch.num_rows):
                if (ii[r], jj[r], seg[r]) != key:
                    if met is not None:
                        yield _batch(met.rows(*key[:2], width))
                    key, met = (ii[r], jj[r], seg[r]), _Products()
                x = matrix(data[r].as_buffer(), rows[r])
                if role[r] == 0:
                    v = x[:, since[key[0], key[1]] :]
                    continue
                if role[r] == 1:
                    left = x
                    if key[0] != key[1]:
                        continue
                met.add(left, x, v)
        if met is not None:
            yield _batch(met.rows(*key[:2], width))

    return kernel


def _moved_on(m: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], steps: Sequence[Direction], n_traits: int) -> np.ndarray:
    """The table's rows of one key after the directions whose products lie in ``layers``."""
    total = 0.0
    for part, shared in layers:
        total = total + part[1:] + np.outer(shared, part[0] - m[0])
    m = m.copy()
    for c, s in zip(total, steps):
        m[BASE + s.trait] += s.sign * np.square(c)
        m[BASE + n_traits + s.trait] += s.sign * c * s.with_y
    return m


def _scores(m: np.ndarray, trait: int, n_traits: int, rest_y: float, df: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """t of each term, NaN where it depends on the model, and where it does not."""
    size, xx, rest, xy = m[1], m[2], m[BASE + trait], m[BASE + n_traits + trait]
    ok = (xx > ROUNDING * size) & (rest > COLLINEAR * xx)
    with np.errstate(divide="ignore", invalid="ignore"):
        beta = xy / rest
        t = beta / np.sqrt(np.maximum(rest_y - xy * beta, 1e-15 * n) / df / rest)
    ok &= np.isfinite(t)
    return np.where(ok, t, np.nan), ok


def _merge_kernel(steps, since, specs, n_traits: int, n: int, width: int, bounds: bool):
    """Moves the table on from a stream sorted by key and kind; hands it on with each task's best terms and largest ratios."""
    depth = BASE + 2 * n_traits
    newest = {(SINGLE, SINGLE): 0} if since is None else since

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {s.trait: [] for s in specs}
        ratio: dict[tuple[int, int, int], float] = {}

        def finish(a: int, j: int, m: np.ndarray, layers: list) -> tuple:
            tile = (SINGLE, SINGLE) if a == SINGLE else (a // width, j)
            looked = since is None or tile in newest
            if layers:
                m = _moved_on(m, layers, steps[newest[tile] :], n_traits)
            for spec in specs if looked else ():
                t, ok = _scores(m, spec.trait, n_traits, spec.rest_y, spec.df, n)
                if a != SINGLE:
                    ok &= j * width + np.arange(m.shape[1]) > a
                if bounds and a != SINGLE:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        k = np.where(ok, (m[2] + n * np.square(m[0])) / m[BASE + spec.trait], 0.0)
                    ratio[*tile, spec.trait] = max(ratio.get((*tile, spec.trait), 0.0), float(k.max()))
                t[scan._closed_mask(a, j * width, m.shape[1], spec.closed)] = np.nan
                order = np.argsort(-np.abs(t), kind="stable")[:SEEDS]
                for at in order[~np.isnan(t[order])].tolist():
                    term = (j * width + at, SINGLE) if a == SINGLE else (a, j * width + at)
                    best[spec.trait].append(((-abs(t[at]), term[1] != SINGLE, term), float(t[at]), m[:, at].copy()))
                best[spec.trait] = sorted(best[spec.trait], key=lambda x: x[0])[:SEEDS]
            return (STATE, a, j, -1, 0.0, np.ascontiguousarray(m).tobytes(), None)

        key, m, layers = None, None, []
        for batch in batches:
            kinds, aa, jj = (batch.column(c).to_pylist() for c in ("kind", "a", "j"))
            data, shared, out = batch.column("m"), batch.column("shared"), []
            for r in range(batch.num_rows):
                part = np.frombuffer(data[r].as_buffer(), dtype=np.float64)
                if kinds[r] == STATE:
                    if key is not None:
                        out.append(finish(*key, m, layers))
                    key, m, layers = (aa[r], jj[r]), part.reshape(depth, -1), []
                else:
                    layers.append((part.reshape(-1, m.shape[1]), np.frombuffer(shared[r].as_buffer(), dtype=np.float64)))
            if out:
                yield _batch(out)
        if key is not None:
            yield _batch([finish(*key, m, layers)])
        rows = [(BEST, *term, trait, t, m.tobytes(), None) for trait, own in best.items() for (_, _, term), t, m in own]
        rows += [(TILE, i, j, trait, k, None, None) for (i, j, trait), k in ratio.items()]
        if rows:
            yield _batch(rows)

    return kernel


def _first_kernel(n_traits: int, depth: int):
    """The table of the empty model, from the moments of all terms."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, j, m in scan._summed(batches, depth):
            rows = np.concatenate([m[:BASE], np.repeat(m[2:3], n_traits, axis=0), m[BASE:]])
            yield _batch([(STATE, a, j, -1, 0.0, rows.tobytes(), None)])

    return kernel


_ENERGY = pa.schema([("block", pa.int32()), ("e", pa.binary())])


def _energy_kernel(vectors: _Vectors, n_blocks: int):
    """Per term the sums of squares of residuals and directions over the samples where its column is not zero."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for _, tiles in read_row_blocks(batches, range(n_blocks)):
            v = np.square(vectors.values(tiles))
            for i in range(n_blocks):
                acc[i] = acc.get(i, 0.0) + v.T @ (tiles[i] != 0).astype(np.float64)
        for i, e in acc.items():
            yield record_batch([(i, np.ascontiguousarray(e).tobytes())], _ENERGY)

    return kernel


def _largest_kernel(n_vectors: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, acc = None, None
        for batch in batches:
            blocks, data = batch.column("block").to_pylist(), batch.column("e")
            for r in range(batch.num_rows):
                e = np.frombuffer(data[r].as_buffer(), dtype=np.float64).reshape(n_vectors, -1)
                if blocks[r] == now:
                    acc = acc + e
                    continue
                if now is not None:
                    yield record_batch([(now, acc.max(1).tobytes())], _ENERGY)
                now, acc = blocks[r], e
        if now is not None:
            yield record_batch([(now, acc.max(1).tobytes())], _ENERGY)

    return kernel


@dataclass(frozen=True)
class Look:
    """How many tile pairs one scan looked at, of how many."""

    looked: int
    tile_pairs: int


class RunningScan:
    """The table of a search and the models it stands for.

    ``prune`` skips tile pairs by their bounds; left open, that is done where there are ``WORTH`` of them or
    more. ``log`` tells for every scan how many were looked at.
    """

    def __init__(self, ts: TileSet, traits: Sequence[str], pairs: bool, prune: bool | None = None):
        self.ts, self.pairs = ts, pairs
        self.at = {t: ts.traits.index(t) for t in traits}
        self.traits = tuple(traits)
        self.models: dict[str, tuple[Term, ...]] = {t: () for t in traits}
        self.steps: list[Direction] = []
        tiles = ts.n_blocks * (ts.n_blocks + 1) // 2 if pairs else 0
        self.prune = pairs and tiles <= KEPT_TILES and (tiles >= WORTH if prune is None else prune)
        self.seen = {(i, j): 0 for i in range(ts.n_blocks) for j in range(i, ts.n_blocks)} if pairs and tiles <= KEPT_TILES else {}
        self.ratio: dict[tuple[int, int, int], float] = {}
        self.seeds: dict[int, list[tuple[Term, np.ndarray]]] = {}
        self.log: list[Look] = []
        self.table: DataFrame | None = None
        self.kept: DurableTable | None = None
        self.found: list = []
        self.turn = 0

    def _keep(self, rows: DataFrame) -> None:
        """The table as it is from now on: a large one, and any now and then, is written to the shared folder."""
        depth = BASE + 2 * len(self.ts.traits)
        n = self.ts.n_blocks * self.ts.width
        old, old_kept = self.table, self.kept
        self.turn += 1
        if depth * 8.0 * (n * n / 2 if self.pairs else n) > DURABLE_BYTES or self.turn % WRITTEN == 0:
            self.kept = DurableTable(rows, "running")
            self.table = self.kept.df
        else:
            self.kept, self.table = None, rows.persist(StorageLevel.MEMORY_AND_DISK)
        self.found = self.table.where(F.col("kind") != STATE).select("kind", "a", "j", "trait", "value", "m").collect()  # SEEDS an outcome and task, a number a tile pair
        if old_kept is not None:
            old_kept.drop()
        elif old is not None:
            old.unpersist()

    def close(self) -> None:
        if self.kept is not None:
            self.kept.drop()
        elif self.table is not None:
            self.table.unpersist()

    def _tasks(self, sets: int, depth: int) -> int:
        n = self.ts.n_blocks * self.ts.width
        size = 8.0 * (n * n / 2 if self.pairs else n) * (BASE + 2 * len(self.ts.traits) + sets * depth)
        keys = self.ts.n_blocks * (self.ts.n_terms if self.pairs else 1)
        return int(min(keys, max(1, size / TASK_BYTES, cores(self.ts.blocks) if size > TASK_BYTES / 8 else 1)))

    def _first(self) -> DataFrame:
        ts = self.ts
        cols = scan._Columns.of(ts, {t: ModelState() for t in ts.traits})
        depth = scan.HEAD + len(ts.traits)
        rows, _ = scan._scored(ts, cols, self.pairs, _first_kernel(len(ts.traits), depth), SCHEMA)
        return rows

    def _layers(self, since: dict[tuple[int, int], int]) -> DataFrame:
        ts, vectors = self.ts, _Vectors.of(self.ts, self.steps, {})
        n_wide, wide = ts.n_blocks * ts.width, len(self.steps) - min(since.values())
        if not self.pairs or 8.0 * (1 + wide) * n_wide * n_wide / 2 <= scan.LOCAL_PAIR_BYTES:
            return ts.blocks.mapInArrow(_layer_kernel(vectors, ts.n_blocks, since), SCHEMA)
        single = {(SINGLE, SINGLE): since[SINGLE, SINGLE]}
        singles = ts.blocks.mapInArrow(_layer_kernel(vectors, ts.n_blocks, single), SCHEMA)
        wanted = [k for k in since if k[0] != SINGLE]
        if not wanted:
            return singles
        met = scan._meeting_rows(ts, ts.columns(vectors.cols.blocks).mapInArrow(_frame_kernel(vectors), scan._FRAME_SCHEMA), wanted)
        return singles.unionByName(met.mapInArrow(_meet_kernel(ts.width, since), SCHEMA))

    def _energies(self, steps: Sequence[Direction], states: Mapping[str, ModelState]) -> np.ndarray:
        """By block: the largest energies of each direction, then of each residual."""
        ts, vectors = self.ts, _Vectors.of(self.ts, steps, states)
        n = len(steps) + len(states)
        parts = ts.blocks.mapInArrow(_energy_kernel(vectors, ts.n_blocks), "block int, e binary")
        summed = parts.repartition(min(ts.n_blocks, cores(parts)), "block").sortWithinPartitions("block").mapInArrow(_largest_kernel(n), "block int, e binary")
        out = np.zeros((ts.n_blocks, n))
        for row in summed.collect():  # a few numbers per block
            out[row.block] = np.frombuffer(bytes(row.e), dtype=np.float64)
        return out

    def _least(self, steps: Sequence[Direction], specs: Mapping[str, scan._TraitSpec]) -> dict[str, float]:
        """For each outcome the |t| of the best of its seeds that is open."""
        ts, n_traits = self.ts, len(self.ts.traits)
        chosen = {t: [(term, m) for term, m in self.seeds.get(self.at[t], []) if term not in specs[t].closed] for t in specs}
        terms = sorted({term for own in chosen.values() for term, _ in own})
        if not terms:
            return {}
        probe = [Direction(0, (t,), np.zeros(1), np.ones(1), np.ones(1), 0.0, -1) for t in terms]
        vectors = _Vectors.of(ts, [*steps, *probe], {})
        cross = scan._cross_of(ts, vectors)
        out: dict[str, float] = {}
        for trait, own in chosen.items():
            for term, m in own:
                at = 1 + len(steps) + terms.index(term)
                layer = cross[1 : 1 + len(steps), at] - cross[0, 1 : 1 + len(steps)] * m[0]
                moved = _moved_on(m[:, None], [(np.concatenate([m[:1], layer])[:, None], np.zeros(len(steps)))], steps, n_traits)
                spec = specs[trait]
                t, ok = _scores(moved, self.at[trait], n_traits, spec.rest_y, spec.df, ts.n_samples)
                if ok[0]:
                    out[trait] = max(out.get(trait, 0.0), abs(float(t[0])))
        return out

    def _open(self, fresh: Sequence[Direction], states: Mapping[str, ModelState], specs: Mapping[str, scan._TraitSpec]) -> list[tuple[int, int]]:
        """The tile pairs that may hold a better term than the best one known."""
        least = self._least(fresh, specs)
        energy = self._energies(fresh, {t: states[t] for t in specs})
        for k, s in enumerate(fresh):
            for (i, j, trait), ratio in list(self.ratio.items()):
                if trait != s.trait:
                    continue
                if s.sign > 0:  # terms that depended on the model may not do so any more
                    self.ratio[i, j, trait] = np.inf
                else:
                    left = 1 / ratio - min(energy[i, k], energy[j, k]) if ratio > 0 else np.inf
                    self.ratio[i, j, trait] = 1 / left if left > 0 else np.inf
        out = []
        for i, j in self.seen:
            for x, (trait, spec) in enumerate(specs.items(), len(fresh)):
                b = self.ratio.get((i, j, spec.trait), np.inf)
                b = b * min(energy[i, x], energy[j, x]) / spec.rest_y if b > 0 else 0.0
                if b >= 1 - SLACK or np.sqrt(spec.df * b / (1 - b)) >= least.get(trait, 0.0) * (1 - SLACK):
                    out.append((i, j))
                    break
        return out

    def best(self, states: Mapping[str, ModelState], closed: Mapping[str, frozenset[Term]], unions: Mapping[str, ModelState]) -> dict[str, Candidate]:
        """The open candidate with the largest |t| for each outcome of ``states``.

        ``unions`` holds for each outcome a state with the columns both of its last model and of this one.
        """
        ts = self.ts
        fresh: list[Direction] = []
        for t, state in states.items():
            fresh += directions(self.at[t], self.models[t], state.terms, unions[t])
            self.models[t] = state.terms
        cols = scan._Columns.of(ts, states)
        specs = {}
        for t, spec in zip(states, scan._specs(ts, cols, states, closed)):
            specs[t] = scan._TraitSpec(self.at[t], (), 0, spec.low, spec.low_xy, spec.rest_y, spec.df, spec.closed)
        first = self.table is None
        if first:
            self._keep(self._first())
        everything = list(self.seen) if self.seen or not self.pairs else None
        if self.prune and not first:
            wanted = self._open(fresh, states, specs)
        else:
            wanted = everything
        self.steps += fresh
        since = None
        if not first or fresh:
            since = {(SINGLE, SINGLE): len(self.steps) - len(fresh)}
            pairs = wanted if wanted is not None else [(i, j) for i in range(ts.n_blocks) for j in range(i, ts.n_blocks)]
            since |= {k: self.seen.get(k, len(self.steps) - len(fresh)) for k in pairs}
            # directions that no tile pair waits for are not needed any more
            gone = min(min(since.values()), min((v for v in self.seen.values()), default=len(self.steps)))
            self.steps = self.steps[gone:]
            since = {k: v - gone for k, v in since.items()}
            self.seen = {k: len(self.steps) if k in since else v - gone for k, v in self.seen.items()}
        rows = self.table.where(F.col("kind") == STATE)
        if since is not None and min(since.values()) < len(self.steps):
            rows = rows.unionByName(self._layers({k: v for k, v in since.items() if v < len(self.steps) or k[0] == SINGLE}))
        kernel = _merge_kernel(tuple(self.steps), since, list(specs.values()), len(ts.traits), ts.n_samples, ts.width, self.prune)
        depth = 1 + (len(self.steps) - min(since.values()) if since else 0)
        merged = rows.repartition(self._tasks(ts.n_parts, depth), "a", "j").sortWithinPartitions("a", "j", "kind").mapInArrow(kernel, SCHEMA)
        self._keep(merged)
        self.log.append(Look(len(wanted) if wanted is not None else len(since or ()) - 1, ts.n_blocks * (ts.n_blocks + 1) // 2 if self.pairs else 0))
        return self._winners(states, specs)

    def _winners(self, states: Mapping[str, ModelState], specs: Mapping[str, scan._TraitSpec]) -> dict[str, Candidate]:
        ranked: dict[int, list[tuple]] = {}
        for row in self.found:
            if row.kind == TILE:
                self.ratio[row.a, row.j, row.trait] = 0.0
            else:
                term = (row.a, row.j)
                ranked.setdefault(row.trait, []).append(((-abs(row.value), term[1] != SINGLE, term), row.value, np.frombuffer(bytes(row.m), dtype=np.float64)))
        for row in self.found:  # a tile pair's terms may lie in several tasks
            if row.kind == TILE:
                self.ratio[row.a, row.j, row.trait] = max(self.ratio[row.a, row.j, row.trait], row.value)
        self.seeds, winners = {}, {}
        for t in states:
            own = sorted(ranked.get(self.at[t], []), key=lambda x: x[0])[:SEEDS]
            self.seeds[self.at[t]] = [(x[0][2], x[2]) for x in own]
            if own:
                winners[t] = own[0]
        if not winners:
            return {}
        near = {}
        for t, ((_, _, term), _, m) in winners.items():
            s, sd = states[t], float(np.sqrt(m[2] / self.ts.n_samples))
            near[t] = ModelState((*s.terms, term), np.append(s.centre, m[0]), np.append(s.scale, sd), np.zeros((0, 0)), np.zeros(0))
        exact = scan._recentred(self.ts, near)
        out = {}
        for t, ((_, _, term), value, m) in winners.items():
            e = exact[t]
            out[t] = Candidate(term, value, specs[t].df, float(e.centre[-1]), float(m[2]), e.gram[-1, :-1], float(e.xy[-1]), e)
        return out
