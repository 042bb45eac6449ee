"""Lasso paths by active sets: few columns are solved for, all others are checked by passes over the tiles.

Penalties go from large to small. The sequential strong rule names the columns that may enter at the next
one: those whose gradient at the last solution is above twice the new penalty less the last (or above
``STRONG`` of the new one, where the step is wide). Only their cross products come to the driver, and only they are solved for, by coordinate descent. A pass over
the tiles then gives the gradients of all columns; any column that breaks the optimality conditions joins
and the penalty is solved again, until none does. So the result holds for all columns, however many there
are: no vector as long as the terms leaves the executors, and no Gram matrix of all columns is made.

Each penalty comes with its duality gap: the residual, shrunken until no gradient exceeds the penalty, is a
dual point, and the difference of the two objectives bounds how far the solution is from the best one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.errors import TooManyColumns
from termscan.operators import scan
from termscan.operators.lasso import coordinate_descent
from termscan.operators.scan import SINGLE
from termscan.operators.tiles import TASK_BYTES, TileSet, cores, from_vectors, read_row_blocks, record_batch

#: Columns that may be solved for at a time: their cross products are on the driver.
ACTIVE_COLUMNS = 8192
#: Share of a penalty below which no column is solved for ahead of time.
STRONG = 0.8
#: A gradient may exceed the penalty by this share of the largest penalty before its column joins.
TOLERANCE = 1e-9

_TILE = pa.schema([("j", pa.int32()), ("kind", pa.int32()), ("m", pa.binary()), ("shared", pa.binary())])
TILE_SCHEMA = "j int, kind int, m binary, shared binary"
_PICK = pa.schema([("term_id", pa.int64()), ("g", pa.float64()), ("mean", pa.float64()), ("scale", pa.float64())])
PICK_SCHEMA = "term_id long, g double, mean double, scale double"

FIT_SCHEMA = "reg double, active long, strong long, passes long, gap double, objective double, converged boolean"


@dataclass(frozen=True)
class PathStep:
    """The solution at one penalty: coefficients of the columns that are not zero, on the scale of the data."""

    reg: float
    terms: tuple[int, ...]
    estimates: np.ndarray
    intercept: float | None
    strong: int
    passes: int
    gap: float
    objective: float
    converged: bool


@dataclass
class _Chosen:
    """Columns that are solved for, with their cross products per row."""

    terms: list[int] = field(default_factory=list)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    gram: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    xy: np.ndarray = field(default_factory=lambda: np.zeros(0))
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))


class _Problem:
    def __init__(self, ts: TileSet, trait: str, intercept: bool, standardize: bool):
        self.ts, self.intercept, self.standardize = ts, intercept, standardize
        self.at = ts.traits.index(trait)
        self.y_mean = float(ts.y_mean[self.at]) if intercept else 0.0
        self.chosen = _Chosen()

    def columns(self, terms: Sequence[int], mean: np.ndarray, scale: np.ndarray, unit: float = 1.0) -> scan._Columns:
        w = self.ts.width
        return scan._Columns(tuple((t, SINGLE) for t in terms), mean, scale, (), (self.at,), np.array([self.y_mean]), np.array([unit]), w)

    def tiles_of(self, terms: Sequence[int]) -> list[int]:
        return sorted({t // self.ts.width for t in terms})


def _gradient_kernel(cols: scan._Columns, beta: np.ndarray, n_blocks: int, first: bool):
    """Per tile: reference values, products with the residual about them and, at ``first``, squares and sums.

    Key -1 holds the residual's squares, its product with the outcome and the outcome's squares.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs: dict[int, np.ndarray] = {}
        acc: dict[int, np.ndarray] = {}
        shared, sums = np.zeros(2), np.zeros(3)
        for _, tiles in read_row_blocks(batches, range(n_blocks)):
            v = cols.values(tiles)
            y = v[:, -1]
            r = y - v[:, :-1] @ beta
            shared += (len(r), r.sum())
            sums += (r @ r, r @ y, y @ y)
            for i in range(n_blocks):
                if i not in refs:
                    refs[i] = scan._reference(tiles[i])
                x = tiles[i] - refs[i]
                part = np.stack([r @ x, np.square(x).sum(0), x.sum(0)]) if first else (r @ x)[None]
                acc[i] = acc[i] + part if i in acc else part
        for i, part in acc.items():
            yield record_batch([(i, 1, np.concatenate([refs[i][None], part]).tobytes(), shared.tobytes())], _TILE)
        yield record_batch([(-1, 1, sums.tobytes(), shared.tobytes())], _TILE)

    return kernel


def _finish_kernel(n: int, intercept: bool, standardize: bool, first: bool):
    """Adds up a tile's parts; with what is known of its columns (kind 0) gives means, scales and gradients."""

    def finish(j: int, known: np.ndarray | None, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple:
        if j < 0:
            return (j, 0, sum(p for p, _ in parts).tobytes(), None)
        if first:
            ref = parts[0][0][0]
            rows, total, squares, sums = 0.0, 0.0, 0.0, 0.0
            for p, shared in parts:
                d = p[0] - ref
                rows, squares = rows + shared[0], squares + p[2] + 2 * d * p[3] + shared[0] * np.square(d)
                sums = sums + p[3] + shared[0] * d
            mean = ref + sums / rows
            sd = np.sqrt(np.maximum(squares - np.square(sums) / rows, 0.0) / n)
            scale = np.where(sd > 0, sd, 1.0) if standardize else np.ones_like(sd)
        else:
            mean, scale = known[0], known[1]
        about = mean if intercept else np.zeros_like(mean)
        total = sum(p[1] + shared[1] * (p[0] - about) for p, shared in parts)
        return (j, 0, np.stack([mean, scale, total / scale / n]).tobytes(), None)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, parts = None, None, []
        for batch in batches:
            jj, kinds, data, shared = batch.column("j").to_pylist(), batch.column("kind").to_pylist(), batch.column("m"), batch.column("shared")
            for r, j in enumerate(jj):
                if j != now:
                    if now is not None:
                        yield record_batch([finish(now, known, parts)], _TILE)
                    now, known, parts = j, None, []
                m = np.frombuffer(data[r].as_buffer(), dtype=np.float64)
                if kinds[r] == 0:
                    known = m.reshape(3, -1)
                elif j < 0:
                    parts.append((m, np.zeros(2)))
                else:
                    parts.append((m.reshape(4 if first else 2, -1), np.frombuffer(shared[r].as_buffer(), dtype=np.float64)))
        if now is not None:
            yield record_batch([finish(now, known, parts)], _TILE)

    return kernel


def _gradients(p: _Problem, unit: float, before: DataFrame | None) -> DataFrame:
    """By tile: means, scales and gradients at the present solution, kept; the row of key -1 has the sums."""
    ts, c, first = p.ts, p.chosen, before is None
    cols = p.columns(c.terms, c.mean, c.scale, unit)
    parts = ts.blocks.mapInArrow(_gradient_kernel(cols, c.beta, ts.n_blocks, first), TILE_SCHEMA)
    if before is not None:
        parts = parts.unionByName(before.where("j >= 0"))
    tasks = max(1, min(ts.n_blocks + 1, cores(parts), int(8.0 * ts.n_terms * ts.n_parts * 4 / TASK_BYTES) + 1))
    done = parts.repartition(tasks, "j").sortWithinPartitions("j", "kind").mapInArrow(_finish_kernel(ts.n_samples, p.intercept, p.standardize, first), TILE_SCHEMA)
    return done.persist(StorageLevel.MEMORY_AND_DISK)


def _pick_kernel(width: int, least: float):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j, data in zip(batch.column("j").to_pylist(), batch.column("m")):
                mean, scale, g = np.frombuffer(data.as_buffer(), dtype=np.float64).reshape(3, -1)
                size = np.abs(g)
                at = np.flatnonzero(size >= least)
                if not len(at):
                    at = np.array([int(size.argmax())])  # the tile's largest, from which the largest of all is known
                yield pa.RecordBatch.from_arrays([pa.array(j * width + at), pa.array(g[at]), pa.array(mean[at]), pa.array(scale[at])], schema=_PICK)

    return kernel


def _picked(p: _Problem, table: DataFrame, least: float) -> list:
    """Columns whose gradients are ``least`` or more, after the column with the largest of all."""
    rows = table.where("j >= 0").select("j", "m").mapInArrow(_pick_kernel(p.ts.width, least), PICK_SCHEMA)
    top = F.max_by(F.struct("term_id", "g", "mean", "scale"), F.abs("g")).alias("t")
    found = rows.agg(top, F.count_if(F.abs("g") >= least).alias("n")).first()
    if found.n + len(p.chosen.terms) > ACTIVE_COLUMNS:
        raise TooManyColumns(f"{found.n} columns may be in the model, more than {ACTIVE_COLUMNS}; use lasso_admm for penalties this small")
    return [found.t, *(rows.where(F.abs("g") >= least).collect() if found.n else [])]


def _cross_kernel(cols: scan._Columns, fresh: int, blocks: Sequence[int]):
    """Products of the last ``fresh`` columns with all of them and the outcome, one record per column."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = 0.0
        for _, tiles in read_row_blocks(batches, blocks):
            v = cols.values(tiles)
            acc = acc + v[:, -1 - fresh : -1].T @ v
        if not np.isscalar(acc):
            yield record_batch([(k, 1, acc[k].tobytes(), None) for k in range(fresh)], _TILE)

    return kernel


def _join(p: _Problem, rows: list, unit: float) -> None:
    """Takes columns in, with their cross products: a pass over the tiles they lie in."""
    c = p.chosen
    rows = sorted({r.term_id: r for r in rows if r.term_id not in set(c.terms)}.values(), key=lambda r: r.term_id)
    if not rows:
        return
    old, fresh = len(c.terms), len(rows)
    c.terms += [r.term_id for r in rows]
    c.mean = np.append(c.mean, [r.mean if p.intercept else 0.0 for r in rows])
    c.scale = np.append(c.scale, [r.scale for r in rows])
    cols, blocks = p.columns(c.terms, c.mean, c.scale, unit), p.tiles_of(c.terms)
    parts = p.ts.columns(blocks).mapInArrow(_cross_kernel(cols, fresh, blocks), TILE_SCHEMA)
    cross = np.zeros((fresh, old + fresh + 1))
    for r in _summed(parts).collect():  # a record per new column
        cross[r.j] = np.frombuffer(bytes(r.m), dtype=np.float64)
    cross /= p.ts.n_samples
    gram = np.zeros((old + fresh, old + fresh))
    gram[:old, :old] = c.gram
    gram[old:, :] = cross[:, :-1]
    gram[:old, old:] = cross[:, :old].T
    c.gram, c.xy, c.beta = gram, np.append(c.xy, cross[:, -1]), np.append(c.beta, np.zeros(fresh))


def _add_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, acc = None, None
    for batch in batches:
        for j, data in zip(batch.column("j").to_pylist(), batch.column("m")):
            part = np.frombuffer(data.as_buffer(), dtype=np.float64)
            if j == now:
                acc = acc + part
                continue
            if now is not None:
                yield record_batch([(now, 0, acc.tobytes(), None)], _TILE)
            now, acc = j, part
    if now is not None:
        yield record_batch([(now, 0, acc.tobytes(), None)], _TILE)


def _summed(parts: DataFrame) -> DataFrame:
    return parts.repartition("j").sortWithinPartitions("j").mapInArrow(_add_kernel, TILE_SCHEMA)


def fit_path(
    ts: TileSet, trait: str, regs: Sequence[float], intercept: bool = True, standardize: bool = True, tol: float = 1e-12, gap_tol: float = 1e-6,
    max_rounds: int = 50,
) -> list[PathStep]:
    """(1 / 2n) RSS + reg |b| for each of ``regs``, largest first.

    ``standardize`` weighs each coefficient by the population deviation of its column. A step has
    ``converged`` if its duality gap is at most ``gap_tol`` of the objective of no columns at all, and every
    column keeps the optimality conditions; it is returned either way.
    """
    n = ts.n_samples
    p = _Problem(ts, trait, intercept, standardize)
    table = _gradients(p, 1.0, None)
    sums = lambda t: np.frombuffer(bytes(t.where("j = -1").first().m), dtype=np.float64)
    # the outcome's deviation is scaled out, so that tolerances mean the same for any unit
    unit = float(np.sqrt(sums(table)[2] / n)) or 1.0
    fresh = _gradients(p, unit, table)
    table.unpersist()
    table = fresh
    largest = abs(_picked(p, table, np.inf)[0].g)
    last, null = max(largest, max(regs, default=0.0) / unit), 0.5 * sums(table)[2] / n
    out = []
    for reg in sorted(regs, reverse=True):
        lam = reg / unit
        least = max(2 * lam - last, STRONG * lam, TOLERANCE * largest) if lam < largest else np.inf
        _join(p, _picked(p, table, least)[1:], unit)
        strong, passes, steady = len(p.chosen.terms), 0, False
        while passes < max_rounds and not steady:
            c = p.chosen
            c.beta = coordinate_descent(c.gram, c.xy, lam, tol, start=c.beta)
            fresh = _gradients(p, unit, table)
            passes += 1
            found = _picked(p, fresh, lam + TOLERANCE * largest)
            table.unpersist()
            table = fresh
            new = [r for r in found[1:] if r.term_id not in set(c.terms)]
            steady = not new
            _join(p, new, unit)
        c = p.chosen
        rr, ry, _ = sums(table)
        steepest = abs(found[0].g)
        s = 1.0 if steepest <= lam + TOLERANCE * largest else lam / steepest
        objective = 0.5 * rr / n + lam * float(np.abs(c.beta).sum())
        gap = max(objective - (s * ry - 0.5 * s * s * rr) / n, 0.0)
        on = np.flatnonzero(c.beta)
        b = c.beta[on] * unit / c.scale[on]
        order = np.argsort(np.array(c.terms)[on])
        estimates, terms = b[order], tuple(int(c.terms[k]) for k in on[order])
        offset = p.y_mean - float(c.mean[on][order] @ estimates) if intercept else None
        out.append(PathStep(float(reg), terms, estimates, offset, strong, passes, float(gap) * unit**2, float(objective) * unit**2, bool(steady and gap <= gap_tol * null)))
        last = lam
    table.unpersist()
    return out


def path_fits(spark: SparkSession, steps: Sequence[PathStep]) -> DataFrame:
    """One row per penalty: how many columns are in, how many were solved for, passes, gap, objective, ``converged``."""
    rows = [(s.reg, len(s.terms), s.strong, s.passes, s.gap, s.objective, s.converged) for s in steps]
    return spark.createDataFrame(rows, FIT_SCHEMA)


def path_table(names: DataFrame, steps: Sequence[PathStep]) -> DataFrame:
    """``(reg, position, term, estimate, gap, converged)`` of all of ``names(term_id, term)`` at each penalty; the intercept is last."""
    spark = names.sparkSession
    rows = [(s.reg, t, float(b)) for s in steps for t, b in zip(s.terms, s.estimates)]
    # columns in a model, at most ACTIVE_COLUMNS a penalty
    some = spark.createDataFrame(rows, "reg double, term_id long, value double")
    fits = spark.createDataFrame([(s.reg, s.gap, s.converged, s.intercept) for s in steps], "reg double, gap double, converged boolean, intercept double")
    last = names.count()
    regs = F.array(*[F.lit(s.reg) for s in steps])
    each = names.select("term_id", "term", F.explode(regs).alias("reg")).join(some, ["reg", "term_id"], "left")
    each = each.select("reg", (F.col("term_id") + 1).cast("int").alias("position"), "term", F.coalesce("value", F.lit(0.0)).alias("estimate"))
    if any(s.intercept is not None for s in steps):
        each = each.unionByName(fits.select("reg", F.lit(last + 1).cast("int").alias("position"), F.lit("(Intercept)").alias("term"), F.col("intercept").alias("estimate")))
    return each.join(F.broadcast(fits.drop("intercept")), "reg")  # a row per penalty



def lasso_path(
    df: DataFrame, names: Sequence[str] | DataFrame, regs: Sequence[float], values: str = "values", y: str = "y", sample: str = "sample",
    intercept: bool = True, standardize: bool = True, tol: float = 1e-12,
) -> DataFrame:
    """``(reg, position, term, estimate, gap, converged)`` of (1 / 2n) RSS + reg |b| for several values of reg.

    ``names`` are the columns' names in order, or a table ``(term_id, term)`` of them.
    """
    spark = df.sparkSession
    if not isinstance(names, DataFrame):
        names = spark.createDataFrame(list(enumerate(names)), "term_id long, term string")
    ts = from_vectors(df.select(F.col(sample).alias("sample"), F.col(values).alias("values"), F.col(y).cast("double").alias("y")), ("y",))
    try:
        return path_table(names, fit_path(ts, "y", regs, intercept, standardize, tol))
    finally:
        ts.release()
