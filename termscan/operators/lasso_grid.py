"""Consensus lasso over a grid of row blocks and column slices: no vector as long as the terms lies anywhere whole.

The iteration is that of ``lasso.admm``: each row block i keeps coefficients w and duals u, all agree on z. A
block's ridge step goes through its n x n matrix, for which (I + X X' / rho)^-1 q only needs X q, a sum over
column slices. So a cell, one row block of one slice, holds its part of X, w and u, a slice its part of z:

1. cells: u + w - z, q = X'y + rho (z - u), and their parts of X q and X z;
2. row blocks: add these up, t = (I + X X' / rho)^-1 X q, and their share of the residual squares;
3. cells: w = q / rho - X' t / rho^2;
4. slices: z = shrunken mean of w + u.

The driver gets sums of squares only. Products of pairs are made inside a cell from two tiles, a slice of them
being a pair of term blocks; coefficients come out as a table by term ids. Cells stay where they are, hashed
by their number; what moves is q-sized (per cell) and n-sized (per row block and slice).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.operators.lasso import AdmmResult, _inverse, _shrink
from termscan.operators.scan import SINGLE
from termscan.operators.tiles import TASK_BYTES, TileSet, record_batch
from termscan.session import DurableTable

CELL_SCHEMA = "cell long, i long, a int, b int, n int, left binary, right binary, y binary"
STATE_SCHEMA = "cell long, i long, a int, b int, w binary, u binary, q binary, xty binary"
_STATE = pa.schema([("cell", pa.int64()), ("i", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), *[(c, pa.binary()) for c in ("w", "u", "q", "xty")]])
# Partial sums: of row blocks (X q, X z) or of slices (w + u).
PART_SCHEMA = "i long, a int, b int, m binary"
_PART = pa.schema([("i", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("m", pa.binary())])
SLICE_SCHEMA = "a int, b int, z binary, step double, size double, ones double, dz double"
_SLICE = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("z", pa.binary()), *[(c, pa.float64()) for c in ("step", "size", "ones", "dz")]])
LOG_SCHEMA = "iteration int, primal double, eps_primal double, dual double, eps_dual double, objective double, converged boolean"


@dataclass(frozen=True)
class GridResult:
    """``coefficients(term_a, term_b, estimate)``, -1 for no second term, and the log of the iterations."""

    coefficients: DataFrame
    converged: bool
    log: list[tuple]


def _doubles(column: pa.Array, r: int) -> np.ndarray | None:
    return np.frombuffer(column[r].as_buffer(), dtype=np.float64) if column[r].is_valid else None


def _columns(left: np.ndarray, right: np.ndarray | None, n: int, same: bool) -> np.ndarray:
    """A cell's part of X: a tile, or the products of two tiles' columns, of one tile's pairs only once."""
    x = left.reshape(n, -1)
    if right is None:
        return x
    y = right.reshape(n, -1)
    if same:
        a, b = np.triu_indices(x.shape[1], 1)
        return x[:, a] * y[:, b]
    return (x[:, :, None] * y[:, None, :]).reshape(n, -1)


def _cells(ts: TileSet, pairs: bool) -> tuple[DataFrame, int]:
    last = ts.n_blocks - 1
    rows = ts.blocks.select("row_block", "n_rows", "y", "x")
    one = rows.select("row_block", "n_rows", "y", F.posexplode("x").alias("a", "left"))
    one = one.select("row_block", "n_rows", "y", "a", F.lit(SINGLE).alias("b"), "left", F.lit(None).cast("binary").alias("right"))
    if pairs:
        two = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("a"))
        two = two.select("*", F.explode(F.sequence("a", F.lit(last))).alias("b"))
        two = two.select("row_block", "n_rows", "y", "a", "b", F.col("x")[F.col("a")].alias("left"), F.col("x")[F.col("b")].alias("right"))
        # a tile of one column has no pairs of its own
        two = two.where(~((F.col("a") == F.col("b")) & (F.lit(ts.n_terms) - F.col("a") * ts.width <= 1)))
        one = one.unionByName(two)
    slices = ts.n_blocks * (ts.n_blocks + 1)
    number = F.col("row_block") * slices + F.col("a") * (ts.n_blocks + 1) + F.col("b") + 1
    cells = one.select(number.alias("cell"), F.col("row_block").alias("i"), "a", "b", F.col("n_rows").alias("n"), "left", "right", "y")
    size = 8.0 * ts.n_samples * ts.n_terms * (1 + (ts.n_blocks + 1 if pairs else 0))
    return cells, max(1, min(int(size / TASK_BYTES) + 1, ts.n_samples * slices))


def _read(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]):
    for batch in batches:
        keys = [batch.column(c).to_pylist() for c in ("cell", "i", "a", "b", "n")]
        for r, (cell, i, a, b, n) in enumerate(zip(*keys)):
            x = _columns(_doubles(batch.column("left"), r), _doubles(batch.column("right"), r), n, a == b)
            yield cell, i, a, b, x, {c: _doubles(batch.column(c), r) for c in names}


def _gram_kernel(trait: int, n_traits: int):
    """X X' of each cell for its row block, and the products with the outcome."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, i, a, b, x, v in _read(batches, ("y",)):
            yield record_batch([(i, a, b, (x @ x.T).tobytes())], _PART)

    return kernel


def _first_kernel(trait: int, n_traits: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, i, a, b, x, v in _read(batches, ("y",)):
            y = v["y"].reshape(-1, n_traits)[:, trait]
            xty = (x.T @ y).tobytes()
            yield record_batch([(cell, i, a, b, None, np.zeros(x.shape[1]).tobytes(), None, xty)], _STATE)

    return kernel


def _q_kernel(rho: float):
    """Step 1: duals and q of each cell, and its parts of X q and X z."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, i, a, b, x, v in _read(batches, ("w", "u", "xty", "z")):
            z = v["z"] if v["z"] is not None else np.zeros(x.shape[1])
            u = v["u"] if v["w"] is None else v["u"] + v["w"] - z
            q = v["xty"] + rho * (z - u)
            yield record_batch([(cell, i, a, b, None, u.tobytes(), q.tobytes(), v["xty"].tobytes(), np.concatenate([x @ q, x @ z]).tobytes())], _Q)

    return kernel


_Q = pa.schema([*_STATE, ("m", pa.binary())])
Q_SCHEMA = STATE_SCHEMA + ", m binary"


def _sum_kernel(keys: tuple[str, ...], schema: pa.Schema):
    """Adds up ``m`` of equal keys in a stream sorted by them."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, acc = None, None
        for batch in batches:
            for r, key in enumerate(zip(*(batch.column(k).to_pylist() for k in keys))):
                part = _doubles(batch.column("m"), r)
                if key == now:
                    acc = acc + part
                    continue
                if now is not None:
                    yield record_batch([(*now, acc.tobytes())], schema)
                now, acc = key, part
        if now is not None:
            yield record_batch([(*now, acc.tobytes())], schema)

    return kernel


_ROW = pa.schema([("i", pa.int64()), ("m", pa.binary())])
_COL = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("m", pa.binary())])


def _by_row(parts: DataFrame) -> DataFrame:
    return parts.select("i", "m").repartition("i").sortWithinPartitions("i").mapInArrow(_sum_kernel(("i",), _ROW), "i long, m binary")


def _solve_kernel(rho: float, trait: int, n_traits: int):
    """Step 2: t of each row block, half its residual squares at z."""
    schema = pa.schema([("i", pa.int64()), ("t", pa.binary()), ("half_rss", pa.float64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, i in enumerate(batch.column("i").to_pylist()):
                both, inverse = _doubles(batch.column("m"), r), _doubles(batch.column("inverse"), r)
                n = len(both) // 2
                y = _doubles(batch.column("y"), r).reshape(-1, n_traits)[:, trait]
                fit = both[n:] - y
                yield record_batch([(i, (inverse.reshape(n, n) @ both[:n]).tobytes(), float(0.5 * (fit @ fit)))], schema)

    return kernel


def _w_kernel(rho: float):
    """Step 3: coefficients of each cell."""
    schema = pa.schema([*_STATE, ("gap", pa.float64()), ("ww", pa.float64()), ("uu", pa.float64()), ("m", pa.binary())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, i, a, b, x, v in _read(batches, ("u", "q", "xty", "z", "t")):
            w = v["q"] / rho - x.T @ v["t"] / rho**2
            gap = w if v["z"] is None else w - v["z"]
            row = (cell, i, a, b, w.tobytes(), v["u"].tobytes(), None, v["xty"].tobytes(), float(gap @ gap), float(w @ w), float(v["u"] @ v["u"]), (w + v["u"]).tobytes())
            yield record_batch([row], schema)

    return kernel


W_SCHEMA = STATE_SCHEMA + ", gap double, ww double, uu double, m binary"


def _z_kernel(n_blocks: int, shrink: float):
    """Step 4: the new z of each slice, next to the old one."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                new = _shrink(_doubles(batch.column("m"), r) / n_blocks, shrink)
                old = _doubles(batch.column("z"), r)
                step = new if old is None else new - old
                yield record_batch([(a, b, new.tobytes(), float(step @ step), float(new @ new), float(np.abs(new).sum()), float(len(new)))], _SLICE)

    return kernel


def _coefficient_kernel(width: int, n_terms: int):
    schema = pa.schema([("term_a", pa.int64()), ("term_b", pa.int64()), ("estimate", pa.float64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                z = _doubles(batch.column("z"), r)
                left = a * width + np.arange(min(width, n_terms - a * width))
                if b == SINGLE:
                    one, two = left, np.full(len(left), SINGLE)
                elif a == b:
                    i, j = np.triu_indices(len(left), 1)
                    one, two = left[i], left[j]
                else:
                    right = b * width + np.arange(min(width, n_terms - b * width))
                    one, two = np.repeat(left, len(right)), np.tile(right, len(left))
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(z + 0.0)], schema=schema)

    return kernel


def admm_grid(
    ts: TileSet, trait: str, lam: float = 0.5, rho: float = 1.0, max_iter: int = 100, abs_tol: float = 1e-4, rel_tol: float = 1e-2, pairs: bool = False
) -> GridResult:
    """Minimise RSS / 2 + lam |b| by consensus over the row blocks of ``ts``; no intercept, no standardisation.

    With ``pairs`` the columns are the terms and all products of two. State is written to the shared folder
    in every iteration, so plans stay the same size and a lost executor costs one step.
    """
    spark = ts.blocks.sparkSession
    at, n_traits = ts.traits.index(trait), len(ts.traits)
    cells, tasks = _cells(ts, pairs)
    cells = cells.repartition(tasks, "cell").sortWithinPartitions("cell").persist(StorageLevel.MEMORY_AND_DISK)
    inverses = _by_row(cells.mapInArrow(_gram_kernel(at, n_traits), PART_SCHEMA))
    ys = ts.blocks.select(F.col("row_block").alias("i"), "y")
    rows = DurableTable(inverses.mapInArrow(_inverse_kernel(rho), "i long, inverse binary").join(ys, "i"), "lasso-rows")
    n_rows = rows.df.count()
    state = DurableTable(cells.mapInArrow(_first_kernel(at, n_traits), STATE_SCHEMA), "lasso-state")
    slices = DurableTable(state.df.select("a", "b").distinct().select("a", "b", F.lit(None).cast("binary").alias("z")), "lasso-z")
    shape = cells.select("cell", "n", "left", "right")
    log, converged, ones, columns = [], False, 0.0, 0.0
    for iteration in range(1, max_iter + 1):
        z = slices.df.select("a", "b", "z")
        known = state.df.join(z, ["a", "b"])
        asked = DurableTable(shape.join(known, "cell").mapInArrow(_q_kernel(rho), Q_SCHEMA), "lasso-q")
        solved = _by_row(asked.df).join(rows.df, "i").mapInArrow(_solve_kernel(rho, at, n_traits), "i long, t binary, half_rss double")
        solved = DurableTable(solved, "lasso-t")
        known = asked.df.drop("m", "w").join(z, ["a", "b"]).join(solved.df.select("i", "t"), "i")
        moved = DurableTable(shape.join(known, "cell").mapInArrow(_w_kernel(rho), W_SCHEMA), "lasso-w")
        sums = moved.df.agg(F.sum("gap").alias("gap"), F.sum("ww").alias("ww"), F.sum("uu").alias("uu")).first()
        half_rss = solved.df.agg(F.sum("half_rss").alias("s")).first().s
        summed = moved.df.select("a", "b", "m").repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_sum_kernel(("a", "b"), _COL), "a int, b int, m binary")
        fresh = DurableTable(summed.join(z, ["a", "b"]).mapInArrow(_z_kernel(n_rows, lam / (n_rows * rho)), SLICE_SCHEMA), "lasso-z")
        after = fresh.df.agg(F.sum("step").alias("step"), F.sum("size").alias("size"), F.sum("ones").alias("ones"), F.sum("dz").alias("columns")).first()
        columns = after.columns
        primal, dual = np.sqrt(sums.gap), np.sqrt(n_rows * after.step) * rho
        slack = np.sqrt(columns * n_rows) * abs_tol
        eps_primal = slack + rel_tol * max(np.sqrt(sums.ww), np.sqrt(n_rows * after.size))
        eps_dual = slack + rel_tol * rho * np.sqrt(sums.uu)
        converged = bool(primal <= eps_primal and dual <= eps_dual)
        log.append((iteration, *map(float, (primal, eps_primal, dual, eps_dual, half_rss + lam * ones)), converged))
        ones = after.ones
        for old in (state, slices, asked, solved):
            old.drop()
        state, slices = moved, fresh
        if converged:
            break
    cells.unpersist()
    rows.drop()
    coefficients = DurableTable(slices.df.mapInArrow(_coefficient_kernel(ts.width, ts.n_terms), "term_a long, term_b long, estimate double"), "lasso-coefficients").df
    state.drop()
    slices.drop()
    return GridResult(coefficients, converged, log)


def _inverse_kernel(rho: float):
    schema = pa.schema([("i", pa.int64()), ("inverse", pa.binary())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, i in enumerate(batch.column("i").to_pylist()):
                k = _doubles(batch.column("m"), r)
                n = int(round(np.sqrt(len(k))))
                yield record_batch([(i, _inverse(np.eye(n) + k.reshape(n, n) / rho).tobytes())], schema)

    return kernel


def from_vector(spark: SparkSession, result: AdmmResult, n_terms: int) -> GridResult:
    """The result of ``lasso.admm`` with pairs, a short vector, in the form of a grid's."""
    a, b = np.triu_indices(n_terms, 1)
    ids = [(k, SINGLE) for k in range(n_terms)] + list(zip(a.tolist(), b.tolist()))
    rows = [(*t, float(e)) for t, e in zip(ids, result.beta + 0.0)]
    log = [(*r, result.converged and r[0] == len(result.log)) for r in result.log]
    return GridResult(spark.createDataFrame(rows, "term_a long, term_b long, estimate double"), result.converged, log)


def named(result: GridResult, names: DataFrame) -> DataFrame:
    """``(position, term_a, term_b, term, estimate, converged)`` by names ``(term_id, term)``; a pair's name is both, joined by ``_``.

    Positions start from 1: first the terms, then their pairs in order.
    """
    n = names.count()
    one = names.select(F.col("term_id").alias("term_a"), F.col("term").alias("name_a"))
    two = names.select(F.col("term_id").alias("term_b"), F.col("term").alias("name_b"))
    rows = result.coefficients.join(one, "term_a").join(two, "term_b", "left")
    label = F.when(F.col("term_b") == SINGLE, F.col("name_a")).otherwise(F.concat_ws("_", "name_a", "name_b"))
    second = F.when(F.col("term_b") != SINGLE, F.col("term_b"))
    a, b = F.col("term_a"), F.col("term_b")
    place = F.when(b == SINGLE, a + 1).otherwise(n + a * n - (a * (a + 1) / 2).cast("long") + b - a)
    return rows.select(place.alias("position"), "term_a", second.alias("term_b"), label.alias("term"), "estimate", F.lit(result.converged).alias("converged"))
