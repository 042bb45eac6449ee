"""Lasso three ways: Spark ML, coordinate descent on distributed moments, consensus ADMM on row blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.errors import BadShape, NotConverged
from termscan.operators.blocks import with_pairs
from termscan.operators.tiles import TASK_BYTES, record_batch
from termscan.session import DurableTable

COEF_SCHEMA = "position int, term string, estimate double"

# Gram matrices up to this many columns are solved on the driver; ADMM has no such limit.
GRAM_COLUMNS = 4096
# Doubles per record when long vectors are added up.
SLICE = 8192
# Partial sums of all tasks together up to this size are added up on the driver.
DRIVER_BYTES = 4_000_000
BLOCK_BYTES = 32_000_000
# Iterations of ADMM between durable copies of its state; tasks replay the steps since then.
DURABLE_EVERY = 8


def soft_threshold(v: Column, k: Column | float) -> Column:
    """v pulled towards zero by k, and zero within k of it."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    return F.signum(v) * F.greatest(F.abs(v) - k, F.lit(0.0))


def arg_min(values: Column) -> Column:
    """Index of the first smallest entry, -1 for an empty array."""
    return F.when(F.size(values) == 0, F.lit(-1)).otherwise(F.array_position(values, F.array_min(values)).cast("int") - 1)


def _shrink(v: np.ndarray, k: float) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - k, 0.0)


def coefficient_table(spark: SparkSession, names: Sequence[str], beta: np.ndarray, intercept: float | None = None) -> DataFrame:
    labels, values = list(names), np.asarray(beta, dtype=float) + 0.0
    if intercept is not None:
        labels, values = [*labels, "(Intercept)"], np.append(values, intercept)
    rows = pd.DataFrame({"position": np.arange(1, len(labels) + 1), "term": labels, "estimate": values})
    return spark.createDataFrame(rows, COEF_SCHEMA)


def lasso_ml(
    df: DataFrame, names: Sequence[str], reg: float, values: str = "values", y: str = "y",
    intercept: bool = True, standardize: bool = True, tol: float = 1e-6, max_iter: int = 100,
) -> DataFrame:
    """Spark ML's lasso, (1 / 2n) RSS + reg |b|, as a coefficient table."""
    data = df.select(array_to_vector(F.col(values)).alias("features"), F.col(y).cast("double").alias("label"))
    model = LinearRegression(
        elasticNetParam=1.0, regParam=reg, fitIntercept=intercept, standardization=standardize, tol=tol, maxIter=max_iter
    ).fit(data)
    if model.summary.totalIterations >= max_iter:
        raise NotConverged(f"the optimiser did not end within {max_iter} iterations")
    return coefficient_table(df.sparkSession, names, model.coefficients.toArray(), model.intercept if intercept else None)


@dataclass(frozen=True)
class ArrayMoments:
    """Cross products of an array column and an outcome, about the means if centred."""

    n: int
    mean: np.ndarray
    y_mean: float
    gram: np.ndarray
    xy: np.ndarray
    yy: float


_SUMS = pa.schema([("i", pa.int32()), ("m", pa.binary())])
_SUMS_SCHEMA = "i int, m binary"


def _gram_kernel(d: int, shift: np.ndarray):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            v = np.concatenate([x, batch.column("y").to_numpy(zero_copy_only=False)[:, None]], axis=1) - shift
            acc = v.T @ v if acc is None else acc + v.T @ v
        if acc is not None:
            yield record_batch([(i, acc[i].tobytes()) for i in range(d + 1)], _SUMS)

    return kernel


def _sum_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal keys in a stream sorted by key."""
    key, acc = None, None
    for batch in batches:
        keys, m = batch.column("i").to_pylist(), batch.column("m")
        for r, k in enumerate(keys):
            part = np.frombuffer(m[r].as_buffer(), dtype=np.float64)
            if k == key:
                acc = acc + part
            else:
                if key is not None:
                    yield record_batch([(key, acc.tobytes())], _SUMS)
                key, acc = k, part
    if key is not None:
        yield record_batch([(key, acc.tobytes())], _SUMS)


def summed_by_key(parts: DataFrame) -> DataFrame:
    """``(i, m)`` records of doubles added up per key, each key in a task that streams its records."""
    return parts.repartition("i").sortWithinPartitions("i").mapInArrow(_sum_kernel, _SUMS_SCHEMA)


def _narrow_columns(values: str, y: str) -> list[Column]:
    return [F.col(values).cast("array<double>").alias("values"), F.col(y).cast("double").alias("y")]


def _narrow(df: DataFrame, values: str, y: str) -> DataFrame:
    return df.select(*_narrow_columns(values, y))


def gram_rows(df: DataFrame, d: int, values: str = "values", y: str = "y", shift: np.ndarray | None = None) -> DataFrame:
    """One record per row of [X y]'[X y]: tasks add up their own rows, then records of a row meet."""
    shift = np.zeros(d + 1) if shift is None else shift
    return summed_by_key(_narrow(df, values, y).mapInArrow(_gram_kernel(d, shift), _SUMS_SCHEMA))


def array_shape(df: DataFrame, values: str = "values") -> tuple[int, int]:
    """Rows, and entries per array; ragged arrays raise."""
    s = df.agg(F.count("*").alias("n"), F.min(F.size(values)).alias("low"), F.max(F.size(values)).alias("high")).first()
    if not s.n or s.low != s.high:
        raise BadShape(f"{s.n} rows with {s.low} to {s.high} entries")
    return int(s.n), int(s.high)


def array_moments(df: DataFrame, values: str = "values", y: str = "y", centred: bool = False) -> ArrayMoments:
    """Moments for the driver; at most ``GRAM_COLUMNS`` columns."""
    n, d = array_shape(df, values)
    if d > GRAM_COLUMNS:
        raise ValueError(f"{d} columns are too many for a Gram matrix on the driver; use lasso_admm")
    shift = np.zeros(d + 1)
    if centred:
        narrow = _narrow(df, values, y)
        sums = narrow.select(F.posexplode(F.concat("values", F.array("y"))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
        for r in sums.collect():
            shift[r.i] = r.m
    full = np.zeros((d + 1, d + 1))
    for r in gram_rows(df, d, values, y, shift).collect():
        full[r.i] = np.frombuffer(bytes(r.m), dtype=np.float64)
    return ArrayMoments(n, shift[:d], float(shift[d]), full[:d, :d], full[:d, d], float(full[d, d]))


def gram(df: DataFrame, values: str = "values") -> DataFrame:
    """X'X of an array column as cells ``(i, j, v)``."""
    _, d = array_shape(df, values)
    rows = gram_rows(df.withColumn("y", F.lit(0.0)), d, values)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, i in enumerate(batch.column("i").to_pylist()):
                if i < d:
                    row = np.frombuffer(batch.column("m")[r].as_buffer(), dtype=np.float64)[:d]
                    yield pa.RecordBatch.from_pydict({"i": np.full(d, i), "j": np.arange(d), "v": row})

    return rows.mapInArrow(cells, "i long, j long, v double")


def coordinate_descent(
    g: np.ndarray, xy: np.ndarray, lam: float, tol: float = 1e-10, max_iter: int = 10_000, start: np.ndarray | None = None
) -> np.ndarray:
    """Minimise b'Gb / 2 - b'xy + lam |b| by sweeps over the coordinates."""
    beta = np.zeros(len(xy)) if start is None else start.copy()
    rest = xy - g @ beta
    diag = np.diag(g)
    for _ in range(max_iter):
        largest = 0.0
        for j in np.flatnonzero(diag > 0):
            new = _shrink(rest[j] + diag[j] * beta[j], lam) / diag[j]
            step = new - beta[j]
            if step:
                rest -= g[:, j] * step
                beta[j] = new
                largest = max(largest, abs(step) * np.sqrt(diag[j]))
        if largest <= tol * max(1.0, float(np.sqrt(np.abs(xy).max(initial=0.0)))):
            return beta
    raise NotConverged(f"coordinate descent did not end within {max_iter} sweeps")


def lasso_cd(
    df: DataFrame, names: Sequence[str], lam: float, values: str = "values", y: str = "y", tol: float = 1e-10, max_iter: int = 10_000
) -> DataFrame:
    """RSS / 2 + lam |b| without intercept: one pass for the moments, then sweeps on them."""
    m = array_moments(df, values, y)
    return coefficient_table(df.sparkSession, names, coordinate_descent(m.gram, m.xy, lam, tol, max_iter))


def lasso_objective(df: DataFrame, beta: Sequence[float], lam: float, values: str = "values", y: str = "y") -> DataFrame:
    """RSS / 2 + lam |b| as one row."""
    coef = F.array(*[F.lit(float(b)) for b in beta])
    fit = F.aggregate(F.zip_with(values, coef, lambda x, b: x * b), F.lit(0.0), lambda s, v: s + v)
    r = fit - F.col(y)
    penalty = float(lam) * float(np.abs(np.asarray(beta, dtype=float)).sum())
    return df.agg((F.lit(0.5) * F.sum(r * r) + F.lit(penalty)).alias("objective"))


_BLOCK = pa.schema(
    [("block", pa.int64()), ("n_rows", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("xty", pa.binary()), ("inverse", pa.binary())]
)
BLOCK_SCHEMA = "block long, n_rows int, x binary, y binary, xty binary, inverse binary"


def _inverse(m: np.ndarray) -> np.ndarray:
    low = np.linalg.inv(np.linalg.cholesky(m))
    return low.T @ low


@dataclass(frozen=True)
class _Design:
    """How the columns of a block come about: as stored, or with the products of all pairs."""

    stored: int
    pairs: bool

    @property
    def columns(self) -> int:
        return self.stored * (self.stored + 1) // 2 if self.pairs else self.stored

    def expand(self, x: np.ndarray) -> np.ndarray:
        return with_pairs(x) if self.pairs else x


def _block_kernel(design: _Design, rho: float):
    """Each block with its products and the inverse its updates need, of the smaller of two sizes.

    Only the single columns are stored; products of pairs are made again whenever they are used.
    """
    stored, d = design.stored, design.columns

    def finish(block: int, xs: list, ys: list) -> pa.RecordBatch:
        single, y = np.concatenate(xs), np.concatenate(ys)
        x, n = design.expand(single), len(single)
        inverse = _inverse(x.T @ x + rho * np.eye(d) if n >= d else np.eye(n) + x @ x.T / rho)
        return record_batch([(block, n, single.tobytes(), y.tobytes(), (x.T @ y).tobytes(), inverse.tobytes())], _BLOCK)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, xs, ys = None, [], []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            blocks = batch.column("block").to_numpy()
            x = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(-1, stored)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(blocks)]):
                if blocks[lo] != current:
                    if xs:
                        yield finish(current, xs, ys)
                    current, xs, ys = int(blocks[lo]), [], []
                xs.append(x[lo:hi])
                ys.append(y[lo:hi])
        if xs:
            yield finish(current, xs, ys)

    return kernel


def ridge_update(x: np.ndarray, inverse: np.ndarray, q: np.ndarray, rho: float) -> np.ndarray:
    """(X'X + rho I)^-1 q. A block with fewer rows than columns goes through the n x n inverse instead."""
    n, d = x.shape
    return inverse @ q if n >= d else q / rho - x.T @ (inverse @ (x @ q)) / rho**2


def _replayed(batches: Iterator[pa.RecordBatch], history: Sequence[np.ndarray], design: _Design, rho: float):
    """Every block with its w and u after one step per z of the history.

    A step adds the last gap to u and solves the block's ridge problem about z - u.
    """
    read = lambda b, c, r: np.frombuffer(b.column(c)[r].as_buffer(), dtype=np.float64)
    d = design.columns
    for batch in batches:
        blocks, rows = batch.column("block").to_pylist(), batch.column("n_rows").to_pylist()
        for r, (block, n) in enumerate(zip(blocks, rows)):
            x = design.expand(read(batch, "x", r).reshape(n, design.stored))
            y, xty = read(batch, "y", r), read(batch, "xty", r)
            side = min(n, d)
            inverse = read(batch, "inverse", r).reshape(side, side)
            w, u = (read(batch, "w", r), read(batch, "u", r)) if batch.column("w")[r].is_valid else (None, np.zeros(d))
            for z in history:
                if w is not None:
                    u = u + w - z
                w = ridge_update(x, inverse, xty + rho * (z - u), rho)
            yield block, x, y, w, u


@dataclass(frozen=True)
class _InTask:
    """A small value that travels with the task."""

    value: list[np.ndarray]


def _share(spark: SparkSession, history: list[np.ndarray]):
    """Long histories go to each executor once, short ones with the tasks, which starts them sooner."""
    return _InTask(history) if sum(z.nbytes for z in history) < 1_000_000 else spark.sparkContext.broadcast(history)


def _totals_kernel(shared, design: _Design, rho: float):
    """Per task, the sum of w + u in slices (keys 0 and up) and the scalar sums (key -1)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history, d = shared.value, design.columns
        z, total, sums, seen = history[-1], np.zeros(d), np.zeros(4), False
        for _, x, y, w, u in _replayed(batches, history, design, rho):
            gap, fit = w - z, x @ z - y
            total += w + u
            sums += (gap @ gap, w @ w, u @ u, 0.5 * (fit @ fit))
            seen = True
        if seen:
            slices = [(s // SLICE, total[s : s + SLICE].tobytes()) for s in range(0, d, SLICE)]
            yield record_batch([(-1, sums.tobytes()), *slices], _SUMS)

    return kernel


_STATE = pa.schema([("block", pa.int64()), ("w", pa.binary()), ("u", pa.binary())])
STATE_SCHEMA = "block long, w binary, u binary"


def _state_kernel(shared, design: _Design, rho: float):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, w, u in _replayed(batches, shared.value, design, rho):
            yield record_batch([(block, w.tobytes(), u.tobytes())], _STATE)

    return kernel


def _added_up(parts: DataFrame, d: int, tasks: int) -> dict[int, np.ndarray]:
    """Totals per key. Few short partial sums come straight to the driver, others meet by key first."""
    small = 8 * d * tasks <= DRIVER_BYTES
    out: dict[int, np.ndarray] = {}
    for r in (parts if small else summed_by_key(parts)).collect():
        part = np.frombuffer(bytes(r.m))
        out[r.i] = out[r.i] + part if r.i in out else part
    return out


@dataclass(frozen=True)
class AdmmResult:
    beta: np.ndarray
    converged: bool
    log: list[tuple[int, float, float, float, float, float]]


LOG_SCHEMA = "iteration int, primal double, eps_primal double, dual double, eps_dual double, objective double"
CONVERGENCE_SCHEMA = LOG_SCHEMA + ", converged boolean"


def row_blocks(
    df: DataFrame, design: _Design, n: int, rho: float, values: str = "values", y: str = "y", sample: str = "sample",
    blocks: int | None = None, block: Column | None = None,
) -> tuple[DataFrame, int]:
    """Row blocks with their inverses, kept in memory and on disk, and how many there are.

    Samples are unique, so their hash spreads them evenly; ``block`` gives their blocks otherwise. A task takes as many blocks as make a
    fair amount of work.
    """
    size = max(1, BLOCK_BYTES // (8 * design.columns))
    count = blocks or max(1, -(-n // size))
    parts = max(1, min(count, int(8 * n * design.columns / TASK_BYTES)))
    block = F.pmod(F.xxhash64(sample), F.lit(count)) if block is None else block
    rows = df.select(block.cast("long").alias("block"), *_narrow_columns(values, y))
    ordered = rows.repartition(parts, "block").sortWithinPartitions("block")
    kept = ordered.mapInArrow(_block_kernel(design, rho), BLOCK_SCHEMA).persist(StorageLevel.MEMORY_AND_DISK)
    return kept, kept.count()


def admm(
    df: DataFrame, lam: float = 0.5, rho: float = 1.0, max_iter: int = 100, abs_tol: float = 1e-4, rel_tol: float = 1e-2,
    values: str = "values", y: str = "y", sample: str = "sample", blocks: int | None = None, pairs: bool = False,
    block: Column | None = None,
) -> AdmmResult:
    """Minimise RSS / 2 + lam |b| by consensus over row blocks; no intercept, no standardisation.

    With ``pairs`` the columns are the values and then the products of all their pairs.

    A block keeps its own coefficients w and dual u; the common z is their shrunken mean. One job
    per iteration brings all blocks up to date and adds up w + u. Their state is written to the
    shared folder every few iterations, and tasks replay the steps since then from the few z that
    the driver holds: plans stay the same size, and a lost executor costs a few steps.
    """
    spark = df.sparkSession
    n, stored = array_shape(df, values)
    design = _Design(stored, pairs)
    d = design.columns
    data, n_blocks = row_blocks(df, design, n, rho, values, y, sample, blocks, block)
    tasks = max(n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    none = F.lit(None).cast("binary")
    ready = data.withColumn("w", none).withColumn("u", none)
    history, log, converged = [np.zeros(d)], [], False
    durable: DurableTable | None = None
    for iteration in range(1, max_iter + 1):
        z, shared = history[-1], _share(spark, history)
        parts = ready.mapInArrow(_totals_kernel(shared, design, rho), _SUMS_SCHEMA)
        totals = _added_up(parts, d, tasks)
        gap, ww, uu, half_rss = totals.pop(-1)
        mean = np.concatenate([totals[k] for k in sorted(totals)]) / n_blocks
        z_new = _shrink(mean, lam / (n_blocks * rho))
        primal, dual = np.sqrt(gap), np.sqrt(n_blocks) * rho * np.linalg.norm(z_new - z)
        slack = np.sqrt(d * n_blocks) * abs_tol
        eps_primal = slack + rel_tol * max(np.sqrt(ww), np.sqrt(n_blocks) * np.linalg.norm(z_new))
        eps_dual = slack + rel_tol * rho * np.sqrt(uu)
        log.append((iteration, *map(float, (primal, eps_primal, dual, eps_dual, half_rss + lam * np.abs(z).sum()))))
        converged = bool(primal <= eps_primal and dual <= eps_dual)
        if not converged and iteration % DURABLE_EVERY == 0:
            fresh = DurableTable(ready.mapInArrow(_state_kernel(shared, design, rho), STATE_SCHEMA), "admm")
            if durable:
                durable.drop()
            durable, ready, history = fresh, data.join(fresh.df, "block"), []
        history = [*history, z_new]
        if not isinstance(shared, _InTask):
            shared.unpersist()
        if converged:
            break
    if durable:
        durable.drop()
    data.unpersist()
    return AdmmResult(history[-1], converged, log)


def lasso_admm(df: DataFrame, names: Sequence[str], lam: float = 0.5, **options) -> DataFrame:
    """Coefficients by consensus, with how many iterations there were and whether they reached the tolerances."""
    result = admm(df, lam, **options)
    table = coefficient_table(df.sparkSession, names, result.beta)
    return table.select("*", F.lit(len(result.log)).alias("iterations"), F.lit(result.converged).alias("converged"))


def convergence_table(spark: SparkSession, result: AdmmResult) -> DataFrame:
    """Per iteration: residual norms, their limits, the objective of the coefficients it began with, and whether it was the last that was needed."""
    rows = [(*r, result.converged and r[0] == len(result.log)) for r in result.log]
    return spark.createDataFrame(rows, CONVERGENCE_SCHEMA)


def lasso_convergence(df: DataFrame, lam: float = 0.5, **options) -> DataFrame:
    return convergence_table(df.sparkSession, admm(df, lam, **options))
