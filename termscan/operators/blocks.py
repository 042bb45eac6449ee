"""Dense design blocks: samples x (all terms and their non-redundant products)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termscan.operators.tiles import record_batch

_SCHEMA = pa.schema([("block_id", pa.int64()), ("n_rows", pa.int32()), ("n_cols", pa.int32()), ("x", pa.binary()), ("y", pa.binary())])
DESIGN_SCHEMA = "block_id long, n_rows int, n_cols int, x binary, y binary"

# Rows of a block that go into one record, by the size of their design matrix.
RECORD_BYTES = 16_000_000


def with_pairs(x: np.ndarray) -> np.ndarray:
    """Columns, then products of columns i < j in the order of a nested loop."""
    a, b = np.triu_indices(x.shape[1], 1)
    return np.concatenate([x, x[:, a] * x[:, b]], axis=1)


def design_blocks(df: DataFrame, n_terms: int, n_traits: int, block: Column) -> DataFrame:
    """``(block_id, n_rows, n_cols, x, y)`` from ``(sample, values, ys)``, n(n+1)/2 columns in x.

    ``x`` and ``y`` are float64 matrices by rows. A block of many rows comes in several records, so
    that no record grows with the number of samples.
    """
    width = n_terms * (n_terms + 1) // 2
    rows_at_once = max(1, RECORD_BYTES // (8 * width))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            blocks = batch.column("block_id").to_numpy()
            x = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_terms)
            y = batch.column("ys").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_traits)
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(blocks)]):
                for at in range(lo, hi, rows_at_once):
                    end = min(hi, at + rows_at_once)
                    record = (int(blocks[at]), end - at, width, with_pairs(x[at:end]).tobytes(), y[at:end].tobytes())
                    yield record_batch([record], _SCHEMA)

    rows = df.select(block.cast("long").alias("block_id"), "sample", "values", "ys")
    # No shuffle: a record holds rows of one block that one task already has.
    return rows.sortWithinPartitions("block_id", "sample").drop("sample").mapInArrow(build, DESIGN_SCHEMA)


def block_sums(blocks: DataFrame, n_traits: int) -> DataFrame:
    """``(block_id, col, n_rows, sum_x, sum_y)``: column sums per block, with the sum of the first trait."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                n, w = batch.column("n_rows")[r].as_py(), batch.column("n_cols")[r].as_py()
                x = np.frombuffer(batch.column("x")[r].as_buffer()).reshape(n, w)
                y = np.frombuffer(batch.column("y")[r].as_buffer()).reshape(n, n_traits)
                yield pa.RecordBatch.from_pydict(
                    {
                        "block_id": np.full(w, batch.column("block_id")[r].as_py()),
                        "col": np.arange(w),
                        "n_rows": np.full(w, n),
                        "sum_x": x.sum(0),
                        "sum_y": np.full(w, y[:, 0].sum()),
                    }
                )

    parts = blocks.mapInArrow(partial, "block_id long, col long, n_rows long, sum_x double, sum_y double")
    sums = [F.sum(c).alias(c) for c in ("n_rows", "sum_x", "sum_y")]
    return parts.groupBy("block_id", "col").agg(*sums)
