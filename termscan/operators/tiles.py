"""Sample x term tables as dense row blocks.

A row block holds some samples: their outcomes, and their values cut into tiles of up to ``width``
terms, each a float64 matrix. It is one record, so a scan reads it in place wherever it lies: no
join and no shuffle of the data. The number of samples per row block is chosen so that a record
stays small however many terms there are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termscan.errors import BadShape
from termscan.session import DurableTable

Y_BLOCK = -1
TILE_WIDTH = 512
TILE_BYTES = 2_000_000
ROW_BLOCK_BYTES = 64_000_000
# Multiply-adds one task should do per pass, and bytes it should read.
TASK_WORK = 2e9
TASK_BYTES = 128e6
# A task hands on one set of moments whatever it reads, so beyond the cores at hand tasks must read
# this many samples or more: what is shuffled stays a small part of what is read.
TASK_ROWS = 512
TASK_ROWS_PAIRS = 2048

# Tables above this size are written to the shared folder; smaller ones are cheap to pack again.
DURABLE_BYTES = 4e9

BLOCK_SCHEMA = "row_block long, n_rows int, y binary, x array<binary>"
_BLOCK = pa.schema([("row_block", pa.int64()), ("n_rows", pa.int32()), ("y", pa.binary()), ("x", pa.list_(pa.binary()))])


@dataclass(frozen=True)
class TileSet:
    """Row blocks with what the driver needs to know about them."""

    blocks: DataFrame
    n_samples: int
    n_terms: int
    width: int
    traits: tuple[str, ...]
    y_mean: np.ndarray
    y_scale: np.ndarray
    n_parts: int
    written: DurableTable | None = None

    @property
    def n_blocks(self) -> int:
        return -(-self.n_terms // self.width)

    def columns(self, blocks: Sequence[int]) -> DataFrame:
        """Row blocks with only these tiles, which is all that tasks then receive."""
        return self.blocks.select("row_block", "n_rows", "y", F.array(*[F.col("x")[b] for b in blocks]).cast("array<binary>").alias("x"))

    def release(self) -> None:
        if self.written is not None:
            self.written.drop()
        self.blocks.unpersist()


def rows_per_block(n_terms: int, width: int) -> int:
    by_tile = TILE_BYTES // (8 * min(n_terms, width))
    return max(1, min(by_tile, ROW_BLOCK_BYTES // (8 * n_terms)))


def partitions_for(n_samples: int, n_terms: int, pairs: bool, row_blocks: int, cores: int) -> int:
    work = n_samples * n_terms * (n_terms / 2 if pairs else 1.0) * 8
    need = max(work / TASK_WORK, n_samples * n_terms * 8 / TASK_BYTES)
    worth = max(cores, n_samples / (TASK_ROWS_PAIRS if pairs else TASK_ROWS))
    return int(max(1, min(row_blocks, math.ceil(min(need, worth)))))


def cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def record_batch(records: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*records)) if records else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _cut(row_block: int, x: np.ndarray, y: np.ndarray, width: int) -> pa.RecordBatch:
    tiles = [np.ascontiguousarray(x[:, at : at + width]).tobytes() for at in range(0, x.shape[1], width)]
    return record_batch([(row_block, len(x), np.ascontiguousarray(y).tobytes(), tiles)], _BLOCK)


def _doubles(column: pa.Array, width: int) -> np.ndarray:
    """An array column as a matrix; ragged arrays, nulls and values that are not finite raise."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    if column.null_count or flat.null_count or np.any(lengths != width):
        raise BadShape(f"some array does not have {width} values")
    out = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
    return _finite(out)


def _finite(values: np.ndarray) -> np.ndarray:
    if not np.isfinite(values).all():
        raise BadShape("some value is missing or infinite")
    return values


def _pack_vectors(n_terms: int, n_traits: int, width: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, xs, ys = None, [], []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            blocks = batch.column("row_block").to_numpy()
            x = _doubles(batch.column("values"), n_terms)
            y = _doubles(batch.column("ys"), n_traits) if n_traits else np.zeros((len(blocks), 0))
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(blocks)]):
                if blocks[lo] != current:
                    if xs:
                        yield _cut(current, np.concatenate(xs), np.concatenate(ys), width)
                    current, xs, ys = int(blocks[lo]), [], []
                xs.append(x[lo:hi])
                ys.append(y[lo:hi])
        if xs:
            yield _cut(current, np.concatenate(xs), np.concatenate(ys), width)

    return pack


def _pack_cells(n_terms: int, n_traits: int, width: int):
    """Cells sorted by row block, sample and term; outcomes carry negative term ids."""
    per_sample = n_terms + n_traits
    ids = np.arange(-n_traits, n_terms)

    def finish(row_block: int, terms: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        t, v = np.concatenate(terms), np.concatenate(values)
        # Samples that lack cells, or have some twice, break the run of ids.
        if len(t) % per_sample or not np.array_equal(t.reshape(-1, per_sample), np.tile(ids, (len(t) // per_sample, 1))):
            raise BadShape("some sample lacks a cell or has one twice")
        m = v.reshape(-1, per_sample)
        return _cut(row_block, m[:, n_traits:], m[:, :n_traits][:, ::-1], width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, terms, values = None, [], []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            blocks = batch.column("row_block").to_numpy()
            t = batch.column("term_id").to_numpy()
            v = batch.column("value").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(blocks)]):
                if blocks[lo] != current:
                    if terms:
                        yield finish(current, terms, values)
                    current, terms, values = int(blocks[lo]), [], []
                terms.append(t[lo:hi])
                values.append(_finite(v[lo:hi]))
        if terms:
            yield finish(current, terms, values)

    return pack


def _pack_slices(n_terms: int, n_traits: int, width: int):
    """Slices of term vectors sorted by row block and term; outcomes carry negative term ids."""
    ids = np.arange(-n_traits, n_terms)

    def finish(row_block: int, terms: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        if not np.array_equal(np.concatenate(terms), ids):
            raise BadShape("some term is missing or occurs twice")
        flat = np.concatenate(values)
        if len(flat) % len(ids):
            raise BadShape("term vectors differ in length")
        m = flat.reshape(len(ids), -1).T
        return _cut(row_block, m[:, n_traits:], m[:, :n_traits][:, ::-1], width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, terms, values = None, [], []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            blocks, t = batch.column("row_block").to_numpy(), batch.column("term_id").to_numpy()
            column = batch.column("values")
            at = np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
            flat = _finite(column.flatten().to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(blocks)]):
                if blocks[lo] != current:
                    if terms:
                        yield finish(current, terms, values)
                    current, terms, values = int(blocks[lo]), [], []
                terms.append(t[lo:hi])
                values.append(flat[at[lo] : at[hi]])
        if terms:
            yield finish(current, terms, values)

    return pack


def _row_block(n_samples: int, n_terms: int, width: int) -> tuple[Column, int]:
    """Samples are unique, so their hash spreads them evenly over row blocks."""
    n = max(1, -(-n_samples // rows_per_block(n_terms, width)))
    return F.pmod(F.xxhash64("sample"), F.lit(n)), n


def _scale(var: list[float | None]) -> np.ndarray:
    sd = np.sqrt(np.array([v or 0.0 for v in var]))
    return np.where(sd > 0, sd, 1.0)


def _kept(blocks: DataFrame, n_samples: int, n_terms: int, n_parts: int, check: bool) -> tuple[DataFrame, DurableTable | None]:
    """Row blocks that scans can read again and again. ``check`` packs them now, so that a bad table fails here."""
    written = None
    try:
        if 8.0 * n_samples * n_terms > DURABLE_BYTES:
            written = DurableTable(blocks, "tiles")
            # Tasks as large as planned, by putting file splits together.
            blocks = written.df.coalesce(n_parts)
        else:
            blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        rows = blocks.agg(F.sum("n_rows")).first()[0] if check or written else n_samples
    except PythonException as err:
        blocks.unpersist()
        found = re.search(r"BadShape: (.*)", str(err))
        if found:
            raise BadShape(found.group(1)) from err
        raise
    if rows != n_samples:
        raise BadShape(f"{rows} samples in tiles, {n_samples} in the table")
    return blocks, written


def from_vectors(
    df: DataFrame, traits: tuple[str, ...], pairs: bool = False, width: int = TILE_WIDTH, row_block: Column | None = None
) -> TileSet:
    """Tiles from ``(sample, values array<double>, <one double column per trait>)``.

    Only the outcomes are read ahead, for their means; packing itself checks the values.
    """
    first = df.select(F.size("values").alias("n")).first()
    if first is None or first.n < 1:
        raise BadShape("no samples or no terms")
    ys = [F.col(f"`{t}`").cast("double") for t in traits]
    stats = df.agg(
        F.count("*").alias("n"), *[F.avg(y).alias(f"m{i}") for i, y in enumerate(ys)], *[F.var_pop(y).alias(f"v{i}") for i, y in enumerate(ys)]
    ).first()
    packed_ys = F.array(*ys) if traits else F.array().cast("array<double>")
    rows = df.select("sample", F.col("values").cast("array<double>").alias("values"), packed_ys.alias("ys"))
    n_terms = int(first.n)
    width = min(width, n_terms)
    block, n_blocks = _row_block(stats.n, n_terms, width)
    if row_block is not None:
        block, n_blocks = row_block, stats.n
    n_parts = partitions_for(stats.n, n_terms, pairs, n_blocks, cores(df))
    keyed = rows.select(block.cast("long").alias("row_block"), "sample", "values", "ys")
    ordered = keyed.repartition(n_parts, "row_block").sortWithinPartitions("row_block", "sample")
    packed = ordered.select("row_block", "values", "ys").mapInArrow(_pack_vectors(n_terms, len(traits), width), BLOCK_SCHEMA)
    blocks, written = _kept(packed, int(stats.n), n_terms, n_parts, check=True)
    return TileSet(
        blocks,
        int(stats.n),
        n_terms,
        width,
        tuple(traits),
        np.array([stats[f"m{i}"] for i in range(len(traits))], dtype=float),
        _scale([stats[f"v{i}"] for i in range(len(traits))]),
        n_parts,
        written,
    )


def from_long(
    long: DataFrame,
    phenotypes: DataFrame,
    traits: tuple[str, ...],
    pairs: bool = False,
    width: int = TILE_WIDTH,
    n_terms: int | None = None,
) -> TileSet:
    """Tiles from ``(sample, term_id, value)`` and ``(sample, trait, y)``, by one shuffle of the cells.

    Term ids must be 0, 1, 2, ... and every sample must have every term and trait. With ``n_terms``
    from a catalogue the cells are read only once.
    """
    n_cells = None
    if n_terms is None:
        seen = long.agg(F.max("term_id").alias("last"), F.count("*").alias("cells")).first()
        if not seen.cells:
            raise BadShape("no genotype cells")
        n_terms = int(seen["last"]) + 1
        n_cells = seen.cells
    index = F.lit(0)
    for i, t in enumerate(traits):
        index = F.when(F.col("trait") == t, F.lit(i)).otherwise(index)
    chosen = phenotypes.filter(F.col("trait").isin(list(traits)))
    per_trait = {
        r.trait: r for r in chosen.groupBy("trait").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v")).collect()
    }
    n_samples = int(max((r.n for r in per_trait.values()), default=0))
    for t in traits:
        if t not in per_trait or per_trait[t].n != n_samples:
            raise BadShape(f"trait {t} does not have one value for each of {n_samples} samples")
    if n_cells not in (None, n_terms * n_samples):
        raise BadShape(f"{n_cells} cells for {n_terms} terms and {n_samples} samples")
    width = min(width, n_terms)
    block, n_blocks = _row_block(n_samples, n_terms, width)
    cells = long.select("sample", F.col("term_id").cast("long").alias("term_id"), F.col("value").cast("double").alias("value"))
    outcome = chosen.select("sample", (-1 - index).cast("long").alias("term_id"), F.col("y").cast("double").alias("value"))
    keyed = cells.unionByName(outcome).withColumn("row_block", block.cast("long"))
    n_parts = partitions_for(n_samples, n_terms, pairs, n_blocks, cores(long))
    ordered = keyed.repartition(n_parts, "row_block").sortWithinPartitions("row_block", "sample", "term_id")
    packed = ordered.select("row_block", "term_id", "value").mapInArrow(_pack_cells(n_terms, len(traits), width), BLOCK_SCHEMA)
    blocks, written = _kept(packed, n_samples, n_terms, n_parts, check=False)
    return TileSet(
        blocks,
        n_samples,
        n_terms,
        width,
        tuple(traits),
        np.array([per_trait[t].m for t in traits], dtype=float),
        _scale([per_trait[t].v for t in traits]),
        n_parts,
        written,
    )


def matrix(buffer: pa.Buffer, n_rows: int) -> np.ndarray:
    return np.frombuffer(buffer, dtype=np.float64).reshape(n_rows, -1)


def read_row_blocks(batches: Iterator[pa.RecordBatch], which: Sequence[int]) -> Iterator[tuple[int, dict[int, np.ndarray]]]:
    """Each row block as matrices by term block; ``which`` tells the blocks that were selected."""
    for batch in batches:
        ids, rows = batch.column("row_block").to_pylist(), batch.column("n_rows").to_pylist()
        for r, (row_block, n) in enumerate(zip(ids, rows)):
            tiles = batch.column("x")[r].values
            held = {b: matrix(tiles[i].as_buffer(), n) for i, b in enumerate(which)}
            held[Y_BLOCK] = matrix(batch.column("y")[r].as_buffer(), n) if len(batch.column("y")[r].as_buffer()) else np.zeros((n, 0))
            yield row_block, held


def from_term_vectors(
    terms: DataFrame, outcomes: DataFrame, traits: tuple[str, ...], n_terms: int, pairs: bool = False, width: int = TILE_WIDTH
) -> TileSet:
    """Tiles from whole term vectors ``(term_id, values)`` and outcomes ``(trait, values)`` in the same sample order.

    Vectors are cut into slices of a row block's samples, and one shuffle brings the slices of a row
    block together: cells never become records of their own.
    """
    chosen = outcomes.filter(F.col("trait").isin(list(traits))).select("trait", F.col("values").cast("array<double>").alias("values"))
    stats = {
        r.trait: r
        for r in chosen.select("trait", F.explode("values").alias("y"))
        .groupBy("trait")
        .agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
        .collect()
    }
    n_samples = int(max((r.n for r in stats.values()), default=0))
    for t in traits:
        if t not in stats or stats[t].n != n_samples:
            raise BadShape(f"trait {t} does not have one value for each of {n_samples} samples")
    width = min(width, n_terms)
    size = rows_per_block(n_terms, width)
    n_blocks = -(-n_samples // size)
    index = F.lit(0)
    for i, t in enumerate(traits):
        index = F.when(F.col("trait") == t, F.lit(i)).otherwise(index)
    vectors = terms.select(F.col("term_id").cast("long").alias("term_id"), F.col("values").cast("array<double>").alias("values"))
    ys = chosen.select((-1 - index).cast("long").alias("term_id"), "values")
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("row_block")
    # The last slice takes the rest, so that a vector of another length shows.
    length = F.when(F.col("row_block") == n_blocks - 1, F.lit(2**31 - 1)).otherwise(F.lit(size))
    slices = vectors.unionByName(ys).select("term_id", "values", blocks).select(
        F.col("row_block").cast("long").alias("row_block"), "term_id", F.slice("values", F.col("row_block") * size + 1, length).alias("values")
    )
    n_parts = partitions_for(n_samples, n_terms, pairs, n_blocks, cores(terms))
    ordered = slices.repartition(n_parts, "row_block").sortWithinPartitions("row_block", "term_id")
    packed = ordered.mapInArrow(_pack_slices(n_terms, len(traits), width), BLOCK_SCHEMA)
    kept, written = _kept(packed, n_samples, n_terms, n_parts, check=True)
    return TileSet(
        kept,
        n_samples,
        n_terms,
        width,
        tuple(traits),
        np.array([stats[t].m for t in traits], dtype=float),
        _scale([stats[t].v for t in traits]),
        n_parts,
        written,
    )
