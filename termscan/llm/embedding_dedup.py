"""Embedding near-dedup: all pairs of vectors by int8 tile products with rigorous error bounds.

A unit vector x is stored as s q + e with 8-bit codes q, a scale s and the length |e| of what is lost. For
two vectors |x.y - s t q.r| <= |e| (1 + |f|) + |f|, so a tile product of codes (exact: the sums stay
below the precision in which they are kept) tells which pairs can reach the threshold; only these are
computed again from the full vectors in double precision.

Equal vectors form one class. Classes are dealt to blocks around pivots; two blocks whose angular
distance, less their radii, exceeds the threshold's angle are skipped, which is exact. A task holds two
blocks of bounded size, whatever the data hold, and returns link counts and a spanning forest of the
links it finds, never the pairs themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscan.llm.common import components, durable, small_batches

THRESHOLD = 0.95
#: Vectors of a block, and rows of one tile product.
BLOCK, TILE = 4096, 512
#: Pivots: a sample of the vectors, bounded so that it can be broadcast whatever the table's size.
PIVOTS = 256
#: Links that are merged at once within a task.
EDGES = 1 << 20


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = np.asarray(values, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and the lengths of the quantisation errors of unit rows."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    lost = x - codes * scale[:, None]
    return codes, scale, np.sqrt((lost * lost).sum(axis=1)) * (1 + 1e-12) + 1e-15


def _codes_as(codes: np.ndarray) -> np.ndarray:
    """Codes in a type whose sums of products are exact: 127 * 127 * width must stay below 2^24 or 2^53."""
    return codes.astype(np.float32 if codes.shape[1] <= 1040 else np.float64)


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool):
    """Index arrays of the pairs of unit rows with cosine >= threshold, tile by tile; ``same``: only i < j."""
    (cx, sx, ex), (cy, sy, ey) = quantise(x), quantise(y)
    cx, cy = _codes_as(cx), _codes_as(cy)
    for at in range(0, len(x), TILE):
        rows = slice(at, at + TILE)
        for on in range(at if same else 0, len(y), TILE):
            cols = slice(on, on + TILE)
            near = (cx[rows] @ cy[cols].T).astype(np.float64)
            near *= sx[rows, None]
            near *= sy[None, cols]
            # the bound per pair, with room for the rounding of the sums themselves
            near += (ex[rows] * (1 + ey[cols].max()))[:, None] + ey[None, cols] + 1e-9
            i, j = np.nonzero(near >= threshold)
            i, j = i + at, j + on
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), EDGES // 16):
                a, b = i[k : k + EDGES // 16], j[k : k + EDGES // 16]
                hit = (x[a] * y[b]).sum(axis=1) >= threshold
                yield a[hit], b[hit]


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining ``i`` and ``j``: each node's smallest label in its component."""
    own = np.arange(len(label))
    i, j = np.concatenate([i, own]), np.concatenate([j, label])
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _read(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _tile(key, table):
    """One pair of blocks: ``(kind, a, b)``, kind 0 for a's links weighted by copies, kind 1 for an edge."""
    node, copies, side = (table.column(c).to_numpy() for c in ("node", "copies", "side"))
    x = unit_rows(_read(table.column("vector")))
    same = bool((side == 2).all())
    left, right = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    links, label = np.zeros(len(x), np.int64), np.arange(len(x))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in linked_pairs(x[left], x[right], THRESHOLD, same):
        i, j = left[i], right[j]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        held.append((i, j))
        if sum(len(h[0]) for h in held) >= EDGES:
            label, held = merge(label, *map(np.concatenate, zip(*held, strict=True))), []
    if held:
        label = merge(label, *map(np.concatenate, zip(*held, strict=True)))
    some, tied = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(label)))
    return pa.table({
        "kind": pa.array(np.repeat([0, 1], [len(some), len(tied)]), pa.int32()),
        "a": pa.array(np.concatenate([node[some], node[tied]]), pa.int64()),
        "b": pa.array(np.concatenate([links[some], node[label[tied]]]), pa.int64()),
    })


def _assigned(shared):
    """Each vector's nearest pivot and its angle to it."""

    def run(batches):
        pivots = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(_read(pa.chunked_array([batch.column("vector")])))
            cosine = np.clip(x @ pivots.T, -1.0, 1.0)
            cell = cosine.argmax(axis=1)
            angle = np.arccos(cosine[np.arange(len(x)), cell])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("node", "copies", "vector")]
                + [pa.array(cell.astype(np.int64)), pa.array(angle)], ["node", "copies", "vector", "cell", "angle"])

    return run


def near_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors``.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, and
    so do vectors of different lengths. Equal vectors are linked; a repeated id is another vector each
    time it stands, with a row and a component of its own. Rows with a null id get null results and count
    as no link. Only the two named columns are read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    value = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(
        (F.size(value) > 0) & F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(value, lambda v: v != 0.0), F.lit(False))
    # adding zero turns -0.0 into 0.0, so that equal vectors are equal keys
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine & F.col(id_col).isNotNull(), F.transform(value, lambda v: v + 0.0)).alias("vector"))
    usable = rows.where("vector IS NOT NULL")
    classes = usable.groupBy("vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # classes have numbers of their own, as an id may stand for several vectors
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    tiled = []
    for (width,) in classes.select(F.size("vector")).distinct().collect():
        tiled.append(_blocks(classes.where(F.size("vector") == width)))
    none = spark.range(0)
    found = none.select(F.lit(0).alias("kind"), F.col("id").alias("a"), F.col("id").alias("b"))
    for part in tiled:
        found = found.union(part.groupBy("pair").applyInArrow(_tile, "kind int, a long, b long"))
    found = durable(found, "links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    label = components(found.where("kind = 1").select("a", "b"))
    per_class = classes.select("node", "first", "copies").join(counts, "node", "left").join(label, "node", "left").select(
        "node", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    named = per_class.groupBy("component").agg(F.min("first").alias("component_id"))
    per_class = per_class.join(named, "component").select("node", "n_links", "component_id")
    member = usable.join(classes.select(F.col("vector").alias("v"), "node"), F.col("vector") == F.col("v")).select("id", "node")
    result = member.join(per_class, "node").select("id", "n_links", "component_id")
    alone = rows.where("vector IS NULL").select("id", F.when(F.col("id").isNotNull(), F.lit(0)).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return result.union(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _blocks(classes: DataFrame) -> DataFrame:
    """``(pair, side, node, copies, vector)``: each pair of blocks that can hold a link, with both blocks' rows."""
    spark = classes.sparkSession
    total = classes.count()
    n_pivots = max(1, min(PIVOTS, total // BLOCK))
    picked = classes.orderBy(F.xxhash64("node")).limit(n_pivots).select("vector").collect()
    pivots = unit_rows(np.array([r.vector for r in picked]))
    shared = spark.sparkContext.broadcast(pivots)
    kind = "node long, copies long, vector array<double>, cell long, angle double"
    placed = durable(classes.select("node", "copies", "vector").mapInArrow(_assigned(shared), kind), "cells")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()  # PIVOTS rows at most
    parts = {c.cell: math.ceil(c.n / BLOCK) for c in cells}
    # cells no farther apart than the threshold's angle and both radii, with room for rounding
    reach = math.acos(THRESHOLD) + 1e-6
    apart = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
    meet = [(p.cell, q.cell) for p in cells for q in cells if p.cell <= q.cell and apart[p.cell, q.cell] <= reach + p.radius + q.radius]
    sizes = spark.createDataFrame(list(parts.items()), "cell long, parts long")
    met = F.broadcast(spark.createDataFrame([(p, q, parts[p], parts[q]) for p, q in meet], "p long, q long, np long, nq long"))
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("node"), "parts")).drop("parts", "angle")
    left = dealt.join(met, F.col("cell") == F.col("p"))
    # within one cell, block i meets the blocks i and after
    first = F.when(F.col("p") == F.col("q"), F.col("part")).otherwise(F.lit(0)).cast("long")
    left = left.withColumn("other", F.explode(F.sequence(first, F.col("nq") - 1)))
    own = (F.col("p") == F.col("q")) & (F.col("part") == F.col("other"))
    left = left.select(F.struct("p", F.col("part").alias("i"), "q", F.col("other").alias("j")).alias("pair"),
                       F.when(own, F.lit(2)).otherwise(F.lit(0)).alias("side"), "node", "copies", "vector")
    right = dealt.join(met, F.col("cell") == F.col("q"))
    last = F.when(F.col("p") == F.col("q"), F.col("part") - 1).otherwise(F.col("np") - 1).cast("long")
    right = right.where(last >= 0).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    right = right.select(F.struct("p", F.col("other").alias("i"), "q", F.col("part").alias("j")).alias("pair"),
                         F.lit(1).alias("side"), "node", "copies", "vector")
    return left.union(right)
