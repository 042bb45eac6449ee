"""Untyped grids as cells ``(row, col, cell)``.

In this form dropping a column is a filter and a transposition is a projection, with no shuffle.
Only rendering whole lines gathers cells, in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscan.errors import BadShape, DuplicateTerms

# Cells that are joined to one piece before the pieces of a line are joined.
PIECE = 1024


def to_cells(rows: DataFrame, checked: bool = False) -> DataFrame:
    """``(row, cells array<string>)`` to cells; a ragged grid raises, unless that was ``checked`` before."""
    if not checked:
        sizes = rows.agg(F.min(F.size("cells")).alias("low"), F.max(F.size("cells")).alias("high")).first()
        if sizes.low != sizes.high:
            raise BadShape(f"rows have between {sizes.low} and {sizes.high} cells")
    return rows.select("row", F.posexplode("cells").alias("col", "cell")).withColumn("col", F.col("col").cast("long"))


def from_columns(df: DataFrame, row: str, columns: Sequence[str], header: bool = True) -> DataFrame:
    """Cells of a DataFrame with unique consecutive row numbers; row 0 is the header when asked."""
    shift = 1 if header else 0
    body = df.select(
        (F.col(row) + shift).alias("row"),
        F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("col", "cell"),
    )
    if header:
        names = df.sparkSession.createDataFrame([(0, i, c) for i, c in enumerate(columns)], "row long, col int, cell string")
        body = names.unionByName(body)
    return body.select(F.col("row").cast("long"), F.col("col").cast("long"), "cell")


def drop_columns(cells: DataFrame, columns: Sequence[int]) -> DataFrame:
    """Without the columns at these positions; the others close up. Positions out of range are ignored."""
    gone = sorted({int(c) for c in columns if c >= 0})
    if not gone:
        return cells
    shift = F.lit(0)
    for c in gone:
        shift = shift + (F.col("col") > c).cast("long")
    return cells.filter(~F.col("col").isin(gone)).withColumn("col", F.col("col") - shift)


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "cell")


def mark_header(cells: DataFrame, mark: str = "HeaderLine") -> DataFrame:
    """The top-left cell replaced by the header mark."""
    corner = (F.col("row") == 0) & (F.col("col") == 0)
    return cells.withColumn("cell", F.when(corner, F.lit(mark)).otherwise(F.col("cell")))


def select_column(cells: DataFrame, position: int) -> DataFrame:
    """``(row, cell)`` of the column at a position, header included."""
    return cells.filter(F.col("col") == position).select("row", "cell")


def select_column_named(cells: DataFrame, name: str) -> DataFrame:
    """``(row, cell)`` of the column whose header cell is ``name``; raises if several columns have it."""
    at = cells.filter((F.col("row") == 0) & (F.col("cell") == name)).select("col").limit(2)
    if at.count() > 1:
        raise DuplicateTerms(f"several columns are named {name!r}")
    return cells.join(F.broadcast(at), "col").select("row", "cell")


def head_rows(cells: DataFrame, n: int = 5) -> DataFrame:
    """Cells of the first rows, for a preview."""
    return cells.filter(F.col("row") < n)


def to_lines(cells: DataFrame, delimiter: str = "\t") -> DataFrame:
    """``(row, line)``: cells joined in column order, first in pieces of bounded size."""
    ordered = lambda key: F.transform(F.sort_array(F.collect_list(F.struct(key, "text"))), lambda s: s["text"])
    pieces = (
        cells.select("row", F.floor(F.col("col") / PIECE).alias("piece"), "col", F.col("cell").alias("text"))
        .groupBy("row", "piece")
        .agg(F.array_join(ordered("col"), delimiter).alias("text"))
    )
    return pieces.groupBy("row").agg(F.array_join(ordered("piece"), delimiter).alias("line"))


def to_typed_wide(cells: DataFrame) -> DataFrame:
    """A typed wide DataFrame: row 0 names the columns, the first column is a string, the rest doubles."""
    head = cells.filter(F.col("row") == 0).orderBy("col").collect()
    names = [r.cell for r in head]
    if len(set(names)) != len(names):
        raise BadShape("repeated column names")
    body = cells.filter(F.col("row") > 0).groupBy("row").pivot("col", [r.col for r in head]).agg(F.first("cell"))
    typed = [F.col(f"`{r.col}`").cast("string" if i == 0 else "double").alias(r.cell) for i, r in enumerate(head)]
    return body.select(*typed)
