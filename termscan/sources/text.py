"""Readers for delimited text, term-major, sample-major and marker tables, and JSON lines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termscan.errors import BadShape, DuplicateTerms
from termscan.operators import grid
from termscan.session import small_enough_to_broadcast

# First cells that mark the line of sample names in a term-major file (fixed values).
HEADER_MARKS = ("HeaderLine", "Headerline")

# Leading columns of a marker table: name, allele, chromosome, position, genetic distance.
MARKER_COLUMNS = ("term", "allele", "chr", "pos", "cm")


@dataclass(frozen=True)
class TermTable:
    """A genotype or phenotype table in long form with its two catalogues.

    ``values(sample_pos, term_id, value)``, ``samples(sample_pos, sample)``, ``terms(term_id, term)``,
    and where the file has one line per term also ``vectors(term_id, values)`` in sample order.
    """

    values: DataFrame
    samples: DataFrame
    terms: DataFrame
    vectors: DataFrame | None = None

    def long(self) -> DataFrame:
        """``(sample, term_id, value)``, the form the scans take."""
        return self.values.join(self.samples, "sample_pos").select("sample", "term_id", "value")


def _numbered(spark: SparkSession, path: str, **sums: Column) -> tuple[DataFrame, list]:
    """``(row, line)`` with dense row numbers in file order, and one record per input split.

    Each split numbers its own lines; only one record per split, with any further ``sums`` of its
    lines, is added up to place the splits, so no task sees more than its split. A split that is
    planned differently on the second read fails loudly instead of shifting rows.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"),
        F.monotonically_increasing_id().alias("mid"),
    )
    key = ["file", "start", "length", "part"]
    raw = raw.withColumn("part", F.shiftright("mid", 33))
    found = raw.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("mid").alias("first"), *[c.alias(k) for k, c in sums.items()]
    )
    splits = found.orderBy("file", "start").collect()
    placed, total = [], 0
    for s in splits:
        placed.append((s.file, s.start, s.length, s.part, total - s["first"]))
        total += s.n
    shifts = spark.createDataFrame(placed, "file string, start long, length long, part long, shift long")
    if small_enough_to_broadcast(len(placed) * 300):
        shifts = F.broadcast(shifts)
    lost = F.raise_error(F.lit("an input split changed between two reads of the same file"))
    lines = raw.join(shifts, key, "left").select(
        F.when(F.col("shift").isNull(), lost).otherwise(F.col("mid") + F.col("shift")).alias("row"), "line"
    )
    return lines, [(s, p[4]) for s, p in zip(splits, placed)]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(row, line)``: rows are numbered from 0 in file order, files by path."""
    return _numbered(spark, path)[0]


def _cells(lines: DataFrame, delimiter: str) -> DataFrame:
    return lines.select("row", F.split("line", delimiter).alias("cells"))


def read_delimited(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """Grid rows ``(row, cells)``; ``delimiter`` is a regular expression."""
    return _cells(read_lines(spark, path), delimiter)


def read_grid(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """Cells ``(row, col, cell)``; the pass that places the splits also finds ragged rows."""
    size = F.size(F.split("line", delimiter))
    lines, splits = _numbered(spark, path, low=F.min(size), high=F.max(size))
    low, high = min(s.low for s, _ in splits), max(s.high for s, _ in splits)
    if low != high:
        raise BadShape(f"rows have between {low} and {high} cells")
    return grid.to_cells(_cells(lines, delimiter), checked=True)


def _ragged(expected: Column) -> Column:
    return F.raise_error(F.concat(F.lit("ragged row "), F.col("row"), F.lit(", expected cells: "), expected))


def _typed_rows(rows: DataFrame, is_data: Column, n_cells: int, first: int) -> DataFrame:
    """``(row, name, values)`` of data rows from the cells at ``first`` and after, checked and cast to double.

    The condition is part of the expression as well, since Spark may evaluate a cast before a filter.
    """
    checked = F.when(F.size("cells") == n_cells, F.col("cells")).otherwise(
        _ragged(F.lit(n_cells).cast("string")).cast("array<string>")
    )
    numbers = F.transform(F.slice("cells", first + 1, n_cells - first), lambda c: c.cast("double"))
    return (
        rows.filter(is_data)
        .select("row", F.when(is_data, checked).alias("cells"))
        .select("row", F.col("cells")[0].alias("name"), F.when(is_data, numbers).alias("values"))
    )


def _typed_cells(rows: DataFrame, is_data: Column, n_cells: int, first: int) -> DataFrame:
    """``(row, name, at, value)``: the same with one record per value."""
    return _typed_rows(rows, is_data, n_cells, first).select("row", "name", F.posexplode("values").alias("at", "value"))


def require_unique(names: DataFrame, column: str) -> DataFrame:
    """The same rows; a repeated name raises."""
    repeated = names.groupBy(column).count().filter("count > 1").limit(3).collect()
    if repeated:
        raise DuplicateTerms(f"repeated names in {column}: {[r[column] for r in repeated]}")
    return names


def _name(delimiter: str) -> Column:
    """The first cell, without splitting the rest of the line."""
    return F.split("line", delimiter, 2)[0]


def read_term_major(spark: SparkSession, path: str, delimiter: str = "\t") -> TermTable:
    """A file with a line of sample names, then one line per term.

    The catalogues are kept, so that looking at names does not read the file again.
    """
    mark = _name(delimiter).isin(*HEADER_MARKS)
    lines, splits = _numbered(spark, path, marks=F.count_if(mark), marked=F.max(F.when(mark, F.col("mid"))))
    if sum(s.marks for s, _ in splits) != 1:
        raise BadShape(f"a term-major file needs exactly one {HEADER_MARKS[0]} line")
    header_row = next(s.marked + shift for s, shift in splits if s.marks)
    header = lines.filter(F.col("row") == header_row)
    n_cells = header.select(F.size(F.split("line", delimiter))).first()[0]
    is_data = F.col("row") != header_row
    data = lines.filter(is_data)
    # One cell per sample after the name; term numbers follow the file.
    cells = _typed_cells(_cells(lines, delimiter), is_data, n_cells, 1)
    term_id = (F.col("row") - (F.col("row") > header_row).cast("long")).alias("term_id")
    terms = data.select(term_id, _name(delimiter).alias("term")).persist()
    samples = _cells(header, delimiter).select(F.posexplode(F.slice("cells", 2, n_cells - 1)).alias("sample_pos", "sample"))
    values = cells.select(F.col("at").alias("sample_pos"), term_id, "value")
    vectors = _typed_rows(_cells(lines, delimiter), is_data, n_cells, 1).select(term_id, "values")
    return TermTable(values, samples.persist(), require_unique(terms, "term"), vectors)


def read_sample_major(
    spark: SparkSession, path: str, drop: Sequence[int] = (), transpose: bool = False
) -> DataFrame:
    """A typed wide table: first column string, all others double.

    Columns are dropped by position before the optional transposition. The plain form is one csv
    scan that reads only the columns a query needs; meant for up to a few thousand columns. In a folder
    of part files each part's header must have the columns of the first one, in their order.
    """
    if transpose:
        cells = grid.transpose(grid.drop_columns(read_grid(spark, path), drop))
        return grid.to_typed_wide(cells)
    names = spark.read.text(path).first()[0].split("\t")
    if len(set(names)) != len(names):
        raise DuplicateTerms(f"repeated column names in {path}")
    schema = T.StructType([T.StructField(n, T.StringType() if i == 0 else T.DoubleType()) for i, n in enumerate(names)])
    # Dropped columns may hold anything, so they are declared as strings.
    for i in drop:
        if 0 < i < len(names):
            schema[i].dataType = T.StringType()
    df = spark.read.csv(path, header=True, sep="\t", schema=schema, mode="FAILFAST", enforceSchema=False)
    return df.select(*[F.col(f"`{n}`") for i, n in enumerate(names) if i not in set(drop)])


def read_sample_major_long(
    spark: SparkSession, path: str, drop: Sequence[int] = (), delimiter: str = "\t"
) -> TermTable:
    """The same file straight to long form, for any number of terms."""
    rows = read_delimited(spark, path, delimiter)
    if drop:
        dropped = F.array(*[F.lit(i) for i in drop])
        rows = rows.select("row", F.filter("cells", lambda c, i: ~F.array_contains(dropped, i)).alias("cells"))
    head = rows.filter(F.col("row") == 0)
    n_cells = head.select(F.size("cells")).first()[0]
    terms = head.select(F.posexplode(F.slice("cells", 2, n_cells - 1)).alias("term_id", "term"))
    data = rows.filter(F.col("row") > 0)
    cells = _typed_cells(rows, F.col("row") > 0, n_cells, 1)
    samples = data.select((F.col("row") - 1).alias("sample_pos"), F.col("cells")[0].alias("sample"))
    return TermTable(
        cells.select((F.col("row") - 1).alias("sample_pos"), F.col("at").cast("long").alias("term_id"), "value"),
        samples,
        require_unique(terms.withColumn("term_id", F.col("term_id").cast("long")).persist(), "term"),
    )


@dataclass(frozen=True)
class SampleRows:
    """A sample-major file as one vector per sample, ``rows(sample, values)``, and ``terms(term_id, term)``."""

    rows: DataFrame
    terms: DataFrame


def read_sample_rows(spark: SparkSession, path: str, drop: Sequence[int] = (), delimiter: str = "\t") -> SampleRows:
    """A sample-major file for any number of terms, a record per sample; cells never become records of their own.

    Columns are dropped by position, counted from the sample column at 0.
    """
    rows = read_delimited(spark, path, delimiter)
    if 0 in drop:
        raise BadShape("the column of samples cannot be dropped")
    if drop:
        dropped = F.array(*[F.lit(i) for i in drop])
        rows = rows.select("row", F.filter("cells", lambda c, i: ~F.array_contains(dropped, i)).alias("cells"))
    head = rows.filter(F.col("row") == 0)
    n_cells = head.select(F.size("cells")).first()[0]
    terms = head.select(F.posexplode(F.slice("cells", 2, n_cells - 1)).alias("term_id", "term"))
    data = _typed_rows(rows, F.col("row") > 0, n_cells, 1).select(F.col("name").alias("sample"), "values")
    return SampleRows(data, require_unique(terms.withColumn("term_id", F.col("term_id").cast("long")).persist(), "term"))


def read_marker_table(spark: SparkSession, path: str, delimiter: str = "\t") -> tuple[TermTable, DataFrame]:
    """A marker-major file with five leading metadata columns: the long table and the metadata.

    Metadata cells may be ``NA`` (null); a value cell that is no number raises.
    """
    rows = read_delimited(spark, path, delimiter)
    lead = len(MARKER_COLUMNS)
    head = rows.filter(F.col("row") == 0)
    n_cells = head.select(F.size("cells")).first()[0]
    samples = head.select(F.posexplode(F.slice("cells", lead + 1, n_cells - lead)).alias("sample_pos", "sample"))
    data = rows.filter(F.col("row") > 0)
    term_id = (F.col("row") - 1).alias("term_id")
    known = [F.when(F.col("cells")[i] != "NA", F.col("cells")[i]) for i in range(lead)]
    markers = data.select(
        term_id,
        known[0].alias("term"),
        known[1].alias("allele"),
        known[2].cast("int").alias("chr"),
        known[3].cast("long").alias("pos"),
        known[4].cast("double").alias("cm"),
    )
    cells = _typed_cells(rows, F.col("row") > 0, n_cells, lead)
    values = cells.select(F.col("at").alias("sample_pos"), term_id, "value")
    markers = markers.persist()
    terms = require_unique(markers.select("term_id", "term"), "term")
    return TermTable(values, samples.persist(), terms), markers


def read_json_terms(spark: SparkSession, path: str, sample: str = "Sample") -> DataFrame:
    """JSON lines: the sample column as string, every other column as double."""
    columns = spark.read.json(path).columns
    ordered = [sample] + [c for c in columns if c != sample]
    schema = T.StructType([T.StructField(c, T.StringType() if c == sample else T.DoubleType()) for c in ordered])
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def dense_ids(names: DataFrame, column: str, buckets: int = 256) -> DataFrame:
    """``(term_id, <column>)`` with dense ids in sorted order of the distinct names.

    Range partitions number their own names; only one count per partition is added up. The
    sorted names are written to the shared folder first so that both uses see the same ranges.
    """
    from termscan.session import DurableTable

    ranged = names.select(column).distinct().repartitionByRange(buckets, column)
    ranged = ranged.withColumn("part", F.spark_partition_id())
    fixed = DurableTable(ranged, "names").df
    counts = fixed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    return (
        fixed.withColumn("local", local)
        .join(F.broadcast(offsets), "part")  # at most ``buckets`` rows
        .select((F.col("offset") + F.col("local")).alias("term_id"), column)
    )
