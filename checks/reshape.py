"""Layouts, selection of rows and columns, alignment and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import N_TERMS, SQL_LONG, SQL_WIDE, SQL_Y1, SQL_Y2, query, rounded, table, vectors, wide, wide_names
from termscan.operators import grid, reshape, samples
from termscan.plans import jobs

# A supplier grid: text cells with the balance in cents, rows in key order from 0.
GRID = ["s_name", "s_nationkey", "cents"]
_CENTS = "CAST(CAST(round(s_acctbal * 100) AS BIGINT) AS VARCHAR)"
SQL_GRID = f"""cells AS (
  SELECT 0::BIGINT AS row, c::BIGINT AS col, ['s_name', 's_nationkey', 'cents'][c + 1] AS cell FROM range(3) t(c) WHERE EXISTS (SELECT 1 FROM supplier)
  UNION ALL SELECT s_suppkey - lo + 1, 0, s_name FROM supplier, (SELECT min(s_suppkey) AS lo FROM supplier)
  UNION ALL SELECT s_suppkey - lo + 1, 1, CAST(s_nationkey AS VARCHAR) FROM supplier, (SELECT min(s_suppkey) AS lo FROM supplier)
  UNION ALL SELECT s_suppkey - lo + 1, 2, {_CENTS} FROM supplier, (SELECT min(s_suppkey) AS lo FROM supplier))"""


def supplier_rows(spark, folder):
    s = table(spark, folder, "supplier")
    low = s.agg(F.min("s_suppkey")).first()[0]  # keys are consecutive
    cents = F.round(F.col("s_acctbal") * 100).cast("long")
    return s.select((F.col("s_suppkey") - low).alias("row"), "s_name", "s_nationkey", cents.alias("cents"))


def supplier_grid(spark, folder):
    return grid.from_columns(supplier_rows(spark, folder), "row", GRID)


@query(f"WITH {SQL_GRID} SELECT col AS row, row AS col, cell FROM cells")
def transpose_grid(spark, folder):
    return grid.transpose(supplier_grid(spark, folder))


@query(
    f"""WITH {SQL_GRID}, kept AS (SELECT row, col - (col > 1)::INT AS col, cell FROM cells WHERE col <> 1),
t AS (SELECT col AS row, row AS col, CASE WHEN row = 0 AND col = 0 THEN 'HeaderLine' ELSE cell END AS cell FROM kept)
SELECT row, string_agg(cell, chr(9) ORDER BY col) AS line FROM t GROUP BY row"""
)
def convert_format(spark, folder):
    """Columns dropped, transposed, corner marked, as lines of text."""
    return grid.to_lines(jobs.convert_cells(supplier_grid(spark, folder), drop=[1], transpose=True))


@query(f"WITH {SQL_GRID} SELECT row, col, cell FROM cells WHERE row < 5")
def head_rows(spark, folder):
    return grid.head_rows(supplier_grid(spark, folder))


@query(f"WITH {SQL_GRID} SELECT row, cell FROM cells WHERE col = 2")
def select_column_at(spark, folder):
    return grid.select_column(supplier_grid(spark, folder), 2)


@query(f"WITH {SQL_GRID} SELECT row, cell FROM cells WHERE col = 1")
def select_column_named(spark, folder):
    """The named column itself, header included."""
    return grid.select_column_named(supplier_grid(spark, folder), "s_nationkey")


@query("SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem")
def drop_columns_at(spark, folder):
    """Out-of-range positions are ignored."""
    kept = reshape.drop_columns_at(table(spark, folder, "lineitem"), [1, 5, 8, 99])
    return kept.withColumn("shipped", F.date_format("l_shipdate", "yyyy-MM-dd")).drop("l_shipdate")


@query(
    "SELECT s_suppkey AS sample, CAST(s_nationkey AS VARCHAR) || '|' || "
    "CAST(CAST(round(s_acctbal * 100) AS BIGINT) AS VARCHAR) AS cells FROM supplier"
)
def row_vectors(spark, folder):
    """Each supplier's values as one vector, shown as text."""
    rows = reshape.row_vectors(table(spark, folder, "supplier"), "s_suppkey", ["s_nationkey", "s_acctbal"])
    whole = lambda x: F.round(x).cast("long").cast("string")
    return rows.select("sample", F.concat_ws("|", whole(F.col("values")[0]), whole(F.col("values")[1] * 100)).alias("cells"))


@query(
    f"""WITH w AS ({SQL_WIDE}) SELECT sample, term, round(value, 6) + 0.0 AS value
FROM (UNPIVOT w ON COLUMNS(* EXCLUDE (sample)) INTO NAME term VALUE value)"""
)
def wide_to_long(spark, folder):
    long = reshape.wide_to_long(wide(spark, folder), "sample", wide_names())
    return long.select("sample", "term", rounded("value").alias("value"))


@query("SELECT sample, " + ", ".join(f"round(e{i}, 6) + 0.0 AS t{i}" for i in range(N_TERMS)) + f" FROM ({SQL_WIDE})")
def long_to_wide(spark, folder):
    long = reshape.vectors_to_long(vectors(spark, folder), "sample", "values")
    back = reshape.long_to_wide(long, range(N_TERMS), term="term_id")
    return back.select("sample", *[rounded(f"`{i}`").alias(f"t{i}") for i in range(N_TERMS)])


BLOCK = 128


@query(
    f"""WITH l AS ({SQL_LONG}), b AS (SELECT term_id, sample // {BLOCK} AS block, sample, value FROM l)
SELECT term_id, block::BIGINT AS block, min(sample) AS first_pos, count(*) AS n,
  round(sum(value), 6) + 0.0 AS total, round(sum(value * (sample - lo + 1)), 5) + 0.0 AS weighted
FROM (SELECT *, min(sample) OVER (PARTITION BY term_id, block) AS lo FROM b) GROUP BY term_id, block"""
)
def term_vectors(spark, folder):
    """Blocked term vectors; the weighted sum shows their order."""
    long = reshape.vectors_to_long(vectors(spark, folder), "sample", "values")
    v = reshape.term_vectors(long, "sample", BLOCK)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return v.select(
        "term_id",
        "block",
        "first_pos",
        F.size("values").cast("long").alias("n"),
        rounded(add(F.col("values"))).alias("total"),
        rounded(add(F.transform("values", lambda x, i: x * (i + 1))), 5).alias("weighted"),
    )


@query(
    f"SELECT sample, round(e0, 6) + 0.0 AS e0, round(e63, 6) + 0.0 AS e63, label FROM ({SQL_WIDE}) "
    "JOIN (SELECT vec_id AS sample, label FROM embeddings) USING (sample)"
)
def bind_terms(spark, folder):
    """Two tables of the same samples side by side."""
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample"), "label")
    both = reshape.bind_terms(wide(spark, folder), labels)
    return both.select("sample", rounded("e0").alias("e0"), rounded("e63").alias("e63"), "label")


@query("SELECT c_custkey AS sample, c_mktsegment, n FROM customer JOIN (SELECT c_custkey AS k, c_nationkey AS n FROM customer) ON k = c_custkey")
def join_phenotype_strict(spark, folder):
    """The join that first sees to it that both sides have the same samples."""
    c = table(spark, folder, "customer")
    left = c.select(F.col("c_custkey").alias("sample"), "c_mktsegment")
    return samples.join_phenotype(left, c.select(F.col("c_custkey").alias("sample"), F.col("c_nationkey").alias("n")), strict=True)


@query(
    "SELECT o_orderkey AS sample, c_mktsegment, round(c_acctbal, 2) + 0.0 AS c_acctbal, round(o_totalprice, 2) + 0.0 AS y "
    "FROM orders JOIN customer ON o_custkey = c_custkey"
)
def join_phenotype(spark, folder):
    """Inner join of a large table with the outcomes of its keys."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("sample"), "c_mktsegment", "c_acctbal")
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("sample"), "o_orderkey", "o_totalprice")
    joined = samples.join_phenotype(o, c)
    return joined.select(
        F.col("o_orderkey").alias("sample"), "c_mktsegment", rounded("c_acctbal", 2).alias("c_acctbal"), rounded("o_totalprice", 2).alias("y")
    )


@query(
    """SELECT coalesce(a, b) AS sample, CASE WHEN a IS NULL THEN 'left' ELSE 'right' END AS missing_in
FROM (SELECT DISTINCT o_orderkey AS a FROM orders) FULL JOIN (SELECT DISTINCT l_orderkey AS b FROM lineitem) ON a = b
WHERE a IS NULL OR b IS NULL"""
)
def sample_mismatch(spark, folder):
    """Orders without lines, and lines without orders."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("sample"))
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("sample"))
    return samples.sample_mismatch(o, li)


@query(
    """SELECT pos, c_custkey AS sample, round(c_acctbal, 2) + 0.0 AS c_acctbal FROM customer
JOIN (SELECT c_custkey, (SELECT max(c_custkey) FROM customer) - c_custkey AS pos FROM customer) USING (c_custkey)"""
)
def align_rows(spark, folder):
    """Customers in a given order, here from the last key to the first."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("sample"), "c_acctbal")
    last = c.agg(F.max("sample")).first()[0]
    order = c.select("sample", (F.lit(last) - F.col("sample")).alias("pos"))
    return samples.align_rows(c, order).select("pos", "sample", rounded("c_acctbal", 2).alias("c_acctbal"))


@query(
    f"SELECT vec_id AS pos, vec_id AS sample, round({SQL_Y1}, 6) + 0.0 AS y, round({SQL_Y2}, 6) + 0.0 AS y2 FROM embeddings"
)
def positional_join(spark, folder):
    """Row i of one table with row i of another; names must agree."""
    v = vectors(spark, folder).withColumn("pos", F.col("sample"))
    joined = samples.positional_join(v.select("pos", "sample", "y"), v.select("pos", "sample", "y2"))
    return joined.select("pos", "sample", rounded("y").alias("y"), rounded("y2").alias("y2"))


@query("SELECT CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS term_id, c_mktsegment AS term FROM (SELECT DISTINCT c_mktsegment FROM customer)", name="dense_term_ids")
def dense_term_ids(spark, folder):
    """Names numbered in sorted order without a global sort in one task."""
    from termscan.sources.text import dense_ids

    return dense_ids(table(spark, folder, "customer").select(F.col("c_mktsegment").alias("term")), "term", 4)


