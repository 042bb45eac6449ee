"""Queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(column, digits: int = 6):
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def rounded_many(column: str, digits: int):
    """``rounded`` for very many doubles: the same numbers, mostly without a decimal number for each.

    Away from ties (by far more than the products' error of some 2e-4) the nearest whole number is certain, and
    dividing it gives the double next to the decimal number, as ``round`` does.
    """
    value = F.col(column) * float(10**digits)
    certain = (F.abs(value) < 1e12) & (F.abs(value - F.floor(value) - 0.5) > 1e-3)
    return F.when(certain, F.floor(value + 0.5) / float(10**digits)).otherwise(F.round(column, digits)) + F.lit(0.0)


# The embeddings stand in for a genotype table: vec_id is the sample, positions are terms.
N_TERMS = 64


def emb():
    return F.col("embedding").cast("array<double>")


def entry_at(i: int):
    return F.col("embedding")[i].cast("double")


# Two outcomes that depend on a few known terms (0-based positions).
def y1():
    e = entry_at
    return F.col("label") + 40.0 * e(3) - 30.0 * e(10) + 500.0 * e(5) * e(7)


def y2():
    return F.col("label") - 25.0 * entry_at(19) + 35.0 * entry_at(32)


_D = "CAST(embedding[{}] AS DOUBLE)"
SQL_Y1 = f"(label + 40.0::DOUBLE * {_D.format(4)} - 30.0::DOUBLE * {_D.format(11)} + 500.0::DOUBLE * {_D.format(6)} * {_D.format(8)})"
SQL_Y2 = f"(label - 25.0::DOUBLE * {_D.format(20)} + 35.0::DOUBLE * {_D.format(33)})"

# (sample, term_id, value) in SQL.
SQL_LONG = (
    "SELECT vec_id AS sample, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS term_id, "
    "CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings"
)


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``(sample, values, y, y2)``."""
    rows = table(spark, folder, "embeddings")
    return rows.select(F.col("vec_id").alias("sample"), emb().alias("values"), y1().alias("y"), y2().alias("y2"))


def wide_names() -> list[str]:
    return [f"e{i}" for i in range(N_TERMS)]


def wide(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings with one column per position."""
    rows = table(spark, folder, "embeddings")
    return rows.select(F.col("vec_id").alias("sample"), *[entry_at(i).alias(n) for i, n in enumerate(wide_names())])


SQL_WIDE = "SELECT vec_id AS sample, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(N_TERMS)
) + " FROM embeddings"
