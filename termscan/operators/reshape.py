"""Wide, long and term-vector layouts of sample x term tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors_to_long(df: DataFrame, sample: str, values: str) -> DataFrame:
    """One array per sample to ``(sample, term_id, value)``."""
    return df.select(
        F.col(sample).alias("sample"),
        F.posexplode(F.col(values).cast("array<double>")).alias("term_id", "value"),
    ).withColumn("term_id", F.col("term_id").cast("long"))


def wide_to_long(df: DataFrame, sample: str, terms: Sequence[str]) -> DataFrame:
    """One column per term to ``(sample, term, value)``; one pass over each row, whatever its width."""
    values = F.array(*[F.col(f"`{t}`").cast("double") for t in terms])
    names = F.array(*[F.lit(t) for t in terms])
    return df.select(F.col(sample).alias("sample"), F.posexplode(values).alias("at", "value")).select(
        "sample", names[F.col("at")].alias("term"), "value"
    )


def long_to_wide(long: DataFrame, terms: Sequence, sample: str = "sample", term: str = "term") -> DataFrame:
    """One column per listed term; the list is given, so no extra pass looks for it. A repeated cell raises."""
    twice = F.raise_error(F.lit("a cell occurs twice")).cast("double")
    return long.groupBy(sample).pivot(term, list(terms)).agg(F.when(F.count("value") > 1, twice).otherwise(F.first("value")))


def term_vectors(long: DataFrame, position: str, block_rows: int = 4096) -> DataFrame:
    """``(term_id, block, first_pos, values)``: term vectors cut into blocks of sample positions.

    ``position`` is a column of dense sample positions. No array outgrows ``block_rows`` whatever
    the number of samples; blocks of a term in order make its whole vector. A cell that is missing
    within a block, or there twice, raises: the values behind it would stand for other samples.
    """
    keyed = long.withColumn("block", F.floor(F.col(position) / block_rows))
    pairs = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col("value").alias("v"))))
    places = F.element_at("pv", -1)["p"] - F.col("pv")[0]["p"] + 1
    broken = F.raise_error(F.concat(F.lit("a sample lacks a cell or has one twice in term "), F.col("term_id").cast("string")))
    values = F.when(F.size("pv") == places, F.transform("pv", lambda s: s["v"])).otherwise(broken.cast("array<double>"))
    return keyed.groupBy("term_id", "block").agg(pairs.alias("pv")).select(
        "term_id", "block", F.col("pv")[0]["p"].alias("first_pos"), values.alias("values")
    )


def row_vectors(df: DataFrame, sample: str, terms: Sequence[str]) -> DataFrame:
    """``(sample, values)``: the terms of a wide table as one array per sample."""
    return df.select(
        F.col(sample).alias("sample"), F.array(*[F.col(f"`{t}`").cast("double") for t in terms]).alias("values")
    )


def drop_columns_at(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Without the columns at these zero-based positions; positions out of range are ignored."""
    gone = set(positions)
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if i not in gone])


def select_column_at(df: DataFrame, position: int) -> DataFrame:
    return df.select(F.col(f"`{df.columns[position]}`"))


def bind_terms(left: DataFrame, right: DataFrame, on: str = "sample") -> DataFrame:
    """Columns of two tables side by side for the same samples."""
    return left.join(right, on, "inner")
