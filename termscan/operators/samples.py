"""Aligning tables by sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscan.errors import SampleMismatch


def sample_mismatch(left: DataFrame, right: DataFrame, on: str = "sample") -> DataFrame:
    """Samples that only one side has, as ``(sample, missing_in)``."""
    a = left.select(F.col(on)).distinct().withColumn("in_left", F.lit(True))
    b = right.select(F.col(on)).distinct().withColumn("in_right", F.lit(True))
    side = F.when(F.col("in_left").isNull(), F.lit("left")).otherwise(F.lit("right"))
    both = a.join(b, on, "full_outer")
    return both.filter(F.col("in_left").isNull() | F.col("in_right").isNull()).select(on, side.alias("missing_in"))


def require_same_samples(left: DataFrame, right: DataFrame, on: str = "sample") -> None:
    wrong = sample_mismatch(left, right, on).limit(5).collect()
    if wrong:
        raise SampleMismatch("samples do not match: " + ", ".join(f"{r[0]} missing in {r[1]}" for r in wrong))


def join_phenotype(genotypes: DataFrame, phenotypes: DataFrame, on: str = "sample", strict: bool = False) -> DataFrame:
    """Inner join on the sample; ``strict`` first checks that both sides have the same samples."""
    if strict:
        require_same_samples(genotypes, phenotypes, on)
    return genotypes.join(phenotypes, on, "inner")


def align_rows(df: DataFrame, order: DataFrame, on: str = "sample") -> DataFrame:
    """Rows sorted as ``order(pos, sample)`` says; the sample sets must agree."""
    require_same_samples(df, order, on)
    return df.join(order.select(on, "pos"), on).orderBy("pos")


def positional_join(left: DataFrame, right: DataFrame, position: str = "pos", name: str = "sample") -> DataFrame:
    """Row i with row i. Both sides carry names, and a pair of rows with different names raises."""
    other = right.withColumnRenamed(name, "__name")
    joined = left.join(other, position, "full_outer")
    wrong = F.raise_error(F.concat(F.lit("row names differ at position "), F.col(position).cast("string")))
    checked = F.when(F.col(name).eqNullSafe(F.col("__name")), F.col(name)).otherwise(wrong.cast(left.schema[name].dataType))
    return joined.withColumn(name, checked).drop("__name")


def same_order(left: DataFrame, right: DataFrame, position: str = "sample_pos", name: str = "sample") -> bool:
    """Whether two catalogues of samples list the same names at the same positions."""
    other = right.select(position, F.col(name).alias("__name"))
    joined = left.select(position, name).join(other, position, "full_outer")
    return joined.filter(~F.col(name).eqNullSafe(F.col("__name"))).isEmpty()
