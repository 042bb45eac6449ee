"""Writers: delimited text, coefficient summaries and run logs."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.operators import grid


def write_tsv(cells: DataFrame, path: str, delimiter: str = "\t") -> None:
    """A grid as delimited text, its part files in row order."""
    grid.to_lines(cells, delimiter).repartitionByRange("row").sortWithinPartitions("row").select("line").write.text(path)


def write_wide_tsv(df: DataFrame, path: str) -> None:
    """A typed wide table as tab-separated text with a header in each part file."""
    df.write.csv(path, sep="\t", header=True)


def elapsed(df: DataFrame) -> DataFrame:
    """A ``seconds`` column also in minutes and hours."""
    return df.withColumn("minutes", F.col("seconds") / 60.0).withColumn("hours", F.col("seconds") / 3600.0)


def elapsed_lines(seconds: float) -> list[str]:
    units = (("seconds", 1.0), ("minutes", 60.0), ("hours", 3600.0))
    return [f"Calculation time (in {name}): {seconds / size}" for name, size in units]


def write_summary(
    spark: SparkSession, folder: str, phenotype: str, seconds: float, inputs: dict[str, str], summary: str
) -> None:
    """One text summary per phenotype: timing, input paths, coefficient table."""
    lines = elapsed_lines(seconds) + [""] + [f"{k}: {v}" for k, v in inputs.items()] + ["", *summary.split("\n")]
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")
    rows.coalesce(1).sortWithinPartitions("i").select("line").write.mode("overwrite").text(f"{folder}/{phenotype}.summary")


def write_summaries(
    spark: SparkSession, folder: str, summaries: Mapping[str, Sequence[str]], seconds: Mapping[str, float], status: Mapping[str, str], inputs: Mapping[str, str]
) -> None:
    """``<phenotype>.summary`` for all phenotypes by one job: each with its own time and how its search ended.

    The job writes a folder per phenotype beside the place they belong; only when all are there are they
    put in place, one rename each, so a run that breaks off leaves no half of a summary.
    """
    names = list(summaries)
    rows = []
    for no, name in enumerate(names):
        lines = [*elapsed_lines(seconds[name]), "", *[f"{k}: {v}" for k, v in inputs.items()], f"Search ended: {status[name]}", "", *summaries[name], ""]
        rows += [(no, i, line) for i, line in enumerate(lines)]
    aside = f"{folder}/_summaries-{uuid.uuid4().hex}"
    lines = spark.createDataFrame(rows, "no int, i int, line string")
    lines.repartition("no").sortWithinPartitions("no", "i").select("no", "line").write.partitionBy("no").text(aside)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(aside).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for no, name in enumerate(names):
        files.delete(path(f"{folder}/{name}.summary"), True)
        if not files.rename(path(f"{aside}/no={no}"), path(f"{folder}/{name}.summary")):
            raise OSError(f"the summary of {name} could not be put in place")
    files.delete(path(aside), True)


def write_runs(spark: SparkSession, folder: str, seconds: Mapping[str, float], status: Mapping[str, str]) -> None:
    """How long each phenotype's search took and how it ended, as one dataset."""
    runs = spark.createDataFrame([(t, status[t], float(s)) for t, s in seconds.items()], "phenotype string, status string, seconds double")
    elapsed(runs).coalesce(1).write.mode("overwrite").parquet(f"{folder}/runs")


def write_model_terms(models: DataFrame, folder: str) -> None:
    """All coefficient tables as one dataset, a folder per phenotype."""
    models.write.mode("overwrite").partitionBy("phenotype").parquet(f"{folder}/model_terms")


def write_total_time(spark: SparkSession, folder: str, seconds: float) -> None:
    runs = elapsed(spark.createDataFrame([(float(seconds),)], "seconds double"))
    runs.coalesce(1).write.mode("overwrite").json(f"{folder}/total_time")
