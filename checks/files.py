"""Readers and writers: each query writes a table as a file in the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import SQL_LONG, SQL_Y1, query, rounded, table, vectors
from checks.reshape import SQL_GRID, supplier_grid, supplier_rows
from checks.selection import BACKWARD, FORWARD, _model_sql
from termscan.operators import grid, reshape
from termscan.plans import jobs
from termscan.session import shared_folder
from termscan.sources import sinks, text


def _path(spark, label):
    return f"{shared_folder(spark)}/termscan/{label}-{uuid.uuid4().hex}"


@query(f"WITH {SQL_GRID} SELECT row, col, cell FROM cells")
def read_delimited(spark, folder):
    """A grid written as text with several part files and read back with dense row numbers."""
    path = _path(spark, "grid")
    sinks.write_tsv(supplier_grid(spark, folder), path, "|")
    return grid.to_cells(text.read_delimited(spark, path, r"\|"))


@query(f"WITH {SQL_GRID} SELECT row, string_agg(cell, chr(9) ORDER BY col) AS line FROM cells GROUP BY row")
def write_tsv(spark, folder):
    """The lines of a written grid in file order."""
    path = _path(spark, "tsv")
    sinks.write_tsv(supplier_grid(spark, folder), path)
    return text.read_lines(spark, path)


@query(
    f"""WITH l AS ({SQL_LONG}) SELECT sample AS sample_pos, 's' || sample AS sample, term_id, 'e' || term_id AS term,
CAST(round(value * 1000000) AS BIGINT) AS micro FROM l"""
)
def read_term_major(spark, folder):
    """Embeddings as a term-major file: a header of samples, one line per term."""
    path = _path(spark, "terms")
    _write_term_major(vectors(spark, folder), path)
    t = text.read_term_major(spark, path)
    cells = t.values.join(t.samples, "sample_pos").join(t.terms, "term_id")
    return cells.select(
        F.col("sample_pos").cast("long").alias("sample_pos"), "sample", "term_id", "term", F.round(F.col("value") * 1e6).cast("long").alias("micro")
    )


def _write_term_major(df, path, column="values", names=lambda i: F.concat(F.lit("e"), i.cast("string"))):
    """Cells of a term-major file from one array per sample with ids 0, 1, 2, ..."""
    body = reshape.vectors_to_long(df, "sample", column).select(
        (F.col("term_id") + 1).alias("row"), (F.col("sample") + 1).alias("col"), F.col("value").cast("string").alias("cell")
    )
    head = df.select(F.lit(0).cast("long").alias("row"), (F.col("sample") + 1).alias("col"), F.concat(F.lit("s"), F.col("sample").cast("string")).alias("cell"))
    ids = body.select("row").distinct()
    label = ids.select("row", F.lit(0).cast("long").alias("col"), names(F.col("row") - 1).alias("cell"))
    corner = df.sparkSession.createDataFrame([(0, 0, text.HEADER_MARKS[0])], "row long, col long, cell string")
    sinks.write_tsv(body.unionByName(head).unionByName(label).unionByName(corner), path)


@query("SELECT s_name, s_nationkey::DOUBLE AS s_nationkey, round(s_acctbal * 100)::DOUBLE + 0.0 AS cents FROM supplier")
def read_sample_major(spark, folder):
    """A typed wide table from a sample-major file, without its dropped column."""
    path = _path(spark, "wide")
    rows = supplier_rows(spark, folder).select("s_name", F.lit("NA").alias("note"), "s_nationkey", "cents")
    sinks.write_wide_tsv(rows.coalesce(1), path)
    return text.read_sample_major(spark, path, drop=[1])


@query("SELECT s_name, s_nationkey::DOUBLE AS s_nationkey, round(s_acctbal * 100)::DOUBLE + 0.0 AS cents FROM supplier")
def read_sample_major_transposed(spark, folder):
    """The same from a file that holds the table turned."""
    path = _path(spark, "turned")
    sinks.write_tsv(grid.transpose(supplier_grid(spark, folder)), path)
    return text.read_sample_major(spark, path, transpose=True)


@query(
    """SELECT s_name AS sample, t.term_id, t.term, CASE t.term_id WHEN 0 THEN s_nationkey::DOUBLE ELSE round(s_acctbal * 100)::DOUBLE END + 0.0 AS value
FROM supplier, (SELECT 0::BIGINT AS term_id, 's_nationkey' AS term UNION ALL SELECT 1, 'cents') t"""
)
def read_sample_major_long(spark, folder):
    """The same straight to the long form."""
    path = _path(spark, "long")
    sinks.write_tsv(supplier_grid(spark, folder), path)
    t = text.read_sample_major_long(spark, path)
    return t.long().join(t.terms, "term_id").select("sample", "term_id", "term", "value")


@query(
    """SELECT (p_partkey - (SELECT min(p_partkey) FROM part)) AS term_id, p_name || '#' || p_partkey AS term, p_brand AS allele, p_size AS chr, p_partkey AS pos,
CASE WHEN p_size > 25 THEN -1.0::DOUBLE ELSE p_size::DOUBLE END AS cm, n, total FROM part, (SELECT 3::BIGINT AS n), (SELECT p_partkey AS k, 3 * p_size + 3.0::DOUBLE AS total FROM part) WHERE k = p_partkey"""
)
def read_marker_table(spark, folder):
    """Parts as a marker table: five metadata columns, then one column per sample."""
    path = _path(spark, "markers")
    p = table(spark, folder, "part")
    low = p.agg(F.min("p_partkey")).first()[0]
    rows = p.select(
        (F.col("p_partkey") - low).alias("row"),
        F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("Samples"),
        F.col("p_brand").alias("allele"),
        F.col("p_size").alias("chr"),
        F.col("p_partkey").alias("pos"),
        F.when(F.col("p_size") > 25, F.lit("NA")).otherwise(F.col("p_size").cast("string")).alias("cm"),
        *[(F.col("p_size") + i).cast("double").alias(f"s{i}") for i in range(3)],
    )
    sinks.write_tsv(grid.from_columns(rows, "row", [c for c in rows.columns if c != "row"]), path)
    t, markers = text.read_marker_table(spark, path)
    sums = t.values.groupBy("term_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return markers.join(sums, "term_id").withColumn("cm", F.coalesce("cm", F.lit(-1.0)))


@query("SELECT s_name AS \"Sample\", s_nationkey::DOUBLE AS s_nationkey, round(s_acctbal * 100)::DOUBLE + 0.0 AS cents FROM supplier")
def read_json_terms(spark, folder):
    """JSON lines with whole numbers come back as doubles."""
    path = _path(spark, "json")
    supplier_rows(spark, folder).select(F.col("s_name").alias("Sample"), "s_nationkey", "cents").write.json(path)
    return text.read_json_terms(spark, path)


def _run_job(spark, folder):
    out, geno, pheno = (_path(spark, p) for p in ("out", "geno", "pheno"))
    df = vectors(spark, folder)
    _write_term_major(df, geno)
    _write_term_major(df.select("sample", F.array("y").alias("ys")), pheno, "ys", lambda i: F.lit("y"))
    return jobs.run_stepwise(spark, geno, pheno, out, FORWARD, BACKWARD), out


_JOB = _model_sql(SQL_Y1, 4, True)
_NAME = "CASE WHEN term_a IS NULL THEN '(Intercept)' WHEN term_b IS NULL THEN 'e' || term_a ELSE 'e' || term_a || '_e' || term_b END"


@query(f"SELECT 'y' AS phenotype, position, {_NAME} AS term, estimate, t_value FROM ({_JOB})")
def run_stepwise(spark, folder):
    """The whole job from term-major files to written coefficients, read back from the output."""
    _, out = _run_job(spark, folder)
    written = spark.read.parquet(f"{out}/model_terms")
    return written.select("phenotype", "position", "term", rounded("estimate", 7).alias("estimate"), rounded("t_value", 7).alias("t_value"))


@query(
    f"SELECT 'y' AS phenotype, {_NAME} AS term, printf('%.3f', estimate) AS estimate, printf('%.3f', t_value) AS t_value FROM ({_JOB})"
)
def write_summary(spark, folder):
    """Coefficient lines of the written text summary."""
    _, out = _run_job(spark, folder)
    lines = spark.read.text(f"{out}/y.summary").select(F.split(F.trim("value"), r"\s+").alias("c"))
    rows = lines.filter((F.size("c") == 5) & F.col("c")[1].rlike(r"^-?\d+\.\d{6}$"))
    return rows.select(
        F.lit("y").alias("phenotype"),
        F.col("c")[0].alias("term"),
        F.format_string("%.3f", F.col("c")[1].cast("double")).alias("estimate"),
        F.col("c")[3].alias("t_value"),
    )


@query("SELECT 'y' AS phenotype, 'threshold' AS status, count(*) > 0 AS timed FROM embeddings")
def run_times(spark, folder):
    """How each search of a job ended, with times that agree in all units and with the job's total."""
    _, out = _run_job(spark, folder)
    runs = spark.read.parquet(f"{out}/runs")
    total = spark.read.json(f"{out}/total_time").first()
    same = (F.abs(F.col("minutes") * 60 - F.col("seconds")) < 1e-6) & (F.abs(F.col("hours") * 3600 - F.col("seconds")) < 1e-6)
    agree = abs(total.minutes * 60 - total.seconds) < 1e-6 and abs(total.hours * 3600 - total.seconds) < 1e-6
    return runs.select("phenotype", "status", (same & (F.col("seconds") > 0) & (F.col("seconds") <= total.seconds) & F.lit(agree)).alias("timed"))
