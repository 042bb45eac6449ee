"""End-to-end jobs: format conversion, stepwise selection and lasso from files."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.errors import NoTermEntered, TooManyColumns
from termscan.operators import grid, lasso, lasso_grid, path, tiles
from termscan.operators.ols import summary_lines
from termscan.operators.samples import require_same_samples, same_order
from termscan.plans.stepwise import check_threshold, model_frame, path_frame, stepwise
from termscan.sources import sinks, text

#: Markers and pairs up to which the coefficients of a lasso may be one vector on the driver, which iterates faster.
DRIVER_COLUMNS = 4096


def convert_cells(cells: DataFrame, drop: Sequence[int] = (), transpose: bool = False) -> DataFrame:
    """A grid made ready to be read back term by term: columns dropped, turned if asked, corner marked."""
    kept = grid.drop_columns(cells, drop)
    return grid.mark_header(grid.transpose(kept) if transpose else kept)


def convert_format(
    spark: SparkSession, source: str, target: str, delimiter: str = "\t", drop: Sequence[int] = (), transpose: bool = False
) -> None:
    """Read delimited text, drop columns, transpose if asked, and write term-major text."""
    cells = text.read_grid(spark, source, delimiter)
    sinks.write_tsv(convert_cells(cells, drop, transpose), target)


def _names(terms: DataFrame, ids: set[int]) -> dict[int, str]:
    """Names of the few terms that made it into a model."""
    return {r.term_id: r.term for r in terms.filter(F.col("term_id").isin(sorted(ids))).collect()} if ids else {}


def _tiles(geno: text.TermTable, pheno: text.TermTable, traits: tuple[str, ...], pairs: bool) -> tiles.TileSet:
    """Tiles of two term-major files. Files in the same sample order are cut as they are, others matched by name."""
    names = pheno.terms.withColumnRenamed("term", "trait")
    n_terms = geno.terms.count()
    if same_order(geno.samples, pheno.samples):
        ys = pheno.vectors.join(names, "term_id").select("trait", "values")
        return tiles.from_term_vectors(geno.vectors, ys, traits, n_terms, pairs)
    require_same_samples(geno.samples, pheno.samples)
    y = pheno.long().join(names, "term_id").select("sample", "trait", F.col("value").alias("y"))
    return tiles.from_long(geno.long(), y, traits, pairs, n_terms=n_terms)


def _sample_tiles(spark: SparkSession, genotypes: str, phenotypes: str, drop: Sequence[int], pairs: bool) -> tuple[tiles.TileSet, DataFrame]:
    """Tiles of two sample-major files, samples matched by name, and the names of the terms."""
    geno, pheno = text.read_sample_rows(spark, genotypes, drop), text.read_sample_rows(spark, phenotypes)
    require_same_samples(geno.rows, pheno.rows)
    traits = tuple(r.term for r in pheno.terms.orderBy("term_id").collect())
    both = geno.rows.join(pheno.rows.select("sample", F.col("values").alias("ys")), "sample")
    df = both.select("sample", "values", *[F.col("ys")[i].alias(t) for i, t in enumerate(traits)])
    return tiles.from_vectors(df, traits, pairs), geno.terms


def _term_tiles(spark: SparkSession, genotypes: str, phenotypes: str, pairs: bool) -> tuple[tiles.TileSet, DataFrame]:
    geno, pheno = text.read_term_major(spark, genotypes), text.read_term_major(spark, phenotypes)
    traits = tuple(r.term for r in pheno.terms.orderBy("term_id").collect())
    return _tiles(geno, pheno, traits, pairs), geno.terms


def run_stepwise(
    spark: SparkSession,
    genotypes: str,
    phenotypes: str,
    out: str,
    forward: float = 0.05,
    backward: float = 0.05,
    pairs: bool = True,
    max_iterations: int | None = None,
    layout: str = "terms",
    drop: Sequence[int] = (),
) -> DataFrame:
    """Select single and pair terms for every trait of two files and write the models.

    ``layout`` says whether the files have a line per term or, ``samples``, one per sample; of the latter
    genotype columns may be dropped by position. Writes ``<trait>.summary`` text, all coefficients
    under ``model_terms``, the steps under ``steps``, each trait's time and status under ``runs``, and
    ``total_time``; the number of jobs does not depend on the number of traits. Returns the coefficients.
    """
    check_threshold("forward", forward)
    check_threshold("backward", backward)
    if layout not in ("terms", "samples"):
        raise ValueError(f"layout is 'terms' or 'samples', not {layout!r}")
    if drop and layout == "terms":
        raise ValueError("columns are dropped from sample-major files only")
    started = time.perf_counter()
    ts, terms = _sample_tiles(spark, genotypes, phenotypes, drop, pairs) if layout == "samples" else _term_tiles(spark, genotypes, phenotypes, pairs)
    failure = None
    try:
        models, paths = stepwise(ts, pairs, forward, backward, max_iterations=max_iterations)
    except NoTermEntered as err:
        # What was found for other traits is still written.
        failure, models, paths = err, err.models, err.paths
        if not models:
            ts.release()
            raise
    except BaseException:
        ts.release()
        raise
    used = {i for m in models.values() for t in m.terms for i in t} | {i for p in paths.values() for s in p for i in s.term}
    names = _names(terms, used - {-1})
    frame = model_frame(spark, models, names)
    rows: dict[str, list] = {}
    for r in frame.collect():  # the models are here already
        rows.setdefault(r.phenotype, []).append(r)
    seconds, status = {t: m.seconds for t, m in models.items()}, {t: m.status for t, m in models.items()}
    summaries = {t: summary_lines(own, t) for t, own in rows.items()}
    sinks.write_summaries(spark, out, summaries, seconds, status, {"Genotype File": genotypes, "Phenotype File": phenotypes})
    sinks.write_model_terms(frame, out)
    path_frame(spark, paths, names).write.mode("overwrite").parquet(f"{out}/steps")
    sinks.write_runs(spark, out, seconds, status)
    sinks.write_total_time(spark, out, time.perf_counter() - started)
    ts.release()
    if failure:
        raise failure
    return frame


#: Columns with pairs of which one record per sample may be made: 64 MB of doubles.
PAIR_COLUMNS = 8_000_000


def run_lasso_path(
    spark: SparkSession, genotypes: str, phenotypes: str, out: str, regs: Sequence[float], trait: str | None = None,
    pairs: bool = True, drop: Sequence[int] = (), intercept: bool = True, standardize: bool = True,
) -> DataFrame:
    """Lasso at several penalties over the columns of a sample-major file and the products of their pairs.

    ``trait`` defaults to the first of the phenotype file. Writes the coefficients that are not zero, by term
    ids and names, and per penalty how many there are, the duality gap and whether it converged; returns
    the coefficients ``(reg, term_a, term_b, term, estimate)``, the intercept without ids.
    """
    started = time.perf_counter()
    geno, pheno = text.read_sample_rows(spark, genotypes, drop), text.read_sample_rows(spark, phenotypes)
    require_same_samples(geno.rows, pheno.rows)
    n_terms = geno.terms.count()
    known = {r.term: r.term_id for r in pheno.terms.collect()}
    column = trait or min(known, key=known.get)
    if column not in known:
        raise ValueError(f"no outcome {column!r} in {phenotypes}")
    columns = n_terms * (n_terms + 1) // 2 if pairs else n_terms
    if columns > PAIR_COLUMNS:
        raise TooManyColumns(f"{columns} columns with pairs in one record; use run_lasso")
    values = F.col("values")
    if pairs:
        later = lambda v, i: F.transform(F.slice(values, i + 2, F.lit(n_terms)), lambda w: v * w)
        values = F.concat(values, F.flatten(F.transform(values, later)))
    y = pheno.rows.select("sample", F.col("values")[known[column]].alias("y"))
    ts = tiles.from_vectors(geno.rows.select("sample", values.alias("values")).join(y, "sample"), ("y",))
    try:
        steps = path.fit_path(ts, "y", regs, intercept, standardize)
    finally:
        ts.release()
    rows = [(s.reg, *_pair_ids(t, n_terms), float(b)) for s in steps for t, b in zip(s.terms, s.estimates)]
    found = spark.createDataFrame(rows, "reg double, term_a long, term_b long, estimate double")
    one = geno.terms.select(F.col("term_id").alias("term_a"), F.col("term").alias("a"))
    two = geno.terms.select(F.col("term_id").alias("term_b"), F.col("term").alias("b"))
    found = found.join(one, "term_a").join(two, "term_b", "left").select("reg", "term_a", "term_b", F.concat_ws("_", "a", "b").alias("term"), "estimate")
    last = [(s.reg, None, None, "(Intercept)", s.intercept) for s in steps if s.intercept is not None]
    frame = found.unionByName(spark.createDataFrame(last, found.schema)) if last else found
    frame.write.mode("overwrite").parquet(f"{out}/coefficients")
    path.path_fits(spark, steps).write.mode("overwrite").parquet(f"{out}/fits")
    sinks.write_total_time(spark, out, time.perf_counter() - started)
    return spark.read.schema(frame.schema).parquet(f"{out}/coefficients")


def _pair_ids(column: int, n: int) -> tuple[int, int | None]:
    """The terms of a column: first the single ones, then their pairs in order."""
    if column < n:
        return column, None
    a, rest = 0, column - n
    while rest >= n - 1 - a:
        rest -= n - 1 - a
        a += 1
    return a, a + 1 + rest


def _sample_vectors(values: DataFrame) -> DataFrame:
    """``(sample_pos, values)``: one array per sample, as long as there are terms."""
    cells = F.sort_array(F.collect_list(F.struct("term_id", "value")))
    return values.groupBy("sample_pos").agg(F.transform(cells, lambda c: c["value"]).alias("values"))


def run_lasso(
    spark: SparkSession,
    markers: str,
    phenotypes: str,
    out: str,
    trait: str | None = None,
    lam: float = 0.5,
    rho: float = 1.0,
    max_iter: int = 100,
    abs_tol: float = 1e-4,
    rel_tol: float = 1e-2,
    blocks: int | None = None,
) -> DataFrame:
    """Consensus lasso over all markers and their pairs, from a marker table and a sample-major file.

    ``trait`` defaults to the first, ``blocks`` is how many row blocks have to agree. Writes the coefficients,
    with ``converged``, and the convergence log, and returns the coefficients. Beyond ``DRIVER_COLUMNS`` markers
    and pairs neither names nor coefficients pass through the driver; the iterates are the same.
    """
    started = time.perf_counter()
    table, _ = text.read_marker_table(spark, markers)
    pheno = text.read_sample_major(spark, phenotypes)
    key, column = pheno.columns[0], trait or pheno.columns[1]
    outcome = pheno.select(F.col(f"`{key}`").alias("sample"), F.col(f"`{column}`").alias("y"))
    require_same_samples(table.samples, outcome)
    vectors = _sample_vectors(table.values)
    df = vectors.join(table.samples, "sample_pos").join(outcome, "sample").select("sample", "values", "y")
    n_terms = table.terms.count()
    if n_terms * (n_terms + 1) // 2 <= DRIVER_COLUMNS:
        found = lasso.admm(df, lam, rho, max_iter, abs_tol, rel_tol, blocks=blocks, pairs=True)
        result = lasso_grid.from_vector(spark, found, n_terms)
    else:
        row_block = F.pmod(F.xxhash64("sample"), F.lit(blocks)) if blocks else None
        ts = tiles.from_vectors(df, ("y",), True, row_block=row_block)
        try:
            result = lasso_grid.admm_grid(ts, "y", lam, rho, max_iter, abs_tol, rel_tol, pairs=True)
        finally:
            ts.release()
    frame = lasso_grid.named(result, table.terms)
    frame.write.mode("overwrite").parquet(f"{out}/coefficients")
    spark.createDataFrame(result.log, lasso_grid.LOG_SCHEMA).write.mode("overwrite").parquet(f"{out}/convergence")
    sinks.write_total_time(spark, out, time.perf_counter() - started)
    return spark.read.schema(frame.schema).parquet(f"{out}/coefficients")
