"""Ordinary least squares by distributed moments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.errors import BadShape, TermscanError
from termscan.functions.solve import Coefficients, check_samples, coefficients, coefficients_by_group

INTERCEPT = "(Intercept)"
FIT_SCHEMA = "position int, term string, estimate double, std_error double, t_value double, p_value double"


def _moments(x: Sequence[str], y: str) -> list[Column]:
    """Stable one-pass moments: Spark's covariance keeps running means."""
    cols = [*x, y]
    c = lambda n: F.col(f"`{n}`").cast("double")
    missing = F.greatest(*[(F.coalesce(c(v) * 0.0, F.lit(float("nan"))) != 0.0).cast("int") for v in cols], F.lit(0))
    out = [F.count("*").alias("n"), F.sum(missing).alias("missing"), *[F.avg(c(v)).alias(f"m{i}") for i, v in enumerate(cols)]]
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            cov = F.var_pop(c(cols[i])) if i == j else F.covar_pop(c(cols[i]), c(cols[j]))
            out.append(cov.alias(f"c{i}_{j}"))
    return out


def _solve(row, k: int, rss: float | None = None) -> Coefficients:
    n = int(row["n"])
    if row["missing"]:
        raise BadShape(f"{row['missing']} rows lack a value or have an infinite one")
    check_samples(n, k + 1)
    cov = np.zeros((k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] * n
    mean = np.array([row[f"m{i}"] for i in range(k + 1)])
    return coefficients(n, mean[:k], float(mean[k]), cov[:k, :k], cov[:k, k], float(cov[k, k]), rss)


def fitted(df: DataFrame, x: Sequence[str], y: str, fit: Coefficients) -> DataFrame:
    """With columns ``fitted`` and ``residual``, a projection with constant coefficients."""
    value = F.lit(float(fit.estimate[-1]))
    for name, b in zip(x, fit.estimate):
        value = value + F.lit(float(b)) * F.col(f"`{name}`").cast("double")
    return df.withColumn("fitted", value).withColumn("residual", F.col(f"`{y}`") - F.col("fitted"))


def ols(df: DataFrame, x: Sequence[str], y: str) -> Coefficients:
    """Fit ``y`` on columns ``x`` with an intercept; the residual sum of squares takes its own pass."""
    narrow = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in (*x, y)])
    first = narrow.agg(*_moments(x, y)).first()
    rough = _solve(first, len(x))
    rss = fitted(narrow, x, y, rough).agg(F.sum(F.col("residual") * F.col("residual"))).first()[0]
    return _solve(first, len(x), float(rss))


def ols_table(spark: SparkSession, x: Sequence[str], fit: Coefficients) -> DataFrame:
    """Coefficient rows in regressor order, the intercept last."""
    rows = [
        (i + 1, t, float(fit.estimate[i]), float(fit.std_error[i]), float(fit.t_value[i]), float(fit.p_value[i]))
        for i, t in enumerate((*x, INTERCEPT))
    ]
    return spark.createDataFrame(rows, FIT_SCHEMA)


def ols_stats(spark: SparkSession, fit: Coefficients) -> DataFrame:
    """One row about the whole fit."""
    row = (fit.n, len(fit.estimate), fit.df, float(fit.rss), fit.residual_standard_error)
    return spark.createDataFrame([row], "n long, k int, df long, rss double, rse double")


def ols_by_group(df: DataFrame, group: str, x: Sequence[str], y: str, failures: bool = False) -> DataFrame:
    """One model per group: moments by hash aggregation, then a small solve per group in tasks.

    A group that cannot be fitted raises. With ``failures`` it is one row without a term instead, whose column
    ``failure`` names what a fit of it would raise, and the others are not touched by it.
    """
    k = len(x)
    names = [*x, INTERCEPT]
    schema = "phenotype string, " + FIT_SCHEMA + (", failure string" if failures else "")

    def fitted_alone(n, mean, cov):
        try:
            return coefficients_by_group(n, mean, cov), None
        except TermscanError as err:
            return None, type(err).__name__

    def solve_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            whole = ~pdf["missing"].to_numpy().astype(bool)
            good = pdf[whole]
            n, mean, cov = _group_moments(good, k)
            why = np.full(len(good), None, dtype=object)
            few, flat = n <= k + 1, (np.einsum("gii->gi", cov[:, :k, :k]) <= 0).any(axis=1)
            why[flat], why[few] = "SingularModel", "NotEnoughSamples"
            some = np.flatnonzero(~(few | flat))
            stats, failed = fitted_alone(n[some], mean[some], cov[some]) if len(some) else (None, None)
            parts = [(some, stats)] if stats is not None else []
            if failed:  # some group among these: one by one
                for g in some.tolist():
                    own, why[g] = fitted_alone(n[[g]], mean[[g]], cov[[g]])
                    if own is not None:
                        parts.append((np.array([g]), own))
            for at, own in parts:
                yield pd.DataFrame(
                    {
                        "phenotype": np.repeat(good["g"].to_numpy()[at], k + 1),
                        "position": np.tile(np.arange(1, k + 2), len(at)),
                        "term": np.tile(names, len(at)),
                        **{name: v.ravel() for name, v in own.items()},
                        "failure": np.full(len(at) * (k + 1), None, dtype=object),
                    }
                )
            bad = [(g, f) for g, f in zip(good["g"], why) if f] + [(g, "BadShape") for g in pdf["g"][~whole]]
            if bad:
                none = np.full(len(bad), None, dtype=object)
                blank = dict.fromkeys(("term", "estimate", "std_error", "t_value", "p_value"), none)
                position = pd.array([None] * len(bad), dtype="Int32")
                yield pd.DataFrame({"phenotype": [g for g, _ in bad], "position": position, **blank, "failure": [f for _, f in bad]}, dtype=object)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            if pdf["missing"].any():
                raise BadShape(f"{pdf['missing'].sum()} rows lack a value or have an infinite one")
            stats = coefficients_by_group(*_group_moments(pdf, k))
            yield pd.DataFrame(
                {
                    "phenotype": np.repeat(pdf["g"].to_numpy(), k + 1),
                    "position": np.tile(np.arange(1, k + 2), len(pdf)),
                    "term": np.tile(names, len(pdf)),
                    **{name: v.ravel() for name, v in stats.items()},
                }
            )

    moments = df.groupBy(F.col(group).cast("string").alias("g")).agg(*_moments(x, y))
    return moments.mapInPandas(solve_each if failures else solve, schema)


def _group_moments(pdf: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean = pdf[[f"m{i}" for i in range(k + 1)]].to_numpy(dtype=float)
    cov = np.stack(
        [pdf[[f"c{min(i, j)}_{max(i, j)}" for j in range(k + 1)]].to_numpy(dtype=float) for i in range(k + 1)], axis=1
    )
    return pdf["n"].to_numpy(dtype=float), mean, cov


def ols_ml(df: DataFrame, x: Sequence[str], y: str) -> DataFrame:
    """The same model by Spark ML's normal-equation solver."""
    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in (*x, y)])
    _solve(wide.agg(*_moments(x, y)).first(), len(x))  # raises what a fit here raises
    assembled = VectorAssembler(inputCols=list(x), outputCol="features").transform(wide).select("features", y)
    model = LinearRegression(featuresCol="features", labelCol=y, solver="normal").fit(assembled)
    s = model.summary
    estimate = [*model.coefficients.toArray(), model.intercept]
    stats = zip(estimate, s.coefficientStandardErrors, s.tValues, s.pValues)
    rows = [(i + 1, t, *map(float, v)) for i, (t, v) in enumerate(zip((*x, INTERCEPT), stats))]
    return df.sparkSession.createDataFrame(rows, FIT_SCHEMA)


def model_summary(terms: DataFrame, response: str) -> DataFrame:
    """``(line_no, line)``: the coefficient table as text in the style of R.

    ``terms(position, term, estimate, std_error, t_value, p_value)`` of one model. Names are padded
    to the right, numbers to the left with three more blanks than the widest entry.
    """
    heads = ["Name", "Estimate", "Std. Error", "t value", "Pr(>|t|)"]
    text = terms.select(
        F.col("position").alias("line_no"),
        F.col("term").alias("c0"),
        F.format_string("%.6f", "estimate").alias("c1"),
        F.format_string("%.6f", "std_error").alias("c2"),
        F.format_string("%.3f", "t_value").alias("c3"),
        F.format_string("%.6f", "p_value").alias("c4"),
    )
    # The widest entries: five numbers.
    widths = text.agg(*[F.max(F.length(f"c{i}")).alias(f"w{i}") for i in range(5)]).first()
    width = [max(w, len(h)) for w, h in zip(widths, heads)]
    padded = terms.sparkSession.createDataFrame([(0, *heads)], text.schema).unionByName(text)
    cells = [F.rpad("c0", width[0], " "), *[F.lpad(f"c{i}", width[i] + 3, " ") for i in range(1, 5)]]
    body = padded.select((F.col("line_no") + 2).alias("line_no"), F.concat(*cells).alias("line"))
    first = [(0, f"The Response variable: {response}"), (1, "")]
    return terms.sparkSession.createDataFrame(first, body.schema).unionByName(body)


def summary_lines(terms: Sequence, response: str) -> list[str]:
    """The lines of ``model_summary`` from rows that are here already, as those of a finished search are."""
    ordered = sorted(terms, key=lambda r: r.position)
    text = [("Name", "Estimate", "Std. Error", "t value", "Pr(>|t|)")]
    text += [(r.term, f"{r.estimate:.6f}", f"{r.std_error:.6f}", f"{r.t_value:.3f}", f"{r.p_value:.6f}") for r in ordered]
    width = [max(len(row[i]) for row in text) for i in range(5)]
    body = [row[0].ljust(width[0]) + "".join(cell.rjust(w + 3) for cell, w in zip(row[1:], width[1:])) for row in text]
    return [f"The Response variable: {response}", "", *body]


def summary_text(terms: DataFrame, response: str) -> str:
    return "\n".join(r.line for r in model_summary(terms, response).orderBy("line_no").collect()) + "\n"
