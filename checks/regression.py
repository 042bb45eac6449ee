"""Least squares on lineitem and by group, coefficient summaries, and the lassos."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlgen
from checks.registry import query, rounded, table
from termscan.operators import lasso, ols, path

X, Y = ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"
_LINES = f"SELECT {', '.join(X)}, {Y} FROM lineitem"
_MULTI = sqlgen.ols(_LINES, X, Y)
_SIMPLE = sqlgen.ols(_LINES, X[:1], Y)
_TERMS = "CASE position " + " ".join(f"WHEN {i + 1} THEN '{x}'" for i, x in enumerate(X)) + " ELSE '(Intercept)' END AS term"


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(*X, Y)


def _coef(df, p_digits=6):
    return df.select(
        "position", "term", rounded("estimate", 4).alias("estimate"), rounded("std_error", 4).alias("std_error"),
        rounded("t_value", 6).alias("t_value"), rounded("p_value", p_digits).alias("p_value"),
    )


def _coef_sql(ctes: str) -> str:
    p = sqlgen.p_value("t_value", "df")
    return (
        f"WITH {ctes} SELECT position, {_TERMS}, round(estimate, 4) + 0.0 AS estimate, round(std_error, 4) + 0.0 AS std_error, "
        f"round(t_value, 6) + 0.0 AS t_value, round(greatest({p}, 0), 6) + 0.0 AS p_value FROM coef"
    )


@query(_coef_sql(_MULTI))
def ols_multi(spark, folder):
    return _coef(ols.ols_table(spark, X, ols.ols(_lines(spark, folder), X, Y)))


@query(
    f"""SELECT round(regr_slope({Y}, {X[0]}), 5) + 0.0 AS slope, round(regr_intercept({Y}, {X[0]}), 4) + 0.0 AS intercept,
round(regr_r2({Y}, {X[0]}), 8) + 0.0 AS r2, count(*) AS n FROM lineitem"""
)
def ols_simple(spark, folder):
    """One regressor by built-in aggregates."""
    return _lines(spark, folder).agg(
        rounded(F.regr_slope(Y, X[0]), 5).alias("slope"),
        rounded(F.regr_intercept(Y, X[0]), 4).alias("intercept"),
        rounded(F.regr_r2(Y, X[0]), 8).alias("r2"),
        F.count("*").alias("n"),
    )


@query(f"WITH {_MULTI} SELECT n, CAST({len(X) + 1} AS INTEGER) AS k, df, round(rss / 1e6, 3) + 0.0 AS rss_millions, round(sqrt(rss / df), 4) + 0.0 AS rse FROM coef WHERE position = 1")
def ols_fit(spark, folder):
    """Size, degrees of freedom and residual standard error of a model."""
    s = ols.ols_stats(spark, ols.ols(_lines(spark, folder), X, Y))
    return s.select("n", "k", "df", rounded(F.col("rss") / 1e6, 3).alias("rss_millions"), rounded("rse", 4).alias("rse"))


_KEYS = "l_orderkey, l_linenumber, l_partkey"


@query(
    f"""WITH {_MULTI}, b AS (SELECT {', '.join(f'max(estimate) FILTER (position = {i + 1}) AS b{i}' for i in range(len(X) + 1))} FROM coef),
f AS (SELECT {_KEYS}, {Y} AS y, b{len(X)} + {' + '.join(f'b{i} * {x}' for i, x in enumerate(X))} AS fit FROM lineitem, b)
SELECT {_KEYS}, round(fit, 3) + 0.0 AS fitted, round(y - fit, 3) + 0.0 AS residual FROM f"""
)
def ols_fitted(spark, folder):
    """Fitted values and residuals of every line."""
    fit = ols.ols(_lines(spark, folder), X, Y)
    lines = table(spark, folder, "lineitem")
    out = ols.fitted(lines, X, Y, fit)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", rounded("fitted", 3).alias("fitted"), rounded("residual", 3).alias("residual"))


@query(
    f"WITH {_MULTI} SELECT position, {_TERMS}, round(estimate, 3) + 0.0 AS estimate, round(t_value, 5) + 0.0 AS t_value FROM coef"
)
def ols_ml(spark, folder):
    out = ols.ols_ml(_lines(spark, folder), X, Y)
    return out.select("position", "term", rounded("estimate", 3).alias("estimate"), rounded("t_value", 5).alias("t_value"))


_BY = sqlgen.ols("SELECT l_quantity, l_discount, l_extendedprice, CAST(l_suppkey AS VARCHAR) AS s FROM lineitem", X[:2], Y, "s")


@query(
    f"""WITH {_BY} SELECT g AS phenotype, position, round(estimate, 4) + 0.0 AS estimate, round(t_value, 6) + 0.0 AS t_value,
round(greatest({sqlgen.p_value('t_value', 'df')}, 0), 8) + 0.0 AS p_value FROM coef"""
)
def ols_by_phenotype(spark, folder):
    """One model per supplier, all in one aggregation."""
    out = ols.ols_by_group(table(spark, folder, "lineitem"), "l_suppkey", X[:2], Y)
    return out.select(
        "phenotype", "position", rounded("estimate", 4).alias("estimate"), rounded("t_value", 6).alias("t_value"), rounded("p_value", 8).alias("p_value")
    )


@query(
    """SELECT CAST(l_orderkey AS VARCHAR) AS phenotype, CASE WHEN n < 3 THEN 'NotEnoughSamples' WHEN v = 0 THEN 'SingularModel' END AS failure,
CASE WHEN n >= 3 AND v > 0 THEN round(slope, 4) + 0.0 END AS estimate FROM (SELECT l_orderkey, count(*) AS n, var_pop(l_quantity) AS v,
regr_slope(l_extendedprice, l_quantity) AS slope FROM lineitem GROUP BY l_orderkey)"""
)
def ols_groups_that_fail(spark, folder):
    """A line per order; orders with too few lines, or of one quantity, are rows that say so."""
    fits = ols.ols_by_group(table(spark, folder, "lineitem"), "l_orderkey", ["l_quantity"], "l_extendedprice", failures=True)
    return fits.where("term IS NULL OR term = 'l_quantity'").select("phenotype", "failure", rounded("estimate", 4).alias("estimate"))


_NUM = ["estimate", "std_error", "t_value", "p"]
_FMT = ["%.6f", "%.6f", "%.3f", "%.6f"]
_HEADS = ["Estimate", "Std. Error", "t value", "Pr(>|t|)"]
_TEXT = ", ".join(f"printf('{f}', {c}) AS c{i + 1}" for i, (c, f) in enumerate(zip(_NUM, _FMT)))
_PADDED = " || ".join(f"lpad(c{i}, w{i} + 3, ' ')" for i in range(1, 5))


@query(
    f"""WITH {_SIMPLE}, t AS (SELECT position AS no, {_TERMS.replace(' AS term', ' AS c0')}, estimate, std_error, t_value,
  greatest({sqlgen.p_value('t_value', 'df')}, 0) AS p FROM coef),
c AS (SELECT no, c0, {_TEXT} FROM (SELECT no, CASE WHEN no = 2 THEN '(Intercept)' ELSE c0 END AS c0, estimate, std_error, t_value, p FROM t)
  UNION ALL SELECT 0, 'Name', {', '.join(f"'{h}'" for h in _HEADS)}),
w AS (SELECT {', '.join(f'CAST(max(length(c{i})) AS INTEGER) AS w{i}' for i in range(5))} FROM c)
SELECT CAST(no + 2 AS INTEGER) AS line_no, rpad(c0, w0, ' ') || {_PADDED} AS line FROM c, w
UNION ALL SELECT 0, 'The Response variable: {Y}' UNION ALL SELECT 1, ''"""
)
def model_summary(spark, folder):
    """The coefficient table as text."""
    fit = ols.ols(_lines(spark, folder), X[:1], Y)
    return ols.model_summary(ols.ols_table(spark, X[:1], fit), Y)


# Lasso on an orthogonal design: one column per market segment, so each coefficient has a closed form.
LAM = 50_000.0


def _segments(spark, folder):
    c = table(spark, folder, "customer")
    names = sorted(r[0] for r in c.select("c_mktsegment").distinct().collect())  # five fixed segments
    onehot = F.array(*[(F.col("c_mktsegment") == n).cast("double") for n in names])
    return c.select(F.col("c_custkey").alias("sample"), onehot.alias("values"), F.col("c_acctbal").alias("y")), names


def _lasso_sql(lam: str, extra: str = "") -> str:
    return (
        f"SELECT {extra}c_mktsegment AS term, round(sign(s) * greatest(abs(s) - {lam}, 0) / n, 3) + 0.0 AS estimate "
        "FROM (SELECT c_mktsegment, sum(c_acctbal) AS s, count(*)::DOUBLE AS n, (SELECT count(*) FROM customer) AS total FROM customer GROUP BY c_mktsegment)"
    )


def _estimates(df, *keep):
    return df.select(*keep, "term", rounded("estimate", 3).alias("estimate"))


@query(_lasso_sql(str(LAM)))
def lasso_cd(spark, folder):
    df, names = _segments(spark, folder)
    return _estimates(lasso.lasso_cd(df, names, LAM))


@query(_lasso_sql(str(LAM)))
def lasso_ml(spark, folder):
    df, names = _segments(spark, folder)
    reg = LAM / df.count()
    return _estimates(lasso.lasso_ml(df, names, reg, intercept=False, standardize=False, tol=1e-13))


def _admm_options(df):
    return {"rho": df.count() / 20, "blocks": 4, "abs_tol": 1e-6, "rel_tol": 1e-9, "max_iter": 200}


@query(_lasso_sql(str(LAM)))
def lasso_admm(spark, folder):
    df, names = _segments(spark, folder)
    return _estimates(lasso.lasso_admm(df, names, LAM, **_admm_options(df)))


# The same iteration row by row: four blocks of customers, in each of which every segment has a coefficient w and a dual u.
_CONVERGENCE_SQL = f"""
WITH RECURSIVE cells AS (
  SELECT b.i, g.j, coalesce(c.n, 0)::DOUBLE AS n, coalesce(c.s, 0)::DOUBLE AS s FROM (SELECT unnest(range(4)) AS i) b
  CROSS JOIN (SELECT DISTINCT c_mktsegment AS j FROM customer) g
  LEFT JOIN (SELECT c_custkey % 4 AS i, c_mktsegment AS j, count(*) AS n, sum(c_acctbal) AS s FROM customer GROUP BY ALL) c ON c.i = b.i AND c.j = g.j),
k AS (SELECT count(*) / 20.0::DOUBLE AS rho, sum(c_acctbal * c_acctbal)::DOUBLE AS yy FROM customer),
walk AS (
  SELECT 0 AS iteration, i, j, n, s, 0::DOUBLE AS w, 0::DOUBLE AS u, 0::DOUBLE AS z, 0::DOUBLE AS z_old, false AS done,
    0::DOUBLE AS primal, 0::DOUBLE AS eps_primal, 0::DOUBLE AS dual, 0::DOUBLE AS eps_dual FROM cells
  UNION ALL
  SELECT iteration, i, j, n, s, w, u, z, z_old, primal <= eps_primal AND dual <= eps_dual, primal, eps_primal, dual, eps_dual FROM (
    SELECT iteration, i, j, n, s, w, u, z, z_old, sqrt(sum((w - z_old) * (w - z_old)) OVER ()) AS primal,
      sqrt(20) * 1e-4 + 1e-2 * greatest(sqrt(sum(w * w) OVER ()), sqrt(sum(z * z) OVER ())) AS eps_primal,
      rho * sqrt(sum((z - z_old) * (z - z_old)) OVER ()) AS dual, sqrt(20) * 1e-4 + 1e-2 * rho * sqrt(sum(u * u) OVER ()) AS eps_dual
    FROM (
      SELECT *, sign(m) * greatest(abs(m) - {LAM} / (4 * rho), 0) AS z FROM (
        SELECT *, avg(w + u) OVER (PARTITION BY j) AS m FROM (
          SELECT iteration, i, j, n, s, u, (s + rho * (z_old - u)) / (n + rho) AS w, z_old, rho FROM (
            SELECT iteration + 1 AS iteration, i, j, n, s, CASE WHEN iteration = 0 THEN 0 ELSE u + w - z END AS u, z AS z_old, rho
            FROM walk, k WHERE NOT done AND iteration < 100))))))
SELECT iteration, round(any_value(primal), 4) + 0.0 AS primal, round(any_value(eps_primal), 4) + 0.0 AS eps_primal, round(any_value(dual), 3) + 0.0 AS dual,
  round(any_value(eps_dual), 3) + 0.0 AS eps_dual, bool_or(done) AS converged,
  round((0.5 * (any_value(yy) - 2 * sum(z_old * s) + sum(z_old * z_old * n)) + {LAM} * sum(abs(z_old)) / 4) / 1e6, 5) + 0.0 AS objective_millions
FROM walk, k WHERE iteration > 0 GROUP BY iteration
"""


@query(_CONVERGENCE_SQL)
def lasso_convergence(spark, folder):
    """Residual norms per iteration, at the default tolerances, until the last one needed."""
    df, _ = _segments(spark, folder)
    log = lasso.lasso_convergence(df, LAM, rho=df.count() / 20, blocks=4, block=F.pmod("sample", F.lit(4)))
    return log.select(
        "iteration", rounded("primal", 4).alias("primal"), rounded("eps_primal", 4).alias("eps_primal"), rounded("dual", 3).alias("dual"),
        rounded("eps_dual", 3).alias("eps_dual"), "converged", rounded(F.col("objective") / 1e6, 5).alias("objective_millions"))


REGS = [0.0, 10.0, 30.0, 100.0]


@query(" UNION ALL ".join(_lasso_sql(f"({r} * total)", f"CAST({r} AS DOUBLE) AS reg, ") for r in REGS))
def lasso_path(spark, folder):
    """Several penalties from one pass over the data."""
    df, names = _segments(spark, folder)
    return _estimates(path.lasso_path(df, names, REGS, intercept=False, standardize=False), "reg")


@query("SELECT c_custkey, round(sign(c_acctbal) * greatest(abs(c_acctbal) - 2500, 0), 2) + 0.0 AS v FROM customer")
def soft_threshold(spark, folder):
    c = table(spark, folder, "customer")
    return c.select("c_custkey", rounded(lasso.soft_threshold(F.col("c_acctbal"), 2500.0), 2).alias("v"))


@query(
    f"""SELECT round(0.5 * sum(r * r) / 1e6 + 5 * {LAM} * 4000 / 1e6, 4) + 0.0 AS objective_millions FROM (SELECT 4000 - c_acctbal AS r FROM customer)"""
)
def lasso_objective(spark, folder):
    """The objective at one value for all coefficients."""
    df, names = _segments(spark, folder)
    out = lasso.lasso_objective(df, [4000.0] * len(names), LAM)
    return out.select(rounded(F.col("objective") / 1e6, 4).alias("objective_millions"))
