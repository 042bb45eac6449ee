import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException

from tests.helpers import direct_ols
from termscan.errors import BadShape, NotEnoughSamples, SingularModel
from termscan.functions.solve import coefficients
from termscan.functions.tdist import two_sided_p
from termscan.operators import ols

ROWS = [(1, 6, 100, 1), (2, 4, 156, 2), (3, 3, 146, 3), (5, 4, 398, 4), (7, 1, 201, 5)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([tuple(map(float, r)) for r in ROWS], "x1 double, x2 double, x3 double, y double")


def test_simple_regression(small):
    f = ols.ols(small, ["x1"], "y")
    assert f.estimate == pytest.approx([0.64655, 0.67241], abs=1e-5)
    assert f.std_error == pytest.approx([0.06584, 0.27622], abs=1e-5)
    assert f.t_value == pytest.approx([9.820, 2.434], abs=1e-3)
    assert f.p_value == pytest.approx([0.00224, 0.09297], abs=1e-5)
    assert (f.df, round(f.residual_standard_error, 4)) == (3, 0.3171)


def test_simple_residuals(small):
    f = ols.ols(small, ["x1"], "y")
    r = {r.y: r.residual for r in ols.fitted(small, ["x1"], "y", f).collect()}
    assert [r[float(i)] for i in range(1, 6)] == pytest.approx([-0.31897, 0.03448, 0.38793, 0.09483, -0.19828], abs=1e-5)


def test_three_regressors(small, spark):
    x = ["x1", "x2", "x3"]
    f = ols.ols(small, x, "y")
    assert f.estimate == pytest.approx([0.340324, -0.339646, 0.003229, 2.351060], abs=1e-6)
    assert f.std_error == pytest.approx([0.169190, 0.186496, 0.001900, 0.998613], abs=1e-6)
    assert f.t_value == pytest.approx([2.011, -1.821, 1.700, 2.354], abs=1e-3)
    assert f.p_value == pytest.approx([0.294, 0.320, 0.339, 0.256], abs=1e-3)
    ml = ols.ols_ml(small, x, "y").orderBy("position").collect()
    assert [r.estimate for r in ml] == pytest.approx(list(f.estimate), rel=1e-8)
    assert [r.p_value for r in ml] == pytest.approx(list(f.p_value), rel=1e-6)
    table = ols.ols_table(spark, x, f)
    assert [r.term for r in table.orderBy("position").collect()] == [*x, "(Intercept)"]


def test_summary_text(small, spark):
    f = ols.ols(small, ["x1"], "y")
    text = ols.summary_text(ols.ols_table(spark, ["x1"], f), "y")
    assert text == (
        "The Response variable: y\n\n"
        "Name          Estimate   Std. Error   t value   Pr(>|t|)\n"
        "x1            0.646552     0.065842     9.820   0.002245\n"
        "(Intercept)   0.672414     0.276221     2.434   0.092969\n"
    )


def test_too_few_samples(small):
    with pytest.raises(NotEnoughSamples):
        ols.ols(small.limit(4), ["x1", "x2", "x3"], "y")


def test_collinear_regressors(small):
    with pytest.raises(SingularModel):
        ols.ols(small.selectExpr("x1", "x1 * 2 + 1 AS x2", "y"), ["x1", "x2"], "y")


def test_pair_fixture(spark):
    rows = [(1.1, 5.4, 9.2), (2.3, 6.9, 10.1), (3.4, 7.8, 11.1), (4.6, 8.4, 12.2)]
    df = spark.createDataFrame(rows, "X1 double, X2 double, X3 double")
    one = ols.ols(df, ["X1"], "X2")
    assert 0.02010 < one.p_value[0] < 0.02012 and 0.00665 < one.p_value[1] < 0.00667
    two = ols.ols(df, ["X1", "X2"], "X3")
    assert 0.0372 < two.p_value[0] < 0.0374 and 0.0230 < two.p_value[2] < 0.0232
    assert two.p_value[1] == pytest.approx(0.1934, abs=1e-4)


def test_groups_match_single_fits(spark):
    rng = np.random.default_rng(5)
    g = rng.choice([0, 0, 0, 1, 2], 300)
    x = rng.normal(size=(300, 2)) + 100
    y = x @ [1.0, -2.0] + g + rng.normal(size=300)
    rows = [(int(a), *map(float, b), float(c)) for a, b, c in zip(g, x, y)]
    df = spark.createDataFrame(rows, "g int, a double, b double, y double")
    got = ols.ols_by_group(df, "g", ["a", "b"], "y").collect()
    for k in (0, 1, 2):
        beta, se, t, p = direct_ols(x[g == k], y[g == k])
        mine = sorted((r for r in got if r.phenotype == str(k)), key=lambda r: r.position)
        assert [r.estimate for r in mine] == pytest.approx(list(beta), rel=1e-6)
        assert [r.t_value for r in mine] == pytest.approx(list(t), rel=1e-6)


def test_known_t_probabilities():
    assert two_sided_p([9.820, 1.96, 0.0], [3, 997, 7]) == pytest.approx([0.0022447, 0.05027402, 1.0], abs=1e-6)
    assert two_sided_p([12.706204736], [1])[0] == pytest.approx(0.05, abs=1e-9)
    assert two_sided_p([4.302652730], [2])[0] == pytest.approx(0.05, abs=1e-9)
    assert two_sided_p([1.959963985], [1e9])[0] == pytest.approx(0.05, abs=1e-8)
    assert np.isnan(two_sided_p([1.0, np.nan], [0, 5])).all()
    assert two_sided_p([np.inf], [4])[0] == 0.0
    assert 0 < two_sided_p([40.0], [1000])[0] < 1e-200


@settings(max_examples=50, deadline=None)
@given(st.floats(0, 30), st.integers(1, 400))
def test_t_probability_against_a_finite_sum(t, df):
    c2 = df / (df + t * t)
    theta = np.arctan(t / np.sqrt(df))
    term, total = 1.0, 0.0
    if df % 2 == 0:
        total, term = 1.0, 1.0
        for j in range(1, df // 2):
            term *= (2 * j - 1) / (2 * j) * c2
            total += term
        a = np.sin(theta) * total
    else:
        if df > 1:
            term = total = np.sqrt(c2)
            for j in range(1, (df - 1) // 2):
                term *= 2 * j / (2 * j + 1) * c2
                total += term
        a = 2 / np.pi * (theta + np.sin(theta) * total)
    assert two_sided_p(t, df) == pytest.approx(1 - a, abs=1e-11)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_moment_solution_equals_direct_fit(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(8, 40)), int(rng.integers(1, 5))
    x = rng.normal(size=(n, k)) * 10 ** rng.uniform(-3, 3, k) + rng.normal(size=k)
    y = rng.normal(size=n)
    xm, ym = x.mean(0), y.mean()
    f = coefficients(n, xm, ym, (x - xm).T @ (x - xm), (x - xm).T @ (y - ym), (y - ym) @ (y - ym))
    beta, se, t, _ = direct_ols(x, y)
    assert f.t_value == pytest.approx(t, rel=1e-6, abs=1e-8)
    assert f.std_error == pytest.approx(se, rel=1e-6)


def test_orthogonal_column_leaves_other_slopes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 2))
    y = rng.normal(size=50)
    base = np.column_stack([x, np.ones(50)])
    z = rng.normal(size=50)
    z -= base @ np.linalg.lstsq(base, z, rcond=None)[0]
    assert direct_ols(np.column_stack([x, z]), y)[0][:2] == pytest.approx(direct_ols(x, y)[0][:2])


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_missing_values_are_an_error(spark, bad):
    rows = [(float(i), float(i % 3), float(i % 7), "g") for i in range(20)] + [(bad, 1.0, 2.0, "g")]
    df = spark.createDataFrame(rows, "x1 double, x2 double, y double, g string")
    for fit in (ols.ols, ols.ols_ml):
        with pytest.raises(BadShape, match="1 rows lack"):
            fit(df, ["x1", "x2"], "y")
    with pytest.raises(PythonException, match="1 rows lack"):
        ols.ols_by_group(df, "g", ["x1", "x2"], "y").collect()


def test_groups_that_fail_are_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(g, float(a), float(b), float(a - 2 * b + rng.normal())) for g in "pq" for a, b in rng.normal(size=(12, 2))]
    rows += [("few", 1.0, 2.0, 3.0), ("few", 2.0, 1.0, 3.5), ("flat", *[4.0] * 2, 1.0)] + [("flat", 4.0, float(k), float(k)) for k in range(6)]
    rows += [("twice", float(k), 2.0 * k, float(k % 3)) for k in range(8)] + [("hole", float(k), None if k == 3 else float(k * k), 1.0 * k) for k in range(8)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double")
    got = ols.ols_by_group(df, "g", ["a", "b"], "y", failures=True).collect()
    assert {r.phenotype: r.failure for r in got if r.term is None} == {"few": "NotEnoughSamples", "flat": "SingularModel", "twice": "SingularModel", "hole": "BadShape"}
    alone = {(r.phenotype, r.term): r.estimate for r in ols.ols_by_group(df.where("g IN ('p', 'q')"), "g", ["a", "b"], "y").collect()}
    assert {(r.phenotype, r.term): r.estimate for r in got if r.term is not None} == pytest.approx(alone)
