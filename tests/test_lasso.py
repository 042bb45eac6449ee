import numpy as np
import pytest

from tests.helpers import vector_frame
from termscan.errors import NotConverged, TooManyColumns
from termscan.operators import lasso, lasso_grid, path, tiles


def _data(spark, n=60, d=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = x @ np.where(np.arange(d) % 2, 0.0, 2.0) + rng.normal(size=n)
    return x, y, vector_frame(spark, x, {"y": y}), [f"b{i}" for i in range(d)]


def _beta(df):
    return [r.estimate for r in df.orderBy("position").collect()]


def _optimal(x, y, beta, lam, tol):
    """Subgradient conditions of RSS / 2 + lam |b|."""
    g = x.T @ (y - x @ beta)
    for gj, b in zip(g, beta):
        assert abs(gj) <= lam + tol
        if abs(b) > 1e-7:
            assert gj == pytest.approx(lam * np.sign(b), abs=tol)


@pytest.mark.parametrize("lam", [0.5, 20.0, 1000.0])
def test_three_solvers_agree(spark, lam):
    x, y, df, names = _data(spark)
    cd = _beta(lasso.lasso_cd(df, names, lam))
    _optimal(x, y, np.array(cd), lam, 1e-6)
    admm = _beta(lasso.lasso_admm(df, names, lam, blocks=3, rho=20.0, abs_tol=1e-8, rel_tol=1e-8, max_iter=300))
    assert admm == pytest.approx(cd, abs=1e-6)
    ml = _beta(lasso.lasso_ml(df, names, lam / len(y), intercept=False, standardize=False, tol=1e-12, max_iter=500))
    assert ml == pytest.approx(cd, abs=1e-4)


def test_blocks_with_fewer_rows_than_columns(spark, monkeypatch):
    monkeypatch.setattr(lasso, "DURABLE_EVERY", 3)
    monkeypatch.setattr(lasso, "SLICE", 7)
    monkeypatch.setattr(lasso, "DRIVER_BYTES", 0)
    x, y, df, names = _data(spark, n=40, d=20, seed=1)
    result = lasso.admm(df, 3.0, rho=5.0, blocks=6, abs_tol=1e-7, rel_tol=1e-7, max_iter=400)
    assert result.converged
    _optimal(x, y, result.beta, 3.0, 1e-3)


def test_replayed_state_equals_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(lasso, "DURABLE_EVERY", 2)
    x, y, df, _ = _data(spark, n=30, d=4, seed=2)
    lam, rho, steps = 1.5, 2.0, 7
    result = lasso.admm(df, lam, rho=rho, blocks=1, abs_tol=0.0, rel_tol=0.0, max_iter=steps)
    w = u = z = np.zeros(4)
    for i in range(steps):
        u = u + w - z if i else u
        w = np.linalg.solve(x.T @ x + rho * np.eye(4), x.T @ y + rho * (z - u))
        z = np.sign(w + u) * np.maximum(np.abs(w + u) - lam / rho, 0)
    assert result.beta == pytest.approx(z, rel=1e-9)
    assert len(result.log) == steps and not result.converged


def test_convergence_log(spark):
    x, y, df, _ = _data(spark)
    rows = lasso.lasso_convergence(df, 0.5, rho=10.0, blocks=3).orderBy("iteration").collect()
    assert rows[-1].primal <= rows[-1].eps_primal and rows[-1].dual <= rows[-1].eps_dual
    assert rows[0].objective == pytest.approx(0.5 * y @ y)
    assert rows[-1].objective < rows[0].objective


def test_path_with_intercept_and_standardisation(spark):
    x, y, df, names = _data(spark, n=80, d=4, seed=3)
    y = y + 7
    df = vector_frame(spark, x * [1, 10, 0.1, 1], {"y": y})
    rows = path.lasso_path(df, names, [0.0, 0.2]).collect()
    assert all(r.converged for r in rows)
    for reg in (0.0, 0.2):
        mine = [r.estimate for r in sorted((r for r in rows if r.reg == reg), key=lambda r: r.position)]
        ml = _beta(lasso.lasso_ml(df, names, reg, tol=1e-13, max_iter=1000))
        assert mine == pytest.approx(ml, rel=1e-4, abs=1e-4)


def _scaled(x, y, b, sd):
    n = len(y)
    r = y - y.mean() - (x - x.mean(0)) @ b
    return (x - x.mean(0)).T @ r / n / sd


@pytest.mark.parametrize("small", [False, True])
def test_path_on_a_wide_table(spark, monkeypatch, small):
    """More columns than samples and than a Gram matrix may have: optimal for every column, with a certificate."""
    rng = np.random.default_rng(12)
    n, d = 120, 500
    x = rng.normal(size=(n, d)) * rng.uniform(0.1, 10, d) + rng.normal(size=d) * 50
    x[:, 7] = 3.0
    y = 2 * (x[:, 3] - x[:, 3].mean()) - 0.5 * x[:, 200] + rng.normal(size=n) + 100
    monkeypatch.setattr(lasso, "GRAM_COLUMNS", 50)
    if small:
        monkeypatch.setattr(tiles, "TILE_BYTES", 30_000)
        monkeypatch.setattr(tiles, "TASK_WORK", 1e4)
        monkeypatch.setattr(tiles, "TASK_ROWS", 20)
    df, sd = vector_frame(spark, x, {"y": y}), x.std(0)
    sd[7] = 1.0
    ts = tiles.from_vectors(df, ("y",), False, 64 if small else tiles.TILE_WIDTH)
    assert not small or ts.n_parts > 1
    top = np.abs(_scaled(x, y, np.zeros(d), sd)).max()
    steps = path.fit_path(ts, "y", [top * 1.01, top / 2, top / 5, top / 20])
    assert steps[0].terms == () and steps[0].intercept == pytest.approx(y.mean()) and [len(s.terms) for s in steps] == sorted(len(s.terms) for s in steps)
    for s in steps:
        b = np.zeros(d)
        b[list(s.terms)] = s.estimates
        g = _scaled(x, y, b, sd)
        assert np.abs(g).max() <= s.reg * (1 + 1e-6) and s.converged and 0 <= s.gap <= 1e-6 * y.var()
        assert g[list(s.terms)] == pytest.approx(s.reg * np.sign(s.estimates), rel=1e-5)
        assert s.strong < d / 2  # the others were only checked
    rows = path.lasso_path(df, [f"b{i}" for i in range(d)], [top / 5]).collect()
    ml = _beta(lasso.lasso_ml(df, [f"b{i}" for i in range(d)], top / 5, tol=1e-12, max_iter=2000))
    assert len(rows) == d + 1 and [r.estimate for r in sorted(rows, key=lambda r: r.position)] == pytest.approx(ml, abs=2e-4)
    fits = path.path_fits(spark, steps).collect()
    assert [r.active for r in fits] == [len(s.terms) for s in steps] and all(r.converged for r in fits)
    with pytest.raises(TooManyColumns):
        monkeypatch.setattr(path, "ACTIVE_COLUMNS", 5)
        path.fit_path(ts, "y", [top / 20])
    ts.release()


def test_unfinished_iterations_show(spark):
    x, y, df, names = _data(spark, seed=4)
    assert not any(r.converged for r in lasso.lasso_admm(df, names, 0.5, rho=1000.0, blocks=2, max_iter=2).collect())
    assert [r.converged for r in lasso.lasso_convergence(df, 0.5, rho=10.0, blocks=3).orderBy("iteration").collect()][-1]
    with pytest.raises(NotConverged):
        lasso.coordinate_descent(x.T @ x, x.T @ y, 0.1, max_iter=1)
    with pytest.raises(NotConverged):
        lasso.lasso_ml(df, names, 0.1, max_iter=1)


def test_objective(spark):
    x, y, df, _ = _data(spark)
    beta = [0.5, 0.0, -1.0, 2.0, 0.1]
    got = lasso.lasso_objective(df, beta, 0.7).first()[0]
    assert got == pytest.approx(0.5 * np.square(x @ beta - y).sum() + 0.7 * np.abs(beta).sum())


def test_too_many_columns_for_a_gram_matrix(spark, monkeypatch):
    monkeypatch.setattr(lasso, "GRAM_COLUMNS", 4)
    _, _, df, names = _data(spark)
    with pytest.raises(ValueError, match="lasso_admm"):
        lasso.lasso_cd(df, names, 1.0)


def test_pairs_are_made_inside_the_blocks(spark):
    x, y, df, names = _data(spark, n=50, d=4, seed=5)
    result = lasso.admm(df, 2.0, rho=10.0, blocks=3, abs_tol=1e-8, rel_tol=1e-8, max_iter=300, pairs=True)
    a, b = np.triu_indices(4, 1)
    full = np.column_stack([x, x[:, a] * x[:, b]])
    assert result.beta == pytest.approx(lasso.coordinate_descent(full.T @ full, full.T @ y, 2.0), abs=1e-5)


@pytest.mark.parametrize("pairs", [False, True])
def test_grid_of_cells_walks_as_row_blocks_do(spark, monkeypatch, pairs):
    """The same iterates as with whole vectors: slices of columns and of pairs, several row blocks."""
    x, y, df, names = _data(spark, n=40, d=11 if pairs else 20, seed=1)
    monkeypatch.setattr(tiles, "TILE_BYTES", 8 * 4 * 14)
    ts = tiles.from_vectors(df, ("y",), pairs, 4)
    options = {"rho": 5.0, "abs_tol": 1e-3, "rel_tol": 1e-3, "max_iter": 6}
    got = lasso_grid.admm_grid(ts, "y", 3.0, pairs=pairs, **options)
    want = lasso.admm(df, 3.0, blocks=3, pairs=pairs, **options)
    assert ts.blocks.count() == 3 and got.converged == want.converged
    assert [r[:6] for r in got.log] == [pytest.approx(r, rel=1e-9) for r in want.log]
    labels = spark.createDataFrame(list(enumerate(names)), "term_id long, term string")
    rows = lasso_grid.named(got, labels).orderBy("position").collect()
    a, b = np.triu_indices(x.shape[1], 1)
    assert [r.term for r in rows] == names + ([f"{names[i]}_{names[j]}" for i, j in zip(a, b)] if pairs else [])
    assert [r.estimate for r in rows] == pytest.approx(want.beta, abs=1e-9) and not any(r.converged for r in rows)
    ts.release()


def test_lasso_job(spark, tmp_path, monkeypatch):
    from termscan.plans import jobs

    rng = np.random.default_rng(6)
    x = np.round(rng.uniform(size=(40, 3)) * 2) / 2
    y = 3 * x[:, 0] + 2 * x[:, 1] * x[:, 2] + 0.1 * rng.normal(size=40)
    s = [f"s{i}" for i in range(40)]
    lines = [["Samples", "allele", "chr", "pos", "cm", *s]] + [[f"m{j}", "A/C", 1, j, "NA", *x[:, j]] for j in range(3)]
    (tmp_path / "m.txt").write_text("".join("\t".join(map(str, r)) + "\n" for r in lines))
    order = rng.permutation(40)
    pheno = [["<Marker>", "PH1"]] + [[s[i], y[i]] for i in order]
    (tmp_path / "p.txt").write_text("".join("\t".join(map(str, r)) + "\n" for r in pheno))
    out = str(tmp_path / "out")
    got = jobs.run_lasso(spark, str(tmp_path / "m.txt"), str(tmp_path / "p.txt"), out, lam=0.1, rho=5.0, abs_tol=1e-8, rel_tol=1e-8, max_iter=400, blocks=2)
    rows = got.orderBy("position").collect()
    assert [r.term for r in rows] == ["m0", "m1", "m2", "m0_m1", "m0_m2", "m1_m2"]
    full = np.column_stack([x, x[:, 0] * x[:, 1], x[:, 0] * x[:, 2], x[:, 1] * x[:, 2]])
    want = lasso.coordinate_descent(full.T @ full, full.T @ y, 0.1)
    assert [r.estimate for r in rows] == pytest.approx(want, abs=1e-4) and all(r.converged for r in rows)
    assert spark.read.parquet(f"{out}/coefficients").count() == 6 and spark.read.parquet(f"{out}/convergence").count() > 1
    # the same without a vector on the driver, as far as four iterations go
    options = {"lam": 0.1, "rho": 5.0, "max_iter": 4, "blocks": 2}
    short = jobs.run_lasso(spark, str(tmp_path / "m.txt"), str(tmp_path / "p.txt"), str(tmp_path / "short"), **options).orderBy("position").collect()
    monkeypatch.setattr(jobs, "DRIVER_COLUMNS", 0)
    wide = jobs.run_lasso(spark, str(tmp_path / "m.txt"), str(tmp_path / "p.txt"), str(tmp_path / "wide"), **options).orderBy("position").collect()
    assert [r.term for r in wide] == [r.term for r in short] and [r.estimate for r in wide] == pytest.approx([r.estimate for r in short], abs=1e-9)
