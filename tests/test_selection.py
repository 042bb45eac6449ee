import numpy as np
import pytest

from tests.helpers import cement, direct_ols, direct_stepwise, term_matrix, vector_frame
from termscan.errors import BadShape, IterationLimit, NoCandidates, NoTermEntered, NotEnoughSamples
from termscan.operators import scan, tiles
from termscan.operators.reshape import vectors_to_long
from termscan.plans import stepwise as sw

S = scan.SINGLE


def select(df, traits=("pheno",), pairs=False, width=tiles.TILE_WIDTH, **options):
    ts = tiles.from_vectors(df, traits, pairs, width)
    try:
        return sw.stepwise(ts, pairs, **options)
    finally:
        ts.release()


# --- golden runs on the cement data ---------------------------------------------------------


def test_entry_without_removal(spark):
    models, paths = select(cement(spark, ["x1", "x2", "x3", "x4"]))
    m = models["pheno"]
    assert m.terms == ((1, S), (0, S)) and m.status == "threshold"
    assert m.fit.estimate == pytest.approx([0.65914, 1.43143, 53.02180], abs=1e-5)
    assert m.fit.p_value == pytest.approx([3.42e-05, 5.05e-05, 9.52e-07], rel=2e-3)
    assert [(s.term[0], s.event) for s in paths["pheno"]] == [(1, "entered"), (0, "entered"), (2, "refused")]
    assert [s.p_value for s in paths["pheno"]] == pytest.approx([0.00321174, 5.05494e-05, 0.281934], rel=1e-5)


def test_removal_and_refit(spark):
    models, paths = select(cement(spark, ["x1", "x3"]), initial_included={"pheno": [(1, S)]})
    m = models["pheno"]
    assert m.terms == ((0, S),) and m.status == "exhausted"
    assert m.fit.estimate == pytest.approx([2.1223, 78.5724], abs=1e-4)
    assert m.fit.p_value == pytest.approx([0.00515, 1.6e-06], abs=1e-5)
    removed = [s for s in paths["pheno"] if s.event == "removed"]
    assert [s.term for s in removed] == [(1, S)] and removed[0].p_value == pytest.approx(0.6205, abs=1e-4)


def test_skipped_term_comes_back(spark):
    models, paths = select(cement(spark, ["x1", "x2"]), initial_skipped={"pheno": [(1, S)]})
    m = models["pheno"]
    assert m.terms == ((0, S), (1, S))
    assert m.fit.estimate == pytest.approx([1.43143, 0.65914, 53.02180], abs=1e-5)
    assert [s.event for s in paths["pheno"]] == ["entered", "entered"]


def test_first_scan_p_values(spark):
    ts = tiles.from_vectors(cement(spark, ["x1", "x2", "x3", "x4"]), ("pheno",))
    rows = scan.with_p_values(scan.scan_table(ts, {"pheno": scan.ModelState()})).collect()
    p = {r.a: r.p_value for r in rows}
    assert [p[i] for i in range(4)] == pytest.approx([0.00515, 0.00321174, 0.060671, 0.00532391], rel=2e-3)
    given = scan.measure(ts, {"pheno": [(1, S)]})
    p = {r.a: r.p_value for r in scan.with_p_values(scan.scan_table(ts, given)).collect()}
    assert p == {0: pytest.approx(5.05494e-05, rel=1e-5), 2: pytest.approx(0.0346008, rel=1e-5), 3: pytest.approx(0.732183, rel=1e-5)}


# --- errors and edge cases --------------------------------------------------------------------


def test_nothing_enters(spark):
    with pytest.raises(NoTermEntered):
        select(cement(spark, ["x1", "x3"]), forward=1e-9)


def test_no_candidates(spark):
    with pytest.raises(NoCandidates):
        select(cement(spark, ["x1"]), initial_included={"pheno": [(0, S)]})


@pytest.mark.parametrize("value", [0.0, 1.5, -1.0])
def test_thresholds_are_checked(spark, value):
    with pytest.raises(ValueError):
        select(cement(spark, ["x1", "x2"]), forward=value)


def test_not_enough_samples(spark):
    df = cement(spark, ["x1", "x2"]).limit(3)
    with pytest.raises(NotEnoughSamples):
        select(df, initial_included={"pheno": [(0, S)]}, forward=1.0)


def test_single_marker_has_no_pairs(spark):
    models, _ = select(cement(spark, ["x1"]), pairs=True)
    assert models["pheno"].terms == ((0, S),) and models["pheno"].status == "exhausted"


def test_repeated_and_constant_columns_never_enter_twice(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    x = np.column_stack([x, x[:, 0], np.full(60, 2.0)])
    y = 3 * x[:, 0] + rng.normal(size=60)
    ts = tiles.from_vectors(vector_frame(spark, x, {"y": y}), ("y",), True)
    models, _ = sw.stepwise(ts, True, 0.001, 0.002)
    assert models["y"].terms == ((0, S),)
    given = scan.measure(ts, {"y": [(0, S)]})
    flags = {(r.a, r.b): r.collinear for r in scan.scan_table(ts, given, pairs=True).collect()}
    assert flags[3, S] and flags[4, S] and flags[0, 4] and not flags[1, S]


@pytest.mark.parametrize("small", [False, True])
def test_large_means_cost_no_digits(spark, monkeypatch, small):
    """Means of up to 1.7 million standard deviations, in one task and where blocks of terms meet."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(400, 5))
    y = 3 * base[:, 0] + rng.normal(size=400)
    x = base.copy()
    x[:, 1:4] = base[:, [0]] + 0.01 * base[:, 1:4]
    x = x * [1, 1, 1, 1000, 1] + [0, 1e5, 1e6, 1.7e9, -1e6]
    if small:
        monkeypatch.setattr(scan, "LOCAL_PAIR_BYTES", 0)
        monkeypatch.setattr(tiles, "TILE_BYTES", 2000)
        monkeypatch.setattr(tiles, "TASK_WORK", 1e3)
        monkeypatch.setattr(tiles, "TASK_ROWS_PAIRS", 50)
    ts = tiles.from_vectors(vector_frame(spark, x, {"y": y}).repartition(5), ("y",), True, 2 if small else tiles.TILE_WIDTH)
    r = y - y.mean()

    def direct(a, b):
        c = np.asarray(x[:, a], dtype=np.longdouble) * (1 if b == S else x[:, b])
        c = np.asarray(c - c.mean(), dtype=float)
        slope = c @ r / (c @ c)
        return slope / np.sqrt(np.square(r - slope * c).sum() / 398 / (c @ c))

    rows = scan.scan_table(ts, {"y": scan.ModelState()}, pairs=True).collect()
    assert len(rows) == 15
    for row in rows:
        assert row.t_value == pytest.approx(direct(row.a, row.b), rel=1e-8, abs=1e-8)
    best = scan.best_candidates(ts, {"y": scan.ModelState()}, {}, True)["y"]
    assert best.t_value == pytest.approx(max((t for t in (direct(r.a, r.b) for r in rows)), key=abs), rel=1e-8)


def test_unequal_thresholds_stop(spark):
    """A term that enters and leaves in turn must not run forever."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6))
    y = rng.normal(size=40)
    models, _ = select(vector_frame(spark, x, {"pheno": y}), forward=0.9, backward=0.2, max_iterations=60)
    assert models["pheno"].status in {"cycle", "threshold", "exhausted"}


def test_phenotypes_do_not_share_state(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 8))
    ys = {"p": x[:, 0] + x[:, 1] + 0.3 * rng.normal(size=80), "q": x[:, 1] - x[:, 5] + 0.3 * rng.normal(size=80)}
    df = vector_frame(spark, x, ys)
    both, _ = select(df, ("p", "q"), forward=1e-4, backward=2e-4)
    for trait in ys:
        alone, _ = select(df, (trait,), forward=1e-4, backward=2e-4)
        assert both[trait].terms == alone[trait].terms
        assert both[trait].fit.t_value == pytest.approx(alone[trait].fit.t_value)


# --- against direct computation ---------------------------------------------------------------


def _random(seed, n=70, p=9):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(size=(n, p)) * 2) / 2 + 0.1 * rng.normal(size=(n, p))
    y = 2 * x[:, 0] - x[:, 3] + 3 * x[:, 1] * x[:, 4] + rng.normal(size=n)
    return x, y


@pytest.mark.parametrize("seed,pairs,alpha", [(0, True, 0.01), (1, True, 0.05), (2, False, 0.05), (3, False, 0.3)])
def test_search_equals_refitting_every_model(spark, seed, pairs, alpha):
    x, y = _random(seed)
    models, _ = select(vector_frame(spark, x, {"pheno": y}), pairs=pairs, forward=alpha, backward=alpha)
    assert list(models["pheno"].terms) == direct_stepwise(x, y, pairs, alpha, alpha)
    cols, terms = term_matrix(x, pairs)
    beta, se, t, p = direct_ols(cols[:, [terms.index(m) for m in models["pheno"].terms]], y)
    assert models["pheno"].fit.t_value == pytest.approx(t, rel=1e-8)
    assert models["pheno"].fit.estimate == pytest.approx(beta, rel=1e-8)
    assert models["pheno"].fit.std_error == pytest.approx(se, rel=1e-8)


@pytest.mark.parametrize("width", [2, 4, 512])
@pytest.mark.parametrize("meet", [False, True])
def test_scan_equals_direct_fits(spark, monkeypatch, width, meet):
    if meet:
        monkeypatch.setattr(scan, "LOCAL_PAIR_BYTES", 0)
        monkeypatch.setattr(scan, "SEGMENT_ROWS", 20)
    monkeypatch.setattr(tiles, "TILE_BYTES", 8 * 10 * min(width, 9))
    x, y = _random(7)
    x += 50.0
    ts = tiles.from_vectors(vector_frame(spark, x, {"y": y}), ("y",), True, width)
    model = [(2, S), (0, 5)]
    rows = scan.scan_table(ts, scan.measure(ts, {"y": model}), {"y": frozenset([(1, 2)])}, True).collect()
    cols, terms = term_matrix(x, True)
    base = [terms.index(m) for m in model]
    got = {(r.a, r.b): r for r in rows}
    assert set(got) == set(terms) - set(model) - {(1, 2)}
    for term, r in got.items():
        beta, se, t, _ = direct_ols(cols[:, base + [terms.index(term)]], y)
        assert r.t_value == pytest.approx(t[-2], rel=1e-5, abs=1e-6)
        assert r.std_error == pytest.approx(se[-2], rel=1e-5)
    best = scan.best_candidates(ts, scan.measure(ts, {"y": model}), {"y": frozenset(model)}, True)["y"]
    assert best.term == max((t for t in terms if t not in model), key=lambda t: abs(direct_ols(cols[:, base + [terms.index(t)]], y)[2][-2]))
    ts.release()


def test_long_and_vector_tiles_agree(spark):
    x, y = _random(8)
    df = vector_frame(spark, x, {"y": y, "z": x[:, 2] * x[:, 6] - y})
    long = vectors_to_long(df, "sample", "values")
    pheno = df.selectExpr("sample", "stack(2, 'y', y, 'z', z) AS (trait, y)")
    a = tiles.from_vectors(df, ("y", "z"), True, 4)
    b = tiles.from_long(long, pheno, ("y", "z"), True, 4)
    ma, pa = sw.stepwise(a, True, 0.01, 0.02)
    mb, pb = sw.stepwise(b, True, 0.01, 0.02)
    for trait in ("y", "z"):
        assert ma[trait].terms == mb[trait].terms
        assert ma[trait].fit.t_value == pytest.approx(mb[trait].fit.t_value)
        assert [s.event for s in pa[trait]] == [s.event for s in pb[trait]]


@pytest.mark.parametrize("model", [[], [1], [1, 6, 4]])
def test_plain_dataframe_scan_agrees_with_tiles(spark, model):
    x, y = _random(9)
    df = vector_frame(spark, x, {"y": y})
    long = vectors_to_long(df, "sample", "values")
    basis, n = scan.orthonormal_basis(scan.model_columns(long, [(m, S) for m in model], df), len(model))
    plain = {r.term_id: r.t_value for r in scan.forward_scan_long(long, basis, len(model), n).collect()}
    ts = tiles.from_vectors(df, ("y",))
    state = scan.measure(ts, {"y": [(m, S) for m in model]}) if model else {"y": scan.ModelState()}
    tiled = {r.a: r.t_value for r in scan.scan_table(ts, state).collect()}
    assert {k: v for k, v in plain.items() if k not in model} == pytest.approx(tiled, rel=1e-9)


def test_missing_cells_are_an_error(spark):
    x, y = _random(10)
    df = vector_frame(spark, x, {"y": y})
    long = vectors_to_long(df, "sample", "values")
    pheno = df.selectExpr("sample", "'y' AS trait", "y")
    with pytest.raises(BadShape):
        tiles.from_long(long.filter("NOT (sample = 'i3' AND term_id = 2)"), pheno, ("y",))
    twice = long.filter("NOT (sample = 'i3' AND term_id = 2)").unionByName(long.filter("sample = 'i4' AND term_id = 2"))
    ts = tiles.from_long(twice, pheno, ("y",))
    with pytest.raises(Exception, match="lacks a cell"):
        ts.blocks.count()
    with pytest.raises(BadShape):
        tiles.from_long(long, pheno.filter("sample <> 'i3'"), ("y",))
    with pytest.raises(BadShape):
        tiles.from_vectors(df.selectExpr("sample", "CASE WHEN sample = 'i2' THEN array(CAST(1 AS DOUBLE)) ELSE values END AS values", "y"), ("y",))


def test_perfect_fit_enters_first(spark):
    x, _ = _random(11)
    models, paths = select(vector_frame(spark, x, {"pheno": 5 * x[:, 2] + 1}), forward=1e-6, backward=2e-6)
    assert paths["pheno"][0].term == (2, S)
    assert models["pheno"].terms == ((2, S),)


@pytest.mark.parametrize("meet", [False, True])
def test_written_tiles_in_many_tasks(spark, monkeypatch, meet):
    """Large tables live in the shared folder and are scanned by many tasks; the result is the same."""
    x, y = _random(12, n=200)
    df = vector_frame(spark, x, {"y": y})
    plain, _ = select(df, ("y",), True, forward=0.01, backward=0.02)
    monkeypatch.setattr(tiles, "DURABLE_BYTES", 0)
    monkeypatch.setattr(tiles, "TASK_WORK", 1.0)
    monkeypatch.setattr(tiles, "TILE_BYTES", 8 * 9 * 10)
    if meet:
        monkeypatch.setattr(scan, "LOCAL_PAIR_BYTES", 0)
        monkeypatch.setattr(scan, "SEGMENT_ROWS", 64)
    ts = tiles.from_vectors(df, ("y",), True, 4)
    assert ts.n_parts > 4 and ts.written is not None
    models, _ = sw.stepwise(ts, True, 0.01, 0.02)
    assert models["y"].terms == plain["y"].terms
    assert models["y"].fit.t_value == pytest.approx(plain["y"].fit.t_value)
    ts.release()
    with pytest.raises(Exception):
        ts.blocks.count()


@pytest.mark.parametrize("seed", [0, 1])
def test_a_search_that_goes_round_reports_a_cycle(spark, seed):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(40, 6)), rng.normal(size=40)
    models, _ = select(vector_frame(spark, x, {"pheno": y}), forward=0.9, backward=0.2)
    assert models["pheno"].status == "cycle"
    assert list(models["pheno"].terms) == direct_stepwise(x, y, False, 0.9, 0.2)


def test_iteration_limit(spark):
    x, y = _random(13)
    with pytest.raises(IterationLimit) as reached:
        select(vector_frame(spark, x, {"pheno": y}), pairs=True, max_iterations=1)
    models = reached.value.models
    assert models["pheno"].status == "iterations" and len(models["pheno"].terms) == 1
    assert {r.status for r in sw.model_frame(spark, models).collect()} == {"iterations"}
    with pytest.raises(IterationLimit):
        select(vector_frame(spark, x, {"pheno": y}), pairs=True, max_iterations=0)


def test_terms_whose_p_value_is_zero_rank_by_t(spark):
    """Both p-values are below the smallest double; the larger |t| must win whatever the order."""
    rng = np.random.default_rng(3)
    y = rng.normal(size=3000)
    x = np.column_stack([y + 0.05 * rng.normal(size=3000), y + 0.01 * rng.normal(size=3000)])
    ts = tiles.from_vectors(vector_frame(spark, x, {"y": y}), ("y",))
    rows = {r.a: r for r in scan.with_p_values(scan.scan_table(ts, {"y": scan.ModelState()})).collect()}
    assert rows[0].p_value == rows[1].p_value == 0.0 and rows[1].t_value > rows[0].t_value
    assert scan.best_candidates(ts, {"y": scan.ModelState()}, {}, False)["y"].term == (1, S)


def test_equal_terms_go_to_the_first(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 4))
    x[:, 3] = x[:, 1]
    y = x[:, 1] + 0.1 * rng.normal(size=50)
    for width in (2, 512):
        ts = tiles.from_vectors(vector_frame(spark, x, {"y": y}), ("y",), True, width)
        assert scan.best_candidates(ts, {"y": scan.ModelState()}, {}, True)["y"].term == (1, S)


def test_an_infinite_value_is_an_error(spark):
    x, y = _random(14)
    x[3, 2] = np.inf
    with pytest.raises(BadShape, match="infinite"):
        tiles.from_vectors(vector_frame(spark, x, {"y": y}), ("y",))


@pytest.mark.parametrize("size", [10, 35, 1000])
def test_term_vector_tiles_agree(spark, monkeypatch, size):
    x, y = _random(15)
    monkeypatch.setattr(tiles, "TILE_BYTES", 8 * 4 * size)
    z = x[:, 2] * x[:, 6] - y
    vectors = spark.createDataFrame([(j, [float(v) for v in x[:, j]]) for j in range(x.shape[1])], "term_id long, values array<double>")
    ys = spark.createDataFrame([("z", [float(v) for v in z]), ("y", [float(v) for v in y])], "trait string, values array<double>")
    ts = tiles.from_term_vectors(vectors.repartition(3), ys, ("y", "z"), x.shape[1], True, 4)
    mine, _ = sw.stepwise(ts, True, 0.01, 0.02)
    other, _ = select(vector_frame(spark, x, {"y": y, "z": z}), ("y", "z"), True, forward=0.01, backward=0.02)
    for trait in ("y", "z"):
        assert mine[trait].terms == other[trait].terms
        assert mine[trait].fit.estimate == pytest.approx(other[trait].fit.estimate)
    short = vectors.filter("term_id <> 3").unionByName(vectors.filter("term_id = 3").selectExpr("term_id", "slice(values, 1, 69) AS values"))
    with pytest.raises(BadShape):
        tiles.from_term_vectors(short, ys, ("y",), x.shape[1])
    with pytest.raises(BadShape, match="missing or occurs twice"):
        tiles.from_term_vectors(vectors.filter("term_id <> 3"), ys, ("y",), x.shape[1])
