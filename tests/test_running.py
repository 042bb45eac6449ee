"""Running moments against whole scans: same winners with and without skipped tile pairs, terms that leave and return."""

import numpy as np
import pytest

from tests.helpers import vector_frame
from termscan.operators import running, scan, tiles
from termscan.plans import stepwise as sw

S = scan.SINGLE


def tile_set(spark, x, ys, width, parts=3):
    return tiles.from_vectors(vector_frame(spark, x, ys).repartition(parts), tuple(ys), True, width)


def walk(ts, models, prune, pairs=True):
    """The winner for each of a row of models, by running moments and by a whole scan."""
    trait = ts.traits[0]
    own = running.RunningScan(ts, (trait,), pairs, prune)
    got, want, last = [], [], scan.ModelState()
    for terms, skipped in models:
        both = tuple(dict.fromkeys([*last.terms, *terms]))
        union = scan.measure(ts, {trait: both})[trait] if both else scan.ModelState()
        state = union.keep(terms) if terms else scan.ModelState()
        closed = {trait: frozenset(terms) | frozenset(skipped)}
        got.append(own.best({trait: state}, closed, {trait: union})[trait])
        want.append(scan.best_candidates(ts, {trait: state}, closed, pairs)[trait])
        last = state
    own.close()
    return own, got, want


def rare(n, p, seed):
    """Columns with ever fewer values that are not zero, and some dense ones."""
    rng = np.random.default_rng(seed)
    share = np.concatenate([np.full(4, 0.5), np.geomspace(0.3, 0.004, p - 4)])
    return rng, (rng.random((n, p)) < share) * rng.integers(1, 3, (n, p)).astype(float)


@pytest.mark.parametrize("meet", [False, True])
@pytest.mark.parametrize("prune", [False, True])
def test_models_that_grow_and_shrink(spark, monkeypatch, meet, prune):
    rng, x = rare(500, 14, 4)
    x[:, 2] += 1e4  # a large mean
    y = 2 * x[:, 0] + 1.5 * x[:, 1] * x[:, 3] - x[:, 4] + rng.normal(size=500)
    if meet:
        monkeypatch.setattr(scan, "LOCAL_PAIR_BYTES", 0)
    monkeypatch.setattr(tiles, "TILE_BYTES", 4000)
    monkeypatch.setattr(tiles, "TASK_WORK", 1e4)
    monkeypatch.setattr(tiles, "TASK_ROWS_PAIRS", 100)
    monkeypatch.setattr(running, "WRITTEN", 3)
    ts = tile_set(spark, x, {"y": y}, 3)
    assert ts.n_parts > 1
    a, b, c, d = (0, S), (1, 3), (4, S), (2, 5)
    models = [((), ()), ((a,), ()), ((a, b), ()), ((a, b, d), (c,)), ((b, d), (a,)), ((b, d, c), ()), ((c,), (b,)), ((c, a), ()), ((c, a), (d, b))]
    own, got, want = walk(ts, models, prune)
    for g, w, (terms, _) in zip(got, want, models):
        assert g.term == w.term and g.df == w.df
        assert g.t_value == pytest.approx(w.t_value, rel=1e-9) and g.squares == pytest.approx(w.squares, rel=1e-9)
        state = scan.measure(ts, {"y": (*terms, g.term)})["y"]
        assert np.allclose(g.extended.gram, state.gram, rtol=1e-9, atol=1e-7)
    assert all(x.tile_pairs == 15 for x in own.log)
    ts.release()


def test_tile_pairs_are_skipped(spark):
    """Rare columns cannot beat a strong term, so most of their tile pairs are never looked at again."""
    rng, x = rare(3000, 60, 9)
    y = 3 * x[:, 0] + 2 * x[:, 1] * x[:, 2] - 1.5 * x[:, 3] + rng.normal(size=3000)
    ts = tile_set(spark, x, {"y": y}, 6)
    own, got, want = walk(ts, [((), ()), (((0, S),), ()), (((0, S), (1, 2)), ())], None)
    assert [g.term for g in got] == [w.term for w in want] and [g.t_value for g in got] == pytest.approx([w.t_value for w in want], rel=1e-9)
    assert own.log[0] == running.Look(55, 55)
    assert all(entry.looked < 30 for entry in own.log[1:])
    ts.release()


def test_search_is_the_same_with_and_without_bounds(spark):
    rng, x = rare(800, 24, 2)
    ys = {"one": x[:, 0] - x[:, 3] + 2 * x[:, 1] * x[:, 2] + rng.normal(size=800), "two": x[:, 5] + rng.normal(size=800)}
    ts = tile_set(spark, x, ys, 4)
    runs = [sw.stepwise(ts, True, 0.001, 0.002, prune=p) for p in (False, True)]
    assert {t: m.terms for t, m in runs[0][0].items()} == {t: m.terms for t, m in runs[1][0].items()}
    for t in ys:
        assert [(s.term, s.event) for s in runs[0][1][t]] == [(s.term, s.event) for s in runs[1][1][t]]
    ts.release()


def test_work_does_not_grow_with_the_model(spark):
    """What an iteration shuffles per term: the table's rows and one product per task, whatever the model's size."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12))
    ts = tile_set(spark, x, {"y": x @ rng.normal(size=12) + rng.normal(size=300)}, 12)
    own = running.RunningScan(ts, ("y",), True)
    sizes, last = [], scan.ModelState()
    for k in range(8):
        state = scan.measure(ts, {"y": [(i, S) for i in range(k)]})["y"] if k else scan.ModelState()
        own.best({"y": state}, {"y": frozenset(state.terms)}, {"y": state})
        layers = own._layers({(S, S): len(own.steps) - 1, (0, 0): len(own.steps) - 1}).where("kind = 1") if k else None
        if k:
            sizes.append(layers.selectExpr("sum(length(m))").first()[0] / layers.count())
        last = state
    own.close()
    assert len(last.terms) == 7 and len(set(sizes)) == 1 and len(own.steps) <= 1
    ts.release()
