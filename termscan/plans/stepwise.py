"""Bidirectional stepwise selection by p-value.

The driver keeps the state of the search, a few terms and their k x k cross products per trait;
each iteration is one pass over the tiles for all traits that are still running, by running moments:
only the direction that the newest column adds is multiplied with the terms.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from termscan.errors import IterationLimit, NoCandidates, NoTermEntered
from termscan.functions.solve import Coefficients, check_samples, coefficients
from termscan.functions.tdist import two_sided_p
from termscan.operators.running import RunningScan
from termscan.operators.scan import SINGLE, Candidate, ModelState, Term, measure, residual_squares
from termscan.operators.tiles import TileSet

MODEL_SCHEMA = (
    "phenotype string, position int, term_a long, term_b long, term string, estimate double, "
    "std_error double, t_value double, p_value double, flagged boolean, newest boolean, status string"
)
PATH_SCHEMA = "phenotype string, iteration int, term_a long, term_b long, term string, t_value double, p_value double, event string"


@dataclass(frozen=True)
class Step:
    """One event of a search: a term entered, was removed, or was the best but stayed out."""

    iteration: int
    term: Term
    t_value: float
    p_value: float
    event: str


@dataclass(frozen=True)
class Model:
    """A fitted model in entry order; ``flagged`` terms missed the removal threshold, its search took ``seconds``."""

    terms: tuple[Term, ...]
    fit: Coefficients
    flagged: frozenset[Term]
    status: str
    seconds: float = 0.0


@dataclass(frozen=True)
class _Search:
    """State of one trait between iterations."""

    state: ModelState
    skipped: frozenset[Term]
    previous: ModelState | None = None
    previous_flagged: frozenset[Term] = frozenset()
    seen: frozenset = frozenset()
    path: tuple[Step, ...] = ()


@dataclass(frozen=True)
class _Done:
    state: ModelState
    flagged: frozenset[Term]
    status: str
    path: tuple[Step, ...]


def check_threshold(name: str, value: float) -> float:
    if not 0.0 < value <= 1.0:
        raise ValueError(f"{name} must lie in (0, 1], got {value}")
    return float(value)


def term_p_values(state: ModelState, n: int) -> np.ndarray:
    """p-values of the model's terms, the intercept left out."""
    k = len(state.terms)
    fit = coefficients(n, np.zeros(k), 0.0, state.gram, state.xy, float(n))
    return fit.p_value[:k]


def total_terms(n_terms: int, pairs: bool) -> int:
    return n_terms + (n_terms * (n_terms - 1) // 2 if pairs else 0)


def advance(search: _Search, best: Candidate | None, n: int, n_all: int, forward: float, backward: float) -> _Search | _Done:
    """One iteration, given the best open candidate of the scan."""
    iteration = sum(s.event in ("entered", "refused") for s in search.path) + 1
    p = float(two_sided_p(best.t_value, best.df)) if best else 1.0
    if best is None or p >= forward:
        refused = (Step(iteration, best.term, best.t_value, p, "refused"),) if best else ()
        if search.previous is None:
            raise NoTermEntered(f"no term enters at {forward}")
        return _Done(search.previous, search.previous_flagged, "threshold", search.path + refused)
    # Skipped terms come back after the scan and before the removal check.
    model = best.extend(search.state, n)
    weak = {t: float(v) for t, v in zip(model.terms, term_p_values(model, n)) if v >= backward}
    kept = model.keep([t for t in model.terms if t not in weak])
    path = search.path + (Step(iteration, best.term, best.t_value, p, "entered"),)
    path += tuple(Step(iteration, t, float("nan"), v, "removed") for t, v in weak.items())
    if n_all == len(model.terms):
        if not weak:
            return _Done(model, frozenset(), "exhausted", path)
        return _Done(kept, frozenset(), "exhausted", path)
    here = (frozenset(kept.terms), frozenset(weak))
    if here in search.seen:
        return _Done(model, frozenset(weak), "cycle", path)
    return _Search(kept, frozenset(weak), model, frozenset(weak), search.seen | {here}, path)


def fit_models(ts: TileSet, terms: Mapping[str, Sequence[Term]], near: Mapping[str, ModelState] | None = None) -> dict[str, Coefficients]:
    """Exact least squares of given models: cross products about exact means, then a pass for the residuals."""
    n = ts.n_samples
    states = measure(ts, terms, near)
    raw, betas = {}, {}
    for trait, s in states.items():
        check_samples(n, len(s.terms) + 1)
        raw[trait] = coefficients(n, np.zeros(len(s.terms)), 0.0, s.gram, s.xy, float(n)).estimate
        betas[trait] = raw[trait][:-1]
    rss = residual_squares(ts, states, betas, {t: 0.0 for t in states})
    out = {}
    for trait, s in states.items():
        i = ts.traits.index(trait)
        y_mean, y_scale = float(ts.y_mean[i]), float(ts.y_scale[i])
        gram = s.gram * np.outer(s.scale, s.scale)
        xy = s.xy * s.scale * y_scale
        out[trait] = coefficients(n, s.centre, y_mean, gram, xy, n * y_scale**2, rss[trait] * y_scale**2)
    return out


def stepwise(
    ts: TileSet,
    pairs: bool = False,
    forward: float = 0.05,
    backward: float = 0.05,
    traits: Sequence[str] | None = None,
    initial_included: Mapping[str, Sequence[Term]] | None = None,
    initial_skipped: Mapping[str, Sequence[Term]] | None = None,
    max_iterations: int | None = None,
    prune: bool | None = None,
) -> tuple[dict[str, Model], dict[str, tuple[Step, ...]]]:
    """Select terms for every trait; each starts from its own fresh state.

    A term enters while its p-value is below ``forward``; terms at or above ``backward`` leave and
    sit out the next scan. When nothing more enters, the model of the iteration before is the
    result, together with the terms its own removal check flagged. An outcome that no term enters
    for is an error, raised when the others are done and carrying their results. Searches that go
    round are found, so every search ends by itself; reaching ``max_iterations`` is an error too.
    """
    check_threshold("forward", forward)
    check_threshold("backward", backward)
    n, n_all = ts.n_samples, total_terms(ts.n_terms, pairs)
    running: dict[str, _Search] = {}
    start = {t: tuple(v) for t, v in (initial_included or {}).items() if v}
    measured = measure(ts, start) if start else {}
    for trait in traits or ts.traits:
        skipped = frozenset((initial_skipped or {}).get(trait, ()))
        running[trait] = _Search(measured.get(trait, ModelState()), skipped)
        if n_all <= len(running[trait].state.terms) + len(skipped):
            raise NoCandidates(f"no term is left to try for {trait}")
    done: dict[str, _Done] = {}
    failed: list[str] = []
    started, seconds = time.perf_counter(), {}
    scan = RunningScan(ts, tuple(running), pairs, prune)
    for iteration in count():
        if not running or iteration == max_iterations:
            break
        states = {t: s.state for t, s in running.items()}
        closed = {t: s.skipped | frozenset(s.state.terms) for t, s in running.items()}
        best = scan.best(states, closed, {t: s.previous or s.state for t, s in running.items()})
        for trait, search in list(running.items()):
            try:
                after = advance(search, best.get(trait), n, n_all, forward, backward)
            except NoTermEntered:
                failed.append(trait)
                del running[trait]
                continue
            if isinstance(after, _Done):
                done[trait], seconds[trait] = after, time.perf_counter() - started
                del running[trait]
            else:
                running[trait] = after
    scan.close()
    for trait, s in running.items():
        if s.previous is not None:
            done[trait], seconds[trait] = _Done(s.previous, s.previous_flagged, "iterations", s.path), time.perf_counter() - started
    states = {t: d.state for t, d in done.items()}
    fits = fit_models(ts, {t: s.terms for t, s in states.items()}, states) if done else {}
    models = {t: Model(d.state.terms, fits[t], d.flagged, d.status, seconds[t]) for t, d in done.items()}
    paths = {t: d.path for t, d in done.items()}
    if running:
        raise IterationLimit(f"{', '.join(running)} did not end within {max_iterations} iterations", models, paths)
    if failed:
        raise NoTermEntered(f"no term enters at {forward} for {', '.join(failed)}", models, paths)
    return models, paths


def term_name(term: Term, names: Sequence[str] | None) -> str:
    name = lambda i: names[i] if names is not None else str(i)
    return name(term[0]) if term[1] == SINGLE else f"{name(term[0])}_{name(term[1])}"


def _ids(term: Term) -> tuple[int, int | None]:
    return term[0], None if term[1] == SINGLE else term[1]


def model_frame(spark: SparkSession, models: Mapping[str, Model], names: Mapping[int, str] | None = None) -> DataFrame:
    """Coefficient rows of finished models; the intercept is last and has no term ids."""
    rows = []
    for trait, m in models.items():
        f = m.fit
        for i, term in enumerate((*m.terms, None)):
            ids = _ids(term) if term else (None, None)
            label = term_name(term, names) if term else "(Intercept)"
            stats = (float(f.estimate[i]), float(f.std_error[i]), float(f.t_value[i]), float(f.p_value[i]))
            rows.append((trait, i + 1, *ids, label, *stats, term in m.flagged, i == len(m.terms) - 1, m.status))
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def path_frame(spark: SparkSession, paths: Mapping[str, Sequence[Step]], names: Mapping[int, str] | None = None) -> DataFrame:
    """The events of each search in order."""
    rows = [
        (trait, s.iteration, *_ids(s.term), term_name(s.term, names), s.t_value, s.p_value, s.event)
        for trait, steps in paths.items()
        for s in steps
    ]
    return spark.createDataFrame(rows, PATH_SCHEMA)


