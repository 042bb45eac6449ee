"""Plain numpy versions of what the engine computes, and small data sets."""

from __future__ import annotations

import numpy as np

from termscan.functions.tdist import two_sided_p

# A public cement data set with nine samples (fixed values).
CEMENT_Y = [78.5, 74.3, 104.3, 72.5, 93.1, 115.9, 83.8, 113.3, 109.4]
CEMENT = {
    "x1": [7, 1, 11, 1, 2, 21, 1, 11, 10],
    "x2": [26, 29, 56, 31, 54, 47, 40, 66, 68],
    "x3": [6, 15, 8, 22, 18, 4, 23, 9, 8],
    "x4": [60, 52, 6, 44, 22, 26, 34, 12, 12],
}


def vector_frame(spark, x, ys: dict):
    """``(sample, values, <traits>)`` from a matrix and outcomes."""
    x = np.asarray(x, dtype=float)
    rows = [(f"i{i}", [float(v) for v in x[i]], *[float(y[i]) for y in ys.values()]) for i in range(len(x))]
    return spark.createDataFrame(rows, "sample string, values array<double>, " + ", ".join(f"{t} double" for t in ys))


def cement(spark, names, trait="pheno"):
    return vector_frame(spark, np.array([CEMENT[n] for n in names]).T, {trait: CEMENT_Y})


def direct_ols(x, y):
    """Estimates, errors, t and p with the intercept last."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    full = np.column_stack([x, np.ones(len(y))])
    beta, *_ = np.linalg.lstsq(full, y, rcond=None)
    df = len(y) - full.shape[1]
    r = y - full @ beta
    se = np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * (r @ r) / df)
    return beta, se, beta / se, two_sided_p(beta / se, df)


def term_matrix(x, pairs):
    """Columns and their terms, single ones first, pairs in nested-loop order."""
    n = x.shape[1]
    terms = [(i, -1) for i in range(n)]
    cols = [x[:, i] for i in range(n)]
    if pairs:
        for i in range(n):
            for j in range(i + 1, n):
                terms.append((i, j))
                cols.append(x[:, i] * x[:, j])
    return np.column_stack(cols), terms


def direct_stepwise(x, y, pairs, forward, backward, limit=60):
    """The search by refitting every model; returns the terms of the result, or None if nothing enters."""
    cols, terms = term_matrix(x, pairs)
    included, skipped, previous = [], set(), None
    seen = set()
    for _ in range(limit):
        best = None
        for c in range(len(terms)):
            if c in included or c in skipped:
                continue
            _, _, t, p = direct_ols(cols[:, included + [c]], y)
            if best is None or abs(t[-2]) > best[0] + 1e-9:
                best = (abs(t[-2]), c, p[-2])
        if best is None or best[2] >= forward:
            return previous
        skipped = set()
        model = included + [best[1]]
        p = direct_ols(cols[:, model], y)[3]
        weak = {c for c, v in zip(model, p) if v >= backward}
        included, skipped = [c for c in model if c not in weak], weak
        if len(model) == len(terms):
            return [terms[c] for c in (included if weak else model)]
        previous = [terms[c] for c in model]
        here = (frozenset(included), frozenset(skipped))
        if here in seen:
            return previous
        seen.add(here)
    return previous
