"""Least squares from centred moments: the small k x k part of every fit."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from termscan.errors import NotEnoughSamples, SingularModel
from termscan.functions.tdist import two_sided_p

# A regressor whose residual variance is below this share of its own variance is collinear.
COLLINEAR = 1e-10


@dataclass(frozen=True)
class Coefficients:
    """Slopes in regressor order, then the intercept, with their statistics."""

    n: int
    df: int
    rss: float
    estimate: np.ndarray
    std_error: np.ndarray
    t_value: np.ndarray
    p_value: np.ndarray

    @property
    def residual_standard_error(self) -> float:
        return float(np.sqrt(self.rss / self.df))


def cholesky_or_fail(gram: np.ndarray) -> np.ndarray:
    """Lower Cholesky factor of a scaled Gram matrix; collinear regressors raise."""
    if gram.size == 0:
        return np.zeros((0, 0))
    scale = np.sqrt(np.diag(gram))
    if not np.all(scale > 0):
        raise SingularModel("a regressor is constant")
    corr = gram / np.outer(scale, scale)
    try:
        low = np.linalg.cholesky(corr)
    except np.linalg.LinAlgError as err:
        raise SingularModel("the regressors are linearly dependent") from err
    if np.any(np.diag(low) ** 2 < COLLINEAR):
        raise SingularModel("the regressors are linearly dependent")
    return low * scale[:, None]


def check_samples(n: int, k: int) -> int:
    """Degrees of freedom for ``k`` coefficients, the intercept among them."""
    if n <= k:
        raise NotEnoughSamples(f"{n} samples cannot fit {k} coefficients")
    return n - k


def slopes(gram: np.ndarray, xy: np.ndarray) -> np.ndarray:
    low = cholesky_or_fail(gram)
    return np.linalg.solve(low.T, np.linalg.solve(low, xy)) if low.size else np.zeros(0)


def coefficients(
    n: int,
    x_mean: np.ndarray,
    y_mean: float,
    gram: np.ndarray,
    xy: np.ndarray,
    yy: float,
    rss: float | None = None,
) -> Coefficients:
    """Coefficient table from centred cross products; ``rss`` from a second pass when given."""
    k = len(x_mean)
    df = check_samples(n, k + 1)
    low = cholesky_or_fail(gram)
    beta = slopes(gram, xy)
    if rss is None:
        rss = max(float(yy - beta @ xy), 0.0)
    inv = np.linalg.inv(low) if k else np.zeros((0, 0))
    cov = inv.T @ inv
    var0 = 1.0 / n + float(x_mean @ cov @ x_mean)
    sigma2 = rss / df
    estimate = np.append(beta, y_mean - float(x_mean @ beta))
    std_error = np.sqrt(sigma2 * np.append(np.diag(cov), var0))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = estimate / std_error
    return Coefficients(n, df, rss, estimate, std_error, t, two_sided_p(t, df))


def coefficients_by_group(n: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> dict[str, np.ndarray]:
    """Coefficient tables of many small models at once.

    ``mean`` is (groups, k + 1) and ``cov`` (groups, k + 1, k + 1) with population covariances, the
    outcome last. Groups with too few samples or dependent regressors raise, as single fits do.
    """
    k = mean.shape[1] - 1
    check_samples(int(n.min()), k + 1)
    df = n - k - 1
    c = cov * n[:, None, None]
    gram, xy, yy = c[:, :k, :k], c[:, :k, k], c[:, k, k]
    scale = np.sqrt(np.einsum("gii->gi", gram))
    if not np.all(scale > 0):
        raise SingularModel("a regressor is constant")
    corr = gram / scale[:, :, None] / scale[:, None, :]
    try:
        low = np.linalg.cholesky(corr)
    except np.linalg.LinAlgError as err:
        raise SingularModel("the regressors are linearly dependent") from err
    if np.any(np.square(np.einsum("gii->gi", low)) < COLLINEAR):
        raise SingularModel("the regressors are linearly dependent")
    inv = np.linalg.inv(corr) / scale[:, :, None] / scale[:, None, :]
    beta = np.einsum("gij,gj->gi", inv, xy)
    rss = np.maximum(yy - np.einsum("gi,gi->g", beta, xy), 0.0)
    x_mean = mean[:, :k]
    var0 = 1.0 / n + np.einsum("gi,gij,gj->g", x_mean, inv, x_mean)
    estimate = np.column_stack([beta, mean[:, k] - np.einsum("gi,gi->g", x_mean, beta)])
    var = np.column_stack([np.einsum("gii->gi", inv), var0])
    std_error = np.sqrt((rss / df)[:, None] * var)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = estimate / std_error
    return {"estimate": estimate, "std_error": std_error, "t_value": t, "p_value": two_sided_p(t, df[:, None])}
