"""Dense solvers for one small system at a time, called inside Spark tasks.

A system has one unknown per reference cell type (about ten), whatever the number of reads,
regions or mixtures. Huber fits are reweighted least squares: each step solves a weighted
normal equation.
"""

from __future__ import annotations

import numpy as np


def solve_free(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Least squares from normal equations; the shortest solution if they are singular."""
    return np.linalg.lstsq(gram, rhs, rcond=None)[0]


def solve_free_stack(grams: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """`solve_free` for a stack of systems at once."""
    return (np.linalg.pinv(grams, rcond=grams.shape[-1] * np.finfo(float).eps, hermitian=True) @ rhs[..., None])[..., 0]


def solve_nonnegative(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """min x'Gx/2 - h'x over x >= 0."""
    return fit_nonnegative(gram, rhs)[0]


def fit_nonnegative(gram: np.ndarray, rhs: np.ndarray, steps: int | None = None) -> tuple[np.ndarray, int, bool]:
    """Solution, steps taken and whether it is final, by the active-set method of Lawson and
    Hanson. Each step lets one more unknown off zero; `steps` defaults to ten for each."""
    k = len(rhs)
    x = np.zeros(k)
    free = np.zeros(k, dtype=bool)
    tolerance = 1e-12 * max(1.0, float(np.abs(rhs).max(initial=0.0)))
    limit = 10 * k + 10 if steps is None else steps
    for step_no in range(limit + 1):
        slope = rhs - gram @ x
        slope[free] = -np.inf
        entering = int(np.argmax(slope))
        if free.all() or slope[entering] <= tolerance:
            return x, step_no, True
        if step_no == limit:
            break
        free[entering] = True
        while True:
            trial = np.zeros(k)
            trial[free] = solve_free(gram[np.ix_(free, free)], rhs[free])
            leaving = free & (trial <= 0)
            if not leaving.any():
                x = trial
                break
            if leaving[entering] and x[entering] == 0 and leaving.sum() == 1:
                # A column that depends on the free ones brings no progress.
                x, final = _polish(gram, rhs, x)
                return x, step_no + 1, final
            gap = x[leaving] - trial[leaving]
            step = float(np.min(np.where(gap > 0, x[leaving] / np.where(gap > 0, gap, 1.0), 0.0)))
            x = x + step * (trial - x)
            free &= ~(leaving & (x <= tolerance))
            x[~free] = 0.0
            if not free.any():
                break
    return x, limit, False


def triangular_factors(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each code 0, 1, ... a triangular factor of its rows: pieces of a few rows are factored as one stack, and the
    factors of one code again, until each has one. All codes up to the largest must occur."""
    width = rows.shape[1]
    height = 4 * width
    while True:
        order = np.argsort(codes, kind="stable")
        codes, rows = codes[order], rows[order]
        place = np.arange(len(codes)) - np.searchsorted(codes, codes)
        heads = place % height == 0
        stack = np.zeros((int(heads.sum()), height, width))
        stack[np.cumsum(heads) - 1, place % height] = rows
        factors, owners = np.linalg.qr(stack, mode="r"), codes[heads]
        if (np.diff(owners) > 0).all():
            return factors
        codes, rows = np.repeat(owners, width), factors.reshape(-1, width)


def fit_free_factor(r: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, int, bool]:
    """min |Rx - q|; the shortest solution if columns depend on each other."""
    return np.linalg.lstsq(r, q, rcond=max(r.shape) * np.finfo(float).eps)[0], 1, True


def fit_nonnegative_factor(r: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, int, bool]:
    """min |Rx - q| over x >= 0 by the active-set method, without products of R with itself. A column is judged by its
    part orthogonal to the free ones, scaled to length 1, so that columns that differ in their last digits are told apart."""
    k = r.shape[1]
    x, free, barred = np.zeros(k), np.zeros(k, bool), np.zeros(k, bool)
    lengths, noise = np.linalg.norm(r, axis=0), 1e-13 * float(np.linalg.norm(q))
    limit = 10 * k + 10
    for step_no in range(limit + 1):
        basis = np.linalg.qr(r[:, free])[0]
        rest, own = q - r @ x, r
        for _ in range(2):  # the second time takes out what rounding left
            rest, own = rest - basis @ (basis.T @ rest), own - basis @ (basis.T @ own)
        size = np.linalg.norm(own, axis=0)
        open_columns = ~free & ~barred & (size > 1e-13 * lengths)
        slope = np.where(open_columns, own.T @ rest / np.where(open_columns, size, 1.0), -np.inf)
        entering = int(np.argmax(slope))
        if slope[entering] <= noise:
            return x, step_no, True
        if step_no == limit:
            break
        free[entering] = True
        while True:
            trial = np.zeros(k)
            trial[free] = fit_free_factor(r[:, free], q)[0]
            leaving = free & (trial <= 0)
            if not leaving.any():
                x, barred = trial, np.zeros(k, bool)
                break
            if leaving[entering] and x[entering] == 0:
                free[entering], barred[entering] = False, True  # only rounding made it look better
                break
            step = float(np.min(x[leaving] / (x[leaving] - trial[leaving])))
            x = np.maximum(x + step * (trial - x), 0.0)
            out = leaving & (x <= 1e-15 * x.max())
            out[np.flatnonzero(leaving)[np.argmin(x[leaving])]] = True
            free &= ~out
            x[~free] = 0.0
    return x, limit, False


POLISH_SWEEPS = 20_000


def _polish(gram: np.ndarray, rhs: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, bool]:
    """Coordinate descent to the constrained minimum, for (nearly) dependent columns; whether
    it came to rest."""
    x = x.copy()
    scale = np.diag(gram)
    for _ in range(POLISH_SWEEPS):
        before = x.copy()
        for i in np.flatnonzero(scale > 0):
            x[i] = max(0.0, x[i] + (rhs[i] - gram[i] @ x) / scale[i])
        if np.abs(x - before).max() < 1e-13:
            return x, True
    return x, False


def huber_weights(residual: np.ndarray, limit: float) -> np.ndarray:
    size = np.abs(residual)
    return np.where(size > limit, limit / np.where(size > 0, size, 1.0), 1.0)


def next_scale(residual: np.ndarray, sigma: float, epsilon: float) -> float:
    """Scale that minimises the joint loss for these residuals, the outliers being those
    beyond epsilon * sigma."""
    inside = np.abs(residual) <= epsilon * sigma
    left = len(residual) - epsilon ** 2 * (~inside).sum()
    return scale_update(float((residual[inside] ** 2).sum()), left, sigma)


def scale_update(inside_squares: float, left: float, sigma: float) -> float:
    if left <= 0:
        return 2 * sigma  # too many outliers for this scale
    return max(float(np.sqrt(inside_squares / left)), 1e-12)


# One stop rule for all Huber fits: no coefficient moves further in a step, or so many steps.
HUBER_TOLERANCE = 1e-10
HUBER_STEPS = 1000


def huber_fit(a: np.ndarray, b: np.ndarray, epsilon: float, nonnegative: bool, joint_scale: bool) -> tuple[np.ndarray, float]:
    """Coefficients and scale of `fit_huber`."""
    return fit_huber(a, b, epsilon, nonnegative, joint_scale)[:2]


def fit_huber(a: np.ndarray, b: np.ndarray, epsilon: float, nonnegative: bool, joint_scale: bool,
              steps: int | None = None) -> tuple[np.ndarray, float, int, bool]:
    """Huber regression without intercept: coefficients, scale, steps and whether it came to rest.

    joint_scale=False: the loss turns linear beyond `epsilon` itself (scale stays 1).
    joint_scale=True: beyond epsilon * sigma, sigma being estimated along.
    """
    solve = solve_nonnegative if nonnegative else solve_free
    x = solve(a.T @ a, a.T @ b)
    sigma = max(float(np.std(b - a @ x)), 1e-12) if joint_scale else 1.0
    steps = HUBER_STEPS if steps is None else steps
    for step in range(1, steps + 1):
        residual = b - a @ x
        if joint_scale:
            sigma = next_scale(residual, sigma, epsilon)
        weighted = a * huber_weights(residual, epsilon * sigma)[:, None]
        new = solve(weighted.T @ a, weighted.T @ b)
        moved = float(np.abs(new - x).max(initial=0.0))
        x = new
        if moved < HUBER_TOLERANCE:
            return x, sigma, step, True
    return x, sigma, steps, False


def singular_values(gram: np.ndarray) -> np.ndarray:
    """Singular values of a matrix from its Gram matrix, largest first."""
    return np.sqrt(np.clip(np.linalg.eigvalsh(gram)[::-1], 0.0, None))
