"""Small dense regressions in NumPy: scaling, lasso, least squares, random experiments."""

from __future__ import annotations

import numpy as np


def robust_scaler(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(median, interquartile range) by column; a range of 0 counts as 1."""
    low, mid, high = np.percentile(x, [25, 50, 75], axis=0)
    spread = high - low
    return mid, np.where(spread == 0, 1.0, spread)


def lasso(x: np.ndarray, y: np.ndarray, alpha: float, sweeps: int = 20_000, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise |y - xw - b|^2 / 2n + alpha |w|_1, by coordinate descent."""
    n = len(y)
    mx, my = x.mean(0), y.mean()
    xc, yc = x - mx, y - my
    gram, corr = xc.T @ xc / n, xc.T @ yc / n
    w = np.zeros(x.shape[1])
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(w)):
            if gram[j, j] <= 0:
                continue
            r = corr[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(r) * max(abs(r) - alpha, 0.0) / gram[j, j]
            most = max(most, abs(new - w[j]) * np.sqrt(gram[j, j]))
            w[j] = new
        if most <= tol * max(1.0, np.sqrt((yc * yc).mean())):
            break
    return w, float(my - mx @ w)


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    coef = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]), y, rcond=None)[0]
    return coef[1:], float(coef[0])


def r2(y: np.ndarray, predicted: np.ndarray) -> float:
    total = ((y - y.mean()) ** 2).sum()
    return float(1 - ((y - predicted) ** 2).sum() / total) if total else float("nan")


def contiguous_folds(n: int, k: int) -> np.ndarray:
    """Fold of each row: k runs of rows, the first n % k one longer."""
    size = np.full(k, n // k)
    size[: n % k] += 1
    return np.repeat(np.arange(k), size)


def zscore(x: np.ndarray) -> np.ndarray:
    sd = x.std(0)
    return (x - x.mean(0)) / np.where(sd == 0, 1.0, sd)


def _entries(x: np.ndarray, y: np.ndarray, dummies: int, limit: int) -> list[int]:
    """Columns in the order in which least-angle regression takes them, until ``limit`` dummies are in.

    The last ``dummies`` columns are the dummies.
    """
    p = x.shape[1]
    left = y - y.mean()
    active: list[int] = []
    seen = 0
    for _ in range(min(p, len(y) - 1)):
        c = x.T @ left
        rest = [j for j in range(p) if j not in active]
        if not rest or np.abs(c[rest]).max() < 1e-10:
            break
        j = max(rest, key=lambda k: abs(c[k]))
        active.append(j)
        seen += j >= p - dummies
        if seen >= limit:
            break
        top = np.abs(c[active]).max()
        signs = np.sign(c[active])
        xa = x[:, active] * signs
        inv = np.linalg.pinv(xa.T @ xa)
        a = 1 / np.sqrt(max(inv.sum(), 1e-12))
        u = xa @ (a * inv.sum(1))
        step = top / a
        b = x.T @ u
        for k in rest:
            if k != j:
                for t in ((top - c[k]) / (a - b[k]) if a != b[k] else np.inf, (top + c[k]) / (a + b[k]) if a != -b[k] else np.inf):
                    if 1e-12 < t < step:
                        step = t
        left = left - step * u
    return active


def random_experiments(x: np.ndarray, y: np.ndarray, rate: float, experiments: int = 20, seed: int = 1) -> np.ndarray:
    """Selected columns by terminated random experiments with false discovery rate up to ``rate``.

    Each experiment appends normal dummy columns and stops a forward selection
    once T dummies are in.  Columns are voted on; the largest T and the lowest
    vote whose estimated false discovery proportion stays within the rate win.
    """
    n, p = x.shape
    rng = np.random.default_rng(seed)
    xs, best = zscore(x) / np.sqrt(n), np.zeros(p, bool)
    trials = [zscore(rng.normal(size=(n, p))) / np.sqrt(n) for _ in range(experiments)]
    shares = []
    for t in range(1, max(2, n // 2)):
        votes = np.zeros(p)
        for d in trials:
            for j in _entries(np.hstack([xs, d]), y, p, t):
                if j < p:
                    votes[j] += 1
        share = votes / experiments
        shares.append(share)
        grid = np.unique(share[share > 0.5])
        found = False
        before = shares[-2] if len(shares) > 1 else np.zeros(p)
        null = max(p - (share > 0.5).sum(), 0)
        for v in grid:
            chosen = share >= v
            expected = min(t * null / (p + 1), p)
            false = ((1 - share[chosen]) * np.where(share[chosen] > before[chosen], 1, 0.5)).sum() + expected * (1 - v)
            if false / max(1, chosen.sum()) <= rate:
                best, found = chosen, True
                break
        if not found:
            break
    return best
