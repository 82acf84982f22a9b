"""Natural cubic smoothing splines with a residual bound, and arc length along them."""

from __future__ import annotations

import numpy as np


def _solve5(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solves a symmetric positive definite pentadiagonal system; d1, d2 are the side diagonals."""
    a, b1, b2, x = d0.tolist(), [*d1.tolist(), 0.0], [*d2.tolist(), 0.0, 0.0], b.tolist()
    n = len(a)
    d, l1, l2 = [0.0] * n, [0.0] * (n + 1), [0.0] * (n + 2)  # l1[i] and l2[i] lead from i to the next and the one after
    for i in range(n):
        p, q = (d[i - 1], d[i - 2]) if i > 1 else (d[0] if i else 0.0, 0.0)
        u, v = l1[i - 1] if i else 0.0, l2[i - 2] if i > 1 else 0.0
        d[i] = a[i] - u * u * p - v * v * q
        x[i] -= (u * x[i - 1] if i else 0.0) + (v * x[i - 2] if i > 1 else 0.0)
        if i + 1 < n:
            l1[i] = (b1[i] - (l2[i - 1] * u * p if i else 0.0)) / d[i]
        if i + 2 < n:
            l2[i] = b2[i] / d[i]
    for i in range(n - 1, -1, -1):
        x[i] = x[i] / d[i] - (l1[i] * x[i + 1] if i + 1 < n else 0.0) - (l2[i] * x[i + 2] if i + 2 < n else 0.0)
    return np.array(x)


class Spline:
    """A natural cubic through (u, f) with second derivatives m; straight beyond its ends."""

    def __init__(self, u: np.ndarray, f: np.ndarray, m: np.ndarray):
        self.u, self.f, self.m = u, f, m

    def __call__(self, at, order: int = 0):
        at = np.asarray(at, float)
        u, f, m = self.u, self.f, self.m
        if len(u) == 1:
            return np.full(at.shape, f[0]) if order == 0 else np.zeros(at.shape)
        i = np.clip(np.searchsorted(u, at, side="right") - 1, 0, len(u) - 2)
        h = u[i + 1] - u[i]
        inside = np.clip(at, u[0], u[-1])
        a, b = (u[i + 1] - inside) / h, (inside - u[i]) / h
        slope = (f[i + 1] - f[i]) / h + h / 6 * ((1 - 3 * a * a) * m[i] + (3 * b * b - 1) * m[i + 1])
        if order == 1:
            return slope
        if order == 2:
            return np.where((at < u[0]) | (at > u[-1]), 0.0, a * m[i] + b * m[i + 1])
        value = a * f[i] + b * f[i + 1] + h * h / 6 * ((a**3 - a) * m[i] + (b**3 - b) * m[i + 1])
        return value + slope * (at - inside)


def smoothing_spline(u: np.ndarray, y: np.ndarray, s: float) -> Spline:
    """The smoothest natural cubic whose squared residuals sum to at most s.

    u is strictly increasing.  The straight line of least squares is taken if
    it is close enough; else the smoothing weight is found by bisection.
    """
    n = len(u)
    if n < 3:
        return Spline(u, np.asarray(y, float), np.zeros(n))
    c = np.polyfit(u - u[0], y, 1)
    line = np.polyval(c, u - u[0])
    if ((y - line) ** 2).sum() <= s:
        return Spline(u, line, np.zeros(n))
    h = np.diff(u)
    q = np.diff(np.diff(y) / h)
    r0, r1 = (h[:-1] + h[1:]) / 3, h[1:-1] / 6
    a, b, e = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]
    k0 = a * a + b * b + e * e
    k1 = b[:-1] * a[1:] + e[:-1] * b[1:]
    k2 = e[:-2] * a[2:]

    def fit(weight: float):
        g = _solve5(r0 + weight * k0, r1 + weight * k1, weight * k2, q)
        bend = np.zeros(n)
        bend[:-2] += a * g
        bend[1:-1] += b * g
        bend[2:] += e * g
        return weight * bend, g

    if s <= 0:
        off, g = fit(0.0)
        return Spline(u, np.asarray(y, float), np.concatenate([[0], g, [0]]))
    low, high = 0.0, float(np.mean(h) ** 3)
    while (fit(high)[0] ** 2).sum() < s and high < 1e30:
        low, high = high, high * 16
    for _ in range(60):
        mid = (low + high) / 2 if low == 0 else np.sqrt(low * high)
        if (fit(mid)[0] ** 2).sum() <= s:
            low = mid
        else:
            high = mid
        if high - low <= 1e-7 * high:
            break
    off, g = fit(low)
    return Spline(u, y - off, np.concatenate([[0], g, [0]]))


def arc_parameter(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])


def path_splines(x: np.ndarray, y: np.ndarray, s: float, unit: bool) -> tuple[np.ndarray, Spline, Spline]:
    """(parameter of each point, x spline, y spline); points that do not advance share a knot."""
    u = arc_parameter(x, y)
    if unit and u[-1] > 0:
        u = u / u[-1]
    first = np.concatenate([[True], np.diff(u) > 0])
    group = np.cumsum(first) - 1
    n = np.bincount(group)
    xs, ys = np.bincount(group, x) / n, np.bincount(group, y) / n
    return u, smoothing_spline(u[first], xs, s), smoothing_spline(u[first], ys, s)


class Path:
    """A plane curve (x spline, y spline) with nearest points and arc lengths."""

    def __init__(self, sx: Spline, sy: Spline, per_knot: int = 4):
        self.sx, self.sy = sx, sy
        u = sx.u
        if len(u) == 1:
            u = np.array([u[0], u[0] + 1.0])
        step = np.linspace(0, 1, per_knot, endpoint=False)
        self.grid = np.append((u[:-1, None] + np.diff(u)[:, None] * step).ravel(), u[-1])
        self.gx, self.gy = sx(self.grid), sy(self.grid)
        node, weight = np.polynomial.legendre.leggauss(4)
        half = np.diff(self.grid) / 2
        at = self.grid[:-1, None] + half[:, None] * (1 + node)
        self.cum = np.concatenate([[0.0], np.cumsum((self._speed(at) * weight).sum(1) * half)])

    def _speed(self, at):
        return np.hypot(self.sx(at, 1), self.sy(at, 1))

    def length(self, at: np.ndarray) -> np.ndarray:
        """Arc length from the path's start, on straight ends beyond it."""
        at = np.asarray(at, float)
        i = np.clip(np.searchsorted(self.grid, at, side="right") - 1, 0, len(self.grid) - 2)
        node, weight = np.polynomial.legendre.leggauss(4)
        half = (at - self.grid[i]) / 2
        return self.cum[i] + (self._speed(self.grid[i][..., None] + half[..., None] * (1 + node)) * weight).sum(-1) * half

    def valley(self, x: float, y: float, near: float | None = None, within: float | None = None) -> int:
        """Number of the grid point nearest to (x, y); only those within a distance of ``near`` if there are any."""
        first, end = 0, len(self.grid)
        if near is not None and within is not None:
            a, b = np.searchsorted(self.grid, near - within), np.searchsorted(self.grid, near + within, side="right")
            first, end = (a, b) if a < b else (first, end)
        return int(first + ((self.gx[first:end] - x) ** 2 + (self.gy[first:end] - y) ** 2).argmin())

    def refine(self, x: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Parameters of the points nearest to many (x, y), each in the valley around its grid point k."""
        grid, last, span = self.grid, len(self.grid) - 1, self.grid[-1] - self.grid[0]
        lo = np.where(k == 0, grid[0] - span, grid[np.maximum(k - 1, 0)])
        hi = np.where(k == last, grid[-1] + span, grid[np.minimum(k + 1, last)])
        t, todo = grid[k], np.arange(len(k))
        for _ in range(50):  # Newton, kept within the valley by bisection
            at = t[todo]
            ex, ey, vx, vy = self.sx(at) - x[todo], self.sy(at) - y[todo], self.sx(at, 1), self.sy(at, 1)
            g = ex * vx + ey * vy
            a, b = np.where(g > 0, lo[todo], at), np.where(g > 0, at, hi[todo])
            lo[todo], hi[todo] = a, b
            curve = vx * vx + vy * vy + ex * self.sx(at, 2) + ey * self.sy(at, 2)
            new = np.where(curve > 0, at - g / np.where(curve > 0, curve, 1.0), (a + b) / 2)
            new = np.where((a <= new) & (new <= b), new, (a + b) / 2)
            t[todo] = new
            todo = todo[np.abs(new - at) > 1e-12 * np.maximum(1.0, np.abs(at))]
            if not len(todo):
                break
        return t
