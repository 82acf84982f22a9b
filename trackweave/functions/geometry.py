"""Plane geometry for a handful of points."""

from __future__ import annotations

import numpy as np


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise, without points on its sides."""
    pts = sorted(set(map(tuple, points)))
    if len(pts) < 3:
        return np.array(pts, float)

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(reversed(pts)), float)


def polygon_area(corners: np.ndarray) -> float:
    if len(corners) < 3:
        return 0.0
    x, y = corners[:, 0], corners[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def perimeter(corners: np.ndarray) -> float:
    if len(corners) < 2:
        return 0.0
    d = corners - np.roll(corners, -1, axis=0)
    return float(np.sqrt((d * d).sum(1)).sum())


def clip(corners: np.ndarray, normal: np.ndarray, offset: float) -> np.ndarray:
    """The part of a convex polygon with normal . p <= offset."""
    if not len(corners):
        return corners
    side = corners @ normal - offset
    out = []
    for i in range(len(corners)):
        j = (i + 1) % len(corners)
        if side[i] <= 0:
            out.append(corners[i])
        if (side[i] < 0 < side[j]) or (side[j] < 0 < side[i]):
            out.append(corners[i] + (corners[j] - corners[i]) * side[i] / (side[i] - side[j]))
    return np.array(out, float).reshape(-1, 2)


def voronoi_areas(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Each point's cell within the hull: the hull cut by the bisectors with all others.

    Points at one place share their cell evenly.
    """
    shift = points.mean(0)
    p = points - shift
    hull = convex_hull(p)
    areas = np.zeros(len(p))
    for i in range(len(p)):
        cell, same = hull, 1
        for j in range(len(p)):
            if i == j:
                continue
            normal = p[j] - p[i]
            if not normal.any():
                same += 1
                continue
            cell = clip(cell, normal, float(normal @ (p[i] + p[j]) / 2))
        areas[i] = polygon_area(cell) / same
    return areas, polygon_area(hull)


def rectangle_diagonal(points: np.ndarray) -> float:
    """Diagonal of the smallest rotated rectangle around the points."""
    hull = convex_hull(points)
    if len(hull) < 3:
        return perimeter(hull) / 2 if len(hull) == 2 else 0.0
    best = None
    for edge in np.roll(hull, -1, axis=0) - hull:
        u = edge / np.hypot(*edge)
        a, b = hull @ u, hull @ np.array([-u[1], u[0]])
        w, h = np.ptp(a), np.ptp(b)
        if best is None or w * h < best[0]:
            best = w * h, np.hypot(w, h)
    return float(best[1])
