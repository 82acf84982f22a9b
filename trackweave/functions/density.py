"""Hierarchical density clustering of a handful of points, and connected components."""

from __future__ import annotations

import numpy as np


def components(near: np.ndarray) -> np.ndarray:
    """Label of each point's connected component, numbered by first member; singletons are -1."""
    n = len(near)
    label = np.full(n, -2)
    k = 0
    for i in range(n):
        if label[i] != -2:
            continue
        todo, members = [i], [i]
        label[i] = k
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & (label == -2)):
                label[j] = k
                todo.append(j)
                members.append(j)
        if len(members) == 1:
            label[i] = -1
        else:
            k += 1
    return label


def hdbscan(points: np.ndarray, min_cluster_size: int = 2, min_samples: int = 2, epsilon: float = 0.0, single: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(labels, membership strengths): mutual reachability, minimum spanning tree, condensed tree, excess of mass.

    min_samples counts the point's neighbours without itself, up to n - 1.
    Clusters born below ``epsilon`` are replaced by their lowest ancestor born
    at or above it; with ``single`` the root can be a cluster, and its points
    beyond epsilon are noise.
    """
    n = len(points)
    if n < 2:
        return np.full(n, -1), np.zeros(n)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    # single linkage from Prim's tree
    key, link, done, tree = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), []
    at = 0
    for _ in range(n - 1):
        done[at] = True
        closer = ~done & (reach[at] < key)
        key[closer], link[closer] = reach[at][closer], at
        at = int(np.where(done, np.inf, key).argmin())
        tree.append((key[at], link[at], at))
    tree.sort(key=lambda e: e[0])
    parent, size, merge = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (w, a, b) in enumerate(tree):
        a, b, c = top(a), top(b), n + k
        parent[a] = parent[b] = c
        size[c] = size[a] + size[b]
        merge[c] = (a, b, w)

    def leaves(i):
        out, todo = [], [i]
        while todo:
            j = todo.pop()
            if j < n:
                out.append(j)
            else:
                todo += merge[j][:2]
        return out

    # condensed tree: cluster -> birth, falls (point, lambda), children (cluster, lambda, size)
    inverse = lambda w: 1.0 / w if w > 0 else np.inf
    birth, falls, kids, above = {0: 0.0}, {0: []}, {0: []}, {0: None}
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        while node >= n:
            a, b, w = merge[node]
            lam = inverse(w)
            big = [x for x in (a, b) if size[x] >= min_cluster_size]
            if len(big) == 2:
                for x in (a, b):
                    new = len(birth)
                    birth[new], falls[new], kids[new], above[new] = lam, [], [], c
                    kids[c].append((new, lam, size[x]))
                    todo.append((x, new))
                node = -1
            else:
                for x in (a, b):
                    if x not in big:
                        falls[c] += [(p, lam) for p in leaves(x)]
                node = big[0] if big else -1
            if node == -1:
                break
        else:
            falls[c].append((node, np.inf))
    cap = max([lam for f in falls.values() for _, lam in f if np.isfinite(lam)] + [lam for k in kids.values() for _, lam, _ in k if np.isfinite(lam)] + [1.0])
    finite = lambda lam: min(lam, cap * 1e6)  # noqa: E731  coincident points
    mass = {c: sum(finite(lam) - finite(birth[c]) for _, lam in falls[c]) + sum((finite(lam) - finite(birth[c])) * s for _, lam, s in kids[c]) for c in birth}
    chosen, score = {}, {}
    for c in sorted(birth, reverse=True):
        below = sum(score[k] for k, _, _ in kids[c])
        if c == 0 and not single:
            chosen[c], score[c] = False, below
        elif kids[c] and below > mass[c]:
            chosen[c], score[c] = False, below
        else:
            chosen[c], score[c] = True, mass[c]

    def under(c):
        out, todo = [], [k for k, _, _ in kids[c]]
        while todo:
            k = todo.pop()
            out.append(k)
            todo += [j for j, _, _ in kids[k]]
        return out

    for c in sorted(birth):
        if chosen[c]:
            for k in under(c):
                chosen[k] = False
    picked = [c for c in birth if chosen[c]]
    if epsilon > 0:
        out: list[int] = []
        for c in sorted(picked):
            born = np.inf if birth[c] == 0 else 1.0 / birth[c]
            while born < epsilon:
                p = above[c]
                if p is None or (p == 0 and not single):
                    break
                c = p
                born = np.inf if birth[c] == 0 else 1.0 / birth[c]
            if c not in out:
                out.append(c)
        picked = [c for c in out if not any(c in under(o) for o in out)]
    labels, strength = np.full(n, -1), np.zeros(n)
    for k, c in enumerate(sorted(picked)):
        members = [(p, lam) for x in [c, *under(c)] for p, lam in falls[x]]
        if c == 0:
            limit = 1.0 / epsilon if epsilon > 0 else max((lam for _, lam, _ in kids[0]), default=max(lam for _, lam in falls[0]))
            members = [(p, lam) for p, lam in members if lam >= limit]
        most = max((finite(lam) for _, lam in members), default=0.0)
        for p, lam in members:
            labels[p] = k
            strength[p] = 1.0 if most == 0 or not np.isfinite(lam) else min(finite(lam), most) / most
    return labels, strength
