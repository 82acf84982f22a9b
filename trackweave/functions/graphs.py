"""Small digraphs: simple cycles and unlabelled edit distance."""

from __future__ import annotations


def simple_cycles(edges: list[tuple]) -> int:
    """Number of simple cycles: each is counted from its smallest node."""
    order = {n: i for i, n in enumerate(sorted({x for e in edges for x in e}, key=str))}
    after: dict[int, set[int]] = {i: set() for i in order.values()}
    for a, b in edges:
        after[order[a]].add(order[b])
    total = 0
    for root in after:
        trail = [(root, iter(after[root]))]
        on = {root}
        while trail:
            node, rest = trail[-1]
            for nxt in rest:
                if nxt == root:
                    total += 1
                elif nxt > root and nxt not in on:
                    on.add(nxt)
                    trail.append((nxt, iter(after[nxt])))
                    break
            else:
                trail.pop()
                on.discard(node)
    return total


def edit_distance(e1: list[tuple], e2: list[tuple], nodes: int) -> int:
    """Fewest edge insertions and deletions that make two digraphs on ``nodes`` nodes alike.

    Node sets have one size, so only the matching of nodes matters; matchings
    are tried with the best bound first.
    """

    def matrix(edges):
        ids = {n: i for i, n in enumerate(sorted({x for e in edges for x in e}, key=str))}
        m = [[0] * nodes for _ in range(nodes)]
        for a, b in edges:
            m[ids[a]][ids[b]] = 1
        return m

    a, b = matrix(e1), matrix(e2)
    weight = [sum(a[i]) + sum(r[i] for r in a) for i in range(nodes)]
    order = sorted(range(nodes), key=lambda i: -weight[i])
    tail = [0] * (nodes + 1)
    for k in range(nodes - 1, -1, -1):
        i = order[k]
        tail[k] = tail[k + 1] + sum(a[i][j] + a[j][i] for j in order[k + 1 :])
    total_b = sum(map(sum, b))
    best = sum(map(sum, a)) + total_b
    chosen: list[int] = []
    free = set(range(nodes))

    def go(k: int, cost: int, used: int) -> None:
        nonlocal best
        # edges yet to come: the two rests differ by at least this much if only counts are matched
        rest_a = tail[k] + sum(a[order[p]][j] + a[j][order[p]] for p in range(k) for j in order[k:])
        if cost + abs(rest_a - (total_b - used)) >= best:
            return
        if k == nodes:
            best = cost
            return
        i, tried = order[k], []
        for v in free:
            step = seen = 0
            for p, u in enumerate(chosen):
                step += abs(a[i][order[p]] - b[v][u]) + abs(a[order[p]][i] - b[u][v])
                seen += b[v][u] + b[u][v]
            step += abs(a[i][i] - b[v][v])
            tried.append((step, v, seen + b[v][v]))
        for step, v, seen in sorted(tried):
            chosen.append(v)
            free.discard(v)
            go(k + 1, cost + step, used + seen)
            free.add(v)
            chosen.pop()

    go(0, 0, 0)
    return best
