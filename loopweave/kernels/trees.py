"""Small dense methods on one distance matrix: linkage, neighbour joining, scaling, assignment.

They serve a task of their own on matrices of at most MOST labels; callers
group many of them by Spark.
"""

from __future__ import annotations

import re

import numpy as np

#: The most labels that a matrix may have.
MOST = 2000


def checked(d: np.ndarray) -> np.ndarray:
    d = np.asarray(d, float)
    if d.ndim != 2 or d.shape[0] != d.shape[1] or d.shape[0] > MOST or not np.isfinite(d).all():
        raise ValueError(f"the matrix must be square and finite and have at most {MOST} labels")
    return d


def linkage(d: np.ndarray, k: int, method: str = "average") -> np.ndarray:
    """Clusters 0 .. k - 1 by agglomeration, numbered as they first occur; Lance and Williams' update."""
    d = checked(d).copy()
    n = len(d)
    size, members = np.ones(n), [[i] for i in range(n)]
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    for _ in range(n - k):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        if method == "average":
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        else:
            new = (np.maximum if method == "complete" else np.minimum)(d[i], d[j])
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        d[i, ~alive] = d[~alive, i] = np.inf
        alive[j] = False
        size[i] += size[j]
        members[i] += members[j]
    out = np.empty(n, int)
    for c, i in enumerate(sorted(np.flatnonzero(alive), key=lambda i: min(members[i]))):
        out[members[i]] = c
    return out


def neighbour_joining(d: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges ``(child, parent, length)`` of the unrooted tree; leaves are 0 .. n - 1 (Saitou and Nei, 1987)."""
    d = checked(d).copy()
    n = len(d)
    nodes, edges, fresh = list(range(n)), [], n
    while len(nodes) > 2:
        m = len(nodes)
        r = d.sum(axis=1)
        q = (m - 2) * d - r[:, None] - r[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(divmod(int(np.argmin(q)), m))
        li = d[i, j] / 2 + (r[i] - r[j]) / (2 * (m - 2))
        edges += [(nodes[i], fresh, li), (nodes[j], fresh, d[i, j] - li)]
        rest = [k for k in range(m) if k not in (i, j)]
        to = (d[i, rest] + d[j, rest] - d[i, j]) / 2
        d = np.vstack([np.column_stack([d[np.ix_(rest, rest)], to]), np.append(to, 0.0)])
        nodes = [nodes[k] for k in rest] + [fresh]
        fresh += 1
    if len(nodes) == 2:
        edges.append((nodes[0], nodes[1], float(d[0, 1])))
    return edges


def splits(edges: list[tuple[int, int, float]], n: int) -> list[frozenset[int]]:
    """The tree's bipartitions with two leaves or more on each side, as the side that is smaller, or has leaf 0 not in it."""
    kids: dict[int, list[int]] = {}
    for child, parent, _ in edges:
        kids.setdefault(parent, []).append(child)

    def leaves(node: int) -> frozenset[int]:
        return frozenset().union(*(leaves(c) for c in kids.get(node, []))) if node >= n else frozenset([node])

    out = set()
    for child, _, _ in edges:
        side = leaves(child)
        other = frozenset(range(n)) - side
        if len(side) > 1 and len(other) > 1:
            out.add(min(side, other, key=lambda s: (len(s), sorted(s))))
    return sorted(out, key=lambda s: (len(s), sorted(s)))


def quoted(name: str) -> str:
    """A label as tree texts write it: in quotes if it holds marks or white space, quotes doubled."""
    return name if re.fullmatch(r"[^\s()\[\]{}:;,'\"]+", name) else "'" + name.replace("'", "''") + "'"


def newick(edges: list[tuple[int, int, float]], names: list[str], digits: int = 6) -> str:
    """The tree as text, from its last node."""
    kids: dict[int, list[tuple[int, float]]] = {}
    for child, parent, length in edges:
        kids.setdefault(parent, []).append((child, length))
    if not edges:
        return f"{quoted(names[0])};" if names else ";"

    def text(node: int) -> str:
        inner = ",".join(f"{text(c)}:{length:.{digits}f}" for c, length in kids.get(node, []))
        name = quoted(names[node]) if node < len(names) else ""
        return f"({inner}){name}" if inner else name

    return text(edges[-1][1]) + ";"


def smacof(d: np.ndarray, dims: int = 2, starts: int = 4, rounds: int = 300, eps: float = 1e-3, seed: int = 0) -> np.ndarray:
    """Coordinates that fit distances by majorisation (de Leeuw, 1977); the best of several starts."""
    d = checked(d)
    n = len(d)
    best, lowest = np.zeros((n, dims)), np.inf
    for s in range(starts):
        x = np.random.default_rng([seed, s]).normal(size=(n, dims))
        before = np.inf
        for _ in range(rounds):
            apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
            stress = ((apart - d) ** 2).sum() / 2
            with np.errstate(divide="ignore", invalid="ignore"):
                b = -np.where(apart > 0, d / apart, 0.0)
            b[np.arange(n), np.arange(n)] = -b.sum(axis=1)
            x = b @ x / n
            if before - stress < eps * max(stress, 1e-12):
                break
            before = stress
        if stress < lowest:
            best, lowest = x, stress
    return best


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the largest total gain (Kuhn and Munkres, by shortest augmenting paths)."""
    gain = np.asarray(gain, float)
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[i0 - 1, free - 1] - u[i0] - v[free]
            closer = slack < least[free]
            least[free[closer]], way[free[closer]] = slack[closer], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((j, i) if flip else (i, j) for i, j in pairs)
