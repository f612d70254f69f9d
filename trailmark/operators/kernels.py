"""Array kernels in numpy, without Spark: assignment, agglomerative clustering, graphs."""

from __future__ import annotations

import heapq

import numpy as np


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column of a cheapest assignment of a rectangular matrix, by shortest augmenting paths with potentials."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        reach, came = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        row, col = i, -1
        while True:
            slack = c[row] - u[row] - v
            if col >= 0:
                slack = slack + base
            better = ~done & (slack < reach)
            reach[better] = slack[better]
            came[better] = col
            free = np.where(done, np.inf, reach)
            col = int(free.argmin())
            base = reach[col]
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        used = done.copy()
        used[col] = False
        u[i] += base
        for j in np.flatnonzero(used):
            u[row_of[j]] += base - reach[j]
            v[j] -= base - reach[j]
        while col >= 0:
            prev = came[col]
            row_of[col] = row_of[prev] if prev >= 0 else i
            col = prev
    pairs = [(int(r), j) for j, r in enumerate(row_of) if r >= 0]
    return sorted((j, i) if turned else (i, j) for i, j in pairs)


def greedy(cost: np.ndarray) -> list[tuple[int, int]]:
    """The globally smallest entry again and again, each row and column once; the first in row order of equal ones."""
    c = np.array(cost, float)
    out = []
    for _ in range(min(c.shape)):
        i, j = np.unravel_index(int(c.argmin()), c.shape)
        out.append((int(i), int(j)))
        c[i, :], c[:, j] = np.inf, np.inf
    return sorted(out)


def peaks_of(x: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which cells have no larger p among their eight neighbours; equal neighbours are allowed to the right, below and below right only.

    Of cells at one place the likeliest counts for its neighbours, and they are all a peak or none.
    """
    cx, cy = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    key = (cy << 32) + cx
    every, which = np.unique(key, return_inverse=True)
    best = np.full(len(every), -np.inf)
    np.maximum.at(best, which, p)
    peak = np.ones(len(every), bool)
    for dx, dy in ((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)):
        other = every + (dy << 32) + dx
        at = np.minimum(np.searchsorted(every, other), max(0, len(every) - 1))
        there = every[at] == other
        beaten = (best[at] > best) | ((best[at] == best) & (not (dx >= 0 and dy >= 0)))
        peak &= ~(there & beaten)
    return peak[which]


ASSIGN = {"hungarian": hungarian, "greedy": greedy}

#: Lance-Williams weights (of i, of j, of their distance, of the absolute difference) for sizes of i, j and k.
LINKAGES = {
    "single": lambda a, b, k: (0.5, 0.5, 0.0, -0.5),
    "complete": lambda a, b, k: (0.5, 0.5, 0.0, 0.5),
    "average": lambda a, b, k: (a / (a + b), b / (a + b), 0.0, 0.0),
    "weighted": lambda a, b, k: (0.5, 0.5, 0.0, 0.0),
    "ward": lambda a, b, k: ((a + k) / (a + b + k), (b + k) / (a + b + k), -k / (a + b + k), 0.0),
}


def agglomerate(d: np.ndarray, linkage: str = "complete") -> list[tuple[int, int, float]]:
    """Merges (i, j, distance) of all points by nearest-neighbour chains, in order of distance; a cluster is called by any member.

    Ward's update works on squared distances, and its merges are given as distances again.
    """
    n = len(d)
    x = np.array(d, float)
    if linkage == "ward":
        x = x * x
    np.fill_diagonal(x, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    weights, merges, chain = LINKAGES[linkage], [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            i = chain[-1]
            row = np.where(alive, x[i], np.inf)
            row[i] = np.inf
            j = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        i, j = min(i, j), max(i, j)
        apart = x[i, j]
        others = alive.copy()
        others[[i, j]] = False
        o = np.flatnonzero(others)
        ai, aj, b, g = weights(size[i], size[j], size[o])
        x[i, o] = x[o, i] = ai * x[i, o] + aj * x[j, o] + b * apart + g * np.abs(x[i, o] - x[j, o])
        size[i] += size[j]
        alive[j] = False
        merges.append((i, j, float(np.sqrt(apart)) if linkage == "ward" else float(apart)))
    order = sorted(range(n - 1), key=lambda m: merges[m][2])
    return [merges[m] for m in order]


def components_of(n: int, links) -> np.ndarray:
    """Labels, numbered by first appearance, of the components of links (i, j)."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in links:
        a, b = find(int(i)), find(int(j))
        root[max(a, b)] = min(a, b)
    names: dict[int, int] = {}
    return np.array([names.setdefault(find(i), len(names)) for i in range(n)], int)


def cut(n: int, merges: list[tuple[int, int, float]], k: int) -> np.ndarray:
    """Labels of k clusters, numbered by first appearance: all but the last k - 1 merges."""
    return components_of(n, [(i, j) for i, j, _ in merges[: max(0, n - k)]])


def minimum_spanning_tree(w: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest, by Prim's method from the first node of each component; inf is no edge."""
    n = len(w)
    seen, out = np.zeros(n, bool), []
    for start in range(n):
        if seen[start]:
            continue
        seen[start] = True
        best, of = np.array(w[start], float), np.full(n, start)
        while True:
            b = np.where(seen, np.inf, best)
            j = int(b.argmin())
            if not np.isfinite(b[j]):
                break
            out.append((int(of[j]), j))
            seen[j] = True
            closer = w[j] < best
            best, of = np.where(closer, w[j], best), np.where(closer, j, of)
    return out


def symmetric(w: np.ndarray, diagonal: float = np.inf) -> np.ndarray:
    """A matrix whose upper part is that of the lower one, with the diagonal filled."""
    low = np.tril(np.asarray(w, float), -1)
    out = low + low.T
    np.fill_diagonal(out, diagonal)
    return out


def shortest_paths(graph: dict, start) -> dict:
    """Distances from `start` in a graph {node: {node: weight}} without negative weights."""
    out: dict = {}
    heap = [(0.0, 0, start)]
    order = 0
    while heap:
        d, _, node = heapq.heappop(heap)
        if node in out:
            continue
        out[node] = d
        for other, w in graph.get(node, {}).items():
            if other not in out:
                order += 1
                heapq.heappush(heap, (d + w, order, other))
    return out


def cluster_cells(x: np.ndarray, y: np.ndarray, p: np.ndarray, k: int, linkage: str = "complete", least: float = 0.10, attempts: int = 10, scale: float = 1.0) -> np.ndarray | None:
    """A label for each cell, splitting them among k individuals; None if that can't be done (everyone then keeps all cells).

    Cost of two cells: squared distance less their log probabilities. Clusters whose peak is below `least` of the mean of the
    others' are taken out and the rest is split again; what was taken out joins the nearest centre.
    """
    n = len(p)
    if n < k:
        return None
    if k == 1:
        return np.zeros(n, int)
    with np.errstate(divide="ignore"):
        lp = np.log(p)
    cost = ((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2) * scale - np.maximum(lp, -700)[:, None] - np.maximum(lp, -700)
    labels = cut(n, agglomerate(cost, linkage), k)
    if attempts <= 0:
        return labels
    peaks = np.array([p[labels == c].max() for c in range(k)])
    rest = (peaks.sum() - peaks) / (k - 1)
    weak = peaks < least * rest
    if not weak.any():
        return labels
    keep = ~weak[labels]
    again = cluster_cells(x[keep], y[keep], p[keep], k, linkage, least, attempts - 1, scale)
    if again is None:
        return labels
    out = np.empty(n, int)
    out[keep] = again
    centres = np.array([[x[keep][again == c].mean(), y[keep][again == c].mean()] for c in range(k)])
    gone = np.flatnonzero(~keep)
    out[gone] = ((x[gone, None] - centres[:, 0]) ** 2 + (y[gone, None] - centres[:, 1]) ** 2).argmin(1)
    return out
