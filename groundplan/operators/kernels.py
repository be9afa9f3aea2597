"""Numpy kernels on the graph of one map, for chunks of its nodes."""

from __future__ import annotations

import numpy as np


def _clear(mask: np.ndarray, low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of cells: every point of the line from a to b, one per step of its longer side, is walkable."""
    d = b - a
    n = np.abs(d).max(axis=1)
    out, at = np.zeros(len(a), bool), np.flatnonzero(n)
    a, d, n = a[at], d[at], n[at]
    for k in range(1, int(n.max(initial=0)) + 1):
        p = np.rint(a + d * k / n[:, None]).astype(np.int64) - low
        ok = mask[p[:, 0], p[:, 1]]
        out[at[ok & (n == k)]] = True
        ok &= n > k
        at, a, d, n = at[ok], a[ok], d[ok], n[ok]
    return out


def visible(cells: np.ndarray, start: int, stop: int, pairs: int = 1 << 18) -> np.ndarray:
    """Rows start..stop of the symmetric visibility matrix of cells, which are (row, column) pairs; so many pairs are tried at once."""
    low = cells.min(axis=0)
    mask = np.zeros(cells.max(axis=0) - low + 1, bool)
    mask[tuple((cells - low).T)] = True
    n = len(cells)
    out = np.zeros((stop - start, n), bool)
    step = max(1, pairs // n)
    for k in range(start, stop, step):
        some = cells[k : min(k + step, stop)]
        own, other = np.repeat(some, n, axis=0), np.tile(cells, (len(some), 1))
        out[k - start : k - start + len(some)] = (_clear(mask, low, own, other) | _clear(mask, low, other, own)).reshape(len(some), n)
    return out


def hops(adjacency: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Fewest steps from each source to each node; -1 where there is no path. Only rows of nodes just reached and columns of nodes still open are multiplied."""
    out = np.full((len(sources), len(adjacency)), -1, np.int64)
    out[np.arange(len(sources)), sources] = 0
    front, d = out == 0, 0
    while front.any():
        d += 1
        at, to = np.flatnonzero(front.any(axis=0)), np.flatnonzero((out < 0).any(axis=0))
        new = (front[:, at].astype(np.float32) @ adjacency[np.ix_(at, to)].astype(np.float32) > 0) & (out[:, to] < 0)
        front = np.zeros(out.shape, bool)
        front[:, to] = new
        out[front] = d
    return out


def _ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of each range, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - length), length)


class Turns:
    """Shortest lengths on a graph whose edges are straight lines, from the turns that shortest paths can take.

    A path turns at v from u to t only if u and t are not beside each other and no other node between them makes it shorter (equals count). So
    for each edge u -> v there are few edges v -> t that can follow, and paths grow from all sources by these alone. What is left out can't
    lose a length: where t is beside u too, the path through u is as short, and so on back to the source.
    """

    def __init__(self, adjacency: np.ndarray, xy: np.ndarray):
        n = self.n = len(xy)
        src, self.dst = np.nonzero(adjacency)
        x, y = (np.ascontiguousarray(k, dtype=float) for k in xy.T)
        self.row = np.searchsorted(src, np.arange(n + 1))
        self.length = np.hypot(x[self.dst] - x[src], y[self.dst] - y[src])
        closed = adjacency | np.eye(n, dtype=bool)
        best, key = np.full(n, np.inf), src * n + self.dst
        first, then = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for u in range(n - 1):
            a, b = self.row[u], self.row[u + 1]
            beside = self.dst[a:b]
            i, t = np.divmod(np.flatnonzero(closed[beside, u + 1 :] & ~closed[u, u + 1 :]), n - u - 1)
            if not len(i):
                continue
            t += u + 1
            v = beside[i]
            c = self.length[a + i] + np.sqrt((x[v] - x[t]) ** 2 + (y[v] - y[t]) ** 2)
            best[:] = np.inf
            np.minimum.at(best, t, c)
            tie = np.flatnonzero(c <= best[t] + 1e-9)
            v, t = v[tie], t[tie]
            first += [a + i[tie], t * n + v]
            then += [v * n + t, v * n + u]
        # of every second part, edges are still given by their ends
        first = np.concatenate([np.searchsorted(key, e) if k and k % 2 == 0 else e for k, e in enumerate(first)])
        order = np.argsort(first, kind="stable")
        self.then = np.searchsorted(key, np.concatenate(then)[order])
        self.at = np.r_[0, np.cumsum(np.bincount(first, minlength=len(src)))]

    def distances(self, sources: np.ndarray) -> np.ndarray:
        """From each source to each node; inf where there is no path."""
        d = np.full((len(sources), self.n), np.inf)
        flat = d.reshape(-1)
        size = self.row[sources + 1] - self.row[sources]
        edge, who = _ranges(self.row[sources], size), np.repeat(np.arange(len(sources)), size)
        d[who, self.dst[edge]] = self.length[edge]
        d[np.arange(len(sources)), sources] = 0
        while len(edge):
            size = self.at[edge + 1] - self.at[edge]
            after = self.then[_ranges(self.at[edge], size)]
            to = np.repeat(who * self.n, size) + self.dst[after]
            offer = np.repeat(flat[who * self.n + self.dst[edge]], size) + self.length[after]
            ok = np.flatnonzero(offer < flat[to] - 1e-9)
            to, offer, after = to[ok], offer[ok], after[ok]
            np.minimum.at(flat, to, offer)
            ok = np.flatnonzero(offer <= flat[to])
            to, k = np.unique(to[ok], return_index=True)
            edge, who = after[ok][k], to // self.n
        return d


def dependencies(adjacency: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """For each source and node, the node's share in shortest paths from there to all others (ends do not count)."""
    far = hops(adjacency, sources)
    paths, share = (far == 0).astype(np.float64), np.zeros(far.shape)
    levels = [np.flatnonzero((far == d).any(axis=0)) for d in range(int(far.max(initial=0)) + 1)]
    links = [adjacency[np.ix_(f, t)].astype(np.float64) for f, t in zip(levels, levels[1:])]
    for d, (f, t, a) in enumerate(zip(levels, levels[1:], links)):
        paths[:, t] += np.where(far[:, t] == d + 1, np.where(far[:, f] == d, paths[:, f], 0) @ a, 0)
    for d, (f, t, a) in reversed(list(enumerate(zip(levels, levels[1:], links)))):  # only steps to the next distance count
        after = np.divide(1 + share[:, t], paths[:, t], out=np.zeros((len(sources), len(t))), where=(far[:, t] == d + 1))
        share[:, f] += np.where(far[:, f] == d, paths[:, f] * (after @ a.T), 0)
    share[far == 0] = 0
    return share


def smoothed(counts: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian of 4 sigma radius along both axes, mirrored at the edges."""
    reach = int(4 * sigma + 0.5)
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight /= weight.sum()
    for axis in (0, 1):
        wide = np.pad(counts, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], "symmetric")
        counts = np.apply_along_axis(np.convolve, axis, wide, weight, "valid")
    return counts
