"""Proximity graphs over the vectors of one partition: beam search, choice of diverse edges, and their insertion.

All steps work on a block of points at once. Vectors are rows of ``x``; a point's score for a query is its inner product less
its ``bias``: none for a search by inner product, half its squared length for one by distance. Edges are a matrix of row
numbers, padded with the number of rows, which stands for no row at all.
"""

from __future__ import annotations

import numpy as np

#: Points that are searched for or pruned at a time; a memory bound.
BLOCK, PRUNED = 512, 128
#: Open points that a search expands at a time.
SPREAD = 4


def half_squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(1) / 2


def beam(x: np.ndarray, bias: np.ndarray, edges: np.ndarray, queries: np.ndarray, starts: np.ndarray, width: int, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores), queries x width: the best points that a search from ``starts`` meets, best first and ties to the lower
    row, padded with len(x) and -inf. Each query holds its ``width`` best points and expands the best of those not expanded
    yet, ``spread`` at a time, until none is left."""
    parts = [_beam(x, bias, edges, queries[at : at + BLOCK], starts[at : at + BLOCK], width, min(spread, width)) for at in range(0, len(queries), BLOCK)]
    if not parts:
        return np.zeros((0, width), "i4"), np.zeros((0, width), x.dtype)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _beam(x, bias, edges, q, starts, width, spread):
    n, b = len(x), len(q)
    rows, scores, done = np.full((b, width), n, "i4"), np.full((b, width), -np.inf, x.dtype), np.ones((b, width), bool)
    seen = np.zeros((b, n + 1), bool)
    every = np.arange(b)
    seen[:, n] = True
    rows[:, 0], scores[:, 0], done[:, 0] = starts, np.einsum("ij,ij->i", q, x[starts]) - bias[starts], False
    seen[every, starts] = True
    live = every
    while True:
        waiting = np.where(done[live], -np.inf, scores[live])
        some = waiting.max(1) > -np.inf
        live, waiting = live[some], waiting[some]
        if not live.size:
            break
        pick = np.argpartition(-waiting, spread - 1, axis=1)[:, :spread] if spread < width else np.tile(np.arange(width), (len(live), 1))
        own = np.where(np.take_along_axis(waiting, pick, 1) > -np.inf, rows[live[:, None], pick], n)
        done[live[:, None], pick] = True
        met = np.sort(edges[own].reshape(len(live), -1), axis=1)
        new = ~seen[live[:, None], met]
        new[:, 1:] &= met[:, 1:] != met[:, :-1]
        at, place = np.nonzero(new)
        met = met[at, place]
        seen[live[at], met] = True
        s = np.einsum("ij,ij->i", q[live[at]], x[met]) - bias[met]
        good = s > scores[live].min(1)[at]
        at, met, s = at[good], met[good], s[good]
        if not len(at):
            continue
        # What came to each search, side by side with what it holds.
        place = np.arange(len(at)) - np.searchsorted(at, at)
        more = np.full((len(live), int(place.max()) + 1), -np.inf, x.dtype)
        more_rows = np.full(more.shape, n, "i4")
        more[at, place], more_rows[at, place] = s, met
        all_scores, all_rows = np.concatenate([scores[live], more], 1), np.concatenate([rows[live], more_rows], 1)
        all_done = np.concatenate([done[live], more == -np.inf], 1)
        keep = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
        scores[live], rows[live], done[live] = (np.take_along_axis(v, keep, 1) for v in (all_scores, all_rows, all_done))
    order = np.lexsort((rows, -scores), axis=1)
    return np.take_along_axis(rows, order, 1), np.take_along_axis(scores, order, 1)


def diverse(x: np.ndarray, points: np.ndarray, found: np.ndarray, most: int, alpha: float = 1.0) -> np.ndarray:
    """For each point up to ``most`` of its candidates ``found`` (rows, padded with len(x)), nearest first; one is passed over if
    ``alpha`` times its distance from one that is taken is no more than its distance from the point. The point itself and
    repeated candidates are left out."""
    n, half = len(x), half_squares(x)
    out = np.full((len(points), most), n, "i4")
    for low in range(0, len(points), PRUNED):
        p, c = points[low : low + PRUNED], np.sort(found[low : low + PRUNED], axis=1)
        alive = (c != n) & (c != p[:, None])
        alive[:, 1:] &= c[:, 1:] != c[:, :-1]
        c = np.where(alive, c, 0)
        far = np.where(alive, half[c] + half[p][:, None] - np.einsum("pd,pcd->pc", x[p], x[c]), np.inf)
        order = np.argsort(far, axis=1, kind="stable")[:, : max(1, int(alive.sum(1).max(initial=0)))]
        c, far, alive = (np.take_along_axis(v, order, 1) for v in (c, far, alive))
        v = x[c]
        apart = half[c][:, :, None] + half[c][:, None, :] - v @ v.transpose(0, 2, 1)
        every, taken = np.arange(len(p)), np.zeros(len(p), "i8")
        while alive.any() and taken.min(initial=most) < most:
            first = alive.argmax(1)
            ok = alive[every, first] & (taken < most)
            if not ok.any():
                break
            out[low + every[ok], taken[ok]] = c[every[ok], first[ok]]
            taken += ok
            alive[every, first] = False
            alive &= alpha * alpha * apart[every, first] > far
    return out


def connect(x: np.ndarray, edges: np.ndarray, points: np.ndarray, chosen: np.ndarray, most: int, alpha: float = 1.0) -> None:
    """Edges of the points are those chosen, and each chosen one gets an edge back; one that has more than ``most`` keeps diverse
    ones. edges is changed in place."""
    n = len(x)
    edges[points, : chosen.shape[1]] = chosen
    edges[points, chosen.shape[1] : most] = n
    to, come = chosen.ravel(), np.repeat(points, chosen.shape[1])
    to, come = to[to != n], come[to != n]
    order = np.argsort(to, kind="stable")
    to, come = to[order], come[order]
    ends, first, count = np.unique(to, return_index=True, return_counts=True)
    # Points with about as many edges back together, so that no matrix is mostly padding.
    for part in np.array_split(np.argsort(count, kind="stable"), max(1, -(-len(ends) // PRUNED))):
        if not len(part):
            continue
        width = int(count[part].max())
        at = first[part][:, None] + np.minimum(np.arange(width), count[part][:, None] - 1)
        own = np.concatenate([edges[ends[part], :most], come[at]], 1)
        edges[ends[part], :most] = _merged(x, ends[part], own, most, alpha)


def _merged(x, points, own, most, alpha):
    """Edges of points out of ``own``: all of them where they are few enough, else diverse ones."""
    n = len(x)
    own = np.sort(own, axis=1)
    own[:, 1:][own[:, 1:] == own[:, :-1]] = n
    own = np.sort(own, axis=1)
    out = np.full((len(points), most), n, "i4")
    few = (own != n).sum(1) <= most
    cut = own[few, :most]
    out[few, : cut.shape[1]] = cut
    if (~few).any():
        out[~few] = diverse(x, points[~few], own[~few], most, alpha)
    return out


def reached(edges: np.ndarray, start: int) -> np.ndarray:
    """Whether each row can be reached from start."""
    n = len(edges) - 1
    seen, front = np.zeros(n + 1, bool), np.array([start])
    seen[[start, n]] = True
    while front.size:
        front = np.unique(edges[front])
        front = front[~seen[front]]
        seen[front] = True
    return seen[:n]


def rescue(x: np.ndarray, edges: np.ndarray, start: int, width: int) -> None:
    """Every row can be reached from start afterwards: the last column of edges, which ``connect`` leaves alone, gets an edge to
    a row that could not be, from the nearest row that a search for it meets and that has none yet. Each edge brings at
    least one more row within reach, so the number of rounds is bounded."""
    n, half = len(x), half_squares(x)
    while True:
        seen = reached(edges, start)
        lost = np.flatnonzero(~seen)
        if not lost.size:
            return
        found, _ = beam(x, half, edges, x[lost], np.full(len(lost), start), width)
        for row, own in zip(lost, found, strict=True):
            if seen[row]:
                continue
            free = own[(own != n) & (edges[np.minimum(own, n - 1), -1] == n)]
            others = free if len(free) else np.flatnonzero(seen & (edges[:n, -1] == n))
            edges[others[0], -1] = row
            seen |= reached(edges, row)
