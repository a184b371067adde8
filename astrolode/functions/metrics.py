"""Distances of points and a vantage-point tree over them, in numpy."""

from __future__ import annotations

import numpy as np

EARTH_KM = 6371.0088


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Straight distances; the last axis holds the coordinates."""
    d = a - b
    return np.sqrt(np.einsum("...i,...i->...", d, d))


def great_circle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances on a sphere of the Earth's mean radius, in km; the last axis holds latitude and longitude in degrees."""
    p, q = np.radians(a), np.radians(b)
    h = np.sin((p[..., 0] - q[..., 0]) / 2) ** 2 + np.cos(p[..., 0]) * np.cos(q[..., 0]) * np.sin((p[..., 1] - q[..., 1]) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


METRICS = {"euclidean": euclidean, "great_circle": great_circle}


class VantageTree:
    """Vantage-point tree that answers many queries at once.

    Each node holds one point and splits the rest at their median distance from it. A query set goes down the tree as
    a whole and is narrowed by the triangle inequality at each node.
    """

    LEAF = 24

    def __init__(self, points: np.ndarray, metric=euclidean):
        self.points, self.metric = points, metric
        self.order = np.arange(len(points))
        self.nodes: dict[tuple[int, int], tuple[int, float, float, float]] = {}
        todo = [(0, len(points))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= self.LEAF:
                continue
            part = self.order[lo:hi]
            at = int(np.argmax(metric(points[part], points[part[0]])))  # a point at the rim divides best
            part[[0, at]] = part[[at, 0]]
            d = metric(points[part[1:]], points[part[0]])
            mid = (hi - lo - 1) // 2
            split = np.argpartition(d, mid)
            self.order[lo + 1 : hi] = part[1:][split]
            d = d[split]
            self.nodes[lo, hi] = (lo + 1 + mid, float(d[:mid].max()), float(d[mid:].min()), float(d.max()))
            todo += [(lo + 1, lo + 1 + mid), (lo + 1 + mid, hi)]

    def within(self, queries: np.ndarray, radius: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, distance) of all pairs at a distance of at most the query's radius, up to rounding."""
        radius = np.broadcast_to(np.asarray(radius, float), (len(queries),)) * (1 + 1e-9) + 1e-9
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = [(0, len(self.order), np.arange(len(queries)))] if len(self.order) else []
        while todo:
            lo, hi, q = todo.pop()
            if not q.size:
                continue
            node = self.nodes.get((lo, hi))
            if node is None:
                d = self.metric(queries[q][:, None, :], self.points[self.order[lo:hi]][None, :, :])
                i, j = np.nonzero(d <= radius[q][:, None])
                out.append((q[i], self.order[lo + j], d[i, j]))
                continue
            cut, inner, outer, far = node
            d, r = self.metric(queries[q], self.points[self.order[lo]]), radius[q]
            hit = d <= r
            out.append((q[hit], np.full(int(hit.sum()), self.order[lo]), d[hit]))
            todo += [(lo + 1, cut, q[d - r <= inner]), (cut, hi, q[(d + r >= outer) & (d - r <= far)])]
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query, the nearest point (of equally near ones the first) and its distance."""
        best, who = np.full(len(queries), np.inf), np.full(len(queries), -1)

        def take(q: np.ndarray, point: np.ndarray, d: np.ndarray) -> None:
            better = (d < best[q]) | ((d == best[q]) & (point < who[q]))
            best[q[better]], who[q[better]] = d[better], point[better]

        def visit(lo: int, hi: int, q: np.ndarray) -> None:
            if not q.size or lo == hi:
                return
            node = self.nodes.get((lo, hi))
            if node is None:
                part = np.sort(self.order[lo:hi])
                d = self.metric(queries[q][:, None, :], self.points[part][None, :, :])
                k = d.argmin(1)
                take(q, part[k], d[np.arange(q.size), k])
                return
            cut, inner, outer, far = node
            d = self.metric(queries[q], self.points[self.order[lo]])
            take(q, np.full(q.size, self.order[lo]), d)
            near = d < (inner + outer) / 2
            visit(lo + 1, cut, q[near])
            visit(cut, hi, q[~near])
            slack = best[q] * (1 + 1e-9) + 1e-9
            visit(cut, hi, q[near & (d + slack >= outer) & (d - slack <= far)])
            visit(lo + 1, cut, q[~near & (d - slack <= inner)])

        visit(0, len(self.order), np.arange(len(queries)))
        return who, best
