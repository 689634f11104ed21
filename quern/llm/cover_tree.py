"""Cover trees over unit vectors, and their dual traversal for all pairs within a distance.

Nodes of one level are centers more than the level's radius apart, and what lies within it of them; radii halve from level to
level. A pair of nodes goes where the distance of their centers exceeds both covering radii and the threshold, and counts
as a whole where it stays within the threshold with both radii. What is left at the ends is decided by the cosine itself.
"""

from __future__ import annotations

import numpy as np

#: Rounding of distances from products is below this; bounds give way by it.
SLACK = 1e-6
#: Elements of a matrix of cosines at a time; centers that are found at a time.
CHUNK, BLOCK = 1 << 20, 128


def distances(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosines, 0.0))


def net(x: np.ndarray, radius: float, most: int = 0, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy centers, in order of the rows from ``first`` on, each over radius from all before it; of each row its nearest center and the distance.

    most: so many centers at most where given; then rows may lie farther from theirs.
    """
    n = len(x)
    near, owner, centers = np.full(n, np.inf), np.zeros(n, np.int64), []
    open_ = np.append(first, np.delete(np.arange(n), first)) if n else np.zeros(0, np.int64)
    while len(open_) and not (most and len(centers) >= most):
        some = open_[:BLOCK]
        apart = distances(x[some] @ x[some].T) > radius
        chosen: list[int] = []
        for k in range(len(some)):
            if apart[k, chosen].all():
                chosen.append(k)
        chosen = chosen[: most - len(centers)] if most else chosen
        own = some[chosen]
        for lo in range(0, n, step := max(1, CHUNK // len(own))):
            d = distances(x[lo : lo + step] @ x[own].T)
            best = d.argmin(1)
            least = d[np.arange(len(d)), best]
            closer = least < near[lo : lo + step]
            near[lo : lo + step][closer] = least[closer]
            owner[lo : lo + step][closer] = best[closer] + len(centers)
        near[own], owner[own] = 0.0, np.arange(len(own)) + len(centers)
        centers += own.tolist()
        open_ = open_[near[open_] > radius]
    return np.array(centers, np.int64), owner, near


class CoverTree:
    """Nodes as arrays: center, covering radius, children, and members as a range of ``order``. Leaves have one member or a radius of at most ``least``."""

    def __init__(self, x: np.ndarray, least: float, top: float = 1.0):
        self.x, self.order = x, np.arange(len(x))
        self.center, self.radius, self.lo, self.hi, self.children = [], [], [], [], []
        if not len(x):
            return
        far = distances(x @ x[0])
        todo = [(self._node(0, float(far.max()), 0, len(x)), top)]
        while todo:
            node, radius = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo == 1 or self.radius[node] <= least:
                continue
            while radius >= self.radius[node] and radius > least / 2:
                radius /= 2
            members = self.order[lo:hi].copy()
            centers, owner, near = net(x[members], radius, first=int(np.flatnonzero(members == self.center[node])[0]))
            by = np.argsort(owner, kind="stable")
            self.order[lo:hi] = members[by]
            ends = lo + np.searchsorted(owner[by], np.arange(len(centers) + 1))
            largest = np.zeros(len(centers))
            np.maximum.at(largest, owner, near)
            own = [self._node(int(members[c]), float(r), int(a), int(b)) for c, r, a, b in zip(centers, largest, ends, ends[1:])]
            self.children[node] = own
            todo += [(k, radius / 2) for k in own]
        self.center, self.radius = np.array(self.center), np.array(self.radius)
        self.size = np.array(self.hi) - np.array(self.lo)

    def _node(self, center: int, radius: float, lo: int, hi: int) -> int:
        for held, value in ((self.center, center), (self.radius, radius), (self.lo, lo), (self.hi, hi), (self.children, [])):
            held.append(value)
        return len(self.center) - 1

    def members(self, node: int) -> np.ndarray:
        return self.order[self.lo[node] : self.hi[node]]


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots (the least row of each component) after the links i, j."""
    while True:
        a, b = root[i], root[j]
        other = a != b
        if not other.any():
            return root
        i, j, a, b = i[other], j[other], a[other], b[other]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


class Links:
    """What a traversal finds: of each row how many others it links with, by weight, and the components."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.count, self.root = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def matrix(self, rows: np.ndarray, columns: np.ndarray, linked: np.ndarray) -> None:
        i, j = np.nonzero(linked)
        if len(i):
            i, j = rows[i], columns[j]
            np.add.at(self.count, i, self.weights[j])
            np.add.at(self.count, j, self.weights[i])
            self.root = joined(self.root, i, j)

    def all(self, rows: np.ndarray, columns: np.ndarray) -> None:
        self.count[rows] += self.weights[columns].sum()
        self.count[columns] += self.weights[rows].sum()
        self.root = joined(self.root, np.concatenate([rows[1:], columns]), np.full(len(rows) - 1 + len(columns), rows[0]))

    def inside(self, rows: np.ndarray) -> None:
        self.count[rows] += self.weights[rows].sum() - self.weights[rows]
        self.root = joined(self.root, rows[1:], np.full(len(rows) - 1, rows[0]))


class _Dual:
    """One traversal; frontiers are pairs of arrays of nodes, of which each of the one meets each of the other."""

    def __init__(self, links: Links, s: CoverTree, t: CoverTree, cosine: float, rows: np.ndarray, others: np.ndarray):
        self.links, self.s, self.t, self.cosine, self.rows, self.others = links, s, t, cosine, rows, others
        self.limit = float(distances(np.array(cosine)))
        self.todo: list[tuple[np.ndarray, np.ndarray]] = []

    def points(self, a: np.ndarray, b: np.ndarray, upper: bool = False) -> None:
        """All pairs of members, by their cosines."""
        for lo in range(0, len(a), step := max(1, CHUNK // max(1, len(b)))):
            linked = self.s.x[a[lo : lo + step]] @ self.t.x[b].T >= self.cosine
            if upper:
                linked &= np.arange(len(b)) > np.arange(lo, lo + len(linked))[:, None]
            self.links.matrix(self.rows[a[lo : lo + step]], self.others[b], linked)

    def below(self, p: int, q: int) -> None:
        a, b = self.s.children[p], self.t.children[q]
        if a or b:
            self.todo.append((np.array(a or [p]), np.array(b or [q])))
        else:
            self.points(self.s.members(p), self.t.members(q))

    def meet(self, a: np.ndarray, b: np.ndarray, upper: bool = False) -> None:
        s, t = self.s, self.t
        for lo in range(0, len(a), step := max(1, CHUNK // len(b))):
            c = a[lo : lo + step]
            cosines = s.x[s.center[c]] @ t.x[t.center[b]].T
            one, other = s.size[c] == 1, t.size[b] == 1
            open_ = np.arange(len(b)) > np.arange(lo, lo + len(c))[:, None] if upper else np.ones(cosines.shape, bool)
            linked = open_ & (cosines >= self.cosine) & one[:, None] & other
            self.links.matrix(self.rows[s.center[c]], self.others[t.center[b]], linked)
            many, more = np.flatnonzero(~one), np.flatnonzero(~other)
            d = distances(cosines)
            both = s.radius[c][:, None] + t.radius[b]
            open_ &= (d <= both + self.limit + SLACK) & ~(one[:, None] & other)
            whole = open_ & (d + both <= self.limit - SLACK)
            for i, j in zip(*np.nonzero(whole)):
                self.links.all(self.rows[s.members(c[i])], self.others[t.members(b[j])])
            open_ &= ~whole
            # A node meets all single points near it at once.
            for i in many:
                if len(j := np.flatnonzero(open_[i] & other)):
                    if s.children[c[i]]:
                        self.todo.append((np.array(s.children[c[i]]), b[j]))
                    else:
                        self.points(s.members(c[i]), t.center[b[j]])
            for j in more:
                if len(i := np.flatnonzero(open_[:, j] & one)):
                    if t.children[b[j]]:
                        self.todo.append((c[i], np.array(t.children[b[j]])))
                    else:
                        self.points(s.center[c[i]], t.members(b[j]))
            for i in many:
                for j in more[open_[i, more]]:
                    self.below(c[i], b[j])

    def run(self) -> None:
        while self.todo:
            self.meet(*self.todo.pop())


def dual(links: Links, s: CoverTree, t: CoverTree | None, cosine: float, rows: np.ndarray, others: np.ndarray | None = None) -> None:
    """Adds all pairs of s and t, or within s where t is None, whose cosine is at least that. rows, others: of each row of a tree the one in links."""
    if not len(s.x) or t is not None and not len(t.x):
        return
    if t is not None:
        both = _Dual(links, s, t, cosine, rows, others)
        both.todo.append((np.array([0]), np.array([0])))
        both.run()
        return
    both, nodes = _Dual(links, s, s, cosine, rows, rows), [0]
    while nodes:
        p = nodes.pop()
        if s.size[p] > 1 and 2 * s.radius[p] <= both.limit - SLACK:
            links.inside(rows[s.members(p)])
        elif s.children[p]:
            both.meet(np.array(s.children[p]), np.array(s.children[p]), upper=True)
            both.run()
            nodes += s.children[p]
        else:
            both.points(s.members(p), s.members(p), upper=True)
