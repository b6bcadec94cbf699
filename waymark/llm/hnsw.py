"""A navigable small-world graph over unit vectors, built and searched for many vectors side by side.

Vectors join in batches. One that lies within `radius` (a cosine) of a node becomes a member of that node's ball
instead of a node, so thick groups of near copies don't crowd the graph. Neighbours are chosen as usual: the nearest
first, and only those nearer to the new node than to a neighbour already chosen.
"""

from __future__ import annotations

import numpy as np


def level_of(ids: np.ndarray, m: int) -> np.ndarray:
    """Levels with the share 1/m of each level's nodes on the next, from a hash of the id."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return np.minimum((-np.log(u) / np.log(m)).astype(int), 6)


class Graph:
    def __init__(self, dim: int, m: int = 12, wide: int = 48):
        self.m, self.wide, self.n = m, wide, 0
        self.x = np.zeros((0, dim))
        self.links: list[np.ndarray] = []  # by level: (n, 2m) neighbours, -1 empty
        self.near: list[np.ndarray] = []  # their cosines
        self.level = np.zeros(0, int)

    def _grow(self, x: np.ndarray, level: np.ndarray) -> None:
        self.x, self.level = np.vstack([self.x, x]), np.concatenate([self.level, level])
        self.n = len(self.x)
        while len(self.links) <= level.max(initial=0):
            self.links.append(np.zeros((0, 2 * self.m), np.int32))
            self.near.append(np.zeros((0, 2 * self.m)))
        for k in range(len(self.links)):
            more = self.n - len(self.links[k])
            self.links[k] = np.vstack([self.links[k], np.full((more, 2 * self.m), -1, np.int32)])
            self.near[k] = np.vstack([self.near[k], np.full((more, 2 * self.m), -np.inf)])

    def _beam(self, q: np.ndarray, start: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the best `width` nodes reached from its start nodes (n, s): ids (-1 empty) and cosines, best first."""
        n = len(q)
        seen = np.zeros((n, self.n + 1), bool)  # the last column stands for the empty neighbour
        ids, sims = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf)
        todo = np.zeros((n, width), bool)
        s = min(start.shape[1], width)
        ids[:, :s] = start[:, :s]
        seen[np.arange(n)[:, None], ids[:, :s]] = True
        seen[:, -1] = True
        sims[:, :s] = np.where(ids[:, :s] >= 0, np.einsum("nd,nsd->ns", q, self.x[ids[:, :s]]), -np.inf)
        todo[:, :s] = ids[:, :s] >= 0
        rows = np.arange(n)
        links = self.links[level]
        while len(rows):
            pick = np.where(todo[rows], sims[rows], -np.inf).argmax(axis=1)
            go = todo[rows, pick]
            rows, pick = rows[go], pick[go]
            if not len(rows):
                break
            todo[rows, pick] = False
            near = links[ids[rows, pick]].astype(np.int64)
            fresh = ~seen[rows[:, None], near]
            seen[rows[:, None], near] = True
            r, c = np.nonzero(fresh)
            got = np.full(near.shape, -np.inf)
            got[r, c] = np.einsum("ed,ed->e", q[rows[r]], self.x[near[r, c]])
            all_sims = np.concatenate([sims[rows], got], axis=1)
            all_ids = np.concatenate([ids[rows], np.where(fresh, near, -1)], axis=1)
            all_todo = np.concatenate([todo[rows], fresh], axis=1)
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[rows], ids[rows], todo[rows] = (np.take_along_axis(a, top, 1) for a in (all_sims, all_ids, all_todo))
            todo[rows] &= sims[rows] > -np.inf
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _entry(self, n: int, level: int) -> np.ndarray:
        """Start nodes of a level that has no level above: a few, spread over its nodes."""
        nodes = np.flatnonzero(self.level >= level)
        return np.tile(nodes[np.linspace(0, len(nodes) - 1, min(8, len(nodes))).astype(int)], (n, 1))

    def nearest(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        start = None
        for k in range(len(self.links) - 1, -1, -1):
            start = self._entry(len(q), k) if start is None else start
            start, sims = self._beam(q, start, k, width if k == 0 else max(8, width // 4))
        return start, sims

    def _chosen(self, x: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """(n, m) of the candidates (n, c), best first, that pass the neighbour rule; -1 empty."""
        c = self.x[ids]
        among = c @ c.transpose(0, 2, 1)
        n, width = ids.shape
        taken, out = np.zeros((n, width), bool), np.full((n, self.m), -1, np.int64)
        for j in range(width):
            worst = np.where(taken, among[:, j], -np.inf).max(axis=1)
            fine = (sims[:, j] > -np.inf) & (sims[:, j] > worst) & (taken.sum(axis=1) < self.m)
            out[fine, taken[fine].sum(axis=1)] = ids[fine, j]
            taken[:, j] = fine
        return out

    def _tie(self, level: int, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> None:
        links, near = self.links[level], self.near[level]
        for i, j, w in zip(a.tolist(), b.tolist(), s.tolist()):
            for u, v in ((i, j), (j, i)):
                at = int(near[u].argmin())
                if w > near[u, at] and v not in links[u]:
                    links[u, at], near[u, at] = v, w

    def insert(self, x: np.ndarray, ids: np.ndarray, radius: float, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Adds unit vectors; returns each one's node and its cosine to that node."""
        node, cosine = np.full(len(x), -1, np.int64), np.ones(len(x))
        at = 0
        while at < len(x):
            own = np.arange(at, min(len(x), at + max(16, min(batch, self.n))))
            at = own[-1] + 1
            q = x[own]
            found = self.nearest(q, self.wide) if self.n else (np.full((len(own), 1), -1), np.full((len(own), 1), -np.inf))
            close = found[1][:, 0] >= radius
            node[own[close]], cosine[own[close]] = found[0][close, 0], found[1][close, 0]
            rest = np.flatnonzero(~close)
            among = q[rest] @ q[rest].T
            lead: list[int] = []
            for i in range(len(rest)):
                if lead:
                    best = int(among[i, lead].argmax())
                    if among[i, lead[best]] >= radius:
                        node[own[rest[i]]], cosine[own[rest[i]]] = self.n + best, among[i, lead[best]]
                        continue
                node[own[rest[i]]] = self.n + len(lead)
                lead.append(i)
            if not lead:
                continue
            new, first = rest[lead], self.n
            level = level_of(ids[own[new]], self.m)
            before = len(self.links)
            starts = None
            candidates = {}
            for k in range(before - 1, -1, -1):
                starts = self._entry(len(new), k) if starts is None else starts
                starts, sims = self._beam(q[new], starts, k, self.wide if k == 0 else 16)
                candidates[k] = (starts, sims)
            self._grow(q[new], level)
            mutual = q[new] @ q[new].T
            np.fill_diagonal(mutual, -np.inf)
            fresh = np.arange(first, self.n)
            for k in range(int(level.max()) + 1):
                joins = np.flatnonzero(level >= k)
                peers = np.where(level[None, :] >= k, mutual, -np.inf)[joins]
                old_ids, old_sims = candidates.get(k, (np.zeros((len(new), 0), np.int64), np.zeros((len(new), 0))))
                c_ids = np.concatenate([old_ids[joins], np.tile(fresh, (len(joins), 1))], axis=1)
                c_sims = np.concatenate([old_sims[joins], peers], axis=1)
                order = np.argsort(-c_sims, axis=1, kind="stable")[:, : self.wide]
                c_ids, c_sims = np.take_along_axis(c_ids, order, 1), np.take_along_axis(c_sims, order, 1)
                chosen = self._chosen(q[new][joins], c_ids, c_sims)
                r, c = np.nonzero(chosen >= 0)
                a, b = fresh[joins][r], chosen[r, c]
                self._tie(k, a, b, np.einsum("ed,ed->e", self.x[a], self.x[b]))
        return node, cosine

    def within(self, q: np.ndarray, least: np.ndarray, width: int, side: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, cosine) of nodes found with a cosine of least[query] or more. A beam whose last entry is still
        that near is widened; one as wide as the graph reads all nodes, whether links lead to them or not."""
        out = [[], [], []]
        for a in range(0, len(q), side):
            rows, w = np.arange(a, min(len(q), a + side)), min(width, self.n)
            while len(rows):
                if w < self.n:
                    ids, sims = self.nearest(q[rows], w)
                else:
                    ids, sims = np.tile(np.arange(self.n), (len(rows), 1)), q[rows] @ self.x.T
                full = (sims[:, -1] >= least[rows]) & (w < self.n)
                r, c = np.nonzero((sims >= least[rows, None]) & ~full[:, None])
                for o, v in zip(out, (rows[r], ids[r, c], sims[r, c])):
                    o.append(v)
                rows, w = rows[full], min(self.n, 2 * w)
        return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)
