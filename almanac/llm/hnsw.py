"""Hierarchical navigable small-world graphs in flat arrays: layers of neighbour ids, searched for many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Links:
    """links: neighbours that a new node picks; layers above the lowest hold so many, the lowest twice as many.
    build, search: nodes that a beam keeps while the graph is built and searched. wide: nodes that a beam
    opens at a time. batch: nodes that are put in, and queries that are searched, at a time. marks: marks of
    seen nodes that a beam holds, at most. seed: of the levels."""

    links: int = 16
    build: int = 64
    search: int = 128
    wide: int = 8
    batch: int = 512
    marks: int = 1 << 24
    seed: int = 11


def levels(n: int, p: Links) -> np.ndarray:
    """The highest layer of each of n nodes: each layer has 1 / p.links of the nodes of the one below."""
    u = 1.0 - np.random.default_rng(p.seed).random(n)
    return np.floor(-np.log(u) / np.log(p.links)).astype(np.int64)


class Graph:
    """Nodes are unit vectors, those of higher layers first, so that a layer's nodes are the first ones. layers
    holds for each layer an array with a row of neighbours for each of its nodes, -1 where there is none;
    the lowest has one column more, for links that keep every node in reach of the first."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], p: Links = Links()):
        self.vectors, self.layers, self.p = vectors, layers, p

    @classmethod
    def build(cls, vectors: np.ndarray, p: Links = Links()) -> tuple[Graph, np.ndarray]:
        """(the graph of unit vectors, the place in vectors of each of its nodes). Nodes are put in in batches that
        at most double the graph; each searches what is there and meets the others of its batch."""
        n, level = len(vectors), levels(len(vectors), p)
        order = np.argsort(-level, kind="stable")
        level = level[order]
        top = int(level[0]) if n else 0
        sizes = [int((level >= k).sum()) for k in range(top + 1)]
        layers = [np.full((size, 2 * p.links + 1 if k == 0 else p.links), -1, dtype=np.int32) for k, size in enumerate(sizes)]
        graph = cls(np.ascontiguousarray(vectors[order], dtype=np.float32), layers, p)
        at = 0
        while at < n:
            end = min(n, at + max(1, min(graph._lot(), at)), sizes[level[at]])
            graph._insert(at, end, int(level[at]))
            at = end
        graph._connect()
        return graph, order

    def _lot(self) -> int:
        return max(1, min(self.p.batch, self.p.marks // max(1, len(self.vectors))))

    def _insert(self, at: int, end: int, level: int) -> None:
        p, q, new = self.p, self.vectors[at:end], np.arange(at, end)
        entry = np.zeros((len(new), 1), dtype=np.int64)
        mutual = q @ q.T
        np.fill_diagonal(mutual, -np.inf)
        near = np.argsort(-mutual, axis=1, kind="stable")[:, : min(len(new) - 1, p.links)]
        own, own_sim = np.where(np.isfinite(np.take_along_axis(mutual, near, 1)), near + at, -1), np.take_along_axis(mutual, near, 1)
        for layer in range(len(self.layers) - 1, -1, -1):
            ids, sim = (np.zeros((len(new), 0), dtype=np.int64), np.zeros((len(new), 0), dtype=np.float32)) if not at else self.beam(q, entry, layer, p.build if layer <= level else 1)
            entry = ids if at else entry
            if layer <= level:
                ids, sim = np.concatenate([ids, own], axis=1), np.concatenate([sim, own_sim], axis=1)
                ids, sim = _sorted(ids, sim, p.build)
                picked = self.spread(ids, sim, p.links)
                self.layers[layer][new, : picked.shape[1]] = picked
                i, j = np.nonzero(picked >= 0)
                self._link_back(layer, new[i], picked[i, j])

    def spread(self, ids: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those that are nearer to the row's node than to any
        taken before, and then the nearest others, up to most."""
        x = self.vectors[np.maximum(ids, 0)]
        among = x @ x.transpose(0, 2, 1)
        keep, count = np.zeros(ids.shape, dtype=bool), np.zeros(len(ids), dtype=np.int64)
        closest = np.full(ids.shape, -np.inf, dtype=np.float32)
        for c in range(ids.shape[1]):
            ok = (ids[:, c] >= 0) & (count < most) & (closest[:, c] < sim[:, c])
            keep[:, c] = ok
            count += ok
            np.maximum(closest, among[:, c], out=closest, where=ok[:, None])
        order = np.argsort(np.where(ids < 0, 2, np.where(keep, 0, 1)), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, order, 1)

    def _link_back(self, layer: int, source: np.ndarray, target: np.ndarray) -> None:
        """Adds source to the neighbours of target, pair by pair; full lists are thinned by spread()."""
        links, width = self.layers[layer], 2 * self.p.links if layer == 0 else self.p.links
        sim = np.einsum("pd,pd->p", self.vectors[source], self.vectors[target])
        order = np.lexsort((source, -sim, target))
        source, target, sim = source[order], target[order], sim[order]
        rank = np.arange(len(target)) - np.searchsorted(target, target)
        source, target, sim, rank = (a[rank < width] for a in (source, target, sim, rank))
        nodes, row = np.unique(target, return_inverse=True)
        for s in range(0, len(nodes), self.p.batch):
            some = (row >= s) & (row < s + self.p.batch)
            mine = nodes[s : s + self.p.batch]
            ids = np.full((len(mine), width + int(rank[some].max()) + 1), -1, dtype=np.int64)
            sims = np.full(ids.shape, -np.inf, dtype=np.float32)
            ids[:, :width] = links[mine, :width]
            sims[:, :width] = np.where(ids[:, :width] >= 0, np.einsum("nd,nkd->nk", self.vectors[mine], self.vectors[np.maximum(ids[:, :width], 0)]), -np.inf)
            new = row[some] - s, width + rank[some]
            known = (links[target[some], :width] == source[some][:, None]).any(axis=1)
            ids[new], sims[new] = np.where(known, -1, source[some]), np.where(known, -np.inf, sim[some])
            ids, sims = _sorted(ids, sims, ids.shape[1])
            full = (ids >= 0).sum(axis=1) > width
            out = ids[:, :width].copy()
            if full.any():
                out[full] = self.spread(ids[full], sims[full], width)
            links[mine, :width] = out

    def _connect(self) -> None:
        """Gives nodes that can't be reached from the first a link from the nearest that can."""
        links = self.layers[0]
        reached = np.zeros(len(links), dtype=bool)
        reached[:1] = True
        edge = np.flatnonzero(reached)
        while True:
            while len(edge):
                near = np.unique(links[edge])
                near = near[near >= 0]
                edge = near[~reached[near]]
                reached[edge] = True
            left = np.flatnonzero(~reached)
            if not len(left):
                return
            free = np.flatnonzero(reached & (links[:, -1] < 0))
            at = free[int((self.vectors[free] @ self.vectors[left[0]]).argmax())]
            links[at, -1] = left[0]
            edge = left[:1]
            reached[edge] = True

    def beam(self, q: np.ndarray, entry: np.ndarray, layer: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of up to ef nodes of a layer near each query, nearest first; ids -1 fill up.

        Each query keeps its ef best nodes and opens the best p.wide that it has not opened yet, until all that it
        keeps are open. All queries move at once."""
        links, n = self.layers[layer], len(q)
        ids, sim = np.full((n, ef), -1, dtype=np.int64), np.full((n, ef), -np.inf, dtype=np.float32)
        opened = np.ones((n, ef), dtype=bool)
        seen = np.zeros((n, len(links)), dtype=np.int32)
        entry = entry[:, :ef]
        i, j = np.nonzero(entry >= 0)
        ids[i, j], opened[i, j] = entry[i, j], False
        sim[i, j] = np.einsum("pd,pd->p", q[i], self.vectors[entry[i, j]])
        seen[i, entry[i, j]] = 1
        live, token, wide = np.arange(n), 1, min(self.p.wide, ef)
        while len(live):
            s = np.where(opened[live], -np.inf, sim[live])
            pick = np.argpartition(-s, wide - 1, axis=1)[:, :wide] if wide < ef else np.broadcast_to(np.arange(ef), s.shape)
            ok = np.take_along_axis(s, pick, 1) > -np.inf
            go = ok.any(axis=1)
            live, pick, ok = live[go], pick[go], ok[go]
            if not len(live):
                break
            opened[live[:, None], pick] = True
            near = links[np.maximum(ids[live[:, None], pick], 0)].astype(np.int64)
            near[~ok] = -1
            near = near.reshape(len(live), -1)
            i, j = np.nonzero(near >= 0)
            node, row = near[i, j], live[i]
            new = seen[row, node] == 0
            i, j, node, row = i[new], j[new], node[new], row[new]
            mark = np.arange(token + 1, token + 1 + len(node), dtype=np.int32)
            token += len(node)
            seen[row, node] = mark  # of a node that is met twice in a step the last counts
            new = seen[row, node] == mark
            i, j, node, row = i[new], j[new], node[new], row[new]
            got = np.full(near.shape, -np.inf, dtype=np.float32)
            got[i, j] = np.einsum("pd,pd->p", q[row], self.vectors[node])
            all_sim = np.concatenate([sim[live], got], axis=1)
            best = np.argpartition(-all_sim, ef - 1, axis=1)[:, :ef]
            sim[live] = np.take_along_axis(all_sim, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), best, 1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], got == -np.inf], axis=1), best, 1)
        ids[sim == -np.inf] = -1
        return _sorted(ids, sim, ef)

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the k nearest found for each unit vector of q, nearest first; -1 fill up."""
        ef, out = max(k, self.p.search), []
        for s in range(0, len(q), self._lot()):
            some = np.ascontiguousarray(q[s : s + self._lot()], dtype=np.float32)
            entry = np.zeros((len(some), 1), dtype=np.int64)
            for layer in range(len(self.layers) - 1, -1, -1):
                entry, sim = self.beam(some, entry, layer, ef if layer == 0 else 1)
            out.append((entry[:, :k], sim[:, :k]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros((0, k), dtype=np.int64), np.zeros((0, k), dtype=np.float32))


def _sorted(ids: np.ndarray, sim: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -sim), axis=1)[:, :most]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
