"""Hierarchical navigable small-world graphs in numpy (after Malkov & Yashunin).

Built from the sparsest level down: a level first links the nodes it shares with
the level above, then inserts the others in batches, each found by a beam search
from the level above. Neighbours are chosen by the diversity rule, which keeps
clusters connected. Searches run for a batch of queries in lockstep.
"""

from __future__ import annotations

import numpy as np

#: Links a node, and on the lowest level; beam while building; queries at a time.
LINKS, BUILD_BEAM, BATCH = 12, 48, 256


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, safe against overflow in the squares."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Graph:
    def __init__(self, vectors: np.ndarray, levels: list[np.ndarray], links: list[np.ndarray]):
        self.x, self.levels, self.links = vectors, levels, links

    @staticmethod
    def build(vectors: np.ndarray, seed: int = 0) -> Graph:
        """Of unit vectors; levels[0] are all nodes, in order."""
        n = len(vectors)
        graph = Graph(vectors.astype(np.float32), [], [])
        height = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        top = 0
        while (height > top).sum() > LINKS:
            top += 1
        height = np.minimum(height, top)
        for level in range(top, -1, -1):
            graph._level(np.flatnonzero(height >= level), np.flatnonzero(height > level), 2 * LINKS if level == 0 else LINKS)
        graph.levels.reverse()
        graph.links.reverse()
        return graph

    def _level(self, nodes: np.ndarray, above: np.ndarray, width: int) -> None:
        links = np.full((len(self.x), width), -1, np.int32)
        first = above if len(above) else nodes
        for i in range(0, len(first), BATCH):
            part = first[i : i + BATCH]
            sims = self.x[part] @ self.x[first].T
            sims[np.arange(len(part)), np.arange(i, i + len(part))] = -2
            k = min(BUILD_BEAM, len(first) - 1)
            if k > 0:
                pick = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                self._connect(links, part, first[pick], np.take_along_axis(sims, pick, 1))
        rest = np.setdiff1d(nodes, first, assume_unique=True)
        for i in range(0, len(rest), BATCH):
            part = rest[i : i + BATCH]
            start = self._descend(self.x[part], len(self.links))
            ids, sims, _ = self._beam(self.x[part], start, links, BUILD_BEAM)
            # Nodes of one batch don't find each other in the graph yet.
            own = self.x[part] @ self.x[part].T
            np.fill_diagonal(own, -2)
            ids = np.concatenate([ids, np.broadcast_to(part, own.shape)], axis=1)
            sims = np.concatenate([sims, own], axis=1)
            pick = np.argpartition(-sims, BUILD_BEAM - 1, axis=1)[:, :BUILD_BEAM]
            self._connect(links, part, np.take_along_axis(ids, pick, 1), np.take_along_axis(sims, pick, 1))
        self.levels.append(nodes)
        self.links.append(links)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """For each row, up to ``width`` candidates, best first, none closer to one
        chosen before than to the row's own node; then the best of the others."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        live = (ids >= 0) & (sims > -1.5)
        points = self.x[np.maximum(ids, 0)]
        between = points @ points.transpose(0, 2, 1)
        rows, taken, open_ = np.arange(len(ids)), np.zeros(ids.shape, bool), live.copy()
        for _ in range(width):
            at = open_.argmax(axis=1)
            has = open_[rows, at]
            taken[rows[has], at[has]] = True
            open_[has] &= between[rows[has], at[has]] <= sims[has]
            open_[rows, at] = False
        rank = np.where(taken, 0, np.where(live, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        best = np.argsort(rank, axis=1)[:, :width]
        out = np.take_along_axis(np.where(live, ids, -1), best, 1)
        if out.shape[1] < width:
            out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
        return out

    def _connect(self, links: np.ndarray, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        width = links.shape[1]
        chosen = self._diverse(ids, sims, max(2, width // 2))
        known = links[nodes]
        links[nodes] = self._trim(nodes, np.concatenate([known, chosen], axis=1), width)
        to, frm = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        to, frm = to[to >= 0], frm[to >= 0]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        targets, begin, count = np.unique(to, return_index=True, return_counts=True)
        # Nodes that very many ask for are served in rounds.
        for at in range(0, int(count.max(initial=0)), 32):
            some = np.flatnonzero(count > at)
            more = np.minimum(count[some] - at, 32)
            extra = np.full((len(some), 32), -1, np.int64)
            row = np.repeat(np.arange(len(some)), more)
            col = np.arange(len(row)) - np.repeat(np.cumsum(more) - more, more)
            extra[row, col] = frm[begin[some][row] + at + col]
            links[targets[some]] = self._trim(targets[some], np.concatenate([links[targets[some]], extra], axis=1), width)

    def _trim(self, nodes: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
        out = np.empty((len(nodes), width), np.int32)
        for i in range(0, len(nodes), 1024):
            part, own = ids[i : i + 1024], nodes[i : i + 1024]
            part = np.sort(part, axis=1)
            part[:, 1:][part[:, 1:] == part[:, :-1]] = -1
            sims = np.einsum("nd,nkd->nk", self.x[own], self.x[np.maximum(part, 0)])
            sims[(part < 0) | (part == own[:, None])] = -2
            out[i : i + 1024] = self._diverse(part, sims, width)
        return out

    def _descend(self, q: np.ndarray, built: int) -> np.ndarray:
        """Start nodes for the level below those built so far, from the top."""
        if not built:
            return np.zeros((len(q), 1), np.int64)
        nodes = self.levels[0]
        best = nodes[np.argsort(-(q @ self.x[nodes].T), axis=1)[:, :2]]
        for links in self.links[1:built]:
            best, _, _ = self._beam(q, best, links, 4)
        return best

    def _beam(self, q: np.ndarray, start: np.ndarray, links: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes that a beam search from ``start`` reaches."""
        n, rows = len(q), np.arange(len(q))
        seen = np.zeros((n, len(self.x)), bool)
        ids = np.full((n, max(width, start.shape[1])), -1, np.int64)
        ids[:, : start.shape[1]] = start
        sims = np.where(ids >= 0, np.einsum("nd,nkd->nk", q, self.x[np.maximum(ids, 0)]), -2).astype(np.float32)
        seen[rows[:, None], start] = True
        done = ids < 0
        while True:
            waiting = np.where(done, -3, sims)
            at = waiting.argmax(axis=1)
            live = np.flatnonzero(waiting[rows, at] > -3)
            if not len(live):
                return ids, sims, seen
            done[live, at[live]] = True
            near = links[ids[live, at[live]]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], near]  # -1 reads the last node, and counts for nothing
            at, col = np.nonzero(fresh)
            seen[live[at], near[at, col]] = True
            near = np.where(fresh, near, -1)
            new = np.where(fresh, np.einsum("nd,nkd->nk", q[live], self.x[np.maximum(near, 0)]), -2).astype(np.float32)
            use = np.flatnonzero((new > sims[live].min(axis=1)[:, None]).any(axis=1))
            if not len(use):
                continue
            live = live[use]
            all_ids = np.concatenate([ids[live], near[use]], axis=1)
            all_sims = np.concatenate([sims[live], new[use]], axis=1)
            all_done = np.concatenate([done[live], near[use] < 0], axis=1)
            keep = np.argpartition(-all_sims, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
            ids[live], sims[live], done[live] = (np.take_along_axis(a, keep, 1) for a in (all_ids, all_sims, all_done))

    def within(self, q: np.ndarray, least: float, width: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of similarity ``least`` or more: a beam search finds
        the surroundings, and links are followed from every node in reach."""
        out_q, out_n = [], []
        links = self.links[0]
        for i in range(0, len(q), BATCH):
            part = q[i : i + BATCH].astype(np.float32)
            ids, sims, _ = self._beam(part, self._start(part), links, width)
            seen = np.zeros((len(part), len(self.x)), bool)
            who, col = np.nonzero((ids >= 0) & (sims >= least - slack))
            node, sim = ids[who, col], sims[who, col]
            seen[who, node] = True
            while len(who):
                good = sim >= least
                out_q.append(i + who[good])
                out_n.append(node[good])
                near = links[node].astype(np.int64)
                k = near.shape[1]
                who, node = np.repeat(who, k), near.ravel()
                ok = node >= 0
                who, node = who[ok], node[ok]
                ok = ~seen[who, node]
                code = np.unique(who[ok] * len(self.x) + node[ok])
                who, node = code // len(self.x), code % len(self.x)
                seen[who, node] = True
                sim = np.concatenate([np.einsum("nd,nd->n", part[who[a : a + 8192]], self.x[node[a : a + 8192]]) for a in range(0, len(who), 8192)]) if len(who) else np.zeros(0)
                ok = sim >= least - slack
                who, node, sim = who[ok], node[ok], sim[ok]
        if not out_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_q), np.concatenate(out_n)

    def _start(self, q: np.ndarray) -> np.ndarray:
        """Start nodes on the lowest level of a whole graph."""
        if len(self.levels) == 1:
            return np.zeros((len(q), 1), np.int64)
        nodes = self.levels[-1]
        best = nodes[np.argsort(-(q @ self.x[nodes].T), axis=1)[:, :2]]
        for links in self.links[-2:0:-1]:
            best, _, _ = self._beam(q, best, links, 4)
        return best

    def pack(self) -> list[bytes]:
        """Node lists and links of every level, without the vectors."""
        return [a.astype(np.int32).tobytes() for a in (*self.levels, *(k[n] for n, k in zip(self.levels, self.links, strict=True)))]

    @staticmethod
    def unpack(vectors: np.ndarray, parts: list[bytes]) -> Graph:
        arrays = [np.frombuffer(p, np.int32) for p in parts]
        half = len(arrays) // 2
        levels, links = [a.astype(np.int64) for a in arrays[:half]], []
        for nodes, flat in zip(levels, arrays[half:], strict=True):
            table = np.full((len(vectors), len(flat) // max(1, len(nodes))), -1, np.int32)
            table[nodes] = flat.reshape(len(nodes), -1)
            links.append(table)
        return Graph(vectors.astype(np.float32), levels, links)
