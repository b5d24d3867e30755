"""A navigable small-world graph with a hierarchy, searched for many queries at once."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

#: Links of a node (twice as many on the ground layer), candidates when building, queries a step.
M, BUILD_BEAM, BATCH = 16, 64, 256
#: Nodes that each query expands in a step.
EXPAND = 4


class Hnsw:
    """Cosine neighbours of unit vectors. ``layers[0]`` is the ground; layer l holds ``nodes[l]``."""

    def __init__(self, x: np.ndarray, nodes: list[np.ndarray], layers: list[np.ndarray]):
        self.x, self.nodes, self.layers = x, nodes, layers

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 5) -> Hnsw:
        n = len(x)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(int)
        nodes = [np.flatnonzero(level >= j) for j in range(int(level.max(initial=0)) + 1)]
        while len(nodes) > 1 and len(nodes[-1]) < 2:
            nodes.pop()
        graph = cls(x, [], [])
        for members in reversed(nodes):
            graph._layer(members, 2 * M if members is nodes[0] else M)
        return graph

    def _layer(self, members: np.ndarray, width: int) -> None:
        """Add a layer below the present ones: its upper members first, then the others, batch by batch.

        While it grows, a node may hold half as many links again as it keeps in the end, so that
        links are chosen anew once for many that came, not for each.
        """
        links = np.full((len(self.x), width + width // 2), -1, np.int32)
        held = np.zeros(len(self.x), np.int64)
        above = self.nodes[0] if self.nodes else members[:1]
        rest = np.setdiff1d(members, above, assume_unique=True)
        done = np.zeros(0, np.int64)
        step = 32
        for part in ([above] if len(above) <= BATCH else np.array_split(above, -(-len(above) // BATCH))):
            self._insert(part, done, links, held, width)
            done = np.r_[done, part]
        k = 0
        while k < len(rest):
            part = rest[k : k + step]
            self._insert(part, done, links, held, width)
            done = np.r_[done, part]
            k += len(part)
            step = min(BATCH, 2 * step)
        self._choose(np.flatnonzero(held > width), links, held, width)
        self.nodes.insert(0, members)
        self.layers.insert(0, np.ascontiguousarray(links[:, :width]))

    def _insert(self, part: np.ndarray, done: np.ndarray, links: np.ndarray, held: np.ndarray, width: int) -> None:
        q = self.x[part]
        among = q @ q.T
        np.fill_diagonal(among, -2)
        ids, sims = np.broadcast_to(part, among.shape), among
        if len(done):
            entry = self._descend(q) if self.layers else np.broadcast_to(done[:1], (len(part), 1))
            known = np.isin(entry, done)
            entry = np.where(known, entry, done[0])
            got, near = self._beam(q, entry, links, min(BUILD_BEAM, len(done)))
            ids, sims = np.c_[ids, got], np.c_[sims, near]
        keep = min(BUILD_BEAM, ids.shape[1])
        top = np.argsort(-sims, axis=1, kind="stable")[:, :keep]
        ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        own = max(width // 2, 8)
        links[part, :own] = self._spread(ids, sims, own)
        held[part] = (links[part] >= 0).sum(1)
        # links back: into free places, or chosen anew among the old ones and the new ones
        src, dst = np.repeat(part, own), links[part, :own].ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        nth = np.arange(len(dst)) - np.repeat(first, count)
        while len(dst):
            place = held[dst] + nth
            fits = place < links.shape[1]
            links[dst[fits], place[fits]] = src[fits]
            np.add.at(held, dst[fits], 1)
            src, dst, nth = src[~fits], dst[~fits], nth[~fits]
            targets = np.unique(dst)
            self._choose(targets, links, held, width)
            nth = np.arange(len(dst)) - np.searchsorted(dst, dst)

    def _choose(self, targets: np.ndarray, links: np.ndarray, held: np.ndarray, width: int) -> None:
        """Cut the links of these nodes to ``width``."""
        for k in range(0, len(targets), BATCH):
            t = targets[k : k + BATCH]
            pool = np.sort(links[t].astype(np.int64), axis=1)
            pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
            near = np.matmul(self.x[pool], self.x[t][:, :, None])[:, :, 0]
            near[pool < 0] = -2
            order = np.argsort(-near, axis=1, kind="stable")
            kept = self._spread(np.take_along_axis(pool, order, 1), np.take_along_axis(near, order, 1), width)
            kept = np.take_along_axis(kept, np.argsort(kept < 0, axis=1, kind="stable"), 1)
            links[t] = -1
            links[t, :width] = kept
            held[t] = (kept >= 0).sum(1)

    def _spread(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Of candidates in falling similarity, those nearer to the node than to any chosen before;
        places left go to the nearest others."""
        b, k = ids.shape
        v = self.x[ids]
        between = np.matmul(v, v.transpose(0, 2, 1))
        chosen = np.zeros((b, k), bool)
        nearest = np.full((b, k), -2.0, self.x.dtype)
        n_chosen = np.zeros(b, np.int64)
        for j in range(k):
            ok = (sims[:, j] > -2) & (nearest[:, j] < sims[:, j]) & (n_chosen < width)
            chosen[:, j] = ok
            n_chosen += ok
            np.maximum(nearest, between[:, :, j], out=nearest, where=ok[:, None])
        order = np.argsort(np.where(chosen, 0, np.where(sims > -2, 1, 2)), axis=1, kind="stable")[:, :width]
        out = np.full((b, width), -1, np.int32)
        picked = np.take_along_axis(ids, order, 1)
        out[:, : picked.shape[1]] = np.where(np.take_along_axis(sims, order, 1) > -2, picked, -1)
        return out

    def _descend(self, q: np.ndarray) -> np.ndarray:
        """The best node of the lowest finished layer, from the top down."""
        at = np.broadcast_to(self.nodes[-1][:1], (len(q), 1))
        for links in reversed(self.layers):
            at = self._beam(q, at, links, 8)[0][:, :4]
            at = np.where(at < 0, at[:, :1], at)
        return at

    def _beam(self, q: np.ndarray, entry: np.ndarray, links: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and similarities (falling; -1 and -2 where there are fewer) of up to ``width`` nodes."""
        b = len(q)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, len(self.x) + 1), bool)  # the last column takes the ids of -1
        ids = np.full((b, width), -1, np.int64)
        sims = np.full((b, width), -2.0, self.x.dtype)
        fresh = entry
        opened = np.zeros((b, width), bool)
        while True:
            fresh = np.sort(fresh, axis=1)
            new = ~seen[rows, fresh] & (fresh >= 0)
            new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
            seen[rows, fresh] = True
            near = np.where(new, np.einsum("bkd,bd->bk", self.x[fresh], q), -2.0)
            fresh = np.where(new, fresh, -1)
            all_ids, all_sims = np.c_[ids, fresh], np.c_[sims, near]
            all_open = np.c_[opened, np.zeros(fresh.shape, bool)]
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids, sims, opened = (np.take_along_axis(a, order, 1) for a in (all_ids, all_sims, all_open))
            todo = ~opened & (ids >= 0)
            if not todo.any():
                return ids, sims
            first = np.argsort(~todo, axis=1, kind="stable")[:, :EXPAND]
            real = np.take_along_axis(todo, first, 1)
            np.put_along_axis(opened, first, np.take_along_axis(opened, first, 1) | real, 1)
            fresh = links[np.take_along_axis(ids, first, 1)]
            fresh = np.where(real[:, :, None], fresh, -1).reshape(b, -1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of the beam and their similarities for each query."""
        width = min(beam, len(self.x))
        entry = self.nodes[-1][:1]
        at = np.broadcast_to(entry, (len(q), 1))
        for links in reversed(self.layers[1:]):
            at = self._beam(q, at, links, 8)[0][:, :4]
            at = np.where(at < 0, at[:, :1], at)
        return self._beam(q, at, self.layers[0], width)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *self.nodes, *self.layers)
        return out.getvalue()

    @classmethod
    def load(cls, x: np.ndarray, blob: bytes) -> Hnsw:
        z = np.load(io.BytesIO(blob))
        parts = [z[f"arr_{i}"] for i in range(len(z.files))]
        return cls(x, parts[: len(parts) // 2], parts[len(parts) // 2 :])


@dataclass
class Hits:
    """linked[i, j]: query i and node j link. Of ``true`` links of the audited queries the walk had ``found``;
    the audits multiplied ``scanned`` of len(queries) * len(nodes) pairs."""

    linked: np.ndarray
    beam: int
    found: int
    true: int
    scanned: int


def within(graph: Hnsw, q: np.ndarray, threshold: float, exact, beam: int = 64, own: bool = False, audit: int = 256, recall: float = 0.99) -> Hits:
    """Which queries and nodes have a cosine of ``threshold`` or more; own: the queries are the nodes, and
    no node links with itself.

    All queries walk the graph; those whose whole beam lies within the threshold walk it again with
    a wider one. An audit then takes the exact neighbours of at most ``audit`` queries that the walk
    linked and as many others, an eighth of the queries each at most. Of a shard's own links, each is
    sought from both ends, so the share found from both tells what one walk misses. Where the walk
    had less than ``recall`` of the audit's links, or nine tenths from both ends, the beam widens;
    after a beam of the whole graph everything is scanned. Links that an audit finds are kept.
    exact(i, j) is the cosine in double precision of query rows i and nodes j; only pairs that it
    confirms are links.
    """
    n = len(graph.x)
    slack = 1e-5  # what single precision may lose in the search

    def scan(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), n), bool)
        r, c = np.nonzero(q[rows] @ graph.x.T >= threshold - slack)
        for k in range(0, len(r), 1 << 16):
            a, b = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
            out[a, b] = exact(rows[a], b) >= threshold
        if own:
            out[np.arange(len(rows)), rows] = False
        return out

    def walk(rows: np.ndarray, width: int, out: np.ndarray) -> None:
        full = []
        for k in range(0, len(rows), BATCH):
            part = rows[k : k + BATCH]
            ids, sims = graph.search(q[part], width)
            r, c = np.nonzero(sims >= threshold - slack)
            if own:
                other = part[r] != ids[r, c]
                r, c = r[other], c[other]
            good = exact(part[r], ids[r, c]) >= threshold
            out[part[r[good]], ids[r[good], c[good]]] = True
            full.append(part[sims[:, -1] >= threshold - slack])
        full = np.concatenate(full) if full else np.zeros(0, np.int64)
        if len(full) and width < n:
            walk(full, width * 4, out)

    everyone = np.arange(len(q))
    mixed = np.random.default_rng(9).permutation(len(q))
    size, scanned = min(audit, -(-len(q) // 8)), 0
    while True:
        out = np.zeros((len(q), n), bool)
        walk(everyone, beam, out)
        agreed = True
        if own:
            once = int(out.sum())
            agreed = int((out & out.T).sum()) >= 0.9 * once
            out |= out.T
        linked = out.any(1)[mixed]
        sample = np.r_[mixed[linked][:size], mixed[~linked][:size]]
        truth = scan(sample)
        scanned += truth.size
        found, true = int((out[sample] & truth).sum()), int(truth.sum())
        out[sample] |= truth
        if agreed and found >= recall * true:
            if own:
                out |= out.T
            return Hits(out, beam, found, true, scanned)
        if beam >= n:
            for k in range(0, len(q), 1024):
                out[everyone[k : k + 1024]] = scan(everyone[k : k + 1024])
            return Hits(out, beam, found, true, scanned + out.size)
        beam *= 4
