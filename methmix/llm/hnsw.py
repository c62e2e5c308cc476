"""Hierarchical navigable small-world graphs, built and searched in batches of vectors with numpy inside a task."""

from __future__ import annotations

import numpy as np

LINKS = 12            # links that a new node makes
MOST_LINKS = 24       # links that a node keeps
BUILD_BEAM = 32
BATCH = 256
EXPANDED = 4          # nodes that a query expands in one step
LEVEL_FACTOR = 16     # a layer has one node for so many of the layer below


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray,
                beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` most similar nodes found for every query, best first: nodes (-1 for none) and similarities.

    `entries` has the start nodes of each query in a row (-1 for none).
    """
    n, count = len(vectors), len(queries)
    nodes = np.full((count, beam), -1, np.int64)
    sims = np.full((count, beam), -np.inf, np.float32)
    done = np.zeros((count, beam), bool)
    seen = np.zeros((count, n + 1), bool)
    seen[:, n] = True  # stands for no node
    active = np.arange(count)
    fresh = np.where(entries < 0, n, entries)
    while len(active):
        # Each new node once, and never one seen before.
        fresh = np.sort(fresh, axis=1)
        new = ~seen[active[:, None], fresh]
        new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
        seen[active[:, None], fresh] = True
        rows, places = np.nonzero(new)
        found = np.full(fresh.shape, -np.inf, np.float32)
        found[rows, places] = np.einsum("nd,nd->n", vectors[fresh[rows, places]], queries[active[rows]])
        all_nodes = np.concatenate([nodes[active], np.where(new, fresh, -1)], axis=1)
        all_sims = np.concatenate([sims[active], found], axis=1)
        all_done = np.concatenate([done[active], ~new], axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        nodes[active] = np.take_along_axis(all_nodes, order, 1)
        sims[active] = np.take_along_axis(all_sims, order, 1)
        done[active] = np.take_along_axis(all_done, order, 1)
        # The best nodes of each beam that are not expanded yet.
        waiting = ~done[active] & (nodes[active] >= 0)
        active = active[waiting.any(axis=1)]
        if not len(active):
            break
        waiting = ~done[active] & (nodes[active] >= 0)
        first = np.argsort(~waiting, axis=1, kind="stable")[:, :EXPANDED]
        chosen = np.take_along_axis(waiting, first, 1)
        at = np.where(chosen, np.take_along_axis(nodes[active], first, 1), -1)
        rows = np.repeat(active[:, None], first.shape[1], axis=1)
        done[rows[chosen], first[chosen]] = True
        fresh = np.where(at[:, :, None] >= 0, links[np.maximum(at, 0)], -1).reshape(len(active), -1)
        fresh = np.where(fresh < 0, n, fresh)
    return nodes, sims


def diverse(vectors: np.ndarray, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of candidates, best first, at most `most` that are nearer to their owner than to one chosen before; free
    places go to the best of the others. -1 for none."""
    count, width = nodes.shape
    near = vectors[np.maximum(nodes, 0)]
    between = near @ near.transpose(0, 2, 1)
    valid = nodes >= 0
    chosen = np.zeros((count, width), bool)
    for c in range(width):
        closer = (np.where(chosen, between[:, c, :], -np.inf) > sims[:, c:c + 1]).any(axis=1)
        chosen[:, c] = valid[:, c] & ~closer & (chosen.sum(axis=1) < most)
    rank = np.where(chosen, 0, np.where(valid, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(nodes, order, 1), -1)


def _padded(values: np.ndarray, width: int) -> np.ndarray:
    out = np.full((len(values), width), -1, np.int64)
    out[:, :values.shape[1]] = values[:, :width]
    return out


def _link_back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, out: np.ndarray) -> None:
    """Adds the reverse of the links `out` of the nodes `new`; full nodes choose anew among old and new."""
    source = np.repeat(new, out.shape[1])[out.ravel() >= 0]
    target = out.ravel()[out.ravel() >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    owners, starts, counts = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(starts, counts)
    # Links come in rounds of at most MOST_LINKS for a node, so that no node's list grows without bound.
    for low in range(0, int(counts.max(initial=0)), MOST_LINKS):
        some = (place >= low) & (place < low + MOST_LINKS)
        rows = np.searchsorted(owners, target[some])
        add = np.full((len(owners), MOST_LINKS), -1, np.int64)
        add[rows, place[some] - low] = source[some]
        hit = np.flatnonzero((add >= 0).any(axis=1))
        both = np.concatenate([links[owners[hit]], add[hit]], axis=1)
        room = (both >= 0).sum(axis=1) <= MOST_LINKS
        easy = np.argsort(both[room] < 0, axis=1, kind="stable")[:, :MOST_LINKS]
        links[owners[hit[room]]] = np.take_along_axis(both[room], easy, 1)
        full, full_rows = both[~room], owners[hit[~room]]
        for at in range(0, len(full), BATCH):
            part, own = full[at:at + BATCH], full_rows[at:at + BATCH]
            sims = np.einsum("qmd,qd->qm", vectors[np.maximum(part, 0)], vectors[own])
            sims[part < 0] = -np.inf
            best = np.argsort(-sims, axis=1, kind="stable")
            links[own] = diverse(vectors, np.take_along_axis(part, best, 1), np.take_along_axis(sims, best, 1), MOST_LINKS)


class Graph:
    """Layers from the sparse top to the whole set; nodes of a layer are the first ones of the insertion order."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray) -> "Graph":
        """`vectors`: unit rows in random order (float32)."""
        n, sizes = len(vectors), [len(vectors)]
        while sizes[-1] > 4 * LEVEL_FACTOR:
            sizes.append(sizes[-1] // LEVEL_FACTOR)
        graph = cls(vectors, [])
        for size in reversed(sizes):
            links = np.full((size, MOST_LINKS), -1, np.int64)
            above = len(graph.layers[-1]) if graph.layers else 0
            start = 0
            while start < size:
                stop = min(size, start + BATCH, max(2 * start, 32))
                new = np.arange(start, stop)
                own = vectors[new] @ vectors[new].T
                np.fill_diagonal(own, -np.inf)
                # A batch's nodes are candidates of each other, too.
                width = min(BUILD_BEAM, len(new))
                inside = np.argpartition(-own, width - 1, axis=1)[:, :width]
                nodes = np.where(np.isneginf(np.take_along_axis(own, inside, 1)), -1, new[inside])
                sims = np.take_along_axis(own, inside, 1).astype(np.float32)
                if start:
                    entries = graph._descend(vectors[new]) if above else np.zeros((len(new), 1), np.int64)
                    entries = np.where(entries < start, entries, 0)
                    found, near = beam_search(vectors[:start], links[:start], vectors[new], entries, BUILD_BEAM)
                    nodes, sims = np.concatenate([found, nodes], axis=1), np.concatenate([near, sims], axis=1)
                order = np.argsort(-sims, axis=1, kind="stable")
                nodes, sims = np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)
                out = diverse(vectors, nodes, sims, LINKS)
                links[new] = _padded(out, MOST_LINKS)
                _link_back(vectors, links, new, out)
                start = stop
            graph.layers.append(links)
        return graph

    def _descend(self, queries: np.ndarray) -> np.ndarray:
        """Start nodes in the layer below the lowest finished one."""
        entries = np.zeros((len(queries), 1), np.int64)
        for links in self.layers:
            entries, _ = beam_search(self.vectors[:len(links)], links, queries, entries, 4)
        return entries

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities, best first; a beam as wide as the graph compares with every node."""
        if beam >= len(self.vectors):
            sims = queries @ self.vectors.T
            order = np.argsort(-sims, axis=1, kind="stable")
            return order, np.take_along_axis(sims, order, 1)
        nodes, sims = [], []
        for at in range(0, len(queries), BATCH):
            some = queries[at:at + BATCH]
            entries = np.zeros((len(some), 1), np.int64)
            for links in self.layers[:-1]:
                entries, _ = beam_search(self.vectors[:len(links)], links, some, entries, 4)
            a, b = beam_search(self.vectors, self.layers[-1], some, entries, beam)
            nodes.append(a)
            sims.append(b)
        return np.concatenate(nodes), np.concatenate(sims)

    def to_bytes(self) -> list[bytes]:
        return [links.astype(np.int32).tobytes() for links in self.layers]

    @classmethod
    def from_bytes(cls, vectors: np.ndarray, layers: list[bytes]) -> "Graph":
        return cls(vectors, [np.frombuffer(b, np.int32).reshape(-1, MOST_LINKS).astype(np.int64) for b in layers])
