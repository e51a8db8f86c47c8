"""BK-trees over 64-bit fingerprints, many at a time.

A node's children are keyed by their integer Hamming distance to it. The nodes of all trees of a forest stand in
one array, level by level, each with the number of its parent and its edge; as parents come in order, the
children of a node with edges in a range are one slice. Trees are built and walked a level at a time, so
a forest of many small trees costs no more than one large tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: An edge is 64 at most.
EDGES = 128
#: (query, node) pairs that are walked at once.
FRONT = 1 << 16


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class BKForest:
    """``prints``: nodes' fingerprints, level by level; ``link``: parent * EDGES + edge of each node (roots: negative), ascending; ``roots``: of each tree."""

    def __init__(self, prints: np.ndarray, link: np.ndarray, roots: np.ndarray):
        self.prints, self.link, self.roots = prints, link, roots
        self.parents = np.zeros(len(prints), bool)
        self.parents[np.unique(link[link >= 0] // EDGES)] = True

    @classmethod
    def of(cls, prints: np.ndarray, tree: np.ndarray) -> tuple[BKForest, np.ndarray]:
        """The forest of distinct ``prints``, each in the tree of its number (0 to n - 1, ascending); and the place of each node among ``prints``."""
        member, group = np.arange(len(prints)), tree.astype(np.int64)
        nodes, links, first = [], [], 0
        above = np.full(len(prints), -1, np.int64)  # link of the group that a member is in
        while len(member):
            head = np.ones(len(member), bool)
            head[1:] = group[1:] != group[:-1]
            at = np.cumsum(head) - 1
            pivots = member[head]
            nodes.append(pivots)
            links.append(above[head])
            rest = ~head
            under, member = first + at[rest], member[rest]
            edge = distance(prints[member], prints[pivots[at[rest]]])
            above = under * EDGES + edge
            order = np.argsort(above, kind="stable")
            member, above = member[order], above[order]
            group = above
            first += len(pivots)
        place = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        link = np.concatenate(links) if links else np.zeros(0, np.int64)
        return cls(prints[place], link, np.flatnonzero(link < 0)), place

    @classmethod
    def joined(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[BKForest, np.ndarray]:
        """One forest of single trees (prints, link); and for each node of the trees in turn its number in the forest."""
        sizes = np.array([len(p) for p, _ in parts], np.int64)
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        prints, link = np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])
        level = np.zeros(len(prints), np.int64)
        parent = np.where(link < 0, -1, start + link // EDGES)
        open_ = np.flatnonzero(link >= 0)
        while len(open_):  # a node's level is its parent's and one more
            new = level[parent[open_]] + 1
            moved = new != level[open_]
            level[open_] = new
            if not moved.any():
                break
        order = np.argsort(level, kind="stable")
        number = np.empty(len(prints), np.int64)
        number[order] = np.arange(len(prints))
        new = np.where(link < 0, -1, number[parent] * EDGES + link % EDGES)[order]
        return cls(prints[order], new, np.flatnonzero(new < 0)), number

    def walk(self, queries: np.ndarray, root: np.ndarray, radius: int, seen: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) of the pairs within ``radius``, each query going down the tree with that root along the edges within the radius."""
        todo = [iter([(np.arange(a, min(a + FRONT, len(queries))), root[a : a + FRONT]) for a in range(0, len(queries), FRONT)])]
        while todo:
            part = next(todo[-1], None)
            if part is None:
                todo.pop()
                continue
            q, node = part
            if seen is not None:
                seen.append(len(q))
            d = distance(queries[q], self.prints[node])
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            more = np.flatnonzero(self.parents[node])
            if len(more):
                q, node, d = q[more], node[more], d[more]
                low = np.searchsorted(self.link, node * EDGES + np.maximum(d - radius, 0))
                n = np.searchsorted(self.link, node * EDGES + np.minimum(d + radius, 64) + 1) - low
                todo.append(_below(q, low, n))


def _below(q: np.ndarray, low: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) of the ``n`` children from ``low`` of every query's node, about FRONT at a time; a slice is made when it is asked for."""
    ends = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + FRONT, side="right")))
        size = n[a:b]
        total = int(size.sum())
        if total:
            within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            yield np.repeat(q[a:b], size), np.repeat(low[a:b], size) + within
        a = b
