"""A prefix tree of ordered sets that finds the sets similar to a probe, sharing the overlap along common beginnings."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np


def needed(percent: int, a: int, b: int) -> int:
    """Least overlap of sets of a and b members whose Jaccard similarity is percent / 100 or more."""
    return -(-percent * (a + b) // (100 + percent))


class _Node:
    __slots__ = ("of", "start", "stop", "below", "ends")

    def __init__(self, of: int, start: int, stop: int):
        self.of, self.start, self.stop = of, start, stop
        self.below: list[_Node] = []
        self.ends: list[int] = []


class PrefixTree:
    """Built once from sets (sorted arrays of unsigned 64-bit tokens in the global order) and held against any number of probes.

    An edge is a run of one set's tokens (start to stop); nodes are kept in preorder, so that a branch is left by one jump. Each node
    knows the smallest size and the longest path below it: with the tokens that the probe has left, they bound what the overlap can become.
    sizes count members that only one set has too; those are not in the sets.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int], percent: int):
        self.sets, self.sizes, self.percent = sets, sizes, percent
        root = _Node(0, 0, 0)
        path = [root]
        before = np.empty(0, np.uint64)
        for i in sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes()):
            y = sets[i]
            m = min(len(before), len(y))
            differ = np.flatnonzero(before[:m] != y[:m])
            depth = int(differ[0]) if len(differ) else m
            last = None
            while path[-1].stop > depth:
                last = path.pop()
            if path[-1].stop < depth:  # the branch begins inside last's edge
                fork = _Node(last.of, last.start, depth)
                fork.below.append(last)
                last.start = depth
                path[-1].below[-1] = fork
                path.append(fork)
            if len(y) > depth:
                path[-1].below.append(_Node(i, depth, len(y)))
                path.append(path[-1].below[-1])
            path[-1].ends.append(i)
            before = y
        self._flatten(root)

    def _flatten(self, root: _Node) -> None:
        self.nodes: list[_Node] = []
        self.up: list[int] = []
        todo = [(root, -1)]
        while todo:
            node, up = todo.pop()
            self.up.append(up)
            self.nodes.append(node)
            todo += [(x, len(self.nodes) - 1) for x in reversed(node.below)]
        n = len(self.nodes)
        self.after = list(range(1, n + 1))
        self.small = [min((self.sizes[i] for i in x.ends), default=1 << 60) for x in self.nodes]
        self.deep = [x.stop for x in self.nodes]
        for v in range(n - 1, 0, -1):
            u = self.up[v]
            self.after[u] = max(self.after[u], self.after[v])
            self.small[u] = min(self.small[u], self.small[v])
            self.deep[u] = max(self.deep[u], self.deep[v])
        self.leaf = {i: v for v, x in enumerate(self.nodes) for i in x.ends}

    def similar(self, x: np.ndarray, nx: int, some: list[int] | None = None) -> list[int]:
        """The sets (of some, or of all) that are similar to x, of nx members; branches without any of some are passed over."""
        wanted = sorted({self.leaf[i] for i in some}) if some is not None else None
        chosen = set(some) if some is not None else None
        overlap, used = [0] * len(self.nodes), [0] * len(self.nodes)
        found = []
        v = 0
        while v < len(self.nodes):
            if wanted is not None:
                k = bisect_left(wanted, v)
                if k == len(wanted):
                    break
                if wanted[k] >= self.after[v]:
                    v = self.after[v]
                    continue
            node, u = self.nodes[v], self.up[v]
            shared, at = (overlap[u], used[u]) if u >= 0 else (0, 0)
            need = needed(self.percent, nx, self.small[v])
            if shared + min(len(x) - at, self.deep[v] - node.start) < need:
                v = self.after[v]
                continue
            if node.stop > node.start and at < len(x):
                edge = self.sets[node.of][node.start : node.stop]
                place = np.searchsorted(x, edge)
                hit = x[np.minimum(place, len(x) - 1)] == edge
                shared += int(hit.sum())
                at = int(place[-1]) + int(hit[-1])
            overlap[v], used[v] = shared, at
            if shared + min(len(x) - at, self.deep[v] - node.stop) < need:
                v = self.after[v]
                continue
            found += [i for i in node.ends if shared >= needed(self.percent, nx, self.sizes[i]) and (chosen is None or i in chosen)]
            v += 1
        return found
