"""Jaccard components of the sets of one group by a prefix tree of ordered sets."""

from __future__ import annotations

import numpy as np

_MIXED = -1


class _Node:
    __slots__ = ("label", "children", "shortest", "longest", "member", "ends")

    def __init__(self, label, length, member, ends):
        self.label, self.children, self.ends = label, {}, ends
        self.shortest = self.longest = length
        self.member = member  # a set below this node if all sets below were in one component, else _MIXED


def ordered(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets with elements numbered by frequency (ties: by value), most frequent first, each in that order."""
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(s) for s in np.split(rank[at], cuts)], len(values)


def jaccard_components(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set (distinct, not empty, sorted) the index of its component: sets link when 100 * intersection >= percent * union.

    Sets go into the tree by growing size; each first walks the tree, which holds the sets before it. The overlap with a node's
    labels is counted once for all sets below. A subtree is left when even all elements that remain on both sides could not give
    the overlap needed, and when all its sets are in the component that the set has joined already: so a group of thousands of
    near copies costs a walk each, not all pairs."""
    ranked, universe = ordered(sets)
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    have = np.zeros(universe, bool)
    top = _Node(np.zeros(0, np.int64), 1 << 60, _MIXED, -1)
    whole = 100 + percent  # 100 * i >= percent * (x + y - i)

    def link(x: int) -> None:
        own, nx = ranked[x], len(ranked[x])
        have[own] = True
        stack = [(top, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            if node is not top and node.member != _MIXED and find(node.member) == find(x):
                continue
            if node.ends >= 0 and whole * overlap >= percent * (nx + depth):
                parent[find(node.ends)] = find(x)
            later = []
            for first, child in node.children.items():
                if child.longest * 100 < percent * nx:
                    continue
                d = depth + len(child.label)
                o = overlap + int(np.count_nonzero(have[child.label]))
                left = nx - int(np.searchsorted(own, child.label[-1], "right"))
                y = min(max(d + left, child.shortest), child.longest)
                if whole * (o + min(left, y - d)) >= percent * (nx + y):
                    (stack if not have[first] else later).append((child, o, d))
            stack += later
        have[own] = False

    def insert(x: int) -> None:
        own, node, at = ranked[x], top, 0
        while True:
            child = node.children.get(own[at])
            if child is None:
                node.children[own[at]] = _Node(own[at:], len(own), x, x)
                return
            label, n = child.label, min(len(child.label), len(own) - at)
            differ = np.flatnonzero(label[:n] != own[at : at + n])
            same = int(differ[0]) if len(differ) else n
            if same < len(label):
                upper = _Node(label[:same], len(own), child.member, -1)
                upper.shortest, upper.longest = child.shortest, child.longest
                child.label = label[same:]
                upper.children[child.label[0]] = child
                node.children[own[at]] = child = upper
            child.shortest, child.longest = min(child.shortest, len(own)), max(child.longest, len(own))
            if child.member != _MIXED and find(child.member) != find(x):
                child.member = _MIXED
            node, at = child, at + same
            if at == len(own):
                node.ends = x
                return

    for x in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        link(x)
        insert(x)
    return [find(i) for i in range(len(sets))]
