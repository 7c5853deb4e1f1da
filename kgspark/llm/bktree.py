"""Forests of BK-trees over binary fingerprints, built and searched level by level in numpy.

Each group of fingerprints has a tree whose root is its first member; a child hangs
from its parent by the edge of their Hamming distance.  A search within a radius
follows an edge only if it differs from the query's distance to the node by at most
the radius, which loses nothing by the triangle inequality.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Pairs of query and node that are held at once.
PAIRS = 1_000_000
#: Items of a tree that is covered by balls first, and number of balls.
LARGE, BALLS = 256, 32


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


@dataclass
class Forest:
    fps: np.ndarray  # n rows of 64-bit words
    root: np.ndarray  # for each item the root of its tree
    code: np.ndarray  # parent * width + edge, ascending
    child: np.ndarray
    width: int


def build(fps: np.ndarray, group: np.ndarray) -> Forest:
    """group: ascending numbers; items of one number are in one tree."""
    n, width = len(fps), fps.shape[1] * 64 + 1
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    root = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    codes, children = [], []
    item, at = np.flatnonzero(~new), root[~new]
    while len(item):
        code = at * width + distance(fps[item], fps[at])
        order = np.argsort(code, kind="stable")
        item, code = item[order], code[order]
        lead = np.ones(len(item), bool)
        lead[1:] = code[1:] != code[:-1]
        codes.append(code[lead])
        children.append(item[lead])
        at = item[lead][np.cumsum(lead) - 1][~lead]
        item = item[~lead]
    code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    child = np.concatenate(children) if children else np.zeros(0, np.int64)
    order = np.argsort(code, kind="stable")
    return Forest(fps, root, code[order], child[order], width)


def search(f: Forest, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (index of the query, item, distance) within the radius; roots: the tree in which each query is looked up."""
    q, node = np.arange(len(queries)), roots
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(q):
        d = distance(queries[q], f.fps[node])
        hit = d <= radius
        found.append((q[hit], node[hit], d[hit]))
        base = node * f.width
        lo = np.searchsorted(f.code, base + np.maximum(d - radius, 0))
        hi = np.searchsorted(f.code, base + np.minimum(d + radius, f.width - 1), side="right")
        size = hi - lo
        q = np.repeat(q, size)
        step = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)
        node = f.child[np.repeat(lo, size) + step]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))


def components(f: Forest, radius: int) -> np.ndarray:
    """For each item the least item that it is linked to through items of its tree, each step within the radius.

    A large tree is first covered by balls around a few of its members, which links whole families in time linear in their size; then only
    the items outside its largest component are looked up, since of a link between components one end is outside."""
    n = len(f.fps)
    label = np.arange(n)
    sizes = np.bincount(f.root, minlength=n)[f.root]
    asked = sizes > 1
    for root in np.flatnonzero((sizes > LARGE) & (f.root == np.arange(n))):
        part = slice(int(root), int(root + sizes[root]))
        open_ = np.ones(sizes[root], bool)
        for _ in range(BALLS):
            if not open_.any():
                break
            near = distance(f.fps[part], f.fps[root + int(open_.argmax())]) <= radius
            met = np.unique(label[part][near])
            label[part] = np.where(np.isin(label[part], met), met[0], label[part])
            open_ &= ~near
        names, count = np.unique(label[part], return_counts=True)
        asked[part] = label[part] != names[count.argmax()]
    asked = np.flatnonzero(asked)
    work = np.cumsum(sizes[asked])
    for block in np.split(asked, np.searchsorted(work, np.arange(PAIRS, work[-1] if len(work) else 0, PAIRS))):
        if not len(block):
            continue
        q, item, _ = search(f, f.fps[block], f.root[block], radius)
        a, b = label[block[q]], label[item]
        while (differ := a != b).any():
            a, b = a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (up := label[label]).tobytes() != label.tobytes():
                label = up
            a, b = label[a], label[b]
    return label
