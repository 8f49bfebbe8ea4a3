"""Ungapped alignment of matrices, merging, and guide trees.

The distances of all column pairs are computed once as a matrix; an alignment is one of its diagonals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from helixframe.functions.stats import COMBINE, gap_penalty
from helixframe.motif.pwm import Motif, reverse_complement

AlignFn = Callable[[np.ndarray, np.ndarray], tuple[float, bool, int]]


def _xlogx(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, p * np.log2(np.where(p > 0, p, 1.0)), 0.0)


def column_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence (bits) of every row of a from every row of b."""
    x, y = a[:, None, :], b[None, :, :]
    # Half of KL(x|m) + KL(y|m) with m the mean, for rows that need not add up to one.
    m = (x + y) / 2
    lm = np.log2(np.where(m > 0, m, 1.0))
    return 0.5 * (_xlogx(x) - x * lm + _xlogx(y) - y * lm).sum(2)


def _best_diagonal(d: np.ndarray, combine, penalty) -> tuple[float, int]:
    """Least distance when the columns of ``d`` start at row 0, 1, ...; of equal ones the first."""
    n1, n2 = d.shape
    best = (np.inf, -1)
    for i in range(n1):
        match = min(n1 - i, n2)
        v = combine(np.diagonal(d, -i)[:match]) + penalty(n1 + n2 - 2 * match, match)
        if v < best[0]:
            best = (v, i)
    return best


def aligner(penalty: str = "exp", gap: float = 0.05, combine: str = "l1", distance=column_distances) -> AlignFn:
    """An alignment function: ``(distance, same strand, offset of the second in the first)``.

    Forward wins ties with reverse; of a positive and a negative offset that tie, the negative wins.
    """
    pen, comb = gap_penalty(penalty, gap), COMBINE[combine]

    def one(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
        d = distance(a, b)
        (d1, i1), (d2, i2) = _best_diagonal(d, comb, pen), _best_diagonal(d.T, comb, pen)
        return (d1, i1) if d1 < d2 else (d2, -i2)

    def align(a: np.ndarray, b: np.ndarray) -> tuple[float, bool, int]:
        f, r = one(a, b), one(a, reverse_complement(b))
        return (f[0], True, f[1]) if f[0] <= r[0] else (r[0], False, r[1])

    return align


def merge_weighted(a: np.ndarray, wa: list[int], b: np.ndarray, wb: list[int], shift: int, *, weighted: bool = True) -> tuple[np.ndarray, list[int]]:
    """Union of two aligned matrices, ``b`` starting at row ``shift`` of ``a``; shared rows are averaged."""
    lo, hi = min(0, shift), max(len(a), shift + len(b))
    total, weight, plain = np.zeros((hi - lo, 4)), np.zeros(hi - lo), np.zeros(hi - lo)
    for m, w, at in ((a, wa, -lo), (b, wb, shift - lo)):
        u = np.asarray(w, dtype=float) if weighted else np.ones(len(m))
        total[at : at + len(m)] += m * u[:, None]
        plain[at : at + len(m)] += u
        weight[at : at + len(m)] += np.asarray(w)
    return total / plain[:, None], weight.astype(int).tolist()


def merge(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """Unweighted union of two aligned matrices."""
    return merge_weighted(a, [1] * len(a), b, [1] * len(b), shift, weighted=False)[0]


def dilute(m: np.ndarray, weights: list[int]) -> np.ndarray:
    """Rows of low weight drawn towards the uniform distribution."""
    w = np.asarray(weights, dtype=float)[:, None]
    return (w * m + 0.25 * (w.max() - w)) / w.max()


def iterative_merge(align: AlignFn, threshold: float, motifs: list[Motif]) -> list[tuple[list[str], np.ndarray, list[int]]]:
    """Merge the closest pair while its distance is below the threshold; the earlier slot keeps the result.

    Of equally close pairs the first (by slots) is merged.
    """
    slots = {i: ([m.name], m.mat, [1] * len(m.mat)) for i, m in enumerate(motifs)}
    pair = {(i, j): align(slots[i][1], slots[j][1]) for i in slots for j in slots if i < j}
    while pair:
        (i, j), (d, same, at) = min(pair.items(), key=lambda x: (x[1][0], x[0]))
        if not d < threshold:
            break
        (n1, m1, w1), (n2, m2, w2) = slots[i], slots.pop(j)
        if not same:
            m2, w2 = reverse_complement(m2), w2[::-1]
        slots[i] = (n1 + n2, *merge_weighted(m1, w1, m2, w2, at))
        pair = {k: v for k, v in pair.items() if j not in k}
        for o in slots:
            if o != i:
                pair[min(i, o), max(i, o)] = align(slots[min(i, o)][1], slots[max(i, o)][1])
    return [slots[i] for i in sorted(slots)]


# --- guide trees ---------------------------------------------------------------------------------
@dataclass
class Node:
    """A leaf (``motif``) or a join of two subtrees at a distance."""

    size: int
    height: float = 0.0
    left: Node | None = None
    right: Node | None = None
    motif: Motif | None = None

    def leaves(self) -> list[Motif]:
        return [self.motif] if self.motif else self.left.leaves() + self.right.leaves()


def build_tree(align: AlignFn, motifs: list[Motif]) -> Node:
    """Average-linkage clustering; of equal distances the earliest pair is joined."""
    if not motifs:
        raise ValueError("no motifs")
    nodes = {i: Node(1, motif=m) for i, m in enumerate(motifs)}
    d = {(i, j): align(motifs[i].mat, motifs[j].mat)[0] for i in nodes for j in nodes if i < j}
    while len(nodes) > 1:
        i, j = min(d, key=lambda k: (d[k], k))
        h = d.pop((i, j))
        a, b = nodes[i], nodes.pop(j)
        for o in nodes:
            if o != i:
                x, y = d.pop((min(i, o), max(i, o))), d.pop((min(j, o), max(j, o)))
                d[min(i, o), max(i, o)] = (a.size * x + b.size * y) / (a.size + b.size)
        nodes[i] = Node(a.size + b.size, h, a, b)
    return next(iter(nodes.values()))


def cut_tree(tree: Node, height: float) -> list[Node]:
    """Subtrees joined at or below the height."""
    return [tree] if tree.motif or tree.height <= height else cut_tree(tree.left, height) + cut_tree(tree.right, height)


def cut_tree_by(start: float, step: float, good: Callable[[list[Node]], bool], tree: Node) -> list[Node]:
    """Lower the cut from ``start`` until the clusters are good, or 0 is reached."""
    at = start
    while True:
        parts = cut_tree(tree, at)
        if good(parts) or at - step <= 0:
            return parts
        at -= step


def merge_tree(align: AlignFn, tree: Node, *, weighted: bool = True) -> tuple[np.ndarray, list[int]]:
    """One matrix (and weights) for a tree, merged from the leaves up."""
    if tree.motif:
        return tree.motif.mat, [1] * len(tree.motif.mat)
    (a, wa), (b, wb) = merge_tree(align, tree.left, weighted=weighted), merge_tree(align, tree.right, weighted=weighted)
    _, same, at = align(a, b)
    if not same:
        b, wb = reverse_complement(b), wb[::-1]
    return merge_weighted(a, wa, b, wb, at, weighted=weighted)
