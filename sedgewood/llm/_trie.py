"""Self-join of 64-bit fingerprints within a Hamming distance by traversing pairs of nodes of a binary trie.

The sorted fingerprints are the trie: a node is a range of them.  A pair of nodes starts as the root with itself and
descends bit by bit, both nodes at once; bits in which they differ add up, and a pair is dropped when they exceed the
budget.  All pairs of one depth are handled by a few numpy passes.  A pair all of whose leaves are known to be
connected is dropped too, so a dense cluster costs about its size, not its square: links at distance one are found
first, then those further away between what is not yet connected.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
MOST_PAIRS = 1 << 20  # node pairs in hand at once; more wait on a stack


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Labels:
    """Connected components of n items as arrays: each item's smallest known equal."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.of[self.of]
                if (up == self.of).all():
                    break
                self.of = up


def join(values: np.ndarray, group: np.ndarray, bits: int, budget: int, side: np.ndarray | None = None) -> np.ndarray:
    """Component label of each value: values of one group are linked if they differ in ``budget`` bits or fewer.

    ``values`` ascend within ``group``, which ascends; only the low ``bits`` bits count.  Where ``side`` is given, groups
    with both sides 0 and 1 (0 first) are joined across sides only.
    """
    n = len(values)
    labels = Labels(n)
    if n < 2:
        return labels.of
    ones = [None] * bits
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    stop = np.append(edge[1:], n)
    if side is None:
        start = np.stack([edge, stop, edge, stop], 1)
    else:
        total = np.concatenate([[0], np.cumsum(side == 0)])
        middle = edge + total[stop] - total[edge]
        alone = (middle == edge) | (middle == stop)
        start = np.stack([edge, np.where(alone, stop, middle), np.where(alone, edge, middle), stop], 1)
    start = start[(start[:, 1] - start[:, 0] > 1) | (start[:, 0] != start[:, 2])]
    for most in range(1, budget + 1):
        _traverse(values, start, bits, most, labels, ones)
    return labels.of


def _traverse(values, start, bits, budget, labels, ones) -> None:
    stack = [(start, np.zeros(len(start), np.int64), 0)]
    while stack:
        pair, err, depth = stack.pop()
        # pairs of nodes that are connected throughout need not be looked at
        turn = np.concatenate([[0], np.cumsum(labels.of[1:] != labels.of[:-1])])
        a0, a1, b0, b1 = pair.T
        done = (turn[a0] == turn[a1 - 1]) & (turn[b0] == turn[b1 - 1]) & (labels.of[a0] == labels.of[b0])
        pair, err = pair[~done], err[~done]
        if not len(pair):
            continue
        a0, a1, b0, b1 = pair.T
        single = ((a1 - a0) == 1) & ((b1 - b0) == 1)
        if single.any():
            a, b = a0[single], b0[single]
            mask = _U((1 << bits) - 1)
            near = popcount((values[a] ^ values[b]) & mask) <= budget
            labels.link(a[near], b[near])
            pair, err = pair[~single], err[~single]
        if not len(pair):
            continue
        if depth == bits:
            labels.link(pair[:, 0], pair[:, 2])  # equal values
            continue
        if ones[depth] is None:
            bit = (values >> _U(bits - 1 - depth)) & _U(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        c = ones[depth]
        a0, a1, b0, b1 = pair.T
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        self_ = (a0 == b0) & (a1 == b1)
        children = [
            (np.stack([a0, am, b0, bm], 1), err),
            (np.stack([am, a1, bm, b1], 1), err),
            (np.stack([a0, am, bm, b1], 1), err + 1),
            (np.stack([am, a1, b0, bm], 1)[~self_], err[~self_] + 1),
        ]
        pair, err = np.concatenate([x for x, _ in children]), np.concatenate([x for _, x in children])
        alive = (err <= budget) & (pair[:, 1] > pair[:, 0]) & (pair[:, 3] > pair[:, 2])
        alive &= ~((pair[:, 0] == pair[:, 2]) & (pair[:, 1] - pair[:, 0] == 1))
        pair, err = pair[alive], err[alive]
        for i in range(0, len(pair), MOST_PAIRS):
            stack.append((pair[i : i + MOST_PAIRS], err[i : i + MOST_PAIRS], depth + 1))
