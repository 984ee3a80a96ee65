"""Minimum-cost bipartite assignment (shortest augmenting paths with potentials)."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a minimum-cost matching that covers the shorter side.

    An empty matrix gives no pairs. Infinite costs are allowed; such pairs are left out.
    """
    cost = np.asarray(cost, dtype=float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    finite = cost[np.isfinite(cost)]
    big = (np.abs(finite).sum() if finite.size else 0.0) + 1.0
    work = np.where(np.isfinite(cost), cost, big)
    row_pot, col_pot = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        reach = work[start] - row_pot[start] - col_pot
        via = np.full(m, -1)  # the column a column was reached from
        done = np.zeros(m, bool)
        while True:
            open_ = np.where(done, np.inf, reach)
            j = int(open_.argmin())
            d = open_[j]
            done[j] = True
            if owner[j] < 0:
                break
            i = owner[j]
            through = d + work[i] - row_pot[i] - col_pot
            better = ~done & (through < reach)
            reach[better], via[better] = through[better], j
        for k in np.flatnonzero(done):
            if k != j:
                row_pot[owner[k]] += d - reach[k]
                col_pot[k] -= d - reach[k]
        row_pot[start] += d
        while True:
            p = via[j]
            owner[j] = start if p < 0 else owner[p]
            if p < 0:
                break
            j = p
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0 and np.isfinite(cost[owner[j], j]))
