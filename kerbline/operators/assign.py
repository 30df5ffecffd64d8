"""Maximum-weight one-to-one matching of small weighted bipartite graphs.

A helper for the grouped-map steps: one call sees one connected component, or the frames of a block.
"""

from __future__ import annotations

import numpy as np


def best_pairs(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a matching with the largest total weight.

    Zero means "no edge"; such pairs are left out. Rows are inserted one after another along
    a cheapest alternating path (potentials keep reduced costs non-negative).
    """
    flipped = weights.shape[0] > weights.shape[1]
    w = weights.T if flipped else weights
    n, m = w.shape
    cost = w.max(initial=0.0) - w
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        slack = cost[start] - row_price[start] - col_price
        came_from = np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        while True:
            j = int(np.argmin(np.where(done, np.inf, slack)))
            reach = slack[j]
            done[j] = True
            if owner[j] < 0:
                break
            i = owner[j]
            through = reach + cost[i] - row_price[i] - col_price
            better = ~done & (through < slack)
            slack[better] = through[better]
            came_from[better] = j
        gain = reach - slack
        for k in np.flatnonzero(done):
            if k != j:
                row_price[owner[k]] += gain[k]
                col_price[k] -= gain[k]
        row_price[start] += reach
        while came_from[j] >= 0:
            owner[j] = owner[came_from[j]]
            j = came_from[j]
        owner[j] = start
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0 and w[owner[j], j] > 0]
    return sorted((c, r) if flipped else (r, c) for r, c in pairs)


def best_columns(weights: np.ndarray) -> np.ndarray:
    """The column that :func:`best_pairs` gives each row of each matrix, -1 for none: ``(many, rows, columns)`` to ``(many, rows)``.

    All matrices take their steps together, so the cost of a step is shared; one that has its path waits for the others.
    """
    many, rows, columns = weights.shape
    flipped = rows > columns
    w = weights.transpose(0, 2, 1) if flipped else weights
    n, m = w.shape[1:]
    cost = w.max(axis=(1, 2), initial=0.0)[:, None, None] - w
    row_price, col_price = np.zeros((many, n)), np.zeros((many, m))
    owner = np.full((many, m), -1)
    for start in range(n):
        slack = cost[:, start] - row_price[:, start, None] - col_price
        came_from = np.full((many, m), -1)
        done = np.zeros((many, m), dtype=bool)
        last, reached = np.zeros(many, dtype=np.int64), np.zeros(many)
        live = np.arange(many)
        while True:
            j = np.argmin(np.where(done[live], np.inf, slack[live]), axis=1)
            reach = slack[live, j]
            done[live, j] = True
            last[live], reached[live] = j, reach
            i = owner[live, j]
            on = i >= 0
            if not on.any():
                break
            live, i, j, reach = live[on], i[on], j[on], reach[on]
            through = reach[:, None] + cost[live, i] - row_price[live, i][:, None] - col_price[live]
            better = ~done[live] & (through < slack[live])
            slack[live] = np.where(better, through, slack[live])
            came_from[live] = np.where(better, j[:, None], came_from[live])
        gain = reached[:, None] - slack
        b, k = np.nonzero(done & (np.arange(m) != last[:, None]))
        row_price[b, owner[b, k]] += gain[b, k]
        col_price[b, k] -= gain[b, k]
        row_price[:, start] += reached
        live, j = np.arange(many), last
        while len(live):
            before = came_from[live, j]
            on = before >= 0
            owner[live[~on], j[~on]] = start
            live, j, before = live[on], j[on], before[on]
            owner[live, j] = owner[live, before]
            j = before
    b, j = np.nonzero(owner >= 0)
    i = owner[b, j]
    own = w[b, i, j] > 0
    b, i, j = b[own], i[own], j[own]
    chosen = np.full((many, rows), -1)
    if flipped:
        chosen[b, j] = i
    else:
        chosen[b, i] = j
    return chosen


def components(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Component label of each edge; ``left`` and ``right`` are integer codes of its ends."""
    label_l = np.arange(left.max(initial=-1) + 1)
    label_r = np.full(right.max(initial=-1) + 1, len(label_l))
    while True:
        np.minimum.at(label_r, right, label_l[left])
        before = label_l.copy()
        # Labels are left nodes: a lower one goes to the node that gave the label as well, and labels of labels are followed.
        np.minimum.at(label_l, label_l[left], label_r[right])
        np.minimum.at(label_l, left, label_r[right])
        label_l = label_l[label_l]
        if (before == label_l).all():
            return label_l[left]


def _number_in(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each element within its group, in the order of the elements, and the sizes of the groups ``0, 1, ...``."""
    sizes = np.bincount(groups)
    order = np.argsort(groups, kind="stable")
    number = np.empty(len(groups), dtype=np.int64)
    number[order] = np.arange(len(groups)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return number, sizes


def solve_edges(left_ids: np.ndarray, right_ids: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mask of the edges chosen by the best matching of an edge list. Components of one shape are solved together."""
    chosen = np.zeros(len(weight), dtype=bool)
    if not len(weight):
        return chosen
    _, first_left, left = np.unique(left_ids, return_index=True, return_inverse=True)
    _, first_right, right = np.unique(right_ids, return_index=True, return_inverse=True)
    _, part = np.unique(components(left, right), return_inverse=True)
    row, rows = _number_in(part[first_left])
    column, columns = _number_in(part[first_right])
    r, c = row[left], column[right]
    _, shape = np.unique(rows * (columns.max() + 1) + columns, return_inverse=True)
    place, counts = _number_in(shape)
    order = np.argsort(shape[part], kind="stable")
    for edges in np.split(order, np.flatnonzero(np.diff(shape[part][order])) + 1):
        which, many = part[edges], int(counts[shape[part[edges[0]]]])
        size = (many, int(rows[which[0]]), int(columns[which[0]]))
        at = (place[which], r[edges], c[edges])
        # Of repeated edges the last one counts.
        matrix, edge = np.zeros(size), np.full(size, -1)
        matrix[at], edge[at] = weight[edges], edges
        if many == 1:
            for i, j in best_pairs(matrix[0]):
                chosen[edge[0, i, j]] = True
            continue
        best = best_columns(matrix)
        b, i = np.nonzero(best >= 0)
        chosen[edge[b, i, best[b, i]]] = True
    return chosen
