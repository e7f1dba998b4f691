"""NumPy helpers for matrices the size of the column count (never of the rows)."""

from __future__ import annotations

import numpy as np

MAX_FEATURES = 4096


def check_width(d: int) -> None:
    if d > MAX_FEATURES:
        raise ValueError(f"{d} features exceed the limit of {MAX_FEATURES} for d x d work")


def symmetric(edges, d: int) -> np.ndarray:
    """Dense symmetric matrix from a pandas edge table with i < j."""
    matrix = np.zeros((d, d))
    i, j = edges["i"].to_numpy(dtype=int), edges["j"].to_numpy(dtype=int)
    matrix[i, j] = matrix[j, i] = edges["weight"].to_numpy(dtype=float)
    return matrix


def component_count(linked: np.ndarray) -> int:
    """Connected components of a dense boolean adjacency."""
    unseen = np.ones(len(linked), dtype=bool)
    count = 0
    while unseen.any():
        count += 1
        frontier = np.zeros(len(linked), dtype=bool)
        frontier[np.argmax(unseen)] = True
        while frontier.any():
            unseen &= ~frontier
            frontier = linked[frontier].any(axis=0) & unseen
    return count


def component_labels(linked: np.ndarray) -> np.ndarray:
    """Number of the connected component of every node of a dense boolean adjacency."""
    label = np.full(len(linked), -1)
    for number in range(len(linked)):
        if (label >= 0).all():
            break
        frontier = np.zeros(len(linked), dtype=bool)
        frontier[np.argmax(label < 0)] = True
        while frontier.any():
            label[frontier] = number
            frontier = linked[frontier].any(axis=0) & (label < 0)
    return label


def laplacian_matrix(weights: np.ndarray, normalized: bool = False) -> np.ndarray:
    degree = weights.sum(axis=1)
    lap = np.diag(degree) - weights
    if normalized:
        scale = np.divide(1.0, np.sqrt(degree), out=np.zeros_like(degree), where=degree > 0)
        lap = scale[:, None] * lap * scale[None, :]
    return lap


def sorted_eigen(matrix: np.ndarray, count: int | None = None):
    """Ascending eigenpairs; each vector's largest-magnitude entry is positive."""
    values, vectors = np.linalg.eigh(matrix)
    lead = np.argmax(np.abs(vectors).round(12), axis=0)
    signs = np.sign(vectors[lead, np.arange(vectors.shape[1])])
    vectors = vectors * np.where(signs == 0, 1.0, signs)
    if count is not None:
        values, vectors = values[:count], vectors[:, :count]
    return values, vectors


def best_matching(gain: np.ndarray) -> np.ndarray:
    """Column given to each row of a square gain matrix, maximising the total.

    Shortest augmenting paths with dual prices, O(k^3).
    """
    cost = -np.asarray(gain, dtype=np.float64)
    k = cost.shape[0]
    price_row, price_col = np.zeros(k), np.zeros(k)
    row_of = np.full(k, -1)
    for start in range(k):
        best = np.full(k, np.inf)
        previous = np.full(k, -1)
        done = np.zeros(k, dtype=bool)
        row, column = start, -1
        reach = 0.0
        while True:
            slack = reach + cost[row] - price_row[row] - price_col
            better = ~done & (slack < best)
            best[better] = slack[better]
            previous[better] = column
            column = int(np.argmin(np.where(done, np.inf, best)))
            reach = best[column]
            done[column] = True
            if row_of[column] < 0:
                break
            row = row_of[column]
        closed = np.flatnonzero(done)
        price_row[start] += reach
        for c in closed:
            if row_of[c] >= 0:
                price_row[row_of[c]] += reach - best[c]
            price_col[c] -= reach - best[c]
        while column >= 0:
            before = previous[column]
            row_of[column] = start if before < 0 else row_of[before]
            column = before
    result = np.empty(k, dtype=int)
    result[row_of] = np.arange(k)
    return result


def average_ranks(values: np.ndarray) -> np.ndarray:
    """1-based ranks, ties sharing their mean rank."""
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    last = np.cumsum(counts)
    return (last - (counts - 1) / 2.0)[inverse]


def spearman(a: np.ndarray, b: np.ndarray) -> float:
    """Rank correlation; 0 when either side is constant."""
    if len(a) < 2:
        return 0.0
    ra, rb = average_ranks(a), average_ranks(b)
    if ra.std() == 0 or rb.std() == 0:
        return 0.0
    return float(np.corrcoef(ra, rb)[0, 1])


# Penalty of the off-diagonal entries of a precision matrix.
LASSO_PENALTY = 0.01


def sparse_precision(
    cov: np.ndarray, penalty: float = LASSO_PENALTY, rounds: int = 2000, tolerance: float = 1e-7
) -> np.ndarray:
    """L1-penalised precision of a covariance matrix (graphical lasso).

    Alternating direction method of multipliers (Boyd et al., 2011): the smooth
    half has a closed form in the eigenbasis, the penalty half is
    soft-thresholding of the off-diagonal entries.
    """
    d = cov.shape[0]
    off_diagonal = ~np.eye(d, dtype=bool)
    sparse, dual, rho = np.eye(d), np.zeros((d, d)), 1.0
    for _ in range(rounds):
        values, vectors = np.linalg.eigh(rho * (sparse - dual) - cov)
        smooth_values = (values + np.sqrt(values**2 + 4.0 * rho)) / (2.0 * rho)
        smooth = (vectors * smooth_values) @ vectors.T
        before, shifted = sparse, smooth + dual
        shrunk = np.sign(shifted) * np.maximum(np.abs(shifted) - penalty / rho, 0.0)
        sparse = np.where(off_diagonal, shrunk, shifted)
        dual = shifted - sparse
        primal_gap = np.linalg.norm(smooth - sparse)
        dual_gap = rho * np.linalg.norm(sparse - before)
        if max(primal_gap, dual_gap) < tolerance * d:
            break
        if primal_gap > 10.0 * dual_gap:
            rho, dual = rho * 2.0, dual / 2.0
        elif dual_gap > 10.0 * primal_gap:
            rho, dual = rho / 2.0, dual * 2.0
    return sparse
