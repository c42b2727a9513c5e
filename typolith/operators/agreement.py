"""Matching of two labellings. Tables here have a row for each pair of labels, so they are small and may come to the driver."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def matching(counts: np.ndarray) -> list[int]:
    """For each row the column of its own that together hold most; -1 for rows beyond the number of columns.

    Exact, by dynamic programming over sets of columns: rows x 2 ** columns steps, so for at most about 16 columns. Of equal
    matchings the one with the smallest column for the first row, then the second, and so on; rows without a column come last.
    """
    rows, columns = counts.shape
    spare = max(0, rows - columns)

    @lru_cache(maxsize=None)
    def best(row: int, free: int, skips: int) -> tuple[float, tuple[int, ...]]:
        if row == rows:
            return 0.0, ()
        found: tuple[float, tuple[int, ...]] | None = None
        for c in [c for c in range(columns) if free >> c & 1] + ([-1] if skips else []):
            value, rest = best(row + 1, free & ~(1 << c) if c >= 0 else free, skips - (c < 0))
            value += float(counts[row, c]) if c >= 0 else 0.0
            if found is None or value > found[0]:
                found = value, (c, *rest)
        return found if found is not None else (float("-inf"), (-1,) * (rows - row))

    return list(best(0, (1 << columns) - 1, spare)[1])


def stationary(p: np.ndarray) -> np.ndarray:
    """The stationary distribution of a transition matrix: the left eigenvector whose eigenvalue is nearest to one."""
    values, vectors = np.linalg.eig(p.T)
    pi = np.real(vectors[:, int(np.argmin(np.abs(values - 1.0)))])
    return pi / pi.sum()


def least_squares(cross: np.ndarray, xy: np.ndarray, yy: float, y: float, n: int) -> tuple[np.ndarray, float]:
    """(coefficients, r2) from sums: cross = X'X, xy = X'y, yy = y'y, y = sum of y."""
    beta = np.linalg.solve(cross, xy)
    return beta, 1.0 - (yy - beta @ xy) / (yy - y * y / n)
