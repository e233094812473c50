"""Leading eigenpairs of a symmetric matrix by FEAST: contour integrals, Rayleigh-Ritz and inertia counts.

The matrix is a covariance, so its side is the number of dimensions and never grows with the rows of a table.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(np.float64).eps)
NODES = 16  # quadrature points on the upper half of each circle; the lower half is their mirror image
APART = 1e-6  # eigenvalues closer than this part of the spectrum's width share an interval


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    The largest entry of a vector is positive. Inertia counts place the contours, and every contour must yield as
    many eigenvectors as the inertia at its ends says; otherwise this is an error. Where the k-th and the next
    eigenvalue agree, the last vector is one of many equally good ones.
    """
    side = len(matrix)
    k = min(k, side)
    scale = float(np.abs(matrix).max()) if side else 0.0
    if scale == 0:
        return np.zeros(k), np.eye(side)[:, :k]
    matrix = (matrix + matrix.T) / (2 * scale)
    diagonal, beside = tridiagonal(matrix)
    low, high = _brackets(diagonal, beside)
    values, vectors = [], []
    top = 0
    while top < k:
        end = top + 1
        while end < side and low[end - 1] - high[end] <= APART * (high[0] - low[-1]):
            end += 1
        gaps = [low[end - 1] - high[end]] if end < side else []
        gaps += [low[top - 1] - high[top]] if top else []
        pad = min(gaps) / 2 if gaps else max(high[top] - low[end - 1], 1e-3 * abs(high[top]), 64 * _EPS)
        ends = np.array([low[end - 1] - pad, high[top] + pad])
        inside = int(np.diff(below(diagonal, beside, ends))[0])
        found = _interval(matrix, *ends, inside)
        if inside != end - top:
            raise ArithmeticError("the inertia at the ends of a contour contradicts the brackets")
        values.append(found[0])
        vectors.append(found[1])
        top = end
    values, vectors = np.concatenate(values)[:k], np.concatenate(vectors, axis=1)[:, :k]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(k)]
    return values * scale, vectors * np.where(largest < 0, -1.0, 1.0)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and subdiagonal after Householder reflections, which keep the inertia of every shifted matrix."""
    a = matrix.copy()
    side = len(a)
    for k in range(side - 2):
        column = a[k + 1 :, k]
        length = np.linalg.norm(column)
        if np.linalg.norm(column[1:]) == 0:
            continue
        v = column.copy()
        v[0] += np.copysign(length, v[0])
        head = -np.copysign(length, column[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * np.outer(v, w) + 2 * np.outer(w, v)
        a[k + 1, k] = head
    return np.diag(a).copy(), np.diag(a, -1).copy()


def below(diagonal: np.ndarray, beside: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each shift: the negative pivots of the shifted matrix."""
    tiny = np.finfo(np.float64).tiny / _EPS
    pivot = diagonal[0] - shifts
    count = (pivot < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - shifts - beside[i - 1] ** 2 / pivot
        count += pivot < 0
    return count


def _brackets(diagonal: np.ndarray, beside: np.ndarray, rounds: int = 26) -> tuple[np.ndarray, np.ndarray]:
    """A narrow interval around every eigenvalue, falling, by bisection with inertia counts."""
    side = len(diagonal)
    radius = np.abs(np.append(beside, 0)) + np.abs(np.append(0, beside))
    reach = float((np.abs(diagonal) + radius).max()) * (1 + 8 * _EPS)
    low, high = np.full(side, -reach), np.full(side, reach)
    above = np.arange(side)  # eigenvalues larger than the one looked for
    for _ in range(rounds):
        middle = (low + high) / 2
        larger = side - below(diagonal, beside, middle)
        is_above = larger > above
        low, high = np.where(is_above, middle, low), np.where(is_above, high, middle)
    return low, high


def _interval(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``count`` eigenpairs between ``low`` and ``high``, the largest first."""
    side = len(matrix)
    centre, radius = (low + high) / 2, (high - low) / 2
    turns = radius * np.exp(1j * np.pi * (np.arange(NODES) + 0.5) / NODES)
    space = np.random.default_rng(20_24).standard_normal((side, min(side, 2 * count + 2)))
    norm, identity = np.abs(matrix).sum(axis=1).max(), np.eye(side)
    best = (np.inf, None, None)
    for _ in range(30):
        projected = np.zeros_like(space)
        for turn in turns:
            projected += (turn * np.linalg.solve((centre + turn) * identity - matrix, space)).real / NODES
        basis, size, _ = np.linalg.svd(projected, full_matrices=False)
        basis = basis[:, size > side * _EPS * size[0]]
        ritz, mixing = np.linalg.eigh(basis.T @ matrix @ basis)
        space = basis @ mixing
        chosen = np.flatnonzero((ritz > low) & (ritz < high))[::-1]
        if len(chosen) == count:
            values, vectors = ritz[chosen], space[:, chosen]
            error = np.abs(matrix @ vectors - vectors * values).max(initial=0.0)
            if error >= best[0] / 2 and best[0] < 1e-9 * norm:
                break
            if error < best[0]:
                best = (error, values, vectors / np.linalg.norm(vectors, axis=0))
            if error <= 2 * _EPS * norm:
                break
    if best[1] is None or best[0] > 1e-9 * norm:
        raise ArithmeticError("a contour did not yield the eigenvectors that the inertia counts")
    return best[1], best[2]
