"""Eigenvectors of a symmetric matrix by spectral divide and conquer.

The matrix minus a shift has a polar decomposition whose unitary factor U is the sign of
the shifted matrix, so (U + I) / 2 projects onto the invariant subspace of the eigenvalues
above the shift. The dynamically weighted Halley iteration gives U from QR factorisations
alone. Bases of the subspace and of its complement split the matrix into two smaller ones,
which are split in turn until single components are left.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps


def polar_unitary(a: np.ndarray, max_iter: int = 60) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix by QR-based weighted Halley steps."""
    n = len(a)
    x = a / np.linalg.norm(a)      # the Frobenius norm bounds the largest singular value
    low = EPS / np.sqrt(n)         # a bound of the smallest one; eigenvalues below it don't matter
    for _ in range(max_iter):
        if low < 1 - 10 * EPS:
            sq = low * low
            d = np.cbrt(4 * (1 - sq) / (sq * sq))
            wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - sq) / (sq * np.sqrt(1 + d)))
            wb = (wa - 1) ** 2 / 4
            wc = wa + wb - 1
        else:
            wa, wb, wc = 3.0, 1.0, 3.0
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        moved = np.linalg.norm(new - x)
        x = new
        if moved < np.cbrt(EPS) and low >= 1 - 10 * EPS:
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None where no
    shift separates the eigenvalues, as they are equal to double precision."""
    n = len(a)
    diagonal = np.sort(np.diag(a))
    middle = float(np.mean(diagonal))   # between the smallest and the largest eigenvalue, always
    best = None
    for shift in (float(np.median(diagonal)), middle, middle * 0.75 + diagonal[0] * 0.25, middle * 0.75 + diagonal[-1] * 0.25):
        shifted = a - shift * np.eye(n)
        if np.linalg.norm(shifted) <= 4 * EPS * scale * np.sqrt(n):
            return None
        sign = polar_unitary(shifted)
        projector = (sign + np.eye(n)) / 2
        rank = int(round(float(np.trace(projector))))
        if not 0 < rank < n:
            continue
        start = np.random.default_rng(n).standard_normal((n, rank))
        basis, _ = np.linalg.qr(projector @ start, mode="complete")
        for _ in range(2):   # subspace iteration with the projector
            basis, _ = np.linalg.qr(projector @ basis[:, :rank], mode="complete")
        upper, lower = basis[:, :rank], basis[:, rank:]
        coupling = np.linalg.norm(lower.T @ a @ upper)
        if best is None or coupling < best[0]:
            best = coupling, upper, lower
        if coupling <= 100 * EPS * scale:
            break
    return best and best[1:]


def symmetric_components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest to the smallest and unit eigenvectors as columns."""
    a = np.asarray(a, np.float64)
    a = (a + a.T) / 2
    n = len(a)
    scale = float(np.linalg.norm(a))
    values, vectors = [], []
    todo = [np.eye(n)]
    while todo:
        basis = todo.pop()
        block = basis.T @ a @ basis
        block = (block + block.T) / 2
        parts = _split(block, scale) if len(block) > 1 and scale > 0 else None
        if parts is None:
            values += np.diag(block).tolist()
            vectors.append(basis)
        else:
            todo += [basis @ part for part in parts]
    if not vectors:
        return np.zeros(0), np.zeros((0, 0))
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.concatenate(vectors, axis=1)[:, order]
