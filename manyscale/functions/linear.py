"""Small dense linear algebra used inside tasks and on model-sized matrices."""

from __future__ import annotations

import numpy as np

RANK_TOLERANCE = 1e-7


def fix_signs(vectors: np.ndarray) -> np.ndarray:
    """Rows with their largest entry made positive, so that a basis does not depend on the solver."""
    if vectors.size == 0:
        return vectors
    lead = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]
    return vectors * np.where(lead < 0, -1.0, 1.0)[:, None]


def descending_eigen(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and the matching eigenvectors as rows with fixed signs."""
    values, vectors = np.linalg.eigh(sym)
    return values[::-1], fix_signs(vectors[:, ::-1].T)


def padded_basis(values: np.ndarray, vectors: np.ndarray, d: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``min(d, n - 1)`` directions that carry energy, filled up with zeros to ``d`` rows.

    ``values`` are descending singular values, ``vectors`` the directions as rows.
    """
    basis, kept = np.zeros((d, vectors.shape[1])), np.zeros(d)
    top = min(d, max(n - 1, 0), len(values))
    if top and values[0] > 0:
        top = int((values[:top] > RANK_TOLERANCE * values[0]).sum())
        basis[:top], kept[:top] = vectors[:top], values[:top]
    return basis, kept


def triangle(m: np.ndarray) -> np.ndarray:
    """At most as many rows as columns with the same ``m^T m``, by orthogonal factorisation, which keeps small values exact."""
    return np.linalg.qr(m, mode="r") if len(m) > m.shape[1] else m


def basis_from_triangle(m: np.ndarray, d: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The basis of ``n`` centered rows that were reduced to ``m``."""
    _, values, vectors = np.linalg.svd(m, full_matrices=False)
    return padded_basis(values, fix_signs(vectors), d, n)


def basis_from_rows(centered: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    return basis_from_triangle(triangle(centered), d, len(centered))


def subspace_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """``tr(A^T B) / (|A| |B|)`` of two bases given as rows; zero if either is empty."""
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float((a * b).sum() / size) if size else 0.0


def rotation_free_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """``|A B^T|^2 / d``: the same for any sign or rotation within either subspace."""
    return float(((a @ b.T) ** 2).sum() / max(1, len(a)))
