"""Leading eigenpairs of a symmetric matrix that is known by its products only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def leading_pairs(
    multiply: Callable[[np.ndarray], np.ndarray],
    size: int,
    dims: int,
    block: int = 32,
    tolerance: float = 1e-10,
    most_rounds: int = 400,
) -> tuple[np.ndarray, np.ndarray]:
    """The `dims` largest eigenvalues (fewer if the matrix is smaller) and their vectors.

    Block Lanczos with full orthogonalisation: memory is `size` times a basis of 3 dims + 4 blocks
    columns. A fuller basis is reduced to its best dims + block directions and grows again. It ends
    when no wanted pair's residual passes `tolerance` of the largest eigenvalue, and raises when
    that takes more than `most_rounds` products.
    """
    rng = np.random.default_rng(7)
    block, widest = min(block, size), 3 * dims + 4 * block
    basis, small = np.zeros((size, 0)), np.zeros((0, 0))
    new = fresh(rng.normal(size=(size, block)), basis, rng)
    for _ in range(most_rounds):
        if basis.shape[1] + new.shape[1] > widest:
            values, vectors = np.linalg.eigh(small)
            best = np.argsort(values)[::-1][: dims + block]
            basis, small = basis @ vectors[:, best], np.diag(values[best])
        product = multiply(new)
        old, basis = basis.shape[1], np.hstack([basis, new])
        inside = basis.T @ product
        outside = product - basis @ inside
        again = basis.T @ outside
        outside -= basis @ again
        grown = np.zeros((basis.shape[1],) * 2)
        grown[:old, :old] = small
        grown[:, old:] = inside + again
        grown[old:, :old] = grown[:old, old:].T
        small = (grown + grown.T) / 2
        values, vectors = np.linalg.eigh(small)
        order = np.argsort(values)[::-1][:dims]
        wanted = vectors[:, order]
        errors = np.linalg.norm(outside @ wanted[old:], axis=0)
        if basis.shape[1] >= size or len(order) == dims and errors.max() <= tolerance * max(np.abs(values).max(), 1e-300):
            return values[order], basis @ wanted
        new = fresh(outside, basis, rng)[:, : size - basis.shape[1]]
    raise RuntimeError(f"eigenpairs have not settled in {most_rounds} products")


def fresh(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns outside the basis; spent ones are replaced by random directions."""
    scale = np.linalg.norm(block, axis=0).max(initial=0.0)
    q, r = np.linalg.qr(block)
    spent = np.abs(np.diag(r)) <= 1e-12 * max(scale, 1e-300)
    q[:, spent] = rng.normal(size=(len(q), int(spent.sum())))
    for _ in range(2):
        q -= basis @ (basis.T @ q)
        q, _ = np.linalg.qr(q)
    return q
