"""Spectral embeddings of sparse symmetric matrices, and cosines to an anchor."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from longspan.functions import columns as C
from longspan.sources.stages import stage

VECTOR_SCHEMA = "period int, i int, vec array<double>"


def leading_vectors(matrix: np.ndarray, dims: int) -> np.ndarray:
    """Rows scaled by the roots of the largest positive eigenvalues.

    For a symmetric matrix the components whose left and right singular vectors agree in sign are
    those with a positive eigenvalue. Each component's largest entry is made positive.
    """
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1]
    floor = 1e-10 * max(1.0, float(np.abs(values).max(initial=0.0)))
    order = order[values[order] > floor][:dims]
    vectors = vectors[:, order] * np.sqrt(values[order])
    if vectors.shape[1]:
        peak = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.where(vectors[peak, range(vectors.shape[1])] < 0, -1.0, 1.0)
    return vectors


def embed_small(matrix: DataFrame, dims: int = 100, value: str = "pmi") -> DataFrame:
    """One dense solve per period, for small vocabularies: what the tests hold `embed` against."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, place = np.unique(pdf["i"].to_numpy(), return_inverse=True)
        dense = np.zeros((len(codes), len(codes)))
        dense[place, np.searchsorted(codes, pdf["j"].to_numpy())] = pdf[value].to_numpy()
        return pd.DataFrame(
            {
                "period": pdf["period"].iloc[0],
                "i": codes,
                "vec": list(leading_vectors(dense, dims)),
            }
        )

    cells = matrix.select("period", "i", "j", value)
    return cells.groupBy("period").applyInPandas(solve, VECTOR_SCHEMA)


def _products(rows: DataFrame, shadow: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """[basis w]'w per period, with `shadow` of the basis first taken out of w.

    Dense blocks are summed per batch of rows, then per cell; only these small matrices leave
    Spark.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for period, part in pdf.groupby("period"):
                basis, block = _blocks(part)
                if int(period) in shadow:
                    block = block - basis @ shadow[int(period)]
                cells = np.hstack([basis, block]).T @ block
                yield pd.DataFrame(
                    {
                        "period": period,
                        "cell": np.arange(cells.size),
                        "width": cells.shape[1],
                        "x": cells.ravel(),
                    }
                )

    cells = (
        rows.select("period", "basis", "w")
        .mapInPandas(partial, "period int, cell int, width int, x double")
        .groupBy("period", "cell", "width")
        .agg(F.sum("x").alias("x"))
        .toPandas()
    )
    return {
        int(period): part.sort_values("cell")["x"].to_numpy().reshape(-1, part["width"].iloc[0])
        for period, part in cells.groupby("period")
    }


def _blocks(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    basis = np.stack(part["basis"].to_numpy()).astype(float)
    return basis, np.stack(part["w"].to_numpy()).astype(float)


def _extend(
    rows: DataFrame,
    shadow: dict[int, np.ndarray],
    turn: dict[int, np.ndarray],
    keep: dict[int, np.ndarray],
) -> DataFrame:
    """Take the basis out of w, make w orthonormal and append it to the basis.

    Where `keep` names a period, its old basis is first reduced to those combinations.
    """

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for period, part in pdf.groupby("period"):
                basis, block = _blocks(part)
                if int(period) in shadow:
                    block = block - basis @ shadow[int(period)]
                block = block @ turn[int(period)]
                if int(period) in keep:
                    basis = basis @ keep[int(period)]
                yield pd.DataFrame(
                    {
                        "period": period,
                        "i": part["i"],
                        "basis": list(np.hstack([basis, block])),
                        "w": list(block),
                    }
                )

    return rows.mapInPandas(grow, "period int, i int, basis array<double>, w array<double>")


def _combine(rows: DataFrame, weights: dict[int, np.ndarray]) -> DataFrame:
    """Basis rows times each period's small matrix."""

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for period, part in pdf.groupby("period"):
                vectors = np.stack(part["basis"].to_numpy()) @ weights[int(period)]
                yield pd.DataFrame({"period": period, "i": part["i"], "vec": list(vectors)})

    return rows.select("period", "i", "basis").mapInPandas(product, VECTOR_SCHEMA)


def _orthonormal(gram: np.ndarray, scale: float) -> np.ndarray:
    """Matrix that makes columns with this Gram matrix orthonormal; spent ones become zero."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-14 * scale
    return vectors * np.where(keep, 1.0 / np.sqrt(np.where(keep, values, 1.0)), 0.0)


def _times(matrix: DataFrame, rows: DataFrame, width: int, value: str) -> DataFrame:
    """Sparse matrix times the newest block: a join and a sum per column."""
    other = rows.select("period", F.col("i").alias("j"), F.col("w").alias("_v"))
    sums = [F.sum(F.col(value) * F.col("_v")[k]).alias(f"_s{k}") for k in range(width)]
    return (
        matrix.join(other, ["period", "j"])
        .groupBy("period", "i")
        .agg(*sums)
        .select("period", "i", F.array(*[F.col(f"_s{k}") for k in range(width)]).alias("w"))
    )


def embed_blocks(
    matrix: DataFrame,
    dims: int = 100,
    block: int = 32,
    value: str = "pmi",
    seed: int = 7,
    tolerance: float = 1e-6,
    max_width: int | None = None,
    most_rounds: int = 200,
) -> DataFrame:
    """Largest positive eigenpairs by block Lanczos.

    Row vectors stay in Spark; only matrices as wide as the basis reach the driver. Each step
    multiplies the newest block by the matrix, takes the basis out of the product twice, and
    writes the grown basis as a table so that lineage stays short. A basis that would pass
    `max_width` columns is reduced to its best dims + block directions and grows again. It ends
    when what the last product adds outside the basis moves no wanted eigenpair by more than
    `tolerance` of the largest eigenvalue, or when the basis is as wide as the vocabulary; it raises
    when that takes more than `most_rounds` products.
    """
    max_width = max_width or max(3 * dims, dims + 4 * block)
    kept = dims + block
    matrix = stage(matrix.select("period", "i", "j", value), "matrix")
    codes = matrix.select("period", "i").distinct()
    sizes = codes.groupBy("period").count().agg(F.max("count")).first()[0] or 0
    draws = [
        F.xxhash64(F.col("i"), F.lit(seed * 1000 + k)) / F.lit(float(2**63)) for k in range(block)
    ]
    rows = stage(
        codes.withColumn("basis", F.array().cast("array<double>")).withColumn("w", F.array(*draws)),
        "basis",
    )
    shadow: dict[int, np.ndarray] = {}
    gram = _products(rows, shadow)
    scale = {p: float(np.trace(g)) for p, g in gram.items()}
    small: dict[int, np.ndarray] = {p: np.zeros((0, 0)) for p in gram}
    width = 0
    for _ in range(most_rounds):
        turn = {p: _orthonormal(g, scale[p]) for p, g in gram.items()}
        keep: dict[int, np.ndarray] = {}
        if width + block > max_width and width > kept:
            for p, t in small.items():
                values, vectors = np.linalg.eigh(t)
                best = np.argsort(values)[::-1][:kept]
                keep[p], small[p] = vectors[:, best], np.diag(values[best])
            width = kept
        rows = stage(_extend(rows, shadow, turn, keep), "basis")
        width += block
        moved = rows.drop("w").join(_times(matrix, rows, block, value), ["period", "i"])
        moved = stage(moved, "product")
        first = {p: x[:width] for p, x in _products(moved, {}).items()}
        second = _products(moved, first)
        shadow, gram, done = {}, {}, width >= sizes
        errors = []
        for p, x in second.items():
            shadow[p] = first[p] + x[:width]
            gram[p] = x[width:] - x[:width].T @ x[:width]
            grown = np.zeros((width, width))
            grown[: width - block, : width - block] = small[p]
            grown[:, width - block :] = shadow[p]
            grown[width - block :, :] = shadow[p].T
            small[p] = grown
            values, vectors = np.linalg.eigh(grown)
            wanted = vectors[width - block :, np.argsort(values)[::-1][:dims]]
            largest = max(float(np.abs(values).max()), 1e-300)
            outside = np.einsum("ak,ab,bk->k", wanted, gram[p], wanted)
            errors.append(np.sqrt(max(float(outside.max()), 0.0)) / largest)
            scale[p] = largest**2
        if done or max(errors, default=0.0) <= tolerance:
            return _combine(rows, {p: leading_vectors(t, dims) for p, t in small.items()})
        rows = moved
    raise RuntimeError(f"eigenpairs have not settled in {most_rounds} products")


def embed(matrix: DataFrame, dims: int = 100, value: str = "pmi") -> DataFrame:
    """Embedding rows per period, by the one solver that holds for every vocabulary."""
    return embed_blocks(matrix, dims, value=value)


def cosine_to_anchor(vectors: DataFrame, key: str, anchor, vec: str = "vec") -> DataFrame:
    """(period, key, cos): each row's cosine with the anchor row of its period.

    Periods without the anchor give no rows. The anchor side is one row per period.
    """
    anchors = vectors.where(F.col(key) == anchor).select("period", F.col(vec).alias("_anchor"))
    return vectors.join(F.broadcast(anchors), "period").select(
        "period", key, C.cosine(F.col(vec), F.col("_anchor")).alias("cos")
    )


def anchor_series(
    cosines: DataFrame, entities: DataFrame, key: str, periods: Sequence[int]
) -> DataFrame:
    """Every entity in every period, null where the entity or the anchor is missing."""
    grid = entities.select(key).distinct().withColumn(
        "period", F.explode(F.array(*[F.lit(int(p)) for p in periods]))
    )
    return grid.join(cosines, [key, "period"], "left")
