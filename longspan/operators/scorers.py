"""Unsupervised case scores from counts, and the count baselines.

All scorers read one wide table (a row per patient with utl, code, concept, code_concept and
feature counts) and return column expressions over it, so the scores of a patient are attached by
being computed in that patient's row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from longspan.operators.mixture import (
    distances_to_fit,
    fit_normals,
    fit_poissons,
)
from longspan.operators.ranking import hash_sample, quantiles
from longspan.sources.stages import stage

SURROGATES = ["code", "concept", "code_concept"]
ALPHAS = [k / 10 for k in range(11)]


def logs(names: Sequence[str]) -> dict[str, Column]:
    return {name: F.log1p(F.col(name).cast("double")) for name in names}


def log_counts(df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Log counts under the same names."""
    return df.select(*keep, *[c.alias(n) for n, c in logs(names).items()])


def baseline_scores() -> dict[str, Column]:
    return {"log_code": F.log1p("code"), "log_concept": F.log1p("concept")}


# --- covariance ---------------------------------------------------------------------------------


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of an array column, all of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def numbers(columns: Sequence[str]) -> Column:
    """The columns as one array of doubles: many columns go through Spark and to Python as one."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def covariance(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Sample covariance of every column pair per group, as (by, a, b, cov, n) rows. `by` names a few
    groups, such as the halves of a split."""
    return block_covariance(df.select(by, numbers(columns).alias("_x")), columns, by, lambda batch: matrix_of(batch.column(1)))


def block_covariance(
    df: DataFrame, columns: Sequence[str], by: str, block_of: Callable[[pa.RecordBatch], np.ndarray]
) -> DataFrame:
    """`covariance` of the named columns that `block_of` makes of a batch of rows.

    Each batch of rows turns into a block of cross-products, and blocks are summed; what is
    shuffled depends on the number of columns, not rows. `by` is the first column.
    """
    names = list(columns)
    kind = dict(df.dtypes)[by]
    schema = f"{by} {kind}, a string, b string, sxy double, sx double, sy double, n double"
    a = np.repeat(names, len(names))
    b = np.tile(names, len(names))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, groups = block_of(batch), batch.column(0).dictionary_encode()
            place = groups.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for k, group in enumerate(groups.dictionary.to_pylist()):
                block = rows[place == k]
                old = sums.get(group, (0.0, 0.0, 0))
                sums[group] = (old[0] + block.T @ block, old[1] + block.sum(axis=0), old[2] + len(block))
        for group, (products, totals, n) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group] * len(a), batch.schema.field(0).type), pa.array(a.tolist()), pa.array(b.tolist()),
                    pa.array(products.ravel()), pa.array(np.repeat(totals, len(names))),
                    pa.array(np.tile(totals, len(names))), pa.array(np.full(len(a), float(n))),
                ],
                names=[by, "a", "b", "sxy", "sx", "sy", "n"],
            )

    return (
        df.mapInArrow(partial, schema)
        .groupBy(by, "a", "b")
        .agg(*[F.sum(c).alias(c) for c in ("sxy", "sx", "sy", "n")])
        .select(
            by, "a", "b",
            F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("n") - 1).alias(
                "cov"
            ),
            F.col("n").cast("bigint").alias("n"),
            (F.col("sx") / F.col("n")).alias("mean_a"),
        )
    )


def as_matrices(cov: DataFrame, by: str, names: Sequence[str]) -> dict:
    """Collect a long covariance table: columns squared numbers per group."""
    rows = cov.toPandas()
    out = {}
    for group, part in rows.groupby(by):
        wide = part.pivot(index="a", columns="b", values="cov").loc[list(names), list(names)]
        out[group] = wide.to_numpy(float)
    return out


# --- hash corruption ----------------------------------------------------------------------------


def corrupt_and_split(
    df: DataFrame, columns: Sequence[str], key: str = "patient_num", rate: float = 0.2,
    train: float = 2 / 3, seed: int = 2023,
) -> DataFrame:
    """Adds corrupt_<c> (a picked share of rows takes the column mean) and is_train.

    Picks rank rows by a hash of the key, so they repeat under any partitioning.
    """
    # One row of means.
    means = df.agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    out = df
    for k, c in enumerate(columns):
        out = hash_sample(out, key, seed + k, rate, f"_pick_{c}")
        out = out.withColumn(
            f"corrupt_{c}",
            F.when(F.col(f"_pick_{c}"), means.select(f"_mean_{c}").scalar()).otherwise(
                F.col(c).cast("double")
            ),
        ).drop(f"_pick_{c}")
    return hash_sample(out, key, seed + len(columns), train, "is_train")


# --- mixture score: counts adjusted for utilisation ---------------------------------------------


def long_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(method, y, e, w): distinct (count, utilisation) pairs with how many patients share them."""
    pairs = [F.struct(F.lit(c).alias("method"), F.col(c).cast("double").alias("y")) for c in names]
    return (
        df.select(F.col("utl").cast("double").alias("e"), F.inline(F.array(*pairs)))
        .groupBy("method", "y", "e")
        .agg(F.count("*").cast("double").alias("w"))
    )


def share_cut(df: DataFrame, score: str, share: float) -> DataFrame:
    """One row: the score above which the given share of rows lies."""
    marks = quantiles(df.withColumn("_all", F.lit(1)), ["_all"], score, [1 - share])
    return marks.select(F.col("quantiles")[0].alias("cut"))


def mixture_score(df: DataFrame) -> tuple[Column, float]:
    """Case probability from code, concept and joint counts, and the estimated share of cases.

    Per count: a two-rate Poisson mixture with utilisation as exposure, and a two-normal mixture
    of the log count less its regression on log utilisation; the six posteriors are averaged.
    """
    counts = stage(long_counts(df, SURROGATES), "counts")
    rates = fit_poissons(counts)
    x, z, w = F.log1p("y"), F.log1p("e"), F.col("w")
    moments = counts.groupBy("method").agg(
        (
            (F.sum(w * x * z) - F.sum(w * x) * F.sum(w * z) / F.sum(w))
            / F.nullif(F.sum(w * z * z) - F.sum(w * z) * F.sum(w * z) / F.sum(w), F.lit(0.0))
        ).alias("slope")
    )
    slopes = {row.method: row.slope or 0.0 for row in moments.collect()}
    chain = None
    for name, slope in sorted(slopes.items()):
        adjusted = x - F.lit(slope) * z
        hit = F.col("method") == name
        chain = F.when(hit, adjusted) if chain is None else chain.when(hit, adjusted)
    normals = fit_normals(counts.select("method", chain.alias("x"), "w"))
    posteriors = []
    for name in SURROGATES:
        count, utl = F.col(name).cast("double"), F.col("utl").cast("double")
        posteriors.append(rates[name].posterior(count, utl))
        posteriors.append(
            normals[name].posterior(F.log1p(count) - F.lit(slopes[name]) * F.log1p(utl))
        )
    score = sum(posteriors[1:], posteriors[0]) / F.lit(float(len(posteriors)))
    share = float(
        np.mean([rates[s].share for s in SURROGATES] + [normals[s].share for s in SURROGATES])
    )
    return score, share


# --- normalised score: surrogates divided by utilisation, denoised by regression ----------------


@dataclass(frozen=True)
class NormalisedConfig:
    name: str
    surrogates: tuple[str, ...]
    features: tuple[str, ...]


def normalised_configs(features: Sequence[str]) -> list[NormalisedConfig]:
    """Code only or all surrogates, without and with features."""
    every = tuple(SURROGATES)
    return [
        NormalisedConfig("norm_code", ("code",), ()),
        NormalisedConfig("norm_code_features", ("code",), ("concept", *features)),
        NormalisedConfig("norm_both", every, ()),
        NormalisedConfig("norm_both_features", every, tuple(features)),
    ]


def choose_exponents(df: DataFrame, surrogates: Sequence[str]) -> dict[str, float]:
    """Utilisation exponent per surrogate whose normalised log count is closest to a two-normal fit.

    Every grid point is fitted to all its distinct values until the fit converges, all points in the
    same rounds, and its distance is that of the exact distribution functions.
    """
    grid = long_counts(df, surrogates).select(
        "method", "w", F.log1p("y").alias("_x"), F.log1p("e").alias("_z"),
        F.explode(F.array(*[F.lit(a) for a in ALPHAS])).alias("alpha"),
    ).select(
        F.concat_ws("|", "method", F.col("alpha").cast("string")).alias("method"),
        (F.col("_x") - F.col("alpha") * F.col("_z")).alias("x"),
        "w",
    )
    values = stage(grid.groupBy("method", "x").agg(F.sum("w").alias("w")), "exponents")
    best: dict[str, tuple[float, float]] = {}
    for key, gap in sorted(distances_to_fit(values, fit_normals(values)).items()):
        name, alpha = key.split("|")
        best[name] = min(best.get(name, (math.inf, 0.0)), (gap, float(alpha)))
    return {name: alpha for name, (_, alpha) in best.items()}


def least_squares(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Coefficients from cross-products; a column without variation gets none."""
    return np.linalg.lstsq(gram, cross, rcond=1e-10)[0]


def normalised_scores(
    df: DataFrame, features: Sequence[str], key: str = "patient_num",
    rate: float = 0.3, seed: int = 1234,
) -> dict[str, Column]:
    """Case probability per configuration.

    Surrogates are log counts less a multiple of log utilisation. With features, each normalised
    surrogate is regressed, without intercept, on itself, the features and utilisation in which a
    hashed share of cells takes the column mean; the fitted line on intact columns is the score.
    Posteriors of a two-normal fit are averaged over a configuration's surrogates.
    """
    exponents = choose_exponents(df, SURROGATES)
    columns = [*SURROGATES, "utl", *features]
    place = {c: k for k, c in enumerate(columns)}
    normal = [f"norm_{s}" for s in SURROGATES]
    inputs = [*normal, *[c for c in columns if c not in ("code", "code_concept")]]
    intact = [place[c] for c in inputs[len(normal) :]]
    shift = np.array([exponents[s] for s in SURROGATES])

    def values(counts: pa.Array) -> np.ndarray:
        """The inputs of a batch of rows of counts."""
        logged = np.log1p(matrix_of(counts))
        turned = logged[:, [place[s] for s in SURROGATES]] - logged[:, [place["utl"]]] * shift
        return np.hstack([turned, logged[:, intact]])

    table = stage(df.select(key, numbers(columns).alias("counts")), "logs")

    def totals(batch: pa.RecordBatch) -> np.ndarray:
        block = values(batch.column(0))
        return np.vstack([block.sum(axis=0), np.full(block.shape[1], float(len(block)))])

    sums = summed(table.select("counts"), totals)
    means = sums[0] / sums[1]
    draw = F.transform(
        F.sequence(F.lit(0), F.lit(len(inputs) - 1)),
        lambda k: F.pmod(F.xxhash64(F.col(key), F.lit(seed) + k), F.lit(1_000_000)) < int(rate * 1_000_000),
    )

    def crossed(batch: pa.RecordBatch) -> np.ndarray:
        block = values(batch.column(0))
        noisy = np.where(matrix_of(batch.column(1)) > 0, means, block)
        both = np.hstack([block[:, : len(normal)], noisy])
        return both.T @ both

    products = summed(table.select("counts", draw.alias("hit")), crossed)
    at = {c: k for k, c in enumerate([*normal, *[f"_c_{c}" for c in inputs]])}

    linear: dict[tuple[str, str], dict[str, float]] = {}
    for config in normalised_configs(features):
        for s in config.surrogates:
            target = f"norm_{s}"
            if not config.features:
                linear[config.name, s] = {target: 1.0}
                continue
            used = [*[f"norm_{t}" for t in config.surrogates], *config.features, "utl"]
            rows = [at[f"_c_{c}"] for c in used]
            beta = least_squares(products[np.ix_(rows, rows)], products[rows, at[target]])
            linear[config.name, s] = dict(zip(used, beta))

    weights = {f"{name}/{s}": [line.get(c, 0.0) for c in inputs] for (name, s), line in linear.items()}
    scored = stage(line_values(table.select("counts"), weights, values), "scores")
    fits = fit_normals(scored)

    def on_counts(weights: dict[str, float]) -> Column:
        """The same line over raw counts."""
        terms = []
        for c, b in weights.items():
            if c in normal:
                s = c.removeprefix("norm_")
                value = F.log1p(s) - F.lit(exponents[s]) * F.log1p("utl")
            else:
                value = F.log1p(F.col(c))
            terms.append(F.lit(float(b)) * value)
        return sum(terms[1:], terms[0])

    out = {}
    for config in normalised_configs(features):
        parts = [
            fits[f"{config.name}/{s}"].posterior(on_counts(linear[config.name, s]))
            for s in config.surrogates
        ]
        out[config.name] = sum(parts[1:], parts[0]) / F.lit(float(len(parts)))
    return out


def summed(df: DataFrame, block_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum of the matrices that `block_of` makes of batches of rows; only such matrices leave the tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                block = block_of(batch)
                total = block if total is None else total + block
        if total is not None:
            cells = [np.arange(total.size, dtype=np.int32), np.full(total.size, total.shape[1], np.int32), total.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["cell", "width", "x"])

    cells = (
        df.mapInArrow(partial, "cell int, width int, x double")
        .groupBy("cell", "width")
        .agg(F.sum("x").alias("x"))
        .toPandas()
        .sort_values("cell")
    )
    return cells["x"].to_numpy(float).reshape(-1, int(cells["width"].iloc[0]))


def line_values(
    vectors: DataFrame, weights: dict[str, Sequence[float]], values: Callable[[pa.Array], np.ndarray]
) -> DataFrame:
    """(method, x, w): distinct values of each method's line over the rows that `values` makes of the
    array column, with how many rows share them."""
    lines = np.array(list(weights.values()), float).T

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = values(batch.column(0)) @ lines if batch.num_rows else np.zeros((0, lines.shape[1]))
            for method, x in zip(weights, found.T):
                at, n = np.unique(x, return_counts=True)
                cells = [pa.array([method] * len(at), pa.string()), pa.array(at), pa.array(n.astype(float))]
                yield pa.RecordBatch.from_arrays(cells, names=["method", "x", "w"])

    rows = vectors.mapInArrow(partial, "method string, x double, w double")
    return rows.groupBy("method", "x").agg(F.sum("w").alias("w"))


# --- covariance score: coefficients from covariances alone --------------------------------------


def lasso(gram: np.ndarray, cross: np.ndarray, penalty: float, rounds: int = 100_000) -> np.ndarray:
    """Penalised coefficients from a covariance matrix by cyclic soft-thresholding."""
    beta = np.zeros(len(cross))
    for _ in range(rounds):
        moved = 0.0
        for k in range(len(cross)):
            if gram[k, k] <= 1e-12:
                continue
            gap = cross[k] - gram[k] @ beta + gram[k, k] * beta[k]
            new = np.sign(gap) * max(abs(gap) - penalty, 0.0) / gram[k, k]
            moved = max(moved, abs(new - beta[k]))
            beta[k] = new
        if moved < 1e-10:
            return beta
    raise RuntimeError(f"no convergence in {rounds} rounds")


def without(cov: np.ndarray, at: int) -> np.ndarray:
    """Covariance after the linear part of one column is taken out of all."""
    if cov[at, at] <= 1e-12:
        return cov
    return cov - np.outer(cov[:, at], cov[at]) / cov[at, at]


def covariance_coefficients(
    train: np.ndarray, valid: np.ndarray, names: Sequence[str], targets: Sequence[str],
    features: Sequence[str], utl: str = "utl",
) -> dict[str, float]:
    """Coefficients on targets, features and utilisation.

    Each target is regressed on the corrupted targets and the features with utilisation taken
    out, the penalty picked by the loss under the validation covariance, and the targets'
    coefficients are averaged.
    """
    at = {c: k for k, c in enumerate(names)}
    fit, check = without(train, at[utl]), without(valid, at[utl])
    used = [*[f"corrupt_{t}" for t in targets], *features]
    rows = [at[c] for c in used]
    scale = np.sqrt(np.maximum(np.diag(fit)[rows], 1e-12))
    total = np.zeros(len(used))
    for target in targets:
        goal = at[target]
        gram = fit[np.ix_(rows, rows)] / np.outer(scale, scale)
        cross = fit[rows, goal] / scale
        top = float(np.abs(cross).max(initial=0.0))
        best = None
        for penalty in top * np.logspace(0, -3, 20):
            beta = lasso(gram, cross, penalty) / scale
            loss = beta @ check[np.ix_(rows, rows)] @ beta - 2 * beta @ check[rows, goal]
            if best is None or loss < best[0]:
                best = (loss, beta)
        total += best[1] / len(targets)
    out = {c.removeprefix("corrupt_"): float(b) for c, b in zip(used, total)}
    slope = train[at[utl], rows] / max(train[at[utl], at[utl]], 1e-12)
    out[utl] = float(-(total * slope).sum())
    return out


@dataclass(frozen=True)
class CovarianceFit:
    scores: dict[str, Column]
    coefficients: list[tuple[str, str, float]]

    def table(self, spark) -> DataFrame:
        """(method, feat, coeff) rows."""
        return spark.createDataFrame(self.coefficients, "method string, feat string, coeff double")


def covariance_scores(
    df: DataFrame, coded: Sequence[str], concepts: Sequence[str],
    key: str = "patient_num", seed: int = 2023,
) -> CovarianceFit:
    """Case probability from covariances of log counts: code with coded features, and both.

    Only two covariance matrices, of the training and validation rows, leave Spark.
    """
    columns = ["utl", "code", "concept", *coded, *concepts]
    logged = df.select(key, *[logs(["code", "concept"])[c].alias(c) for c in ("code", "concept")], numbers(columns).alias("counts"))
    logged = stage(logged, "logs")
    names = [*columns, "corrupt_code", "corrupt_concept"]
    split = corrupt_and_split(logged, ["code", "concept"], key, seed=seed).select(
        "is_train", "counts", numbers(names[-2:]).alias("corrupt")
    )

    def block_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.hstack([np.log1p(matrix_of(batch.column(1))), matrix_of(batch.column(2))])

    matrices = as_matrices(block_covariance(split, names, "is_train", block_of), "is_train", names)
    models = {
        "cov_code": covariance_coefficients(
            matrices[True], matrices[False], names, ["code"], coded
        ),
        "cov_both": covariance_coefficients(
            matrices[True], matrices[False], names, ["code", "concept"], [*coded, *concepts]
        ),
    }

    def line(weights: dict[str, float]) -> Column:
        terms = [F.lit(b) * F.log1p(F.col(c)) for c, b in weights.items()]
        return sum(terms[1:], terms[0])

    lines = {name: [weights.get(c, 0.0) for c in columns] for name, weights in models.items()}
    scored = stage(line_values(logged.select("counts"), lines, lambda counts: np.log1p(matrix_of(counts))), "scores")
    fits = fit_normals(scored)
    return CovarianceFit(
        {name: fits[name].posterior(line(weights)) for name, weights in models.items()},
        [(name, c, b) for name, weights in models.items() for c, b in weights.items()],
    )


def compare_coefficients(table: DataFrame, first: str, second: str) -> DataFrame:
    """Coefficients of two methods side by side, for features both have."""
    def one(method: str) -> DataFrame:
        return table.where(F.col("method") == method).select(
            "feat", F.col("coeff").alias(f"coeff_{method}")
        )

    return one(first).join(one(second), "feat")


# --- all methods --------------------------------------------------------------------------------


def score_table(
    df: DataFrame, coded: Sequence[str], concepts: Sequence[str], keep: Sequence[str],
    key: str = "patient_num",
) -> tuple[DataFrame, CovarianceFit]:
    """Nine scores per patient with at least one main code, next to the kept columns."""
    main = stage(df.where(F.col("code") > 0), "main")
    mixture, _ = mixture_score(main)
    by_covariance = covariance_scores(main, coded, concepts, key)
    scores = {
        "mixture": mixture,
        **by_covariance.scores,
        **normalised_scores(main, [*coded, *concepts], key),
        **baseline_scores(),
    }
    return main.select(*keep, *[c.alias(n) for n, c in scores.items()]), by_covariance


def long_scores(df: DataFrame, ids: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """(ids..., method, score) rows."""
    return df.unpivot(list(ids), list(methods), "method", "score")
