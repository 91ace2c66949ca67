"""Two-component mixtures fitted by Spark aggregates.

A fit starts from a small summary: bin counts (normal) or cell means (Poisson) of fixed size,
solved with numpy on the driver. Full-data rounds then run as one aggregate each until the
parameters settle, so the driver never holds a row per patient.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from longspan.operators.ranking import running_sums

BINS = 4096


@dataclass(frozen=True)
class NormalPair:
    """Shares, means and common variance; component 1 has the higher mean."""

    share: float
    low: float
    high: float
    variance: float

    def posterior(self, x: Column) -> Column:
        """Probability of the higher component: a logistic curve, rising in x."""
        gain = (self.high - self.low) / self.variance
        middle = (self.high + self.low) / 2
        odds = math.log(self.share / (1 - self.share))
        return 1 / (1 + F.exp(-(F.lit(odds) + F.lit(gain) * (x - F.lit(middle)))))


@dataclass(frozen=True)
class PoissonPair:
    """Share and rates per unit of exposure; component 1 has the higher rate."""

    share: float
    low: float
    high: float

    def posterior(self, count: Column, exposure: Column) -> Column:
        odds = math.log(self.share / (1 - self.share))
        return 1 / (
            1
            + F.exp(
                -(
                    F.lit(odds)
                    + count * F.lit(math.log(self.high / self.low))
                    - exposure * F.lit(self.high - self.low)
                )
            )
        )


def _bounded(share: float) -> float:
    return min(max(share, 1e-6), 1 - 1e-6)


def normal_step(n: float, s1: float, sx1: float, sx: float, sxx: float) -> NormalPair:
    """New parameters from sums of the weights, the posterior and their products with x."""
    share = _bounded(s1 / n)
    high = sx1 / max(s1, 1e-12)
    low = (sx - sx1) / max(n - s1, 1e-12)
    variance = (sxx - s1 * high**2 - (n - s1) * low**2) / n
    variance = max(variance, 1e-8)
    if high < low:
        return NormalPair(1 - share, high, low, variance)
    return NormalPair(share, low, high, variance)


def fit_normal_bins(x: np.ndarray, w: np.ndarray, rounds: int = 3000) -> NormalPair:
    """Fit to weighted points; the start splits the points at their mean."""
    mean = float(np.average(x, weights=w))
    above = x > mean
    n = float(w.sum())
    spread = float(np.average((x - mean) ** 2, weights=w))
    if not above.any() or spread <= 0:
        return NormalPair(0.5, mean - 1e-4, mean + 1e-4, max(spread, 1e-8))
    s1 = float(w[above].sum())
    pair = normal_step(
        n, s1, float((w * x)[above].sum()), float((w * x).sum()), float((w * x * x).sum()),
    )
    for _ in range(rounds):
        gain = (pair.high - pair.low) / pair.variance
        logit = math.log(pair.share / (1 - pair.share)) + gain * (x - (pair.high + pair.low) / 2)
        post = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        new = normal_step(
            n, float((w * post).sum()), float((w * post * x).sum()),
            float((w * x).sum()), float((w * x * x).sum()),
        )
        done = abs(new.high - pair.high) + abs(new.low - pair.low) < 1e-10
        pair = new
        if done:
            break
    return pair


def binned(df: DataFrame, key: str, x: str, weight: str, bins: int = BINS):
    """Bin centres and weights per key: at most `bins` numbers per key reach the driver."""
    ends = df.groupBy(key).agg(F.min(x).alias("_low"), F.max(x).alias("_high"))
    width = F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-12)) / F.lit(bins)
    place = F.least(F.floor((F.col(x) - F.col("_low")) / width), F.lit(bins - 1))
    cells = (
        df.join(F.broadcast(ends), key)
        .groupBy(key, place.alias("_bin"))
        .agg(F.sum(weight).alias("_w"), (F.sum(F.col(x) * F.col(weight)) / F.sum(weight)).alias("_x"))
        .toPandas()
        .sort_values("_bin")
    )
    return {
        name: (part["_x"].to_numpy(float), part["_w"].to_numpy(float))
        for name, part in cells.groupby(key)
    }


def fit_normals(
    df: DataFrame, key: str = "method", x: str = "x", weight: str = "w",
    rounds: int = 1000, tolerance: float = 1e-6,
) -> dict[str, NormalPair]:
    """All keys' fits at once; one aggregate over the table per round."""
    pairs = {name: fit_normal_bins(*points) for name, points in binned(df, key, x, weight).items()}
    open_keys = set(pairs)
    for _ in range(rounds):
        if not open_keys:
            break
        rows = [
            (name, math.log(p.share / (1 - p.share)), (p.high - p.low) / p.variance, (p.high + p.low) / 2)
            for name, p in sorted(pairs.items())
            if name in open_keys
        ]
        kinds = f"`{key}` string, _odds double, _gain double, _middle double"
        state = df.sparkSession.createDataFrame(rows, kinds)
        post = 1 / (1 + F.exp(-(F.col("_odds") + F.col("_gain") * (F.col(x) - F.col("_middle")))))
        w, v = F.col(weight), F.col(x)
        sums = (
            df.join(F.broadcast(state), key)
            .withColumn("_r", post)
            .groupBy(key)
            .agg(
                F.sum(w).alias("n"),
                F.sum(w * F.col("_r")).alias("s1"),
                F.sum(w * F.col("_r") * v).alias("sx1"),
                F.sum(w * v).alias("sx"),
                F.sum(w * v * v).alias("sxx"),
            )
            .collect()
        )
        for row in sums:
            old = pairs[row[key]]
            new = normal_step(row.n, row.s1, row.sx1, row.sx, row.sxx)
            scale = math.sqrt(new.variance) + 1e-12
            moved = max(
                abs(new.high - old.high) / scale,
                abs(new.low - old.low) / scale,
                abs(new.share - old.share),
            )
            pairs[row[key]] = new
            if moved < tolerance:
                open_keys.discard(row[key])
    if open_keys:
        raise RuntimeError(f"no convergence in {rounds} rounds: {sorted(open_keys)}")
    return pairs


def poisson_step(n, s1, sy1, sy, se1, se) -> PoissonPair:
    n, s1, sy1, sy, se1, se = map(float, (n, s1, sy1, sy, se1, se))
    high = max(sy1 / max(se1, 1e-12), 1e-9)
    low = max((sy - sy1) / max(se - se1, 1e-12), 1e-9)
    share = _bounded(s1 / n)
    return PoissonPair(1 - share, high, low) if high < low else PoissonPair(share, low, high)


def fit_poisson_cells(
    y: np.ndarray, e: np.ndarray, w: np.ndarray, rounds: int = 3000
) -> PoissonPair:
    rate = float((w * y).sum() / max((w * e).sum(), 1e-12))
    pair = PoissonPair(0.5, max(rate / 2, 1e-9), max(rate * 2, 2e-9))
    for _ in range(rounds):
        logit = (
            math.log(pair.share / (1 - pair.share))
            + y * math.log(pair.high / pair.low)
            - e * (pair.high - pair.low)
        )
        r = w / (1 + np.exp(-np.clip(logit, -500, 500)))
        new = poisson_step(
            w.sum(), r.sum(), (r * y).sum(), (w * y).sum(), (r * e).sum(), (w * e).sum()
        )
        done = abs(new.high - pair.high) + abs(new.low - pair.low) < 1e-10
        pair = new
        if done:
            break
    return pair


def fit_poissons(
    df: DataFrame, key: str = "method", y: str = "y", exposure: str = "e", weight: str = "w",
    rounds: int = 1000, tolerance: float = 1e-6,
) -> dict[str, PoissonPair]:
    """Counts with exposure, all keys at once.

    The start comes from means over cells of the two log values, 16 to each power of e.
    """
    w, count, expo = F.col(weight), F.col(y), F.col(exposure)

    def cell(value: Column) -> Column:
        return F.floor(F.log1p(value) * 16)

    cells = (
        df.groupBy(key, cell(count).alias("_cy"), cell(expo).alias("_ce"))
        .agg(
            F.sum(w).alias("_w"),
            (F.sum(count * w) / F.sum(w)).alias("_y"),
            (F.sum(expo * w) / F.sum(w)).alias("_e"),
        )
        .toPandas()
    )
    pairs = {
        name: fit_poisson_cells(*(part[c].to_numpy(float) for c in ("_y", "_e", "_w")))
        for name, part in cells.groupby(key)
    }
    open_keys = set(pairs)
    for _ in range(rounds):
        if not open_keys:
            break
        rows = [
            (name, math.log(p.share / (1 - p.share)), math.log(p.high / p.low), p.high - p.low)
            for name, p in sorted(pairs.items())
            if name in open_keys
        ]
        kinds = f"`{key}` string, _odds double, _ratio double, _gap double"
        state = df.sparkSession.createDataFrame(rows, kinds)
        logit = F.col("_odds") + count * F.col("_ratio") - expo * F.col("_gap")
        sums = (
            df.join(F.broadcast(state), key)
            .withColumn("_r", w / (1 + F.exp(-logit)))
            .groupBy(key)
            .agg(
                F.sum(w).alias("n"),
                F.sum("_r").alias("s1"),
                F.sum(F.col("_r") * count).alias("sy1"),
                F.sum(w * count).alias("sy"),
                F.sum(F.col("_r") * expo).alias("se1"),
                F.sum(w * expo).alias("se"),
            )
            .collect()
        )
        for row in sums:
            old = pairs[row[key]]
            new = poisson_step(row.n, row.s1, row.sy1, row.sy, row.se1, row.se)
            moved = max(
                abs(new.high / old.high - 1), abs(new.low / old.low - 1), abs(new.share - old.share)
            )
            pairs[row[key]] = new
            if moved < tolerance:
                open_keys.discard(row[key])
    if open_keys:
        raise RuntimeError(f"no convergence in {rounds} rounds: {sorted(open_keys)}")
    return pairs


def normal_cdf(x: np.ndarray, mean: float, variance: float) -> np.ndarray:
    return np.array([0.5 * math.erfc((mean - v) / math.sqrt(2 * variance)) for v in x])


def distances_to_fit(
    df: DataFrame, pairs: dict[str, NormalPair], key: str = "method", x: str = "x", weight: str = "w"
) -> dict[str, float]:
    """Per key the largest gap between the exact distribution function and the fitted one.

    The rows are one for each distinct value; their running sums give the function just below and
    at each value, and only the largest gaps leave the tasks.
    """
    ranked = running_sums(df, [key], x, [weight])

    def gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, part in rows.groupby(key):
                pair, v = pairs[name], part[x].to_numpy(float)
                fitted = pair.share * normal_cdf(v, pair.high, pair.variance) + (1 - pair.share) * normal_cdf(v, pair.low, pair.variance)
                below, total = part[f"{weight}_before"].to_numpy(float), part[f"{weight}_total"].to_numpy(float)
                at = below + part[weight].to_numpy(float)
                gap = np.maximum(np.abs(below / total - fitted), np.abs(at / total - fitted))
                yield pd.DataFrame({key: [name], "gap": [float(gap.max())]})

    columns = [key, x, weight, f"{weight}_before", f"{weight}_total"]
    largest = ranked.select(*columns).mapInPandas(gaps, f"`{key}` string, gap double").groupBy(key).agg(F.max("gap").alias("gap"))
    return {row[key]: row.gap for row in largest.collect()}
