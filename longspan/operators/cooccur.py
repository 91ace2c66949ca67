"""Windowed co-occurrence of codes and its positive pointwise mutual information."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from longspan.functions import columns as C
from longspan.sources.stages import stage

BLOCK_CELLS = 4_000_000


def daily_counts(events: DataFrame, code: str = "feature_id") -> DataFrame:
    """(period, patient_num, day, code, m): repeated records of a day become one row."""
    return (
        events.select(
            F.year("start_date").cast("int").alias("period"),
            "patient_num",
            C.day_number(F.col("start_date")).alias("day"),
            F.col(code).alias("code"),
        )
        .groupBy("period", "patient_num", "day", "code")
        .agg(F.count("*").alias("m"))
    )


def lagged_products(
    day: np.ndarray, place: np.ndarray, m: np.ndarray, later: np.ndarray, size: int, window: int
) -> Iterator[tuple[int, np.ndarray]]:
    """later'earlier counts over lags 1..window, as (first row, block of rows).

    A running sum over days turns the earlier days' counts of each day into one row, so the work
    is one small matrix product instead of a pass over all pairs. `later` marks the rows that may
    stand on the later side.
    """
    days, row = np.unique(day, return_inverse=True)
    counts = np.zeros((len(days), size))
    np.add.at(counts, (row, place), m)
    running = np.vstack([np.zeros((1, size)), np.cumsum(counts, axis=0)])
    low = np.searchsorted(days, days - window, side="left")
    earlier = running[np.arange(len(days))] - running[low]
    own = np.zeros((len(days), size))
    np.add.at(own, (row[later], place[later]), m[later])
    step = max(1, BLOCK_CELLS // max(size, 1))
    for first in range(0, size, step):
        yield first, own[:, first : first + step].T @ earlier


def crowded_years(
    daily: DataFrame, key: list[str], year: list[str], window: int, crowd: int
) -> DataFrame | None:
    """Patients and years with a bucket of more than `crowd` rows; None if there are none.

    With ids 1..d for codes a bucket cannot pass window x d rows, so a small vocabulary needs no
    count at all.
    """
    if dict(daily.dtypes)["code"] == "int":
        largest = daily.agg(F.max("code")).first()[0] or 0
        if window * largest <= crowd:
            return None
    crowded = stage(
        daily.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).select(*year).distinct(),
        "crowded",
    )
    return None if crowded.isEmpty() else crowded


def crowded_pairs(rows: DataFrame, key: list[str], window: int, kind: str) -> DataFrame:
    """Pair counts within buckets, (period, i, j, n), already summed within a bucket.

    A group has the daily counts of one person's bucket and the bucket before, at most
    2 x window rows per code.
    """

    def solve(
        bucket: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        codes, place = np.unique(
            table["code"].to_numpy(zero_copy_only=False), return_inverse=True
        )
        later = table["own"].to_numpy(zero_copy_only=False).astype(bool)
        day, m = table["day"].to_numpy(), table["m"].to_numpy()
        for first, block in lagged_products(day, place, m, later, len(codes), window):
            i, j = np.nonzero(block)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(i), bucket[0].as_py()), pa.int32()),
                    pa.array(codes[i + first], table.schema.field("code").type),
                    pa.array(codes[j], table.schema.field("code").type),
                    pa.array(block[i, j].round().astype(np.int64), pa.int64()),
                ],
                names=["period", "i", "j", "n"],
            )

    return rows.groupBy(*key).applyInArrow(solve, f"period int, i {kind}, j {kind}, n bigint")


def cooccurrence(
    events: DataFrame, window: int = 30, code: str = "feature_id", crowd: int = 2_000
) -> DataFrame:
    """Pairs of a code with codes 1..window days earlier, same patient and year.

    Gives (period, i, j, n) with i the later day's code. `daily_counts` is written once, as it is
    also counted: after it a patient's days hold at most one row per code however many records
    there are. A window over the days before each row lists what it meets, so rows are dealt and
    sorted once; the listed pairs go straight into the partial sum and are never shuffled. Patients'
    years with more than `crowd` rows in some bucket of `window` days would make long lists. There a
    running sum over days and a matrix product give the same counts without forming the pairs, by
    bucket: an earlier day within the window lies in the same bucket or the one before.
    """
    bucket = F.floor(F.col("day") / F.lit(window)).cast("int")
    known = F.col("patient_num").isNotNull() & F.col("day").isNotNull()
    daily = stage(daily_counts(events, code).where(known).withColumn("bucket", bucket), "daily")
    # The patient first: sorts compare the first column fastest, and it has the most values.
    year = ["patient_num", "period"]
    key = [*year, "bucket"]
    crowded = crowded_years(daily, key, year, window, crowd)
    plain, dense = daily, None
    if crowded is not None:
        both = daily.join(crowded, year, "left_semi").select(
            *year,
            F.posexplode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("_shift", "bucket"),
            "day",
            "code",
            "m",
        )
        rows = both.withColumn("own", F.col("_shift") == 0).drop("_shift")
        dense = crowded_pairs(rows, ["period", "patient_num", "bucket"], window, dict(daily.dtypes)["code"])
        plain = daily.join(crowded, year, "left_anti")
    before = W.partitionBy(*year).orderBy("day").rangeBetween(-window, -1)
    met = F.collect_list(F.struct(F.col("code").alias("j"), F.col("m").alias("_m"))).over(before)
    pairs = (
        plain.select("period", F.col("code").alias("i"), "m", met.alias("_met"))
        .select("period", "i", "m", F.inline("_met"))
        .select("period", "i", "j", (F.col("m") * F.col("_m")).alias("n"))
    )
    if dense is not None:
        pairs = pairs.unionByName(dense)
    return pairs.groupBy("period", "i", "j").agg(F.sum("n").alias("n"))


def symmetrise(triplets: DataFrame, passes: int = 1) -> DataFrame:
    """Sum each off-diagonal count with its mirror; the diagonal stays.

    A second pass doubles off-diagonal counts once more and still keeps the diagonal, which is how
    the yearly matrices are built; the per-patient matrices take one pass.
    """
    cell = F.struct("i", "j")
    mirror = F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    cells = F.when(F.col("i") == F.col("j"), F.array(cell)).otherwise(F.array(cell, mirror))
    total = (
        triplets.select("period", "n", F.inline(cells))
        .groupBy("period", "i", "j")
        .agg(F.sum("n").alias("n"))
    )
    factor = 2 ** (passes - 1)
    if factor == 1:
        return total
    return total.withColumn(
        "n", F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(F.col("n") * factor)
    )


def row_sums(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("period", "i").agg(F.sum("n").alias("r"))


def positive_pmi(
    matrix: DataFrame, min_row: float = 10, recompute_marginals: bool = False
) -> DataFrame:
    """ln(n_ij * total / (r_i * r_j)) where positive, for rows with sum above `min_row`.

    The total is over kept rows. With `recompute_marginals` the row sums are taken again within
    the kept rows and columns. The matrix must be symmetric.
    """
    kept = row_sums(matrix).where(F.col("r") > min_row)

    def with_marginals(cells: DataFrame, sums: DataFrame) -> DataFrame:
        rows = sums.withColumnRenamed("r", "r_i")
        cols = sums.select("period", F.col("i").alias("j"), F.col("r").alias("r_j"))
        return cells.join(rows, ["period", "i"]).join(cols, ["period", "j"])

    cells = with_marginals(matrix, kept)
    if recompute_marginals:
        cells = cells.select("period", "i", "j", "n")
        kept = row_sums(cells)
        cells = with_marginals(cells, kept)
    # One row per period.
    totals = kept.groupBy("period").agg(F.sum("r").alias("_total"))
    # Logs, as products of counts pass what a bigint holds. What rounding leaves of a ratio of one
    # is not positive.
    pmi = F.log("n") + F.log("_total") - F.log("r_i") - F.log("r_j")
    return (
        cells.join(F.broadcast(totals), "period")
        .select("period", "i", "j", pmi.alias("pmi"))
        .where(F.col("pmi") > 1e-12)
    )
