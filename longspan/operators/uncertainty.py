"""Spread of per-patient cosines, and what it says about a yearly cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from longspan.operators.cooccur import BLOCK_CELLS, daily_counts
from longspan.operators.embed import leading_vectors
from longspan.operators.lanczos import leading_pairs
from longspan.operators.moments import merged_states, moment_states, sample_variance
from longspan.sources.resume import Steps

#: Dimensions of a patient's vectors, and codes up to which one dense solve is made.
DIMS, DENSE = 100, 256
COSINE_SCHEMA = "period int, patient_num bigint, feature_id string, cos double"


def neighbour_sums(
    day: np.ndarray, place: np.ndarray, m: np.ndarray, size: int, window: int
) -> np.ndarray:
    """Row sums of the symmetric co-occurrence table, without the table.

    A record meets the records of the `window` days before and after it; differences of running
    sums over days give their number, and those over a code's own days the diagonal, which the
    table holds once.
    """

    def met(key: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        running = np.concatenate([[0], np.cumsum(m[order])])
        keys = key[order]
        before = running[np.searchsorted(keys, key, "left")]
        before = before - running[np.searchsorted(keys, np.maximum(key - window, floor), "left")]
        after = running[np.searchsorted(keys, key + window, "right")]
        return before, after - running[np.searchsorted(keys, key, "right")]

    earlier, later = met(day, np.full(len(day), day.min()))
    span = int(day.max() - day.min()) + window + 1
    own, _ = met(place * span + day - day.min(), place * span)
    return np.bincount(place, m * (earlier + later - own), size)


def _anchor_cosines(
    day: np.ndarray, code: np.ndarray, m: np.ndarray, anchor: str, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """Codes with a value and their cosines with the anchor, within one patient and period."""
    none = np.array([], dtype=object), np.array([], dtype=float)
    codes, place = np.unique(code, return_inverse=True)
    if anchor not in codes:
        return none
    kept = neighbour_sums(day, place, m, len(codes), window) > 5
    if kept.sum() < 5 or not kept[np.searchsorted(codes, anchor)]:
        return none
    codes, rows = codes[kept], kept[place]
    place = (np.cumsum(kept) - 1)[place[rows]]
    pairs = PatientPairs(day[rows], place, m[rows], len(codes), window)
    if len(codes) <= DENSE:
        vectors = leading_vectors(np.vstack([pmi for _, pmi in pairs.pmi()]), DIMS)
    else:
        values, found = leading_pairs(pairs.times, len(codes), DIMS)
        positive = values > 1e-10 * max(1.0, float(np.abs(values).max()))
        vectors = found[:, positive] * np.sqrt(values[positive])
    if vectors.shape[1] < 3:
        return none
    length = np.linalg.norm(vectors, axis=1)
    at = np.searchsorted(codes, anchor)
    usable = length > 1e-12
    if not usable[at]:
        return none
    return codes[usable], vectors[usable] @ vectors[at] / (length[usable] * length[at])


class PatientPairs:
    """One patient's positive PMI by blocks of rows, made anew from daily counts for each use.

    What is held is days by codes, so memory grows with the codes and not with their square.
    """

    def __init__(self, day: np.ndarray, place: np.ndarray, m: np.ndarray, size: int, window: int):
        days, row = np.unique(day, return_inverse=True)
        self.size, self.own = size, np.zeros((len(days), size))
        np.add.at(self.own, (row, place), m)
        running = np.vstack([np.zeros((1, size)), np.cumsum(self.own, axis=0)])
        self.earlier = running[:-1] - running[np.searchsorted(days, days - window, side="left")]
        # Pairs count in both directions, those of a code with itself once.
        met = self.own.T @ self.earlier.sum(axis=1) + self.earlier.T @ self.own.sum(axis=1)
        self.sums = met - np.einsum("dk,dk->k", self.own, self.earlier)

    def pmi(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, block of rows); codes without pairs have none."""
        step = max(1, BLOCK_CELLS // 4 // self.size)
        total = self.sums.sum()
        inverse = np.divide(1.0, self.sums, out=np.zeros(self.size), where=self.sums > 0)
        for first in range(0, self.size, step):
            rows = slice(first, min(first + step, self.size))
            block = self.own[:, rows].T @ self.earlier
            block += self.earlier[:, rows].T @ self.own
            line = np.arange(block.shape[0])
            block[line, first + line] /= 2
            block *= inverse[rows, None] * total
            block *= inverse
            # A ratio of one or less has no positive information.
            np.log(np.maximum(block, 1.0, out=block), out=block)
            yield first, block

    def times(self, vectors: np.ndarray) -> np.ndarray:
        return np.vstack([block @ vectors for _, block in self.pmi()])


def year_starts(table: pa.Table) -> np.ndarray:
    """Places where a patient's year begins, in rows sorted by patient and period."""
    patient, period = table["patient_num"], table["period"].to_numpy()
    known = patient.is_valid().to_numpy()
    number = patient.fill_null(0).to_numpy()
    change = (number[1:] != number[:-1]) | (known[1:] != known[:-1]) | (period[1:] != period[:-1])
    return np.concatenate([[0], 1 + np.flatnonzero(change)])


def whole_years(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches cut anew so that no patient's year reaches over two tables.

    What is held is one batch and the year that is not yet known to be complete.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            seam = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
            if len(year_starts(seam)) > 1:
                yield pa.Table.from_batches(held)
                held = []
        cut = int(year_starts(pa.Table.from_batches([batch]))[-1])
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def solvable_years(
    year: np.ndarray, day: np.ndarray, code: np.ndarray, m: np.ndarray, anchor: int, window: int
) -> np.ndarray:
    """Whether each patient's year keeps five codes with the anchor among them, the least that
    `_anchor_cosines` needs.

    `year` numbers the years 0, 1 and so on, and `code` the codes. Years are laid end to end, more
    than a window apart, so one pass of running sums serves all of them.
    """
    years, codes = int(year.max()) + 1, int(code.max()) + 1
    apart = int(day.max() - day.min()) + window + 1
    cells, place = np.unique(year.astype(np.int64) * codes + code, return_inverse=True)
    line = year.astype(np.int64) * apart + (day - day.min())
    kept = cells[neighbour_sums(line, place, m, len(cells), window) > 5]
    enough = np.bincount(kept // codes, minlength=years) >= 5
    anchored = np.zeros(years, bool)
    anchored[kept[kept % codes == anchor] // codes] = True
    return enough & anchored


def patient_cosines(
    events: DataFrame, anchor: str, window: int = 30, least_records: int = 20
) -> DataFrame:
    """Cosine of each code to the anchor within single patients and periods.

    Patients with more than `least_records` records in the period take part. A patient's year is
    (day, code, count) rows, at most 366 per code, whatever the number of records. Years come to
    Python many to a batch and are checked side by side for enough codes with neighbours; only those
    that have them are solved one by one. A patient with many codes is solved by products with
    blocks of rows, in memory that grows with the codes only. A patient without a usable vector
    gives one row with null code and cosine.
    """
    # Windows over the partitions that the solve needs anyway. Who lacks the anchor or has no date
    # can have no cosine and never reaches Python.
    year = ["patient_num", "period"]
    whole = W.partitionBy(*year)
    rows = (
        daily_counts(events)
        .repartition(*year)
        .withColumn("_records", F.sum("m").over(whole))
        .where(F.col("_records") > least_records)
        .drop("_records")
        .withColumn("_anchor", F.bool_or(F.col("code") == anchor).over(whole) & F.col("day").isNotNull())
    )
    without = rows.where(~F.col("_anchor")).select("period", "patient_num").distinct().select(
        "period", "patient_num", F.lit(None).cast("string").alias("feature_id"), F.lit(None).cast("double").alias("cos")
    )
    rows = rows.where("_anchor").drop("_anchor").sortWithinPartitions(*year)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_years(batches):
            first = year_starts(table)
            period = table["period"].to_numpy()[first]
            patient = table["patient_num"].take(pa.array(first)).combine_chunks().cast(pa.int64())
            day, m = table["day"].to_numpy(), table["m"].to_numpy()
            codes = pa.concat_arrays(table["code"].fill_null("None").chunks).dictionary_encode()
            names = codes.dictionary.to_numpy(zero_copy_only=False).astype(str)
            code = codes.indices.to_numpy()
            last = np.append(first[1:], len(day))
            owner = np.repeat(np.arange(len(first)), last - first)
            # The anchor has rows in every year that comes here.
            worth = solvable_years(owner, day, code, m, int(np.flatnonzero(names == anchor)[0]), window)
            places, labels, values = [], [], []
            for k in np.flatnonzero(worth):
                rows = slice(first[k], last[k])
                found, cos = _anchor_cosines(day[rows], names[code[rows]], m[rows], anchor, window)
                worth[k] = len(found) > 0
                places.append(np.full(len(found), k))
                labels.extend(found.tolist())
                values.extend(cos.tolist())
            idle = np.flatnonzero(~worth)
            at = np.concatenate([*places, idle]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(period[at], pa.int32()),
                    patient.take(pa.array(at)),
                    pa.array(labels + [None] * len(idle), pa.string()),
                    pa.array(values + [None] * len(idle), pa.float64()),
                ],
                names=["period", "patient_num", "feature_id", "cos"],
            )

    return rows.select("period", "patient_num", "day", "code", "m").mapInArrow(solve, COSINE_SCHEMA).unionByName(without)


def cosine_variance(cosines: DataFrame, events: DataFrame) -> DataFrame:
    """Variance over patients per period and code, with the counts that scale it.

    `n_original` counts the period's patients before the record cut, `n_total` those that took
    part, `n_valid` those with a value for the code.
    """
    original = (
        events.select(F.year("start_date").cast("int").alias("period"), "patient_num")
        .distinct()
        .groupBy("period")
        .agg(F.count("*").alias("n_original"))
    )
    # Patients and their values in one aggregate pass each; both results are tiny per period.
    total = cosines.select("period", "patient_num").distinct().groupBy("period").agg(
        F.count("*").alias("n_total")
    )
    per_code = (
        cosines.where(F.col("cos").isNotNull())
        .groupBy("period", "feature_id")
        .agg(F.var_samp("cos").alias("emph_var"), F.count("*").alias("n_valid"))
    )
    # One row per period on the broadcast sides.
    return per_code.join(F.broadcast(total), "period").join(F.broadcast(original), "period")


def batched_variance(events: DataFrame, steps: Steps, anchor: str, batches: int = 4, **how) -> DataFrame:
    """What `cosine_variance` gives, from patient batches that are computed and stored one by one.

    The events are written by batch once; each batch's cosines become moment states by period and
    code, with its numbers of patients, and only these are stored. A later application reads the
    batches that are finished. Batches are a hash of the patient, so none of them is a hot one.
    """
    batch = F.pmod(F.xxhash64("patient_num"), F.lit(batches)).cast("int")
    narrow = events.select("patient_num", "start_date", "feature_id", batch.alias("batch"))
    dealt = steps.step("events", lambda: narrow.repartition("batch", "patient_num"), ["batch"], batches=batches)
    told = {"anchor": anchor, "batches": batches, **how}
    states, patients = [], []
    for k in range(batches):
        own = dealt.where(F.col("batch") == k).drop("batch")
        cosines = steps.step("cosines", lambda: patient_cosines(own, anchor, **how), batch=k, **told)
        states.append(steps.step("moments", lambda: moment_states(cosines, ["period", "feature_id"], "cos"), batch=k, **told))
        patients.append(steps.step("patients", lambda: patient_numbers(cosines, own), batch=k, **told))
    merged = merged_states(reduce(DataFrame.unionByName, states), ["period", "feature_id"])
    numbers = reduce(DataFrame.unionByName, patients).groupBy("period").agg(
        F.sum("n_total").alias("n_total"), F.sum("n_original").alias("n_original")
    )
    # One row per period on the broadcast side.
    return merged.select(
        "period", "feature_id", sample_variance().alias("emph_var"), F.col("state.n").alias("n_valid")
    ).join(F.broadcast(numbers.where("n_total > 0")), "period")


def patient_numbers(cosines: DataFrame, events: DataFrame) -> DataFrame:
    """Per period the patients that took part and all of them."""
    total = cosines.select("period", "patient_num").distinct().groupBy("period").agg(F.count("*").alias("n_total"))
    original = (
        events.select(F.year("start_date").cast("int").alias("period"), "patient_num")
        .distinct()
        .groupBy("period")
        .agg(F.count("*").alias("n_original"))
    )
    return original.join(total, "period", "left").fillna(0, ["n_total"])


def scaled_spread(
    variance: DataFrame, least_effective: float = 50, root_of_mean: bool = False
) -> DataFrame:
    """Adds `sd`: the variance over the root of the effective number of patients.

    The effective number is n_original / n_total * n_valid; at or below `least_effective` the
    result is null. With `root_of_mean` the usual sqrt(variance / n) is taken instead.
    """
    effective = F.col("n_original") / F.col("n_total") * F.col("n_valid")
    plain = F.col("emph_var") / F.sqrt(effective)
    usual = F.sqrt(F.col("emph_var") / effective)
    return variance.withColumn("n_effective", effective).withColumn(
        "sd", F.when(effective > least_effective, usual if root_of_mean else plain)
    )
