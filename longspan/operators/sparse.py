"""Counts of any number of features as sparse rows, and covariances over them.

A patient is one row with a map from a feature's place to its count; no column stands for a feature,
so neither plans nor rows grow with the features that a patient does not have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from longspan.operators.features import main_counts
from longspan.operators.joins import lookup_join
from longspan.operators.ranking import dense_ids


def feature_places(curated: DataFrame) -> DataFrame:
    """(feature_id, place) of the flagged features, numbered from 1 in their order."""
    flagged = curated.where((F.col("flag") == 1) & F.col("feature_id").isNotNull())
    return dense_ids(flagged.select("feature_id").distinct(), "feature_id", "place")


def sparse_counts(events: DataFrame, places: DataFrame, main_code: str, main_concept: str) -> DataFrame:
    """The counts of `patient_counts`, and `counts`: a map from place to count, without zeros.

    Events shrink to (patient, place) on the map side; a patient's map has at most one entry for
    each feature. Events of other features count for the totals only.
    """
    known = events.where(F.col("patient_num").isNotNull()).select("patient_num", "feature_id")
    cells = (
        lookup_join(known, places, ["feature_id"], "left")
        .groupBy("patient_num", "place")
        .agg(*main_counts(main_code, main_concept))
    )
    entry = F.when(F.col("place").isNotNull(), F.struct("place", F.col("utl").alias("n")))
    return (
        cells.groupBy("patient_num")
        .agg(
            *[F.sum(c).alias(c) for c in ("utl", "code", "concept")],
            F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("counts"),
        )
        .withColumn("code_concept", F.col("code") + F.col("concept"))
    )


def sparse_covariance(rows: DataFrame, counts: str = "counts") -> DataFrame:
    """(a, b, n_both, cov), a <= b: sample covariance over all patients of the log counts of the
    features that some patient has both of.

    Pairs are made a patient's feature at a time and summed on the map side. A pair that no patient
    has is not listed; its covariance follows from the two means alone.
    """
    logged = F.transform(
        F.map_entries(counts), lambda e: F.struct(e.key.alias("place"), F.log1p(e.value).alias("x"))
    )
    entries = rows.select(F.array_sort(logged).alias("_all"))
    first = entries.select("_all", F.posexplode("_all").alias("_at", "_a"))
    later = F.slice("_all", F.col("_at") + 1, F.size("_all") - F.col("_at"))
    pairs = first.select("_a", F.explode(later).alias("_b")).groupBy(
        F.col("_a.place").alias("a"), F.col("_b.place").alias("b")
    ).agg(F.count("*").alias("n_both"), F.sum(F.col("_a.x") * F.col("_b.x")).alias("_sum"))
    # One row for each feature.
    sums = entries.select(F.explode("_all").alias("_a")).groupBy(F.col("_a.place").alias("place")).agg(
        F.sum("_a.x").alias("_total")
    )
    for side in ("a", "b"):
        pairs = lookup_join(pairs, sums.select(F.col("place").alias(side), F.col("_total").alias(f"_{side}")), [side], "inner")
    n = rows.agg(F.count("*").cast("double").alias("n")).scalar()
    cov = F.try_divide(F.col("_sum") - F.col("_a") * F.col("_b") / n, n - 1)
    return pairs.select("a", "b", "n_both", cov.alias("cov"))
