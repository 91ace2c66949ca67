"""Event counts, code harmonisation, pseudo-events, vocabulary, carry-forward and prevalence."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from longspan.functions import columns as C
from longspan.operators.joins import lookup_join
from longspan.operators.ranking import dense_ids

# Code namespaces that are kept, and the procedure prefix that is shortened.
NAMESPACES = ["RXNORM", "PheCode", "LOINC", "CCS"]
PROCEDURE_PREFIX = ("CCS-PCS:", "CCS:")

RUN = 10_000


def main_counts(main_code: str, main_concept: str) -> list[Column]:
    return [
        F.count("*").alias("utl"),
        F.count_if(F.col("feature_id") == main_code).alias("code"),
        F.count_if(F.col("feature_id") == main_concept).alias("concept"),
    ]


def patient_counts(events: DataFrame, main_code: str, main_concept: str) -> DataFrame:
    """Events, main-code events, main-concept events and the latter two's sum per patient."""
    return (
        events.where(F.col("patient_num").isNotNull())
        .groupBy("patient_num")
        .agg(*main_counts(main_code, main_concept))
        .withColumn("code_concept", F.col("code") + F.col("concept"))
    )


def feature_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("feature_id").agg(F.count("*").alias("n"))


def feature_set(lists: Sequence[DataFrame], drop: Sequence[str]) -> DataFrame:
    """Distinct codes of several lists without the main codes."""
    out = lists[0].select("feature_id")
    for more in lists[1:]:
        out = out.union(more.select("feature_id"))
    return out.distinct().where(C.not_in_set(F.col("feature_id"), drop))


def flagged(curated: DataFrame, kind: str, most: int = 2_000) -> list[str]:
    """Flagged features of one kind, sorted. They become columns, so the list must be short."""
    rows = (
        curated.where((F.col("flag") == 1) & (F.col("kind") == kind) & F.col("feature_id").isNotNull())
        .select("feature_id").distinct().limit(most + 1).collect()
    )
    if len(rows) > most:
        raise ValueError(f"more than {most} flagged features of kind {kind}")
    return sorted(r.feature_id for r in rows)


def wide_matrix(
    events: DataFrame, main_code: str, main_concept: str, features: Sequence[str]
) -> DataFrame:
    """The counts of `patient_counts` and one count column per listed feature, 0 where absent.

    The column list is known, so the pivot is one aggregate: one pass and one shuffle.
    """
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature_id"))
    return (
        events.where(F.col("patient_num").isNotNull())
        .select("patient_num", "feature_id", place.alias("_place"))
        .groupBy("patient_num")
        .agg(
            *main_counts(main_code, main_concept),
            *[F.count_if(F.col("_place") == k).alias(f) for k, f in enumerate(features, 1)],
        )
        .withColumn("code_concept", F.col("code") + F.col("concept"))
    )


def harmonise(events: DataFrame) -> DataFrame:
    """Shorten procedure codes, derive namespace and year, keep the four namespaces."""
    code = F.replace(F.col("feature_id"), F.lit(PROCEDURE_PREFIX[0]), F.lit(PROCEDURE_PREFIX[1]))
    return (
        events.withColumn("feature_id", code)
        .withColumns(
            {"year": F.year("start_date"), "namespace": C.namespace(F.col("feature_id"))}
        )
        .where(F.col("namespace").isin(NAMESPACES))
    )


def keep_patients(events: DataFrame, patients: DataFrame) -> DataFrame:
    """Events of listed patients.

    Both sides are plain shuffles, so Spark's adaptive skew join splits a patient with very many
    events as it runs, without a pass of its own over the events.
    """
    ids = patients.select("patient_num").distinct()
    return events.join(ids, "patient_num", "left_semi")


def drop_patients(events: DataFrame, patients: DataFrame) -> DataFrame:
    ids = patients.select("patient_num").distinct()
    return events.join(ids, "patient_num", "left_anti")


def pseudo_events(monthly: DataFrame, starts: DataFrame, anchor: str) -> DataFrame:
    """Dated events rebuilt from monthly counts.

    Months count from the patient's first anchor month, taken as 30 days each; the n events of a
    month lie evenly in it. Patients without an anchor month or start date drop out.
    `monthly(patient_num, feature_id, month, n)`, `starts(patient_num, start_date)`.
    """
    coded = monthly.where(F.contains(F.col("feature_id"), F.lit(":")) & (F.col("n") >= 1))
    coded = coded.withColumn("namespace", C.namespace(F.col("feature_id"))).where(
        F.col("namespace").isin(NAMESPACES)
    )
    origin = (
        coded.where(F.col("feature_id") == anchor)
        .groupBy("patient_num")
        .agg(F.min("month").alias("_origin"))
        .join(starts.withColumnRenamed("start_date", "_start"), "patient_num")
    )
    # A very large count is cut into runs, so that no row unfolds into more than RUN events and
    # the runs of one month can go to different tasks.
    last = F.floor((F.col("n") - 1) / F.lit(RUN))
    runs = coded.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    within = F.sequence(
        F.col("_run") * RUN, F.least((F.col("_run") + 1) * RUN, F.col("n")) - F.lit(1)
    )
    days = (F.col("month") - F.col("_origin")) * 30 + F.rint(
        F.col("_k") / F.col("n") * 30
    ).cast("int")
    return (
        runs.join(origin, "patient_num")
        .withColumn("_k", F.explode(within))
        .withColumn("start_date", F.date_add("_start", days.cast("int")))
        .select(
            "patient_num", "start_date", "feature_id", F.year("start_date").alias("year"), "namespace"
        )
    )


def vocabulary(events: DataFrame, curated: DataFrame | None = None, least: int = 100) -> DataFrame:
    """Codes that are curated or have more than `least` events, with counts and dense ids."""
    counts = feature_counts(events)
    if curated is None:
        counts = counts.where(F.col("n") > least)
    else:
        listed = curated.select("feature_id").distinct().withColumn("_listed", F.lit(True))
        counts = counts.join(listed, "feature_id", "left").where(
            F.coalesce("_listed", F.lit(False)) | (F.col("n") > least)
        ).drop("_listed")
    return dense_ids(counts, "feature_id")


def with_ids(events: DataFrame, vocab: DataFrame) -> DataFrame:
    """Events whose code is in the vocabulary, with its id."""
    return lookup_join(events, vocab.select("feature_id", "id"), ["feature_id"], "inner")


def carry_forward(events: DataFrame, codes: Sequence[str], months: int = 24) -> DataFrame:
    """Turn each record of the listed therapies into monthly records, one per calendar month.

    The new records replace the therapies' own; within a month the earliest date stays.
    """
    steps = F.sequence(F.lit(0), F.lit(months - 1))
    chosen = C.in_set(F.col("feature_id"), codes)
    spread = (
        events.where(chosen)
        .select("patient_num", "feature_id", "start_date", F.explode(steps).alias("_k"))
        .withColumn("start_date", C.month_step(F.col("start_date"), F.col("_k")))
        .groupBy("patient_num", "feature_id", F.trunc("start_date", "MM").alias("_month"))
        .agg(F.min("start_date").alias("start_date"))
        .select("patient_num", "start_date", "feature_id")
    )
    rest = events.where(~chosen).select("patient_num", "start_date", "feature_id")
    return rest.unionByName(spread)


def class_events(events: DataFrame, codes: DataFrame) -> DataFrame:
    """Events plus a copy of each drug event under its class label.

    `codes(feature_id, treatment_class)`; a drug's first listed class counts.
    """
    classes = codes.select("feature_id", "treatment_class").where("treatment_class is not null")
    both = F.when(F.col("treatment_class").isNull(), F.array("feature_id")).otherwise(
        F.array("feature_id", "treatment_class")
    )
    # One pass: the row and its copy come out of one lookup.
    return (
        lookup_join(events, classes, ["feature_id"], "left")
        .withColumn("feature_id", F.explode(both))
        .select(*events.columns)
    )


def in_years(
    events: DataFrame, first_year: int | None = None, last_year: int | None = None
) -> DataFrame:
    """Events from the first day of one year to the last of another; a bound may be open.

    The bounds are stated on the date column itself, so they reach the Parquet scan, which skips row
    groups by their dates; files from `stages.save_clustered` have narrow ones.
    """
    if first_year is not None:
        events = events.where(F.col("start_date") >= F.lit(datetime.date(first_year, 1, 1)))
    if last_year is not None:
        events = events.where(F.col("start_date") < F.lit(datetime.date(last_year + 1, 1, 1)))
    return events


def yearly_prevalence(
    events: DataFrame, first_year: int | None = None, last_year: int | None = None
) -> DataFrame:
    """Patients with a code over patients active, and event count, per year and code.

    Each event counts once for its code and once for the year's total; both shrink to one row per
    (year, patient, code or total) on the map side, so one pass and one large shuffle give the
    numerators, the denominators and the event counts.
    """
    code = F.struct(F.lit(False).alias("_all"), F.col("feature_id"))
    total = F.struct(F.lit(True).alias("_all"), F.lit(None).cast("string").alias("feature_id"))
    years = in_years(events, first_year, last_year).withColumn("year", F.year("start_date"))
    cells = (
        years.select("year", "patient_num", F.inline(F.array(code, total)))
        .groupBy("year", "patient_num", "_all", "feature_id")
        .agg(F.count("*").alias("_events"))
    )
    # From here one row per year and code.
    active = F.max(F.when(F.col("_all"), F.col("n"))).over(W.partitionBy("year"))
    return (
        cells.groupBy("year", "_all", "feature_id")
        .agg(F.count("*").alias("n"), F.sum("_events").alias("totalcount"))
        .withColumn("npe", active)
        .where(~F.col("_all"))
        .withColumn("freq", F.col("n") / F.col("npe"))
        .select("year", "feature_id", "n", "npe", "freq", "totalcount")
    )


def in_range_counts(events: DataFrame, first: str, last: str) -> DataFrame:
    """Yearly code counts of patients none of whose records lie outside the dates.

    Records shrink to (patient, year, code) before patients are looked at as a whole, so a patient
    is at most years x codes rows there, and one pass over the events serves both steps.
    """
    day = F.lit(first).cast("date"), F.lit(last).cast("date")
    outside = (F.col("start_date") < day[0]) | (F.col("start_date") > day[1])
    cells = events.groupBy("patient_num", F.year("start_date").alias("year"), "feature_id").agg(
        F.count("*").alias("_n"), F.bool_or(F.coalesce(outside, F.lit(False))).alias("_out")
    )
    return (
        cells.withColumn("_any", F.bool_or("_out").over(W.partitionBy("patient_num")))
        .where(~F.col("_any"))
        .groupBy("feature_id", "year")
        .agg(F.sum("_n").alias("n"))
    )
