"""Cohorts, demographic recoding, first events, ever-flags and label assignment."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from longspan.functions import columns as C
from longspan.operators.joins import lookup_join

# Canonical race levels, the source titles that map to them, and the titles and
# ethnicity titles that stand for "not known".
RACE_LEVELS = {
    "American Indian/Alaska Native": ["ALASKA NATIVE", "AMERICAN INDIAN/ALASKA NATIVE"],
    "Asian": ["CHINESE", "ASIAN INDIAN", "FILIPINO", "JAPANESE", "KOREAN", "OTHER ASIAN"],
    "Native Hawaiian or Other Pacific Islander": ["NATIVE HAWAIIAN", "OTHER PACIFIC ISLANDER"],
}
RACE_UNKNOWN = [
    "OTHER",
    "UNREPORTED",
    "NOT SPECIFIED",
    "CHOSE NOT TO DISCLOSE RACE",
    "Unknown or Not Reported",
    "UNREPORTED,CHOSE NOT TO DISCLOSE RACE",
    "NA",
]
ETHNICITY_UNKNOWN = [
    "NOT SPECIFIED",
    "UNREPORTED/CHOSE NOT TO DISCLOSE",
    "UNREPORTED",
    "CHOSE NOT TO DISCLOSE",
]
UNKNOWN_RACE_LEVEL = "Unknown or Not Reported"

# Registry diagnosis codes that count as case and as non-case.
REGISTRY_CASE_CODES = [1, 2, 3, 4, 5, 6, 9, 10]
REGISTRY_CONTROL_CODES = [7, 8, 11, 12]
# Chart-review codes.
REVIEW_CASE_CODES = [1]
REVIEW_CONTROL_CODES = [2, 3]


def build_cohort(
    flags: DataFrame, id_map: DataFrame, demographics: DataFrame, race: int = 7, ethnicity: int = 2
) -> DataFrame:
    """Flagged patients with mapped id and demographics, one derived flag, known sex only.

    `flags(patient_num, flagged, ...)`, `id_map(patient_num, mapping_index)`,
    `demographics(mapping_index, sex, race_code, ethnicity_code, ...)`.
    """
    match = (F.col("race_code") == race) & (F.col("ethnicity_code") == ethnicity)
    return (
        flags.where(F.col("flagged") == 1)
        .drop("flagged")
        .join(id_map, "patient_num", "left")
        .join(demographics, "mapping_index", "left")
        .withColumn("majority", C.flag(match))
        .where(F.col("sex").isNotNull())
    )


def recode_race(title: Column) -> Column:
    """Canonical level; null and the not-known titles become one level, others stay."""
    unknown = title.isNull() | C.in_set(title, RACE_UNKNOWN)
    return F.when(unknown, F.lit(UNKNOWN_RACE_LEVEL)).otherwise(C.recode(title, RACE_LEVELS))


def recode_ethnicity(title: Column) -> Column:
    unknown = title.isNull() | C.in_set(title, ETHNICITY_UNKNOWN)
    return F.when(unknown, F.lit("unknown")).otherwise(title)


def impute_category(
    df: DataFrame, imputed: DataFrame, key: str, names: Sequence[str], unknown: Iterable[str]
) -> DataFrame:
    """Fill unknown categories from a second source that has the same column names."""
    other = imputed.select(key, *[F.col(c).alias(f"{c}_imputed") for c in names])
    joined = df.join(other, key, "left")
    return joined.withColumns(
        {c: C.fill_unknown(F.col(c), F.col(f"{c}_imputed"), unknown) for c in names}
    ).drop(*[f"{c}_imputed" for c in names])


def diagnosis_date(
    diag_year: Column, diag_month: Column, diag_day: Column, symptom_year: Column
) -> Column:
    """Diagnosis date; without a diagnosis year the first-symptom year's mid-July.

    The month and day fall back when the year is missing; a missing month or day of a known year
    falls back on its own too.
    """
    known = diag_year.isNotNull()
    month = F.when(known, F.coalesce(diag_month, F.lit(7))).otherwise(F.lit(7))
    day = F.when(known, F.coalesce(diag_day, F.lit(15))).otherwise(F.lit(15))
    return C.date_of(F.coalesce(diag_year, symptom_year), month, day)


def with_duration(df: DataFrame, start: str, reference: date, name: str) -> DataFrame:
    return df.withColumn(name, C.years_between(F.lit(reference), F.col(start)))


def first_dates(events: DataFrame, codes: Sequence[str] | None = None) -> DataFrame:
    """First date per patient and code, combined on the map side."""
    if codes is not None:
        events = events.where(F.col("feature_id").isin(list(codes)))
    return events.groupBy("patient_num", "feature_id").agg(F.min("start_date").alias("first_date"))


def first_anchor(events: DataFrame, anchor: str) -> DataFrame:
    return first_dates(events, [anchor]).drop("feature_id")


def ages_at_anchor(
    events: DataFrame, patients: DataFrame, anchor: str, reference: date
) -> DataFrame:
    """Every patient with first anchor date, age then and years from then to the reference date.

    `patients(patient_num, birth_date, ...)`.
    """
    joined = patients.join(first_anchor(events, anchor), "patient_num", "left")
    return joined.withColumns(
        {
            "age_at_diag": C.years_between(F.col("first_date"), F.col("birth_date")),
            "disease_duration": C.years_between(F.lit(reference), F.col("first_date")),
        }
    )


def ever_flag(events: DataFrame, codes: DataFrame, name: str = "ever_treated") -> DataFrame:
    """yes/no per patient: any event whose code is in the code list.

    The flag is combined on the map side, so a patient is one row per task in the shuffle.
    """
    listed = codes.select("feature_id").withColumn("_listed", F.lit(True))
    return (
        lookup_join(events.select("patient_num", "feature_id"), listed, ["feature_id"], "left")
        .groupBy("patient_num")
        .agg(F.bool_or(F.coalesce("_listed", F.lit(False))).alias("_any"))
        .select("patient_num", F.when(F.col("_any"), "yes").otherwise("no").alias(name))
    )


def anchor_and_flag(
    events: DataFrame, anchor: str, codes: DataFrame, name: str = "ever_treated"
) -> DataFrame:
    """First anchor date and `ever_flag` per patient, in one pass over the events."""
    listed = codes.select("feature_id").withColumn("_listed", F.lit(True))
    own = F.min(F.when(F.col("feature_id") == anchor, F.col("start_date")))
    return (
        lookup_join(events.select("patient_num", "start_date", "feature_id"), listed, ["feature_id"], "left")
        .groupBy("patient_num")
        .agg(own.alias("first_date"), F.bool_or(F.coalesce("_listed", F.lit(False))).alias("_any"))
        .withColumn(name, F.when(F.col("_any"), "yes").otherwise("no"))
        .drop("_any")
    )


def site_summary(found: DataFrame, patients: DataFrame) -> DataFrame:
    """First dates and flags for the listed patients of all sites.

    `found` is from `anchor_and_flag`, `patients(patient_num, birth_date, site, reference)` has
    each site's reference date.
    """
    return found.join(patients, "patient_num", "right").withColumns(
        {
            "age_at_diag": C.years_between(F.col("first_date"), F.col("birth_date")),
            "disease_duration": C.years_between(F.col("reference"), F.col("first_date")),
        }
    )


def id_crosswalk(linkage: DataFrame, clinical: DataFrame, known: DataFrame) -> DataFrame:
    """Study id to patient id to clinical row, for patients that have events.

    `linkage(study_id, patient_num)`, `clinical(study_id, ...)`, `known(patient_num)`.
    """
    return linkage.join(clinical, "study_id").join(
        known.select("patient_num").distinct(), "patient_num", "left_semi"
    )


def assign_labels(
    patients: DataFrame, review: DataFrame, registry: DataFrame
) -> DataFrame:
    """Adds is_case (1/0/null), is_registry and is_labeled.

    The registry overrides chart review, and within each a non-case code overrides a case code,
    so the answer per source is a minimum of 0/1 over that patient's rows.
    `review(patient_num, ms)`, `registry(patient_num, enrollment_diagnosis)`.
    """

    def answer(code: str, case: Mapping, control: Mapping) -> Column:
        return F.min(
            F.when(F.col(code).isin(list(control)), 0).when(F.col(code).isin(list(case)), 1)
        )

    reviewed = review.groupBy("patient_num").agg(
        answer("ms", REVIEW_CASE_CODES, REVIEW_CONTROL_CODES).alias("_review")
    )
    registered = registry.groupBy("patient_num").agg(
        answer("enrollment_diagnosis", REGISTRY_CASE_CODES, REGISTRY_CONTROL_CODES).alias(
            "_registry"
        ),
        F.lit(True).alias("_in_registry"),
    )
    return (
        patients.join(reviewed, "patient_num", "left")
        .join(registered, "patient_num", "left")
        .withColumns(
            {
                "is_case": F.coalesce("_registry", "_review"),
                "is_registry": F.coalesce("_in_registry", F.lit(False)),
            }
        )
        .withColumn("is_labeled", F.when(F.col("is_case").isNull(), 0).otherwise(1))
        .drop("_review", "_registry", "_in_registry")
    )


def label_or_prediction(df: DataFrame, label: str, prediction: str, name: str) -> DataFrame:
    """The label where there is one, else the prediction."""
    return df.withColumn(name, F.coalesce(F.col(label), F.col(prediction)))
