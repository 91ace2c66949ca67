"""Small literal frames with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from longspan.functions import columns as C, student
from longspan.operators import cohort, features
from longspan.operators.joins import null_safe_join


def one(spark, sql, col):
    return spark.sql(sql).select(col.alias("x")).first()[0]


def test_membership_keeps_nulls(spark):
    ids = spark.createDataFrame([("a",), (None,), ("b",)], "x string")
    kept = {r.x for r in ids.where(C.not_in_set(F.col("x"), ["a"])).collect()}
    assert kept == {None, "b"}


def test_three_valued_flag(spark):
    rows = spark.createDataFrame([(7, None), (1, None), (7, 2)], "race int, eth int")
    flag = C.flag((F.col("race") == 7) & (F.col("eth") == 2))
    assert [r.f for r in rows.select(flag.alias("f")).collect()] == [None, 0, 1]


def test_null_keys_match(spark):
    a = spark.createDataFrame([(1, None), (2, 0)], "k int, l int")
    b = spark.createDataFrame([(1, None, "x"), (2, 1, "y")], "k int, l int, v string")
    got = {r.k: r.v for r in null_safe_join(a, b, ["k", "l"], "left").collect()}
    assert got == {1: "x", 2: None}


def test_band_guard(spark):
    from longspan.operators.trend import with_band

    rows = spark.createDataFrame(
        [(0.5, None), (0.85, 0.1), (None, 0.1), (-0.05, 0.1)], "cos double, sd double"
    )
    got = [(r.high_se, r.low_se) for r in with_band(rows).collect()]
    assert got[0] == (None, None) and got[2] == (None, None)
    assert got[1][0] == 0.9 and got[1][1] == pytest.approx(0.654)
    assert got[3][0] == pytest.approx(0.146) and got[3][1] == -0.1


def test_month_step_overflows(spark):
    day = F.lit("2023-01-31").cast("date")
    got = spark.range(3).select(C.month_step(day, F.col("id").cast("int")).alias("d")).collect()
    assert [str(r.d) for r in got] == ["2023-01-31", "2023-03-03", "2023-03-31"]


def test_carry_forward_keeps_one_per_month(spark):
    events = spark.createDataFrame(
        [(1, dt.date(2023, 1, 31), "T"), (1, dt.date(2023, 5, 1), "X")],
        "patient_num bigint, start_date date, feature_id string",
    )
    got = features.carry_forward(events, ["T"], 3).collect()
    assert sorted((str(r.start_date), r.feature_id) for r in got) == [
        ("2023-01-31", "T"), ("2023-03-03", "T"), ("2023-05-01", "X"),
    ]


def test_pseudo_events_spread_and_round_half_even(spark):
    monthly = spark.createDataFrame(
        [(1, "PheCode:335", 5, 4), (1, "LOINC:1", 6, 1), (1, "LOINC:2", 6, 0), (2, "LOINC:1", 1, 3),
         (1, "C01", 6, 2)],
        "patient_num bigint, feature_id string, month int, n bigint",
    )
    starts = spark.createDataFrame(
        [(1, dt.date(2020, 1, 1)), (2, dt.date(2020, 1, 1))], "patient_num bigint, start_date date"
    )
    got = features.pseudo_events(monthly, starts, "PheCode:335").collect()
    days = sorted((r.feature_id, (r.start_date - dt.date(2020, 1, 1)).days) for r in got)
    assert days == [("LOINC:1", 30)] + [("PheCode:335", d) for d in (0, 8, 15, 22)]


def test_pseudo_events_beyond_one_run(spark, monkeypatch):
    monkeypatch.setattr(features, "RUN", 3)
    monthly = spark.createDataFrame(
        [(1, "PheCode:335", 1, 10)], "patient_num bigint, feature_id string, month int, n bigint"
    )
    starts = spark.createDataFrame([(1, dt.date(2020, 1, 1))], "patient_num bigint, start_date date")
    got = features.pseudo_events(monthly, starts, "PheCode:335").collect()
    assert sorted((r.start_date - dt.date(2020, 1, 1)).days for r in got) == list(range(0, 30, 3))


@pytest.mark.parametrize(
    "parts, want",
    [
        ((None, None, 3, 1990), "1990-07-15"),
        ((1995, None, 3, 1990), "1995-07-03"),
        ((1995, 2, 30, 1990), None),
        ((None, None, None, None), None),
    ],
)
def test_diagnosis_date(spark, parts, want):
    y, m, d, s = (F.lit(v).cast("int") for v in parts)
    got = one(spark, "select 1", cohort.diagnosis_date(y, m, d, s))
    assert (None if got is None else str(got)) == want


def test_bad_texts_are_null(spark):
    assert one(spark, "select 'abc' as t", C.parse_id(F.col("t"))) is None
    assert one(spark, "select '2023-02-30' as t", C.parse_date(F.col("t"), "yyyy-MM-dd")) is None
    got = one(spark, "select '03/02/2023' as t", C.parse_date(F.col("t"), "yyyy-MM-dd", "dd/MM/yyyy"))
    assert str(got) == "2023-02-03"


def test_race_levels(spark):
    rows = spark.createDataFrame([(None,), ("KOREAN",), ("NA",), ("WHITE",)], "t string")
    got = [r.x for r in rows.select(cohort.recode_race(F.col("t")).alias("x")).collect()]
    assert got == ["Unknown or Not Reported", "Asian", "Unknown or Not Reported", "WHITE"]


def test_ethnicity_levels(spark):
    rows = spark.createDataFrame([(None,), ("UNREPORTED",), ("HISPANIC",)], "t string")
    got = [r.x for r in rows.select(cohort.recode_ethnicity(F.col("t")).alias("x")).collect()]
    assert got == ["unknown", "unknown", "HISPANIC"]


def test_registry_overrides_review_and_control_overrides_case(spark):
    people = spark.createDataFrame([(k,) for k in range(1, 6)], "patient_num bigint")
    review = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (3, 1)], "patient_num bigint, ms int")
    registry = spark.createDataFrame(
        [(2, 7), (4, 9), (5, 1), (5, 12)], "patient_num bigint, enrollment_diagnosis bigint"
    )
    got = {
        r.patient_num: (r.is_case, r.is_registry, r.is_labeled)
        for r in cohort.assign_labels(people, review, registry).collect()
    }
    assert got == {
        1: (1, False, 1), 2: (0, True, 1), 3: (0, False, 1), 4: (1, True, 1), 5: (0, True, 1),
    }


@pytest.mark.parametrize(
    "t, df, want",
    [(2.5, 8, 0.0369420377), (1.0, 1, 0.5), (2.0, 2, 0.18350341907), (0.0, 5, 1.0),
     (-2.570581836, 5, 0.05)],
)
def test_student_tail(spark, t, df, want):
    got = one(spark, f"select {t}D as t, {df} as df", student.two_sided_p("t", "df"))
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("df, want", [(1, 12.7062047364), (2, 4.30265272991), (5, 2.57058183661),
                                      (20, 2.08596344727), (120, 1.97993040505)])
def test_student_critical_value(spark, df, want):
    got = one(spark, f"select {df} as df", student.critical_value(0.05, "df"))
    assert got == pytest.approx(want, rel=1e-9)


def test_student_null_when_no_freedom(spark):
    assert one(spark, "select 1D as t, 0 as df", student.two_sided_p("t", "df")) is None
    assert one(spark, "select 0 as df", student.critical_value(0.05, "df")) is None


def test_vocabulary_needs_more_than_least(spark):
    from longspan.operators import features

    rows = [(1, "a")] * 5 + [(1, "b")] * 2 + [(1, "c")]
    events = spark.createDataFrame(rows, "patient_num bigint, feature_id string")
    assert {r.feature_id for r in features.vocabulary(events, least=2).collect()} == {"a"}
    listed = spark.createDataFrame([("c",)], "feature_id string")
    assert {r.feature_id for r in features.vocabulary(events, listed, 2).collect()} == {"a", "c"}


def test_flagged_features_must_be_few(spark):
    from longspan.operators import features

    table = spark.createDataFrame([("b", "coded", 1), ("a", "coded", 1), ("c", "coded", 0), ("d", "concept", 1)], "feature_id string, kind string, flag int")
    assert features.flagged(table, "coded") == ["a", "b"]
    with pytest.raises(ValueError):
        features.flagged(table, "coded", most=1)
