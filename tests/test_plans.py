"""What the physical plans must and must not contain."""

import pytest

import __spark_entry__ as entry
from longspan.operators import features
from longspan.sources import stages
from longspan.plans.base import Inputs

PLAIN = [
    "patient_counts", "wide_matrix", "table_one", "yearly_prevalence", "exclude_out_of_range",
    "carry_forward", "harmonise_codes", "pseudo_events", "cooccurrence", "sppmi", "ols_trend",
    "segmented_trend", "smooth_series", "trend_comparison",
    "roc_curve", "metrics_at_specificity", "numeric_summary", "label_assignment",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_cartesian_product_and_no_python(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    for python in ("PythonUDF", "ArrowEvalPython", "FlatMapGroups", "MapInPandas", "BatchEvalPython"):
        assert python not in text


@pytest.fixture
def staged(monkeypatch):
    """Plans of everything that is written on the way."""
    plans, save = [], stages.save_table

    def record(df, *args):
        plans.append(plan(df))
        return save(df, *args)

    monkeypatch.setattr(stages, "save_table", record)
    return plans


@pytest.mark.parametrize("name", ["cooccurrence", "sppmi", "metrics_at_specificity", "corrupt_split"])
def test_staged_steps_have_no_cartesian_product_and_no_python(spark, sf_dir, staged, name):
    plan(entry.queries()[name](spark, sf_dir))
    assert staged
    for text in staged:
        assert "CartesianProduct" not in text and "Python" not in text and "InPandas" not in text


@pytest.mark.parametrize("name,most", [("corrupt_split", 1), ("site_summary_join", 1), ("harmonise_codes", 4), ("class_features", 1), ("table_one_sites", 1)])
def test_scans_of_the_event_source(spark, sf_dir, staged, name, most):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert sum(t.count("lineitem.parquet") for t in [text, *staged]) <= most


def test_scan_reads_only_used_columns(spark, sf_dir):
    text = plan(features.yearly_prevalence(Inputs(spark, sf_dir).ehr, 1996, 1997))
    assert "l_extendedprice" not in text and "p_retailprice" not in text
    assert "l_shipdate" in text


def test_year_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.sql(
        "select id as patient_num, date'2020-01-01' as start_date, 'a' as feature_id,"
        " cast(2000 + id % 3 as int) as year from range(30)"
    ).write.partitionBy("year").parquet(path)
    text = plan(spark.read.parquet(path).where("year = 2001 and feature_id = 'a'"))
    assert "PartitionFilters: [isnotnull(year" in text and "EqualTo(feature_id,a)" in text


def test_years_reach_the_row_groups(spark, tmp_path):
    """Bounds of years are pushed to the scan, and clustered files let it skip most rows."""
    events = spark.range(40_000).selectExpr(
        "id % 97 as patient_num", "date_add(date'2000-01-01', cast(id * 7919 % 7300 as int)) as start_date", "'a' as feature_id"
    )
    path = str(tmp_path / "clustered")
    stages.save_clustered(events, path, ["start_date"], files=16)
    found = features.yearly_prevalence(stages.load_table(spark, path), 2004, 2004)
    text = plan(found)
    assert "GreaterThanOrEqual(start_date,2004-01-01)" in text and "LessThan(start_date,2005-01-01)" in text

    bounded = features.in_years(stages.load_table(spark, path), 2004, 2004)
    bounded.collect()
    leaves = bounded._jdf.queryExecution().executedPlan().collectLeaves()
    read = leaves.head().metrics().get("numOutputRows").get().value()
    assert bounded.count() <= read < 40_000 / 4
    assert {r.year for r in found.collect()} == {2004}
