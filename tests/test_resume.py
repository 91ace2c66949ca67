"""Steps that a later run goes on from, and the batch states they hold."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from longspan.operators import moments, uncertainty
from longspan.plans import network
from longspan.plans.base import Inputs
from longspan.sources.resume import Steps


@pytest.fixture
def jobs(spark):
    """Number of jobs that a function starts."""

    def count(run):
        group = f"count-{uuid.uuid4().hex}"
        spark.sparkContext.setJobGroup(group, "counted")
        try:
            return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    return count


def test_a_finished_step_is_read(spark, tmp_path):
    built = []

    def run(**told):
        steps = Steps(spark, str(tmp_path / "job"), seed=1)
        return steps.step("rows", lambda: built.append(told) or spark.range(5), **told).count()

    assert run(a=1) == run(a=1) == 5 and built == [{"a": 1}]
    run(a=2)
    assert built == [{"a": 1}, {"a": 2}]


def test_inputs_and_parameters_name_a_step(spark, tmp_path):
    source = str(tmp_path / "in")
    built = []

    def run(**job):
        steps = Steps(spark, str(tmp_path / "job"), [source], **job)
        return steps.step("sum", lambda: built.append(1) or spark.read.parquet(source).agg(F.sum("id").alias("s"))).first().s

    spark.range(4).write.parquet(source)
    assert run() == run() == 6 and len(built) == 1
    assert run(width=2) == 6 and len(built) == 2
    spark.range(4, 6).write.mode("append").parquet(source)
    assert run() == 15 and len(built) == 3


def test_a_run_that_was_ended_between_and_within_steps(spark, tmp_path):
    """The first run ends in its third batch; what it left half written is not read."""
    folder, built = str(tmp_path / "job"), []

    def run(broken=None):
        steps = Steps(spark, folder)

        def build(k):
            built.append(k)
            rows = spark.range(k, k + 3)
            return rows.select(F.raise_error(F.lit("ended")).cast("bigint").alias("id")) if k == broken else rows

        return steps, [steps.step("batch", lambda: build(k), batch=k).agg(F.sum("id")).first()[0] for k in range(4)]

    with pytest.raises(Exception, match="ended"):
        run(broken=2)
    assert built == [0, 1, 2]
    steps, sums = run()
    assert sums == [3, 6, 9, 12] and built == [0, 1, 2, 2, 3]
    assert steps.drop_stale() == 0  # young ones may belong to another application
    steps.drop_stale(older_than=-60)
    assert run()[1] == sums and built == [0, 1, 2, 2, 3]


def test_stale_steps_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "job")
    for version in (1, 2):
        steps = Steps(spark, folder, version=version)
        steps.step("rows", lambda: spark.range(version))
    assert steps.drop_stale(older_than=-60) == 1
    assert [len(list(p.iterdir())) for p in (tmp_path / "job" / "rows").iterdir()] == [1]
    assert steps.step("rows", lambda: pytest.fail("dropped")).count() == 2


@pytest.mark.parametrize("name", ["variance_batches", "patient_cosine_var_batches"])
def test_a_second_run_reads(spark, sf_dir, tmp_path, jobs, name):
    run = getattr(network, name)
    first, many = jobs(lambda: run(spark, sf_dir, str(tmp_path)).toPandas())
    second, few = jobs(lambda: run(spark, sf_dir, str(tmp_path)).toPandas())
    assert few < many / 2
    order = ["period", "feature_id"]
    pd.testing.assert_frame_equal(first.sort_values(order, ignore_index=True), second.sort_values(order, ignore_index=True))
    # Nothing of the events is read but the list of their files.
    assert "events.parquet" not in run(spark, sf_dir, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_batches_equal_one_pass(spark, tmp_path):
    events = Inputs(spark, "/root/testdata/sf0.01").ev
    cosines = uncertainty.patient_cosines(events, "purchase:0", least_records=5).cache()
    whole = uncertainty.cosine_variance(cosines, events).toPandas()
    steps = Steps(spark, str(tmp_path))
    got = uncertainty.batched_variance(events, steps, "purchase:0", 3, least_records=5).toPandas()
    both = whole.merge(got, on=["period", "feature_id"], suffixes=("", "_b"))
    assert len(both) == len(whole) == len(got) > 0
    for column in ("n_valid", "n_total", "n_original"):
        assert (both[column] == both[f"{column}_b"]).all()
    assert np.allclose(both["emph_var"], both["emph_var_b"], rtol=1e-9, atol=1e-12, equal_nan=True)


def test_merged_states_do_not_cancel(spark):
    """Values far from zero, batches of very different size, an empty and a single-valued one."""
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"k": "a", "b": rng.integers(0, 5, 400) // 2 * 2, "x": 1e9 + rng.normal(size=400)})
    frame = pd.concat([frame, pd.DataFrame({"k": ["a", "c", "d"], "b": [7, 1, 1], "x": [1e9, 3.0, None]})])
    states = moments.moment_states(spark.createDataFrame(frame), ["k", "b"], "x").drop("b")
    got = {r.k: r for r in moments.merged_states(states, ["k"]).withColumn("v", moments.sample_variance()).collect()}
    want = frame[frame["k"] == "a"]["x"]
    # A double near 1e9 is known to 1e-7, and so is a mean; sums of squares would be off by 100.
    assert got["a"].state.n == 401 and got["a"].v == pytest.approx(want.var(), rel=1e-7)
    assert got["a"].state.mean == pytest.approx(want.mean(), rel=1e-15)
    assert got["c"].state.n == 1 and got["c"].v is None and "d" not in got
