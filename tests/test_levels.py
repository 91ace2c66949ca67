"""Ordered levels, exact distances to a fit, and quality from known cases only."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from longspan.operators import evaluate, levels, mixture


def test_levels_are_sorted_within_keys(spark):
    rng = np.random.default_rng(1)
    rows = [(g, f"v{int(k):03d}") for g in ("a", "b") for k in rng.integers(0, 200, 600)] + [("a", None), ("c", "only")]
    frame = spark.createDataFrame(rows, "g string, v string")
    got = {(r.g, r.v): r.level for r in levels.ordered_levels(frame, "v", ["g"], F.col("v") == "v100").collect()}
    for g in ("a", "b", "c"):
        values = sorted({v for k, v in rows if k == g and v is not None}, key=lambda v: (v != "v100", v))
        assert [got[g, v] for v in values] == list(range(1, len(values) + 1))
    joined = levels.with_level(frame, levels.ordered_levels(frame, "v"), "v")
    assert joined.count() == len(rows)
    assert [r.level for r in joined.where("v is null").collect()] == [None]
    # The order of levels is the order of values.
    assert joined.select("v", "level").distinct().orderBy("v").toPandas()["level"].dropna().is_monotonic_increasing


def test_distance_is_of_the_exact_distribution(spark):
    """Skewed data, where bins would hide the gap: all mass of one component in one value."""
    rng = np.random.default_rng(2)
    x = np.concatenate([np.full(500, 1.0), rng.exponential(2.0, 1500) ** 2])
    values, counts = np.unique(x, return_counts=True)
    pair = mixture.NormalPair(0.3, 1.0, 9.0, 4.0)
    frame = spark.createDataFrame(pd.DataFrame({"method": "m", "x": values, "w": counts.astype(float)}))
    got = mixture.distances_to_fit(frame, {"m": pair})["m"]
    fitted = 0.3 * mixture.normal_cdf(values, 9.0, 4.0) + 0.7 * mixture.normal_cdf(values, 1.0, 4.0)
    upto = np.cumsum(counts) / len(x)
    below = upto - counts / len(x)
    assert got == pytest.approx(max(np.abs(upto - fitted).max(), np.abs(below - fitted).max()), abs=1e-12)


def test_known_cases_give_the_quality_of_all(spark):
    """With cases and controls apart by two, half of the cases known."""
    rng = np.random.default_rng(3)
    n, share = 6000, 0.3
    case = rng.random(n) < share
    score = rng.normal(size=n) + 2.0 * case
    frame = spark.createDataFrame(
        pd.DataFrame({"id": range(n), "method": "m", "score": score, "known": case & (rng.random(n) < 0.5)})
    )
    rows = evaluate.case_only_evaluation(frame, "id", F.col("known"), top=0.3).collect()
    got = {r.metric: r for r in rows}
    cut = np.quantile(score, 0.7)
    wins = (score[case][:, None] > score[~case]).mean()
    true = {"auroc": wins, "fpr": (score[~case] > cut).mean(), "sensitivity": (score[case] > cut).mean(), "ppv": case[score > cut].mean()}
    true["f_score"] = 2 * true["ppv"] * true["sensitivity"] / (true["ppv"] + true["sensitivity"])
    for metric, value in true.items():
        r = got[metric]
        assert r.estimate == pytest.approx(value, abs=0.08), metric
        assert r.low <= r.mean <= r.high and 0 < r.sd < 0.1


def test_no_known_case(spark):
    frame = spark.createDataFrame([(k, "m", float(k)) for k in range(10)], "id int, method string, score double")
    rows = evaluate.case_only_evaluation(frame, "id", F.lit(False), rounds=3).collect()
    assert {r.metric for r in rows} == set(evaluate.CASE_METRICS) and all(r.estimate is None for r in rows)


def test_rounds_do_not_copy_rows(spark):
    """Resamples are summed side by side before the shuffle."""
    frame = spark.range(100).selectExpr("id", "'m' as method", "id % 7 as score")
    groups = evaluate.resampled_groups(frame, "id", {"n": F.lit(1)}, 20, 11, "method", "score")
    text = groups._jdf.queryExecution().executedPlan().toString()
    assert text.index("Generate") < text.index("Exchange")  # the plan is printed from its end
    assert sorted(r.n for r in groups.where("round = 0").collect()) == [14] * 5 + [15] * 2
