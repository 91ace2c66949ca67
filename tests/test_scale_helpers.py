"""Joins, running sums, quantiles and samples against plain results, with hot keys."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from longspan.operators import joins, ranking


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id"
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain(spark, skewed, how):
    small = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert not joins.hot_keys(skewed, ["k"], 8).isEmpty()
    got = joins.salted_join(skewed, small, ["k"], how, 8)
    want = skewed.join(small, "k", how)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(
        map(tuple, want.collect()), key=str
    )


@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_null_keys_are_kept_and_spread(spark, how):
    big = spark.range(900).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 40).alias("k"), "id"
    )
    small = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = joins.salted_join(big, small, ["k"], how, 8)
    want = big.join(small, "k", how)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_hot_keys_are_split_in_proportion(skewed):
    hot = {r.k: r._parts for r in joins.hot_keys(skewed, ["k"], 8).collect()}
    assert set(hot) == {7} and 10 <= hot[7] <= 12


def test_lookup_never_multiplies_rows(spark, skewed):
    dim = spark.createDataFrame([(7, "b"), (7, "a"), (1, "c")], "k bigint, v string")
    for most in (1000, 0):
        got = joins.lookup_join(skewed, dim, ["k"], "left", most)
        assert got.count() == 3000
        assert got.where("k = 7").select("v").distinct().collect()[0].v == "a"


def test_first_per_key_puts_nulls_last(spark):
    rows = spark.createDataFrame([(1, None, "z"), (1, 5, "y"), (2, None, "x")], "k int, d int, v string")
    got = {r.k: (r.d, r.v) for r in joins.first_per_key(rows, ["k"], ["d"]).collect()}
    assert got == {1: (5, "y"), 2: (None, "x")}


def test_running_sums_equal_cumsum(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": ["a"] * 400 + ["b"] * 3, "x": rng.permutation(403) / 7.0})
    frame["n"] = rng.integers(1, 9, 403)
    got = ranking.running_sums(spark.createDataFrame(frame), ["g"], "x", ["n"], 9).toPandas()
    got = got.sort_values(["g", "x"]).reset_index(drop=True)
    want = frame.sort_values(["g", "x"]).reset_index(drop=True)
    groups = want.groupby("g")
    assert (got["n_before"] == groups["n"].cumsum() - want["n"]).all()
    assert (got["n_total"] == groups["n"].transform("sum")).all()
    assert got["next_x"].equals(groups["x"].shift(-1))


def test_running_sums_of_a_key_over_many_ranges(spark):
    """One key has most rows; the order is of two columns and holds nulls."""
    rng = np.random.default_rng(5)
    rows = [(int(k > 90), None if k % 50 == 0 else int(k // 7), int(k)) for k in rng.permutation(2000)]
    got = ranking.running_sums(spark.createDataFrame(rows, "g int, a int, b int").withColumn("n", F.lit(1)), ["g"], ["a", "b"], ["n"], 16)
    assert "next_a" not in got.columns
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    place = {r: k for k, r in enumerate(want)}
    first = min(k for r, k in place.items() if r[0] == 1)
    for r in got.collect():
        assert r.n_before == place[(r.g, r.a, r.b)] - first * r.g
        assert r.n_total == sum(1 for x in rows if x[0] == r.g)


def test_running_sums_carry_offsets_by_range(spark):
    """No row is compared with a list of edges, and no range of rows is one key's whole group."""
    rows = spark.range(5000).selectExpr("'a' as g", "id as x", "1L as n")
    got = ranking.running_sums(rows, ["g"], "x", ["n"], 8)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in text and "_edges" not in text and "SinglePartition" not in text
    parts = ranking.in_ranges(rows, ["g", "x"], 8).groupBy("_part").count().collect()
    assert len(parts) == 8 and max(p["count"] for p in parts) < 2500


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, values):
    rows = spark.createDataFrame([("v", float(x)) for x in values], "g string, x double")
    got = ranking.quantiles(rows, ["g"], "x", [0.0, 0.25, 0.5, 0.75, 1.0]).first().quantiles
    assert np.allclose(got, np.quantile(values, [0, 0.25, 0.5, 0.75, 1]))


def test_quartiles_by_hand(spark):
    rows = spark.createDataFrame([("v", x) for x in (1.0, 2.0, 3.0, 10.0, None)], "g string, x double")
    assert ranking.quantiles(rows, ["g"], "x", [0.25, 0.5, 0.75]).first().quantiles == [1.75, 2.5, 4.75]


@pytest.mark.parametrize("fraction", [0.0, 0.2, 2 / 3, 1.0])
def test_hash_sample_size_and_repeatability(spark, fraction):
    rows = spark.range(1000).withColumnRenamed("id", "p")
    a = ranking.hash_sample(rows, "p", 5, fraction, "in")
    b = ranking.hash_sample(rows.repartition(7), "p", 5, fraction, "in")
    picked = {r.p for r in a.where("in").collect()}
    assert len(picked) == round(1000 * fraction)
    assert picked == {r.p for r in b.where("in").collect()}
    if 0 < fraction < 1:
        other = {r.p for r in ranking.hash_sample(rows, "p", 6, fraction, "in").where("in").collect()}
        assert other != picked


def test_dense_ids_follow_text_order(spark):
    names = [f"{s}:{k}" for s in ("RXNORM", "LOINC", "a", "é") for k in range(30)]
    rows = spark.createDataFrame([(n,) for n in names], "f string").repartition(5)
    got = {r.f: r.id for r in ranking.dense_ids(rows, "f").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == sorted(
        names, key=lambda n: n.encode()
    )
    assert sorted(got.values()) == list(range(1, len(names) + 1))
