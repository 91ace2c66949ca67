"""Sparse feature rows against a dense table, with more features than columns could hold."""

import numpy as np
import pandas as pd
import pytest

from longspan.operators import sparse

FEATURES = 20_000


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(4)
    patients, features = rng.integers(0, 60, 6000), rng.zipf(1.3, 6000) % (FEATURES + 50)
    return pd.DataFrame({"patient_num": patients, "feature_id": [f"f{k:05d}" for k in features]})


def test_many_features_in_a_small_plan(spark, table):
    curated = spark.range(FEATURES).selectExpr("format_string('f%05d', id) as feature_id", "1 as flag")
    events = spark.createDataFrame(table)
    rows = sparse.sparse_counts(events, sparse.feature_places(curated), "f00001", "f00002")
    assert rows.columns == ["patient_num", "utl", "code", "concept", "counts", "code_concept"]
    assert len(rows._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = {r.patient_num: r for r in rows.collect()}
    for patient, part in table.groupby("patient_num"):
        row, n = got[patient], part["feature_id"].value_counts()
        assert (row.utl, row.code, row.concept) == (len(part), n.get("f00001", 0), n.get("f00002", 0))
        assert row.counts == {int(f[1:]) + 1: k for f, k in n.items() if int(f[1:]) < FEATURES}
    dense = np.zeros((len(got), FEATURES + 1))
    for k, row in enumerate(got.values()):
        dense[k, list(row.counts)] = np.log1p(list(row.counts.values()))
    used = np.flatnonzero(dense.any(axis=0))
    expected = np.cov(dense[:, used], rowvar=False)
    both = (dense[:, used] > 0).T.astype(int) @ (dense[:, used] > 0).astype(int)
    place = {p: k for k, p in enumerate(used)}
    found = sparse.sparse_covariance(rows).collect()
    assert len(found) == np.count_nonzero(np.triu(both))
    for r in found:
        assert r.n_both == both[place[r.a], place[r.b]]
        assert r.cov == pytest.approx(expected[place[r.a], place[r.b]], abs=1e-9)


def test_no_events_and_no_features(spark):
    events = spark.createDataFrame([(1, "x"), (None, "x"), (1, None)], "patient_num int, feature_id string")
    curated = spark.createDataFrame([], "feature_id string, flag int")
    rows = sparse.sparse_counts(events, sparse.feature_places(curated), "x", "y")
    assert [(r.patient_num, r.utl, r.code, r.counts) for r in rows.collect()] == [(1, 2, 1, {})]
    assert sparse.sparse_covariance(rows).count() == 0
    assert sparse.sparse_counts(events.limit(0), sparse.feature_places(curated), "x", "y").count() == 0
