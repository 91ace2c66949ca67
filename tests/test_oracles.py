"""Every listed query against its SQL, or for shape where SQL cannot state it."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from longspan.sources.views import TABLES

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Queries whose spread is null where there are too few patients, as in the smallest tables.
BANDS = ("anchor_series_band", "patient_cosine_var", "patient_cosine_var_batches")
# Tests of exact fits and thresholds above all scores are infinite.
INFINITE = ("anchor_trends", "phenotype_quality")
BAND = ("sd", "high_se", "low_se")
SCORES = ("mixture", "cov_code", "cov_both", "norm_code", "norm_both", "log_code", "log_concept")


def cells(frame: pd.DataFrame) -> list[tuple]:
    def cell(value):
        if value is None or value is pd.NA or value is pd.NaT:
            return "~"
        if isinstance(value, float) and math.isnan(value):
            return "~"
        if hasattr(value, "isoformat"):
            return str(pd.Timestamp(value).date())
        if isinstance(value, (bool, np.bool_, str)):
            return str(value)
        return repr(float(value) + 0.0) if not hasattr(value, "__len__") else str(value)

    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in row) for row in ordered.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    ours = QUERIES[name](spark, sf_dir).toPandas()
    theirs = duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert cells(ours) == cells(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    assert len(set(frame.columns)) == len(frame.columns)
    rows = frame.toPandas()
    assert len(rows) > 0
    for column in rows.columns:
        known = rows[column].notna().mean()
        assert known > 0 or name in BANDS and column in BAND, column
        if rows[column].dtype == float and name not in INFINITE:
            assert np.isfinite(rows[column].dropna()).all(), column
        if column in ("score", "cos", "auroc_mean") or column in SCORES:
            assert rows[column].dropna().between(-1.0 - 1e-9, 20.0).all(), column


def test_band_has_values(spark):
    """The smallest tables have too few patients for a band; the next ones have some."""
    rows = QUERIES["anchor_series_band"](spark, "/root/testdata/sf0.01").toPandas()
    band = rows.dropna(subset=["sd"])
    assert len(band) > 10 and (band["sd"] >= 0).all()
    assert (band["low_se"] <= band["high_se"]).all()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
