"""Series statistics against closed forms and planted shapes."""

import numpy as np
import pytest

from longspan.operators import trend


def series(spark, values, name="d", start=2000):
    rows = [(name, start + k, None if v is None else float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "drug string, year int, cos double")


def test_line_by_hand(spark):
    row = trend.ols_trend(series(spark, [1, 2, 2.5, 4])).first()
    assert row.beta == pytest.approx(0.95)
    assert row.se_beta == pytest.approx(0.1322876, abs=1e-6)
    assert row.n == 4


@pytest.mark.parametrize("values, n", [([1], 1), ([1, 2], 2), ([None, 3, None], 1), ([None], 0)])
def test_short_series_have_no_statistics(spark, values, n):
    row = trend.ols_trend(series(spark, values)).first()
    assert (row.n, row.beta, row.p) == (n, None, None)


def test_exact_line_is_certain(spark):
    row = trend.ols_trend(series(spark, [1, 2, 3, 4])).first()
    assert row.beta == pytest.approx(1.0) and row.p == pytest.approx(0.0, abs=1e-6)


def grid_break(x, y):
    best = None
    for psi in np.linspace(x[1], x[-2], 20001):
        cols = np.column_stack([np.ones(len(x)), x, np.maximum(x - psi, 0)])
        fit = np.linalg.lstsq(cols, y, rcond=None)[0]
        score = ((y - cols @ fit) ** 2).sum()
        if best is None or score < best:
            best = score
    return best


def many(spark, values):
    rows = [(f"d{s}", 2000 + k, float(v)) for s, y in enumerate(values) for k, v in enumerate(y)]
    return spark.createDataFrame(rows, "drug string, year int, cos double")


def test_break_is_the_least_squares_one(spark):
    x, values = np.arange(12.0), []
    for seed in range(8):
        rng = np.random.default_rng(seed)
        values.append(0.3 * x - 0.8 * np.maximum(x - 6.4, 0) + rng.normal(0, 0.2, 12))
    found = {r.drug: r for r in trend.break_trends(many(spark, values)).collect()}
    for s, y in enumerate(values):
        row = found[f"d{s}"]
        psi = row.change_point - 2000
        cols = np.column_stack([np.ones(12), x, np.maximum(x - psi, 0)])
        fit = np.linalg.lstsq(cols, y, rcond=None)[0]
        assert ((y - cols @ fit) ** 2).sum() <= grid_break(x, y) + 1e-9
        assert abs(psi - 6.4) < 1.5
        assert (row.beta1, row.beta2) == pytest.approx((fit[1], fit[1] + fit[2]))
        cols = np.column_stack([cols, -(x > psi).astype(float)])
        full = np.linalg.lstsq(cols, y, rcond=None)[0]
        cov = ((y - cols @ full) ** 2).sum() / 8 * np.linalg.inv(cols.T @ cols)
        errors = np.sqrt([cov[1, 1], cov[1, 1] + cov[2, 2] + 2 * cov[1, 2]])
        assert (row.se1, row.se2) == pytest.approx(tuple(errors))


def test_break_needs_six_points_and_four_periods(spark):
    assert trend.break_trends(many(spark, [[1, 2, 1, 2, 1]])).isEmpty()
    flat = spark.createDataFrame([("d", 2000 + k % 3, float(k)) for k in range(9)], "drug string, year int, cos double")
    assert trend.break_trends(flat).isEmpty()


def noisy(shape, seed=0):
    return np.asarray(shape) + np.random.default_rng(seed).normal(0, 0.01, len(shape))


UP, DOWN = np.arange(10) * 0.1, 1 - np.arange(10) * 0.1


@pytest.mark.parametrize(
    "values, kind",
    [
        (noisy(np.concatenate([UP, DOWN])), "I-D"),
        (noisy(np.concatenate([DOWN, UP])), "D-I"),
        (noisy(np.arange(12) * 0.1), "Increase"),
        (noisy(-np.arange(12) * 0.1), "Decrease"),
        ([0.1, 0.2, 0.3], "None"),
        (noisy([0.1, 0.2, 0.3, 0.4, 0.5]), "Increase"),
        ([0.5, 0.1, 0.5, 0.1, 0.5], "None"),
    ],
)
def test_classes(spark, values, kind):
    row = trend.classified_trends(series(spark, values)).first()
    assert row.type == kind
    assert (row.change_point is None) == (len(values) < 6)
    assert (row.beta is None) == (len(values) <= 3)


def test_change_point_is_found(spark):
    row = trend.classified_trends(series(spark, noisy(np.concatenate([UP, DOWN])))).first()
    assert abs(row.change_point - 2009.5) < 0.5
    assert row.beta1 == pytest.approx(0.1, abs=0.01) and row.beta2 == pytest.approx(-0.1, abs=0.01)
    assert (row.start, row.end, row.n) == (2000, 2019, 20)


def test_half_width_covers(spark):
    y = noisy(np.arange(7) * 0.05, 3)
    row = trend.classified_trends(series(spark, y)).first()
    line = trend.ols_trend(series(spark, y)).first()
    assert row.w == pytest.approx(line.se_beta * 2.57058183661)


def local_fit(x, y, span=0.75):
    out, near = [], max(int(np.floor(span * len(x) + 1e-9)), min(len(x), 4))
    for at in x:
        gap = np.abs(x - at)
        reach = next((r for r in np.sort(gap)[near - 1 :] if (gap < r).sum() >= 3), 2 * gap.max())
        root = np.clip(1 - (gap / reach) ** 3, 0, None) ** 1.5
        cols = np.vander(x - at, 3, increasing=True)
        out.append(np.linalg.lstsq(cols * root[:, None], y * root, rcond=None)[0][0])
    return out


def test_local_smooth_equals_weighted_least_squares(spark):
    rng = np.random.default_rng(3)
    values = [rng.normal(size=n) for n in (4, 5, 7, 12, 25)] + [0.2 * np.arange(11.0) ** 2 - np.arange(11.0)]
    got = trend.smooth_series(many(spark, values)).toPandas().sort_values(["drug", "year"])
    for s, y in enumerate(values):
        mine = got[got["drug"] == f"d{s}"]["smooth"]
        assert np.allclose(mine, local_fit(np.arange(float(len(y))), y), atol=1e-8)


def test_smoother_choice(spark):
    both = series(spark, [1, 2, 3], "short").union(series(spark, [1, 4, 9, 16, 25, 36], "long"))
    got = trend.smooth_series(both).toPandas()
    assert set(got[got["drug"] == "short"]["method"]) == {"lm"}
    long = got[got["drug"] == "long"].sort_values("year")
    assert set(long["method"]) == {"loess"}
    assert np.allclose(long["smooth"], long["cos"])
    short = got[got["drug"] == "short"].sort_values("year")
    assert np.allclose(short["smooth"], [1, 2, 3])


def test_zscores(spark):
    got = [r.z for r in trend.zscores(series(spark, [1, 2, 3, None])).orderBy("year").collect()]
    assert got == pytest.approx([-1, 0, 1])


def test_full_join_keeps_both_sides(spark):
    drugs = spark.createDataFrame([("a", "A"), ("b", "B")], "drug string, name string")
    trends = spark.createDataFrame([("b", 1.0), ("c", 2.0)], "drug string, beta double")
    got = {r.drug: (r["name"], r.beta) for r in trend.export_trends(drugs, trends).collect()}
    assert got == {"a": ("A", None), "b": ("B", 1.0), "c": (None, 2.0)}
