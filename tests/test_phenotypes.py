"""Mixtures, scorers and evaluation: planted structure, bounds and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from longspan.operators import evaluate, mixture, scorers
from longspan.sources.stages import stage


def test_two_normals_are_recovered(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 6000), rng.normal(4, 1, 4000)])
    table = spark.createDataFrame([("a", float(v), 1.0) for v in x], "method string, x double, w double")
    fit = mixture.fit_normals(table)["a"]
    assert fit.low == pytest.approx(0, abs=0.1) and fit.high == pytest.approx(4, abs=0.1)
    assert fit.share == pytest.approx(0.4, abs=0.02) and fit.variance == pytest.approx(1, abs=0.08)
    post = np.array(
        [r.p for r in spark.range(-3, 8).orderBy("id").select(fit.posterior(F.col("id")).alias("p")).collect()]
    )
    assert (np.diff(post) > 0).all() and post.min() >= 0 and post.max() <= 1


def test_weights_count_as_repeats(spark):
    values = [0.0, 0.2, 0.1, 3.0, 3.2, 2.9]
    once = [("a", v, 1.0) for v in values for _ in range(3)] + [("b", v, 3.0) for v in values]
    fits = mixture.fit_normals(spark.createDataFrame(once, "method string, x double, w double"))
    assert fits["a"].high == pytest.approx(fits["b"].high) and fits["a"].share == pytest.approx(0.5, abs=1e-3)


def test_two_rates_are_recovered(spark):
    rng = np.random.default_rng(2)
    e = rng.integers(20, 80, 4000)
    rate = np.where(rng.random(4000) < 0.3, 0.5, 0.05)
    y = rng.poisson(rate * e)
    table = spark.createDataFrame(
        [("a", float(a), float(b), 1.0) for a, b in zip(y, e)], "method string, y double, e double, w double"
    )
    fit = mixture.fit_poissons(table)["a"]
    assert (fit.low, fit.high, fit.share) == pytest.approx((0.05, 0.5, 0.3), rel=0.08)


@pytest.fixture(scope="module")
def cohort(spark):
    """Planted cases: higher code and concept counts, one related feature, one unrelated."""
    rng = np.random.default_rng(5)
    n = 1500
    case = rng.random(n) < 0.4
    utl = rng.integers(30, 120, n)
    code = 1 + rng.poisson(np.where(case, 0.25, 0.02) * utl)
    concept = rng.poisson(np.where(case, 0.2, 0.03) * utl)
    related = rng.poisson(np.where(case, 0.1, 0.02) * utl)
    noise = rng.poisson(0.05 * utl)
    rows = [
        tuple(int(v) for v in t)
        for t in zip(range(n), utl, code, concept, code + concept, related, noise, case)
    ]
    names = "patient_num bigint, utl bigint, code bigint, concept bigint, code_concept bigint, "
    return spark.createDataFrame(rows, names + "`F:1` bigint, `F:2` bigint, y int")


def test_all_scores_separate_cases(spark, cohort):
    table, fit = scorers.score_table(cohort, ["F:1", "F:2"], [], ["patient_num", "y"])
    methods = [c for c in table.columns if c not in ("patient_num", "y")]
    assert len(methods) == 9
    frame = table.toPandas()
    for m in methods[:-2]:
        assert frame[m].between(0, 1).all(), m
    areas = {
        r.method: r.auroc
        for r in evaluate.area_metrics(scorers.long_scores(stage(table), ["y"], methods)).collect()
    }
    assert min(areas.values()) > 0.85, areas
    coefficients = {(m, c): b for m, c, b in fit.coefficients}
    assert coefficients["cov_code", "code"] > 0
    assert coefficients["cov_code", "F:1"] > abs(coefficients["cov_code", "F:2"])
    both = scorers.compare_coefficients(fit.table(spark), "cov_code", "cov_both").toPandas()
    assert set(both["feat"]) == {"code", "F:1", "F:2", "utl"}


def test_scores_do_not_depend_on_partitions(cohort):
    names = ["code", "concept"]
    a = scorers.corrupt_and_split(scorers.log_counts(cohort, names, ["patient_num"]), names)
    b = scorers.corrupt_and_split(
        scorers.log_counts(cohort.repartition(13), names, ["patient_num"]), names
    )
    left, right = (d.toPandas().sort_values("patient_num").reset_index(drop=True) for d in (a, b))
    assert (left["is_train"] == right["is_train"]).all() and left["is_train"].sum() == 1000
    changed = (left["corrupt_code"] != left["code"]).sum()
    assert changed <= 300 and np.allclose(left["corrupt_code"], right["corrupt_code"])


def test_covariance_equals_numpy(cohort):
    frame = cohort.toPandas()
    got = scorers.covariance(cohort, ["utl", "code", "F:1"], "y")
    for group, matrix in scorers.as_matrices(got, "y", ["utl", "code", "F:1"]).items():
        want = np.cov(frame[frame["y"] == group][["utl", "code", "F:1"]].to_numpy(float).T)
        assert np.allclose(matrix, want)


def test_scorers_pass_features_as_one_array(cohort, monkeypatch):
    """No step of the scorers is as wide as the features, so none is a projection too long to compile."""
    widths, keep = [], scorers.stage
    monkeypatch.setattr(scorers, "stage", lambda df, name="stage": widths.append(len(df.columns)) or keep(df, name))
    cohort = cohort.select("*", *[F.col("F:2").alias(f"G:{k}") for k in range(12)])
    features = ["F:1", *[f"G:{k}" for k in range(12)]]
    scorers.normalised_scores(cohort, features)
    scorers.covariance_scores(cohort, features, [])
    assert max(widths) <= 4


def test_sums_and_lines_of_arrays_equal_numpy(cohort):
    names = ["utl", "code", "F:1"]
    frame = cohort.toPandas()[names].to_numpy(float)
    vectors = cohort.repartition(5).select(scorers.numbers(names).alias("x"))

    def products(batch):
        block = scorers.matrix_of(batch.column(0))
        return block.T @ block

    assert np.allclose(scorers.summed(vectors, products), frame.T @ frame)
    lines = {"a": [0.0, 1.0, 0.0], "b": [0.0, 1.0, 2.0]}
    got = scorers.line_values(vectors, lines, scorers.matrix_of).toPandas()
    for name, beta in lines.items():
        x, n = np.unique(frame @ np.array(beta), return_counts=True)
        part = got[got["method"] == name].sort_values("x")
        assert np.allclose(part["x"], x) and (part["w"] == n).all()


def test_lasso_without_penalty_is_least_squares():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    y = x @ [1, -2, 0, 0.5] + rng.normal(0, 0.1, 200)
    assert np.allclose(scorers.lasso(x.T @ x, x.T @ y, 0.0), np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-6)
    assert (scorers.lasso(x.T @ x, x.T @ y, 1e6) == 0).all()


def scored(spark, y, s, method="m"):
    rows = [(k, method, int(a), float(b)) for k, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "patient_num bigint, method string, y int, score double")


@pytest.fixture(scope="module")
def labels():
    rng = np.random.default_rng(8)
    y = (rng.random(120) < 0.4).astype(int)
    return y, np.round(rng.normal(y, 1.2), 1)


def test_areas_equal_pairwise_count(spark, labels):
    y, s = labels
    row = evaluate.area_metrics(scored(spark, y, s)).first()
    pos, neg = s[y == 1][:, None], s[y == 0][None]
    assert row.auroc == pytest.approx(((pos > neg) + 0.5 * (pos == neg)).mean())
    precision = 0.0
    for cut in np.unique(s)[::-1]:
        precision += ((s == cut) & (y == 1)).sum() / y.sum() * y[s >= cut].mean()
    assert row.auprc == pytest.approx(precision)
    back = evaluate.area_metrics(scored(spark, y, -s)).first()
    assert back.auroc == pytest.approx(1 - row.auroc)


def test_roc_equals_definition(spark, labels):
    y, s = labels
    rows = evaluate.roc_curve(scored(spark, y, s)).collect()
    assert len(rows) == len(np.unique(s)) + 1
    for r in rows:
        assert r.sensitivity == pytest.approx((s[y == 1] >= r.threshold).mean())
        assert r.specificity == pytest.approx((s[y == 0] < r.threshold).mean())


def test_orientation_turns_reversed_scores(spark, labels):
    y, s = labels
    turned = evaluate.orient(scored(spark, y, -s))
    assert turned.where("not flipped").count() == 0
    assert evaluate.area_metrics(turned).first().auroc > 0.5


def test_cut_takes_lowest_threshold_on_ties(spark):
    rows = scored(spark, [0, 0, 1, 1, 1], [1, 2, 3, 4, 5])
    cut = evaluate.cut_points(rows, [1.0]).first()
    assert (cut.threshold, cut.specificity, cut.sensitivity) == (2.5, 1.0, 1.0)


def test_one_class_only(spark):
    row = evaluate.area_metrics(scored(spark, [1, 1], [1, 2])).first()
    assert row.auroc is None and row.auprc == pytest.approx(1.0)
    none = evaluate.area_metrics(scored(spark, [0, 0], [1, 2])).first()
    assert none.auroc is None and none.auprc is None


def test_bootstrap_repeats_and_centres(spark, labels):
    y, s = labels
    table = scored(spark, y, s)
    a = evaluate.bootstrap_areas(table, "patient_num", 30).first()
    b = evaluate.bootstrap_areas(table.repartition(5), "patient_num", 30).first()
    assert a.auroc_mean == pytest.approx(b.auroc_mean) and a.auroc_sd == pytest.approx(b.auroc_sd)
    whole = evaluate.area_metrics(table).first().auroc
    assert abs(a.auroc_mean - whole) < 0.03 and 0.01 < a.auroc_sd < 0.12


def test_area_of_large_counts(spark):
    rows = [("m", 1.0, 0, 4 * 10**9, 0, 0, 4 * 10**9, 8 * 10**9), ("m", 2.0, 4 * 10**9, 4 * 10**9, 0, 4 * 10**9, 4 * 10**9, 8 * 10**9)]
    kinds = "method string, score double, pos bigint, neg bigint, pos_before bigint, neg_before bigint, pos_total bigint, neg_total bigint"
    row = evaluate.area_rows(spark.createDataFrame(rows, kinds)).first()
    assert row.auroc == pytest.approx(0.75)


def test_poisson_steps_reach_one():
    steps = evaluate.poisson_steps()
    assert steps == sorted(set(steps)) and steps[-1] == pytest.approx(1.0, abs=1e-15) and len(steps) > 15


def test_unconverged_fit_is_an_error(spark):
    from longspan.operators import mixture

    rows = [("m", float(k % 7) + (5 if k % 3 else 0), 1.0) for k in range(200)]
    table = spark.createDataFrame(rows, "method string, x double, w double")
    with pytest.raises(RuntimeError, match="convergence"):
        mixture.fit_normals(table, rounds=1, tolerance=0.0)
    quoted = table.withColumn("method", F.lit("it's"))
    assert set(mixture.fit_normals(quoted)) == {"it's"}
