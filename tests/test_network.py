"""Co-occurrence, PMI, embeddings and per-patient cosines against numpy."""

import datetime as dt
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from longspan.operators import cooccur, embed, uncertainty

SCHEMA = "patient_num bigint, start_date date, feature_id string"


def events_frame(spark, rows):
    base = dt.date(2020, 1, 1)
    return spark.createDataFrame([(p, base + dt.timedelta(d), f) for p, d, f in rows], SCHEMA)


def random_rows(seed, n, people=3, days=60, codes="abcdefgh"):
    rng = np.random.default_rng(seed)
    return [
        (int(rng.integers(people)), int(rng.integers(days)), str(rng.choice(list(codes))))
        for _ in range(n)
    ]


def brute_pairs(rows, window):
    out = Counter()
    for p, d, f in rows:
        for q, e, g in rows:
            if p == q and 1 <= d - e <= window:
                out[f, g] += 1
    return dict(out)


def as_dict(df):
    return {(r.i, r.j): r.n for r in df.collect()}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.sampled_from("abc")), min_size=1, max_size=40),
    st.integers(1, 12),
)
def test_pairs_equal_record_by_record_count(spark, rows, window):
    assert as_dict(cooccur.cooccurrence(events_frame(spark, rows), window)) == brute_pairs(rows, window)


def test_pairs_with_crowded_buckets_split(spark):
    rows = random_rows(1, 250, people=2)
    got = cooccur.cooccurrence(events_frame(spark, rows), 10, crowd=4)
    assert as_dict(got) == brute_pairs(rows, 10)


def test_crowded_buckets_with_ids(spark):
    rows = random_rows(6, 200, people=2)
    events = events_frame(spark, rows).withColumn("id", (F.ascii("feature_id") - 96).cast("int"))
    got = as_dict(cooccur.cooccurrence(events, 7, "id", crowd=5))
    want = brute_pairs([(p, d, ord(f) - 96) for p, d, f in rows], 7)
    assert got == want


def test_pairs_are_listed_without_a_join(spark):
    """Rows are dealt once, a window lists what each meets; records without a patient or date meet nothing."""
    rows = random_rows(3, 120)
    base = dt.date(2020, 1, 1)
    odd = spark.createDataFrame([(None, base, "a"), (None, base + dt.timedelta(1), "b"), (1, None, "a")], SCHEMA)
    got = cooccur.cooccurrence(events_frame(spark, rows).unionByName(odd), 9)
    assert as_dict(got) == brute_pairs(rows, 9)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Window" in text


def test_crowded_and_other_years_of_one_patient(spark):
    """Only 2020 is crowded; pairs of both years and of a second patient stay what they are."""
    rows = random_rows(7, 80, people=2) + [(0, 366 + 3 * k, "abc"[k % 3]) for k in range(9)] + [(1, 366 + 50 * k, "a") for k in range(4)]
    got = cooccur.cooccurrence(events_frame(spark, rows), 10, crowd=9).groupBy("i", "j").agg(F.sum("n").alias("n"))
    assert as_dict(got) == brute_pairs(rows, 10)


def test_pairs_stay_within_a_year(spark):
    events = spark.createDataFrame(
        [(1, dt.date(2020, 12, 31), "a"), (1, dt.date(2021, 1, 2), "b")], SCHEMA
    )
    assert cooccur.cooccurrence(events, 30).count() == 0


@pytest.mark.parametrize("passes, off", [(1, 4), (2, 8)])
def test_symmetrise_by_hand(spark, passes, off):
    t = spark.createDataFrame([(0, 1, 1, 4), (0, 1, 2, 3), (0, 2, 1, 1)], "period int, i int, j int, n bigint")
    assert as_dict(cooccur.symmetrise(t, passes)) == {(1, 1): 4, (1, 2): off, (2, 1): off}


def numpy_pmi(dense, least, again):
    sums = dense.sum(axis=1)
    keep = sums > least
    dense, sums = dense[np.ix_(keep, keep)], sums[keep]
    if again:
        sums = dense.sum(axis=1)
    with np.errstate(divide="ignore"):
        pmi = np.log(dense * sums.sum() / np.outer(sums, sums))
    return np.where(pmi > 0, pmi, 0), keep


@pytest.mark.parametrize("again", [False, True])
def test_pmi_equals_numpy(spark, again):
    rng = np.random.default_rng(4)
    dense = np.triu(rng.integers(0, 6, (12, 12)))
    dense[:, 3] = 0
    dense[3, :] = 0
    dense[3, 4] = 1
    dense = dense + np.triu(dense, 1).T
    cells = [(0, i, j, int(n)) for (i, j), n in np.ndenumerate(dense) if n]
    t = spark.createDataFrame(cells, "period int, i int, j int, n bigint")
    want, keep = numpy_pmi(dense.astype(float), 10, again)
    codes = np.flatnonzero(keep)
    got = np.zeros_like(want)
    for r in cooccur.positive_pmi(t, 10, again).collect():
        got[np.searchsorted(codes, r.i), np.searchsorted(codes, r.j)] = r.pmi
    assert np.allclose(got, want)


def sign_rule(matrix, dims):
    """Components whose left and right singular vectors agree in sign, scaled."""
    u, d, vt = np.linalg.svd(matrix)
    keep = np.flatnonzero((u * vt.T).sum(axis=0) > 0)[:dims]
    keep = keep[d[keep] > 1e-9]
    return u[:, keep] * np.sqrt(d[keep])


@pytest.fixture(scope="module")
def matrices(spark):
    rng = np.random.default_rng(2)
    dense, rows = {}, []
    for period, size in ((2000, 40), (2001, 25)):
        a = rng.random((size, size)) * (rng.random((size, size)) < 0.3)
        a = np.triu(a) + np.triu(a, 1).T + np.diag(np.full(size, 0.01))
        dense[period] = a
        rows += [(period, i, j, float(x)) for (i, j), x in np.ndenumerate(a) if x]
    return dense, spark.createDataFrame(rows, "period int, i int, j int, pmi double")


def gram_of(frame, period):
    part = frame[frame["period"] == period].sort_values("i")
    vectors = np.stack(part["vec"].to_numpy())
    return vectors @ vectors.T


@pytest.mark.parametrize("dims", [5, 100])
def test_small_embedding_follows_the_sign_rule(matrices, dims):
    dense, table = matrices
    got = embed.embed_small(table, dims).toPandas()
    for period, matrix in dense.items():
        want = sign_rule(matrix, dims)
        assert np.allclose(gram_of(got, period), want @ want.T, atol=1e-9)


def test_large_embedding_agrees_with_small(matrices):
    dense, table = matrices
    small = embed.embed_small(table, 4).toPandas()
    large = embed.embed_blocks(table, 4, block=8).toPandas()
    for period in dense:
        assert np.allclose(gram_of(small, period), gram_of(large, period), atol=1e-5)


def test_large_embedding_with_reduced_basis(matrices):
    dense, table = matrices
    small = embed.embed_small(table, 3).toPandas()
    large = embed.embed_blocks(table, 3, block=4, max_width=16, tolerance=1e-5).toPandas()
    for period in dense:
        assert np.allclose(gram_of(small, period), gram_of(large, period), atol=1e-3)


def test_anchor_series_has_the_whole_grid(spark):
    vectors = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (1, "b", [1.0, 1.0]), (2, "b", [0.0, 2.0])],
        "period int, f string, vec array<double>",
    )
    cos = embed.cosine_to_anchor(vectors, "f", "a")
    got = {
        (r.f, r.period): r.cos
        for r in embed.anchor_series(cos, vectors.where("f = 'b'"), "f", [1, 2, 3]).collect()
    }
    assert got == {("b", 1): pytest.approx(0.5**0.5), ("b", 2): None, ("b", 3): None}


def patient_by_hand(rows, anchor, window):
    codes = sorted({f for _, _, f in rows})
    at = {f: k for k, f in enumerate(codes)}
    pairs = np.zeros((len(codes), len(codes)))
    for (f, g), n in brute_pairs(rows, window).items():
        pairs[at[f], at[g]] = n
    both = pairs + pairs.T
    np.fill_diagonal(both, np.diag(pairs))
    pmi, keep = numpy_pmi(both, 5, True)
    if keep.sum() < 5 or not keep[at[anchor]]:
        return {}
    names = [c for c, k in zip(codes, keep) if k]
    vectors = sign_rule(pmi, 100)
    if vectors.shape[1] < 3:
        return {}
    length = np.linalg.norm(vectors, axis=1)
    where = names.index(anchor)
    return {
        n: vectors[k] @ vectors[where] / length[k] / length[where]
        for k, n in enumerate(names)
        if length[k] > 1e-12 and length[where] > 1e-12
    }


def test_patient_cosines_by_hand(spark):
    rows = random_rows(9, 150, people=3, days=120) + [(9, d, "a") for d in range(10)]
    got = uncertainty.patient_cosines(events_frame(spark, rows), "a", 30).toPandas()
    assert 9 not in set(got["patient_num"])
    for person in range(3):
        want = patient_by_hand([r for r in rows if r[0] == person], "a", 30)
        mine = got[(got["patient_num"] == person) & got["feature_id"].notna()]
        have = dict(zip(mine["feature_id"], mine["cos"]))
        assert set(have) == set(want) and len(want) > 3
        assert all(have[f] == pytest.approx(want[f], abs=1e-8) for f in want)


def test_years_are_checked_side_by_side(spark):
    """Many years in a batch and years over several batches give what each year gives alone."""
    rows = [(p, d, f) for p in range(0, 60, 10) for _, d, f in random_rows(p, 90, people=1, days=100)]
    rows += [(p, d, f) for p in range(1, 60, 10) for d, f in ((0, "a"), (9, "b"), (70, "c"), (71, "d"))]
    rows += [(p, d, "b") for p in range(2, 60, 10) for d in range(6)]
    odd = [(None, d, f) for _, d, f in random_rows(0, 90, people=1, days=100)]
    events = events_frame(spark, rows + odd)
    undated = spark.createDataFrame([(5, None, "a")] * 4, SCHEMA)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        found = uncertainty.patient_cosines(events.unionByName(undated), "a", 20, 3)
        got = {(r.period, r.patient_num, r.feature_id): r.cos for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    want, solved = {(None, 5, None): None}, set()
    daily = Counter((p, d, f) for p, d, f in rows + odd)
    for person in {p for p, _, _ in daily}:
        cells = sorted((d, f, n) for (p, d, f), n in daily.items() if p == person)
        day, code, m = (np.array(c) for c in zip(*cells))
        codes, values = uncertainty._anchor_cosines(day, code, m, "a", 20)
        want |= {(2020, person, str(c)): v for c, v in zip(codes, values)} or {(2020, person, None): None}
        solved |= {person} if len(codes) else set()
    assert {0, 10, None} <= solved and 1 not in solved
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want if k[2])


def test_solvable_years_equal_the_rule_of_each(spark):
    rng = np.random.default_rng(12)
    sizes = rng.integers(1, 60, 80)
    year = np.repeat(np.arange(80), sizes)
    cells = sorted({(int(y), int(d), int(c)) for y, d, c in zip(year, rng.integers(0, 200, len(year)), rng.integers(0, 8, len(year)))})
    year, day, code = np.array(cells).T
    m = rng.integers(1, 4, len(year))
    got = uncertainty.solvable_years(year, day, code, m, 2, 30)
    for y in range(80):
        rows = year == y
        kept = uncertainty.neighbour_sums(day[rows], code[rows], m[rows], 8, 30) > 5
        assert got[y] == (kept.sum() >= 5 and kept[2])
    assert 10 < got.sum() < 70


def test_variance_counts_patients_without_a_vector(spark):
    cosines = spark.createDataFrame(
        [(2020, 1, "x", 0.2), (2020, 2, "x", 0.6), (2020, 3, None, None)],
        uncertainty.COSINE_SCHEMA,
    )
    events = events_frame(spark, [(p, 0, "x") for p in range(1, 7)])
    row = uncertainty.scaled_spread(uncertainty.cosine_variance(cosines, events), 3).first()
    assert (row.n_valid, row.n_total, row.n_original) == (2, 3, 6)
    assert row.n_effective == pytest.approx(4.0)
    assert row.sd == pytest.approx(0.08 / 2)
    none = uncertainty.scaled_spread(uncertainty.cosine_variance(cosines, events)).first()
    assert none.sd is None


def test_neighbour_sums_equal_the_table(spark):
    rng = np.random.default_rng(4)
    for _ in range(30):
        n, size, window = int(rng.integers(1, 60)), 5, int(rng.integers(1, 20))
        cells = sorted({(int(d), int(c)) for d, c in zip(rng.integers(0, 50, n), rng.integers(0, size, n))})
        day, place = np.array(cells).T
        m = rng.integers(1, 4, len(day))
        pairs = np.zeros((size, size))
        for a in range(len(day)):
            for b in range(len(day)):
                if 1 <= day[a] - day[b] <= window:
                    pairs[place[a], place[b]] += m[a] * m[b]
        both = pairs + pairs.T
        np.fill_diagonal(both, np.diag(pairs))
        assert np.allclose(uncertainty.neighbour_sums(day, place, m, size, window), both.sum(1))


def test_a_patient_with_very_many_codes(spark):
    """20,000 codes of which few have neighbours: nothing wider than those is formed."""
    day = np.concatenate([np.arange(20_000) * 40, np.arange(60) % 30])
    place = np.concatenate([np.arange(20_000), np.arange(60) % 6])
    sums = uncertainty.neighbour_sums(day, place, np.ones(len(day)), 20_000, 30)
    assert (sums > 5).sum() == 6
    codes, values = uncertainty._anchor_cosines(day, place.astype(str).astype(object), np.ones(len(day)), "0", 30)
    assert set(codes) <= {str(k) for k in range(6)}


def test_pmi_of_large_counts(spark):
    cells = [(1, i, j, 10**12 * (1 + (i + j) % 3)) for i in (1, 2, 3) for j in (1, 2, 3)]
    table = spark.createDataFrame(cells, "period int, i int, j int, n bigint")
    small = table.withColumn("n", (F.col("n") / 10**11).cast("bigint"))
    large, want = (
        {(r.i, r.j): r.pmi for r in cooccur.positive_pmi(t).collect()} for t in (table, small)
    )
    assert set(large) == set(want) and all(large[k] == pytest.approx(want[k]) for k in want)


def patient_pmi(day, place, m, size, window):
    """Positive PMI of one patient, as one table."""
    met = ((day[:, None] - day >= 1) & (day[:, None] - day <= window)) * np.outer(m, m)
    one_hot = np.eye(size)[place]
    pairs = one_hot.T @ met @ one_hot
    both = pairs + pairs.T
    np.fill_diagonal(both, np.diag(pairs))
    sums = both.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.log(both * sums.sum() / np.outer(sums, sums))
    return np.where(np.isfinite(pmi) & (pmi > 0), pmi, 0.0)


def test_blocks_of_a_patient_equal_the_table(monkeypatch):
    rng = np.random.default_rng(8)
    day, place, m = rng.integers(0, 90, 400), rng.integers(0, 30, 400), rng.integers(1, 4, 400)
    cells = sorted(set(zip(day.tolist(), place.tolist())))
    day, place, m = np.array(cells)[:, 0], np.array(cells)[:, 1], m[: len(cells)].astype(float)
    want = patient_pmi(day, place, m, 31, 10)
    for cells in (4, 400, 10**6):
        monkeypatch.setattr(uncertainty, "BLOCK_CELLS", cells)
        pairs = uncertainty.PatientPairs(day, place, m, 31, 10)
        assert np.allclose(np.vstack([b for _, b in pairs.pmi()]), want)
        x = rng.normal(size=(31, 3))
        assert np.allclose(pairs.times(x), want @ x)


def wide_patient(codes, days=40, topics=60, seed=9):
    """Codes of one topic tend to meet on the same days."""
    rng = np.random.default_rng(seed)
    topic = rng.integers(0, topics, codes)
    busy = rng.random((days, topics)) < 0.2
    seen = (rng.random((days, codes)) < 0.05) | (busy[:, topic] & (rng.random((days, codes)) < 0.5))
    seen[:3, 0] = True
    day, place = np.nonzero(seen)
    return day * 4, np.array([f"c{k:05d}" for k in place], dtype=object), np.ones(len(day))


def test_lanczos_within_a_patient_equals_the_dense_solve(monkeypatch):
    day, code, m = wide_patient(500)
    got = uncertainty._anchor_cosines(day, code, m, "c00000", 8)
    monkeypatch.setattr(uncertainty, "DENSE", 10**6)
    want = uncertainty._anchor_cosines(day, code, m, "c00000", 8)
    assert len(got[0]) > 400 and (got[0] == want[0]).all()
    assert np.allclose(got[1], want[1], atol=1e-7)


def test_a_patient_with_thousands_of_kept_codes_in_bounded_memory():
    """No table of codes by codes: 5,000 kept codes take less than half of one such table."""
    import tracemalloc

    day, code, m = wide_patient(5_300, days=24)  # some of them meet too few others
    tracemalloc.start()
    codes, values = uncertainty._anchor_cosines(day, code, m, "c00000", 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(codes) >= 5_000 and np.abs(values).max() <= 1 + 1e-9
    assert peak < 5_000**2 * 8 / 2


@pytest.mark.parametrize("size,dims", [(5, 3), (40, 40), (300, 20)])
def test_leading_pairs_equal_eigh(size, dims):
    from longspan.operators.lanczos import leading_pairs

    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.normal(size=(size, size)))
    values = np.sort(np.concatenate([rng.normal(size=size - 2), [4.0, 4.0]]))[::-1]
    a = q * values @ q.T
    got, vectors = leading_pairs(lambda x: a @ x, size, dims, block=8)
    assert np.allclose(got, values[:dims], atol=1e-8)
    assert np.allclose(a @ vectors, vectors * got, atol=1e-6)


def test_unsettled_pairs_raise():
    from longspan.operators.lanczos import leading_pairs

    rng = np.random.default_rng(1)
    a = rng.normal(size=(200, 200))
    with pytest.raises(RuntimeError):
        leading_pairs(lambda x: (a + a.T) @ x, 200, 10, block=2, most_rounds=3)


def test_an_embedding_that_does_not_settle_raises(spark):
    cells = [(1, i, j, float((i * j) % 7 + 1)) for i in range(12) for j in range(12)]
    table = spark.createDataFrame(cells, "period int, i int, j int, pmi double")
    with pytest.raises(RuntimeError, match="settled"):
        embed.embed_blocks(table, 3, block=2, tolerance=0.0, most_rounds=2)
