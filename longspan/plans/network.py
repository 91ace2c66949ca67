"""Queries from co-occurrence to embeddings, yearly series and trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from longspan.operators import cooccur, embed, features, levels, moments, trend, uncertainty
from longspan.plans.base import Inputs, query, rounded
from longspan.plans.events import CARRIED, HARMONISED_SQL, CARRIED_SQL, PREVALENCE_SQL, united_sites
from longspan.sources import files
from longspan.sources.resume import Steps, job_folder
from longspan.sources.stages import scratch_path, stage
from longspan.sources.views import ANCHOR

PAIRS_SQL = """
    ids as (select feature_id, cast(row_number() over (order by feature_id) as int) as id
            from (select distinct feature_id from ehr)),
    d as (select cast(year(start_date) as int) as period, patient_num, start_date as day, id,
            count(*) as m
          from ehr join ids on ehr.feature_id = ids.feature_id group by 1, 2, 3, 4),
    pairs as (
      select a.period, a.id as i, b.id as j, cast(sum(a.m * b.m) as bigint) as n
      from d a join d b on a.patient_num = b.patient_num and a.period = b.period
        and date_diff('day', b.day, a.day) between 1 and 30
      group by 1, 2, 3)"""

SYM_SQL = (
    PAIRS_SQL
    + """,
    sym as (
      select period, i, j, cast(sum(case when i = j then n else n * 2 end) as bigint) as n
      from (select * from pairs union all select period, j, i, n from pairs where i <> j)
      group by 1, 2, 3)"""
)


def years_of(rows, column: str) -> range:
    """All years from the first to the last."""
    first, last = rows.agg(F.min(column), F.max(column)).first()
    return range(0) if first is None else range(first, last + 1)


def pair_counts(data: Inputs):
    vocab = features.vocabulary(data.ehr, least=0)
    return cooccur.cooccurrence(features.with_ids(data.ehr, vocab), 30, "id")


def symmetric_counts(data: Inputs, passes: int):
    """The symmetric table, written once: row sums, totals and cells all read it."""
    return stage(cooccur.symmetrise(pair_counts(data), passes), "cooccurrence")


@query("cooccurrence", f"with {PAIRS_SQL.strip()} select * from pairs", ("ehr",))
def cooccurrence(spark, sf_dir):
    return pair_counts(Inputs(spark, sf_dir))


@query("symmetrise", f"with {SYM_SQL.strip()} select * from sym", ("ehr",))
def symmetrise(spark, sf_dir):
    return cooccur.symmetrise(pair_counts(Inputs(spark, sf_dir)), passes=2)


@query(
    "sppmi",
    f"""
    with {SYM_SQL.strip()},
    rs as (select period, i, sum(n) as r from sym group by 1, 2 having sum(n) > 10),
    tot as (select period, sum(r) as total from rs group by 1)
    select * from (
      select s.period, s.i, s.j, round(ln(cast(s.n * t.total as double) / (a.r * b.r)), 6) as pmi
      from sym s join rs a on s.period = a.period and s.i = a.i
        join rs b on s.period = b.period and s.j = b.i join tot t on s.period = t.period
      where cast(s.n * t.total as double) / (a.r * b.r) > 1)
    """,
    ("ehr",),
)
def sppmi(spark, sf_dir):
    return rounded(cooccur.positive_pmi(symmetric_counts(Inputs(spark, sf_dir), 2)), "pmi")


@query(
    "sppmi_recomputed",
    f"""
    with {PAIRS_SQL.strip()},
    sym as (select period, i, j, cast(sum(n) as bigint) as n
            from (select * from pairs union all select period, j, i, n from pairs where i <> j)
            group by 1, 2, 3),
    keep as (select period, i from sym group by 1, 2 having sum(n) > 300),
    cells as (select s.* from sym s join keep a on s.period = a.period and s.i = a.i
              join keep b on s.period = b.period and s.j = b.i),
    rs as (select period, i, sum(n) as r from cells group by 1, 2),
    tot as (select period, sum(r) as total from rs group by 1)
    select c.period, c.i, c.j, round(ln(cast(c.n * t.total as double) / (a.r * b.r)), 6) as pmi
    from cells c join rs a on c.period = a.period and c.i = a.i
      join rs b on c.period = b.period and c.j = b.i join tot t on c.period = t.period
    where cast(c.n * t.total as double) / (a.r * b.r) > 1
    """,
    ("ehr",),
)
def sppmi_recomputed(spark, sf_dir):
    """One symmetrising pass, and row sums taken again after the cut."""
    counts = symmetric_counts(Inputs(spark, sf_dir), 1)
    return rounded(cooccur.positive_pmi(counts, 300, True), "pmi")


@query(
    "yearly_pairs_sppmi",
    f"""
    with {SYM_SQL.strip()},
    rs as (select period, i, sum(n) as r from sym group by 1, 2 having sum(n) > 10),
    tot as (select period, sum(r) as total from rs group by 1)
    select * from (
      select s.period, s.i, s.j, round(ln(cast(s.n * t.total as double) / (a.r * b.r)), 6) as pmi
      from sym s join rs a on s.period = a.period and s.i = a.i
        join rs b on s.period = b.period and s.j = b.i join tot t on s.period = t.period
      where cast(s.n * t.total as double) / (a.r * b.r) > 1)
    """,
    ("ehr",),
)
def yearly_pairs_sppmi(spark, sf_dir):
    """Pair counts written as text by year and read back from a list of files, some missing."""
    path = scratch_path(spark, "pairs")
    pairs = stage(pair_counts(Inputs(spark, sf_dir)), "pairs")
    files.write_csv(pairs.selectExpr("period as year", "i", "j", "n as count"), path, ["year"])
    years = years_of(pairs, "period")
    names = [f"{path}/year={y}" for y in range(years.start - 2, years.stop + 2)]
    counts = cooccur.symmetrise(files.read_yearly_pairs(spark, names), passes=2)
    return rounded(cooccur.positive_pmi(stage(counts, "cooccurrence")), "pmi")


def yearly_vectors(events, vocab):
    vocab = stage(vocab, "vocabulary")
    pairs = cooccur.cooccurrence(features.with_ids(events, vocab), 30, "id")
    counts = stage(cooccur.symmetrise(pairs, passes=2), "cooccurrence")
    matrix = cooccur.positive_pmi(counts)
    names = vocab.select(F.col("id").alias("i"), "feature_id")
    return embed.embed(matrix).join(names, "i").select("period", "feature_id", "vec")


@query("embedding_svd")
def embedding_svd(spark, sf_dir):
    data = Inputs(spark, sf_dir)
    return yearly_vectors(data.ehr, features.vocabulary(data.ehr, least=0))


@query("embedding_lanczos")
def embedding_lanczos(spark, sf_dir):
    """Fewer dimensions than the vocabulary has."""
    counts = symmetric_counts(Inputs(spark, sf_dir), 2)
    return embed.embed_blocks(cooccur.positive_pmi(counts), 20, block=32)


@query(
    "cosine_anchor_given",
    """
    with a as (select cast(embedding as double[]) as v from embeddings where vec_id = 0)
    select e.vec_id, round(list_cosine_similarity(cast(e.embedding as double[]), a.v), 6) as cos
    from embeddings e, a
    """,
)
def cosine_anchor_given(spark, sf_dir):
    vectors = Inputs(spark, sf_dir).embeddings.select(
        F.lit(0).alias("period"), "vec_id", F.col("embedding").alias("vec")
    )
    return rounded(embed.cosine_to_anchor(vectors, "vec_id", 0).drop("period"), "cos")


def drugs_and_classes(codes):
    return codes.select(F.col("feature_id").alias("drug")).union(
        codes.select("treatment_class").distinct()
    )


def chain_events(data: Inputs):
    """Both sites' events under common codes, selected, carried forward, with class labels."""
    united = stage(united_sites(data), "united")
    selected = features.with_ids(united, features.vocabulary(united, data.drug))
    carried = features.carry_forward(selected.drop("id"), CARRIED)
    return features.class_events(carried, data.drug)


def full_series(data: Inputs):
    """Anchor cosines of drugs and classes on the full year grid, from the sites' events on:
    harmonise, unite, select, carry forward, add classes, count, embed, compare."""
    events = stage(chain_events(data), "events")
    vectors = yearly_vectors(events, features.vocabulary(events, least=0))
    cosines = embed.cosine_to_anchor(vectors, "feature_id", ANCHOR).withColumnRenamed(
        "feature_id", "drug"
    )
    years = years_of(events.select(F.year("start_date").alias("year")), "year")
    grid = embed.anchor_series(cosines, drugs_and_classes(data.drug), "drug", years)
    return events, grid.withColumnRenamed("period", "year")


@query(
    "chain_events",
    f"""
    with h as ({HARMONISED_SQL}),
    united as (
      select patient_num, start_date, feature_id from h
      where patient_num in (select patient_num from pe) and patient_num % 2 = 1
      union all select patient_num, start_date, feature_id from h
      where patient_num % 2 = 0 and patient_num not in (select patient_num from reg)),
    kept as (
      select * from united where feature_id in (
        select feature_id from united group by 1
        having count(*) > 100 or feature_id in (select feature_id from drug))),
    carried as (
      select patient_num, start_date, feature_id from kept
      where feature_id not in ('RXNORM:1', 'RXNORM:2')
      union all select patient_num, start_date, feature_id from ({CARRIED_SQL.replace("from ehr", "from kept")}))
    select patient_num, start_date, feature_id from carried
    union all select c.patient_num, c.start_date, d.treatment_class
    from carried c join drug d on c.feature_id = d.feature_id
    """,
    ("ehr", "pe", "reg", "drug"),
)
def chain_events_query(spark, sf_dir):
    """The events that the yearly series start from."""
    return chain_events(Inputs(spark, sf_dir))


@query("cosine_series")
def cosine_series(spark, sf_dir):
    return full_series(Inputs(spark, sf_dir))[1]


@query("patient_cosine_var")
def patient_cosine_var(spark, sf_dir):
    events = Inputs(spark, sf_dir).ev
    cosines = stage(uncertainty.patient_cosines(events, "purchase:0"), "cosines")
    return uncertainty.scaled_spread(uncertainty.cosine_variance(cosines, events))


@query("patient_cosine_var_batches")
def patient_cosine_var_batches(spark, sf_dir, folder=None):
    """The spread of `patient_cosine_var` from stored patient batches; a later run reads them."""
    steps = Steps(spark, folder or job_folder(spark, "patient_cosine_var"), [f"{sf_dir}/events.parquet"])
    variance = uncertainty.batched_variance(Inputs(spark, sf_dir).ev, steps, "purchase:0")
    steps.drop_stale()
    return uncertainty.scaled_spread(variance)


@query(
    "variance_batches",
    """
    with n as (select year(start_date) as period, patient_num, feature_id, ln(1 + count(*)) as x from ev group by all)
    select cast(period as int) as period, feature_id, count(*) as n, round(avg(x), 6) as mean, round(var_samp(x), 6) as variance
    from n group by 1, 2
    """,
    ("ev",),
)
def variance_batches(spark, sf_dir, folder=None, batches=4):
    """Variance over patients of their log counts by year and code, gathered from batches of
    patients that are stored as they are finished; a later run goes on from them."""
    steps = Steps(spark, folder or job_folder(spark, "variance"), [f"{sf_dir}/events.parquet"], batches=batches)

    def values():
        batch = F.pmod(F.xxhash64("patient_num"), F.lit(batches)).cast("int").alias("batch")
        keys = [F.year("start_date").alias("period"), "patient_num", "feature_id"]
        return Inputs(spark, sf_dir).ev.groupBy(*keys).agg(F.log1p(F.count("*")).alias("x")).select("*", batch)

    rows = steps.step("values", values, ["batch"])
    states = [
        steps.step("states", lambda: moments.moment_states(rows.where(F.col("batch") == k), ["period", "feature_id"], "x"), batch=k)
        for k in range(batches)
    ]
    steps.drop_stale()
    merged = moments.merged_states(reduce(DataFrame.unionByName, states), ["period", "feature_id"])
    out = merged.select("period", "feature_id", "state.n", "state.mean", moments.sample_variance().alias("variance"))
    return rounded(out, "mean", "variance")


SERIES_SQL = f"""
    p as ({PREVALENCE_SQL}),
    s as (select feature_id as drug, year, freq as cos,
            case when n >= 15 then sqrt(freq * (1 - freq) / npe) end as sd, totalcount, n from p)"""


def stand_in_series(data: Inputs):
    """Prevalence as a series with known spread, for checks that SQL can repeat."""
    spread = F.sqrt(F.col("freq") * (1 - F.col("freq")) / F.col("npe"))
    return features.yearly_prevalence(data.ehr).select(
        F.col("feature_id").alias("drug"), "year", F.col("freq").alias("cos"),
        F.when(F.col("n") >= 15, spread).alias("sd"), "n",
    )


@query(
    "series_ci",
    f"""
    with {SERIES_SQL.strip()},
    grid as (select drug, cast(y as int) as year from (select distinct drug from s),
             (select unnest(range(first, last + 1)) as y from
               (select min(year) as first, max(year) as last from s))),
    j as (select g.drug, g.year, s.cos, s.sd from grid g left join s
          on g.drug = s.drug and g.year = s.year)
    select j.drug, j.year, round(cos, 6) as cos, round(sd, 6) as sd,
      round(case when cos + sd * 1.96 is not null then least(cos + sd * 1.96, 0.9) end, 6) as high_se,
      round(case when cos - sd * 1.96 is not null then greatest(cos - sd * 1.96, -0.1) end, 6)
        as low_se,
      coalesce(d.generic_name, j.drug) as name
    from j left join drug d on j.drug = d.feature_id
    """,
    ("ehr", "drug"),
)
def series_ci(spark, sf_dir):
    data = Inputs(spark, sf_dir)
    series = stage(stand_in_series(data), "series")
    cosines = series.select("drug", F.col("year").alias("period"), "cos")
    grid = embed.anchor_series(
        cosines, series.select("drug"), "drug", years_of(series, "year")
    ).withColumnRenamed("period", "year")
    names = data.drug.select(F.col("feature_id").alias("drug"), F.col("generic_name").alias("name"))
    out = trend.series_table(
        grid, series.select("drug", "year"), series.select("drug", "year", "sd"), names
    )
    return rounded(out, "cos", "sd", "high_se", "low_se").select(
        "drug", "year", "cos", "sd", "high_se", "low_se", "name"
    )


@query(
    "class_panel",
    f"""
    with {SERIES_SQL.strip()},
    classed as (
      select drug, year, cos from s where n >= 15
      union all select d.treatment_class, s.year, sum(s.cos) / 10
      from s join drug d on s.drug = d.feature_id group by 1, 2),
    listed as (select treatment_class as panel, feature_id as drug from drug
               union select treatment_class, treatment_class from drug),
    r as (select l.panel, c.drug, c.year, c.cos from classed c join listed l on c.drug = l.drug),
    big as (select panel from r group by 1 having count(distinct drug) > 2)
    select panel, drug, year, round(cos, 6) as cos, drug = panel as is_class,
      cast(dense_rank() over (partition by panel order by drug <> panel, drug) as int) as level,
      count(cos) over (partition by panel, drug) as n_valid,
      case when count(cos) over (partition by panel, drug) > 4 then 'loess' else 'lm' end as smoother
    from r where panel in (select panel from big)
    """,
    ("ehr", "drug"),
)
def class_panel(spark, sf_dir):
    data = Inputs(spark, sf_dir)
    series = stage(stand_in_series(data), "series")
    members = data.drug.select("treatment_class", F.col("feature_id").alias("drug"))
    classes = (
        series.join(members, "drug")
        .groupBy(F.col("treatment_class").alias("drug"), "year")
        .agg((F.sum("cos") / 10).alias("cos"))
    )
    rows = series.where(F.col("n") >= 15).select("drug", "year", "cos").unionByName(classes)
    panels = stage(trend.class_panels(rows, members), "panels")
    ordered = levels.with_level(panels, panel_order(panels), "drug", ["panel"])
    return rounded(ordered, "cos").select("panel", "drug", "year", "cos", "is_class", "level", "n_valid", "smoother")


def panel_order(panels: DataFrame) -> DataFrame:
    """The class itself first, then its members in order."""
    return levels.ordered_levels(panels, "drug", ["panel"], F.col("is_class"))


@query(
    "ordered_levels",
    """
    select feature_id, cast(dense_rank() over (order by feature_id not like 'PheCode:%', feature_id) as int) as level, count(*) as n
    from ehr group by 1
    """,
    ("ehr",),
)
def ordered_levels(spark, sf_dir):
    """Codes as ordered levels, conditions first, joined back to their events."""
    events = Inputs(spark, sf_dir).ehr.select("feature_id")
    ordered = levels.ordered_levels(events, "feature_id", first=F.col("feature_id").startswith("PheCode:"))
    # Counted by level alone: a level stands for its value.
    counts = levels.with_level(events, ordered, "feature_id").groupBy("level").agg(F.count("*").alias("n"))
    return ordered.join(counts, "level").select("feature_id", "level", "n")


def series_with_gaps(data: Inputs):
    """Years with few patients have no value."""
    enough = F.col("n") >= 15
    return stand_in_series(data).withColumn("cos", F.when(enough, F.col("cos")))


def tail_sql(df: str, th: str) -> str:
    """Two-sided Student tail with angle `th`, for the SQL side."""
    return f"""case when ({df}) % 2 = 0 then
      1 - sin({th}) * list_sum(list_transform(range(0, ({df}) // 2), lambda k:
        coalesce(list_aggregate(list_transform(range(0, k),
          lambda m: (2.0 * m + 1) / (2 * m + 2) * cos({th}) * cos({th})), 'product'), 1.0)))
    else
      1 - 2 / pi() * ({th} + sin({th}) * cos({th}) * coalesce(list_sum(list_transform(
        range(1, (({df}) - 1) // 2 + 1), lambda k: coalesce(list_aggregate(list_transform(
          range(1, k), lambda m: 2.0 * m / (2 * m + 1) * cos({th}) * cos({th})), 'product'), 1.0))),
        0.0)) end"""


# Two-sided 5% critical values of Student's t for 1 to 10 degrees of freedom.
CRITICAL = [
    12.706204736432095, 4.302652729911275, 3.182446305284263, 2.7764451051977987,
    2.570581836614739, 2.446911848791681, 2.3646242510102993, 2.306004135033371,
    2.2621571627409915, 2.2281388519649385,
]


def critical_sql(df: str) -> str:
    return f"list_extract([{', '.join(f'{c!r}::double' for c in CRITICAL)}], cast({df} as int))"


OLS_SQL = f"""
    fit as (
      select drug, count(cos) as n, regr_slope(cos, year) as b, regr_sxx(cos, year) as sxx,
        regr_syy(cos, year) as syy, regr_sxy(cos, year) as sxy
      from kept group by 1),
    se as (select drug, n, case when n > 2 then b end as beta,
             case when n > 2 then sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) end as se_beta
           from fit),
    tt as (select *, beta / se_beta as t, atan(abs(beta / se_beta) / sqrt(n - 2)) as th from se),
    ols as (select drug, n, round(beta, 6) as beta, round(se_beta, 6) as se_beta,
              round(t, 4) as t, round(case when n > 2 then {tail_sql('n - 2', 'th')} end, 6) as p from tt)"""

DIRECTION_SQL = """case when p < 0.05 and beta > 0 then 'Increase'
      when p < 0.05 and beta < 0 then 'Decrease' else 'None' end"""


@query(
    "ols_trend",
    f"""
    with {SERIES_SQL.strip()},
    kept as (select drug, year, case when n >= 15 then cos end as cos from s),
    {OLS_SQL.strip()}
    select *, {DIRECTION_SQL} as trend from ols
    """,
    ("ehr",),
)
def ols_trend(spark, sf_dir):
    series = series_with_gaps(Inputs(spark, sf_dir))
    out = rounded(trend.ols_trend(series), "beta", "se_beta", "p")
    return rounded(out, "t", places=4).withColumn(
        "trend", trend.direction(F.col("p"), F.col("beta"))
    )


@query(
    "zscore_series",
    f"""
    with {SERIES_SQL.strip()}
    select drug, year, round((cos - avg(cos) over w) / stddev_samp(cos) over w, 6) as z,
      min(year) over w as start, max(year) over w as "end", count(*) over w as n_points
    from s window w as (partition by drug)
    """,
    ("ehr",),
)
def zscore_series(spark, sf_dir):
    series = stage(stand_in_series(Inputs(spark, sf_dir)), "series")
    span = trend.series_span(series).withColumnRenamed("n", "n_points")
    out = rounded(trend.zscores(series), "z")
    return out.join(span, "drug").select("drug", "year", "z", "start", "end", "n_points")


BREAK_SQL = """
    b as (select drug, year - avg(year) over (partition by drug) as u,
            avg(year) over (partition by drug) as centre, cos as y,
            count(*) over (partition by drug) as n,
            row_number() over (partition by drug order by year) as k from s),
    gaps as (select l.drug, l.u as lo, h.u as hi from b l join b h on l.drug = h.drug
               and h.k = l.k + 1 where l.k >= 2 and h.k <= l.n - 1),
    sides as (
      select g.drug, lo, hi, regr_slope(y, u) filter (u <= lo) as sa,
        regr_intercept(y, u) filter (u <= lo) as ia, regr_slope(y, u) filter (u >= hi) as sb,
        regr_intercept(y, u) filter (u >= hi) as ib
      from gaps g join b on g.drug = b.drug group by 1, 2, 3),
    candidates as (
      select drug, u as psi from b where k between 2 and n - 1
      union all select drug, (ia - ib) / (sb - sa) from sides
      where sa <> sb and (ia - ib) / (sb - sa) > lo and (ia - ib) / (sb - sa) < hi),
    terms as (
      select c.drug, c.psi, b.n, b.centre, b.u, b.y, greatest(b.u - c.psi, 0) as h,
        case when b.u > c.psi then -1.0::double else 0.0::double end as g
      from candidates c join b on c.drug = b.drug where b.n >= 6),
    m as (
      select drug, psi, max(n) as n, max(centre) as centre, regr_sxx(y, u) as uu,
        regr_sxx(y, h) as hh, regr_sxx(y, g) as gg, regr_sxy(u, h) as uh, regr_sxy(u, g) as ug,
        regr_sxy(h, g) as hg, regr_sxy(u, y) as uy, regr_sxy(h, y) as hy, regr_sxy(g, y) as gy,
        regr_syy(y, u) as yy from terms group by 1, 2),
    scoredm as (select *, (hy - uh * uy / uu) / (hh - uh * uh / uu) as delta,
        yy - uy * uy / uu - pow(hy - uh * uy / uu, 2) / (hh - uh * uh / uu) as rss,
        uu * (hh * gg - hg * hg) - uh * (uh * gg - hg * ug) + ug * (uh * hg - hh * ug) as det
      from m),
    best as (select *, row_number() over (partition by drug order by rss) as pick from scoredm),
    inv as (
      select *, (uy - delta * uh) / uu as beta1, det <= 1e-9 * uu * hh * gg as spent,
        (hh * gg - hg * hg) / nullif(det, 0) as i11, (uu * gg - ug * ug) / nullif(det, 0) as i22,
        (uu * hh - uh * uh) / nullif(det, 0) as i33, (ug * hg - uh * gg) / nullif(det, 0) as i12,
        (uh * hg - hh * ug) / nullif(det, 0) as i13, (ug * uh - uu * hg) / nullif(det, 0) as i23
      from best where pick = 1),
    noise as (
      select *, (yy - uy * uy * i11 - hy * hy * i22 - gy * gy * i33
        - 2 * (uy * hy * i12 + uy * gy * i13 + hy * gy * i23)) / (n - 4) as v from inv),
    br as (
      select drug, n, psi + centre as change_point, beta1, beta1 + delta as beta2,
        case when spent then 'inf'::double else sqrt(v * i11) end as se1,
        case when spent then 'inf'::double else sqrt(v * (i11 + i22 + 2 * i12)) end as se2
      from noise),
    br_t as (select *, atan(abs(beta1 / se1) / sqrt(n - 4)) as th1,
               atan(abs(beta2 / se2) / sqrt(n - 4)) as th2 from br)"""

CLASS_SQL = f"""
    span as (select drug, count(*) as n, min(year) as start, max(year) as "end",
               regr_slope(cos, year) as b, regr_sxx(cos, year) as sxx, regr_syy(cos, year) as syy,
               regr_sxy(cos, year) as sxy from s group by 1),
    line as (select *, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) as se from span where n > 3),
    line_t as (select *, atan(abs(b / se) / sqrt(n - 2)) as th from line),
    joined as (
      select span.drug, span.n, span.start, span."end", l.b as beta, x.change_point, x.beta1,
        x.beta2, {tail_sql('l.n - 2', 'l.th')} as p, {tail_sql('x.n - 4', 'x.th1')} as p1,
        {tail_sql('x.n - 4', 'x.th2')} as p2, l.se * {critical_sql('l.n - 2')} as w,
        x.se1 * {critical_sql('x.n - 4')} as w1, x.se2 * {critical_sql('x.n - 4')} as w2
      from span left join line_t l on span.drug = l.drug left join br_t x on span.drug = x.drug),
    classed as (
      select *, case
        when p1 < 0.05 and p2 < 0.05 and beta1 > 0 and beta2 < 0 then 'I-D'
        when p1 < 0.05 and p2 < 0.05 and beta1 < 0 and beta2 > 0 then 'D-I'
        when p1 < 0.05 then case when beta1 > 0 then 'Increase' else 'Decrease' end
        when p2 < 0.05 then case when beta2 > 0 then 'Increase' else 'Decrease' end
        when p is null or p > 0.05 then 'None'
        when beta > 0 then 'Increase' else 'Decrease' end as type from joined)"""

CLASS_NUMBERS = ["change_point", "beta", "beta1", "beta2", "p", "p1", "p2", "w", "w1", "w2"]


@query(
    "segmented_trend",
    f"""
    with {SERIES_SQL.strip()}, {BREAK_SQL.strip()}, {CLASS_SQL.strip()}
    select drug, type, n, start, "end",
      {', '.join(f'round({c}, 6) as {c}' for c in CLASS_NUMBERS)} from classed
    """,
    ("ehr",),
)
def segmented_trend(spark, sf_dir):
    series = stage(stand_in_series(Inputs(spark, sf_dir)), "series")
    return rounded(trend.classified_trends(series), *CLASS_NUMBERS)


@query(
    "smooth_series",
    f"""
    with {SERIES_SQL.strip()},
    pairs as (
      select a.drug, a.year, a.cos, b.year - a.year as dx, abs(b.year - a.year) as d, b.cos as y,
        count(*) over w as n, row_number() over (w order by abs(b.year - a.year), b.year) as k,
        rank() over (w order by abs(b.year - a.year)) - 1 as closer
      from s a join s b on a.drug = b.drug window w as (partition by a.drug, a.year)),
    reach as (
      select drug, year, coalesce(min(d) filter (k >= greatest(floor(0.75 * n), least(n, 4))
        and closer >= 3), 2 * max(d)) as h from pairs where n >= 4 group by 1, 2),
    weighted as (
      select p.*, pow(greatest(0, 1 - pow(d / h, 3)), 3) as w
      from pairs p join reach r on p.drug = r.drug and p.year = r.year),
    m as (
      select drug, year, max(cos) as cos, sum(w) as a, sum(w * dx) as b, sum(w * dx * dx) as c,
        sum(w * dx * dx * dx) as d, sum(w * dx * dx * dx * dx) as e, sum(w * y) as t0,
        sum(w * dx * y) as t1, sum(w * dx * dx * y) as t2 from weighted group by 1, 2)
    select drug, year, round(cos, 6) as cos,
      round((t0 * (c * e - d * d) - b * (t1 * e - d * t2) + c * (t1 * d - c * t2))
        / (a * (c * e - d * d) - b * (b * e - d * c) + c * (b * d - c * c)), 6) as smooth,
      'loess' as method from m
    union all
    select drug, year, round(cos, 6), round(regr_intercept(cos, year) over w
      + regr_slope(cos, year) over w * year, 6), 'lm'
    from s where drug in (select drug from s group by 1 having count(*) < 4)
    window w as (partition by drug)
    """,
    ("ehr",),
)
def smooth_series(spark, sf_dir):
    series = stage(stand_in_series(Inputs(spark, sf_dir)), "series")
    return rounded(trend.smooth_series(series), "cos", "smooth")


@query(
    "linear_smooth",
    f"""
    with {SERIES_SQL.strip()}
    select drug, year, round(regr_intercept(cos, year) over w + regr_slope(cos, year) over w * year,
      6) as smooth
    from s window w as (partition by drug)
    """,
    ("ehr",),
)
def linear_smooth(spark, sf_dir):
    series = stand_in_series(Inputs(spark, sf_dir))
    return rounded(trend.linear_smooth(series), "smooth").select("drug", "year", "smooth")


@query(
    "trend_export",
    f"""
    with {SERIES_SQL.strip()},
    kept as (select drug, year, case when n >= 15 then cos end as cos from s),
    {OLS_SQL.strip()}
    select coalesce(d.feature_id, o.drug) as drug, d.generic_name, d.treatment_class,
      o.n, o.beta, o.se_beta, o.t, o.p
    from drug d full join ols o on d.feature_id = o.drug
    """,
    ("ehr", "drug"),
)
def trend_export(spark, sf_dir):
    data = Inputs(spark, sf_dir)
    series = series_with_gaps(data)
    line = rounded(rounded(trend.ols_trend(series), "beta", "se_beta", "p"), "t", places=4)
    return trend.export_trends(data.drug.withColumnRenamed("feature_id", "drug"), line)


@query(
    "trend_comparison",
    f"""
    with {SERIES_SQL.strip()}, {BREAK_SQL.strip()}, {CLASS_SQL.strip()},
    kept as (select * from s),
    {OLS_SQL.strip()}
    select c.drug, c.type, c.n, c.start, c."end",
      {', '.join(f'round(c.{c}, 6) as {c}' for c in CLASS_NUMBERS)},
      o.n as n_lm, o.beta as beta_lm, o.se_beta as se_beta_lm, o.t as t_lm, o.p as p_lm
    from classed c join ols o on c.drug = o.drug
    """,
    ("ehr",),
)
def trend_comparison(spark, sf_dir):
    """Linear and classified trends side by side."""
    series = stage(stand_in_series(Inputs(spark, sf_dir)), "series")
    line = rounded(rounded(trend.ols_trend(series), "beta", "se_beta", "p"), "t", places=4)
    return trend.compare_trends(line, rounded(trend.classified_trends(series), *CLASS_NUMBERS))


@query("anchor_trends")
def anchor_trends(spark, sf_dir):
    """The whole way from events to classified trends of drugs and classes."""
    data = Inputs(spark, sf_dir)
    _, series = full_series(data)
    trends = trend.classified_trends(stage(series, "series"))
    return trend.export_trends(data.drug.withColumnRenamed("feature_id", "drug"), trends)


@query("anchor_series_band")
def anchor_series_band(spark, sf_dir):
    """Yearly cosines of drugs and classes with prevalence and a band from patient-level spread.

    The given tables have few records per patient and year, so the record cut is 5 instead of 20
    and the least effective number of patients 2 instead of 50.
    """
    data = Inputs(spark, sf_dir)
    events, series = full_series(data)
    cosines = stage(uncertainty.patient_cosines(events, ANCHOR, least_records=5), "cosines")
    variance = uncertainty.cosine_variance(cosines, events)
    spread = uncertainty.scaled_spread(variance, least_effective=2).select(
        F.col("feature_id").alias("drug"), F.col("period").alias("year"), "sd"
    )
    prevalence = features.yearly_prevalence(events).select(
        F.col("feature_id").alias("drug"), "year", "freq"
    )
    names = data.drug.select(F.col("feature_id").alias("drug"), F.col("generic_name").alias("name"))
    return trend.series_table(series, prevalence, spread, names)
