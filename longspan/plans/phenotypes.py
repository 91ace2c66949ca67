"""Queries for scores, their evaluation and the patient list."""

from __future__ import annotations

from pyspark.sql import functions as F

from longspan.operators import cohort, evaluate, report, scorers
from longspan.plans.base import Inputs, query, rounded
from longspan.plans.events import COUNTS_SQL, counts, curated, wide
from longspan.sources.stages import stage

COUNT_COLUMNS = ["utl", *scorers.SURROGATES]
METHODS = [
    "mixture", "cov_code", "cov_both", "norm_code", "norm_code_features", "norm_both",
    "norm_both_features", "log_code", "log_concept",
]


def labelled(data: Inputs, patients):
    return cohort.assign_labels(patients, data.ann, data.reg)


@query(
    "log_baseline",
    f"""
    with c as ({COUNTS_SQL})
    select patient_num, round(ln(1 + code), 6) as log_code, round(ln(1 + concept), 6) as log_concept
    from c where code > 0
    """,
    ("ehr",),
)
def log_baseline(spark, sf_dir):
    rows = counts(Inputs(spark, sf_dir)).where(F.col("code") > 0)
    out = rows.select("patient_num", *[c.alias(n) for n, c in scorers.baseline_scores().items()])
    return rounded(out, "log_code", "log_concept")


def with_main_code(data: Inputs):
    """Counts of the curated features for patients with the main code, and the features."""
    coded, concepts = curated(data)
    rows = stage(wide(data, coded + concepts).where(F.col("code") > 0), "wide")
    return rows, coded, concepts


def picked_sql(seed: int, share: str) -> str:
    order = f"md5(concat(patient_num, ':', {seed})), patient_num"
    return f"row_number() over (order by {order}) <= round_even(count(*) over () * {share}, 0)"


@query(
    "corrupt_split",
    f"""
    with c as ({COUNTS_SQL}),
    x as (select patient_num, ln(1 + code) as code, ln(1 + concept) as concept from c)
    select patient_num, round(code, 6) as code, round(concept, 6) as concept,
      round(case when {picked_sql(2023, '0.2::double')} then avg(code) over () else code end, 6) as corrupt_code,
      round(case when {picked_sql(2024, '0.2::double')} then avg(concept) over () else concept end, 6)
        as corrupt_concept,
      {picked_sql(2025, '(2::double / 3)')} as is_train
    from x
    """,
    ("ehr",),
)
def corrupt_split(spark, sf_dir):
    rows = counts(Inputs(spark, sf_dir)).select(
        "patient_num", *[F.log1p(c).alias(c) for c in ("code", "concept")]
    )
    split = scorers.corrupt_and_split(stage(rows, "counts"), ["code", "concept"])
    return rounded(split, "code", "concept", "corrupt_code", "corrupt_concept")


@query("mixture_scores")
def mixture_scores(spark, sf_dir):
    rows = stage(counts(Inputs(spark, sf_dir)).where(F.col("code") > 0), "counts")
    score, share = scorers.mixture_score(rows)
    scored = rows.select("patient_num", *COUNT_COLUMNS, score.alias("score"))
    cut = scorers.share_cut(scored, "score", share)
    return scored.withColumn("above_cut", F.col("score") > cut.scalar())


@query("normalised_scores")
def normalised_scores(spark, sf_dir):
    rows, coded, concepts = with_main_code(Inputs(spark, sf_dir))
    scores = scorers.normalised_scores(rows, [*coded, *concepts])
    return rows.select("patient_num", *COUNT_COLUMNS, *[c.alias(n) for n, c in scores.items()])


@query("covariance_scores")
def covariance_scores(spark, sf_dir):
    rows, coded, concepts = with_main_code(Inputs(spark, sf_dir))
    fit = scorers.covariance_scores(rows, coded, concepts)
    return rows.select(
        "patient_num", *COUNT_COLUMNS, *[c.alias(n) for n, c in fit.scores.items()]
    )


@query("coef_compare")
def coef_compare(spark, sf_dir):
    rows, coded, concepts = with_main_code(Inputs(spark, sf_dir))
    fit = scorers.covariance_scores(rows, coded, concepts)
    return scorers.compare_coefficients(fit.table(spark), "cov_code", "cov_both")


def all_scores(data: Inputs):
    coded, concepts = curated(data)
    rows = labelled(data, wide(data, coded + concepts))
    return scorers.score_table(
        rows, coded, concepts, ["patient_num", "is_case", "is_registry", "is_labeled"]
    )[0]


@query("score_table")
def score_table(spark, sf_dir):
    return all_scores(Inputs(spark, sf_dir))


@query("phenotype_quality")
def phenotype_quality(spark, sf_dir):
    """All scores against labels at four specificities, registry patients and the rest apart."""
    scores = stage(
        all_scores(Inputs(spark, sf_dir)).where(F.col("is_labeled") == 1), "labelled"
    )
    long = scorers.long_scores(scores, ["is_case", "is_registry"], METHODS)
    stratum = F.when(F.col("is_registry"), "registry").otherwise("other")
    long = long.withColumn("method", F.concat_ws("/", stratum, "method"))
    return evaluate.metrics_at_specificity(long, label="is_case")


LONG_SQL = """
    long as (select patient_num, y, 'score_a' as method, score_a as score from scored
             union all select patient_num, y, 'score_b', score_b from scored)"""

ROC_SQL = f"""
    {LONG_SQL},
    g as (select method, score, sum(y) as pos, sum(1 - y) as neg from long group by 1, 2),
    t as (select method, sum(pos) as n_pos, sum(neg) as n_neg from g group by 1),
    c as (select g.*, t.n_pos, t.n_neg,
            lead(score) over w as nxt,
            n_pos - sum(pos) over w as tp, n_neg - sum(neg) over w as fp,
            n_pos - sum(pos) over w + pos as tp_at, n_neg - sum(neg) over w + neg as fp_at
          from g join t on g.method = t.method
          window w as (partition by g.method order by score)),
    roc as (
      select method, coalesce((score + nxt) / 2, cast('inf' as double)) as threshold,
        cast(tp as bigint) as tp, cast(fp as bigint) as fp,
        cast(n_pos as bigint) as n_pos, cast(n_neg as bigint) as n_neg from c
      union all
      select method, cast('-inf' as double), cast(n_pos as bigint), cast(n_neg as bigint),
        cast(n_pos as bigint), cast(n_neg as bigint) from t),
    curve as (select method, threshold, tp / n_pos as sensitivity,
                (n_neg - fp) / n_neg as specificity, tp, fp, n_pos, n_neg from roc)"""

AREA_SQL = """
    area as (select method,
               sum(pos * (n_neg - fp_at + neg / 2)) / max(n_pos * n_neg) as auroc,
               sum(pos / n_pos * tp_at / (tp_at + fp_at)) as auprc
             from c group by 1)"""

CUT_SQL = """
    gaps as (select curve.*, cut.cutoff, row_number() over (partition by method, cut.cutoff
               order by abs(specificity - cut.cutoff), threshold) as rn
             from curve, (select unnest([0.97::double, 0.95, 0.90, 0.80]) as cutoff) cut),
    cuts as (select * from gaps where rn = 1),
    metrics as (
      select k.method, k.cutoff, round(threshold, 8) as threshold,
        round(specificity, 6) as specificity, round(sensitivity, 6) as sensitivity,
        round(tp / nullif(tp + fp, 0), 6) as ppv,
        round((n_neg - fp) / nullif(n_neg - fp + n_pos - tp, 0), 6) as npv,
        round(auroc, 6) as auroc, round(auprc, 6) as auprc
      from cuts k join area a on k.method = a.method)"""

METRIC_NAMES = ["specificity", "sensitivity", "ppv", "npv", "auroc", "auprc"]


def long_scored(data: Inputs):
    return scorers.long_scores(data.scored, ["patient_num", "y"], ["score_a", "score_b"])


@query(
    "roc_curve",
    f"""
    with {ROC_SQL.strip()}
    select method, round(threshold, 8) as threshold, round(sensitivity, 6) as sensitivity,
      round(specificity, 6) as specificity, tp, fp, n_pos, n_neg from curve
    """,
    ("scored",),
)
def roc_curve(spark, sf_dir):
    out = evaluate.roc_curve(long_scored(Inputs(spark, sf_dir)))
    return rounded(rounded(out, "sensitivity", "specificity"), "threshold", places=8)


@query(
    "roc_oriented",
    f"""
    with {LONG_SQL.strip()},
    neg_long as (select patient_num, y, method, -score as score from long),
    med as (select method, quantile_cont(score, 0.5) filter (y = 0)
              > quantile_cont(score, 0.5) filter (y = 1) as flipped from neg_long group by 1)
    select l.patient_num, l.method, case when m.flipped then -l.score else l.score end as score,
      m.flipped
    from neg_long l join med m on l.method = m.method
    """,
    ("scored",),
)
def roc_oriented(spark, sf_dir):
    """Scores turned so that cases have the higher median."""
    rows = long_scored(Inputs(spark, sf_dir)).withColumn("score", -F.col("score"))
    return evaluate.orient(rows).select("patient_num", "method", "score", "flipped")


@query(
    "auroc_auprc",
    f"""
    with {ROC_SQL.strip()}, {AREA_SQL.strip()}
    select method, round(auroc, 6) as auroc, round(auprc, 6) as auprc from area
    """,
    ("scored",),
)
def auroc_auprc(spark, sf_dir):
    return rounded(evaluate.area_metrics(long_scored(Inputs(spark, sf_dir))), "auroc", "auprc")


def metrics(data: Inputs):
    out = rounded(evaluate.metrics_at_specificity(long_scored(data)), *METRIC_NAMES)
    return rounded(out, "threshold", places=8)


@query(
    "metrics_at_specificity",
    f"with {ROC_SQL.strip()}, {AREA_SQL.strip()}, {CUT_SQL.strip()} select * from metrics",
    ("scored",),
)
def metrics_at_specificity(spark, sf_dir):
    return metrics(Inputs(spark, sf_dir))


@query(
    "metrics_side_by_side",
    f"""
    with {ROC_SQL.strip()}, {AREA_SQL.strip()}, {CUT_SQL.strip()},
    wide as (
      select a.method, a.auroc, a.auprc, a.sensitivity as sensitivity_97, a.ppv as ppv_97,
        a.npv as npv_97, b.sensitivity as sensitivity_95, b.ppv as ppv_95, b.npv as npv_95
      from metrics a join metrics b on a.method = b.method
      where a.cutoff = 0.97::double and b.cutoff = 0.95::double),
    tall as (unpivot wide on columns(* exclude (method)) into name metric value value)
    select metric, max(value) filter (method = 'score_a') as score_a,
      max(value) filter (method = 'score_b') as score_b from tall group by 1
    """,
    ("scored",),
)
def metrics_side_by_side(spark, sf_dir):
    """Two cutoffs side by side, turned so that methods are columns."""
    wide = evaluate.side_by_side(
        metrics(Inputs(spark, sf_dir)), 0.97, 0.95
    )
    return evaluate.transposed(wide, ["score_a", "score_b"])


@query(
    "specificity_cut",
    f"""
    with {ROC_SQL.strip()}, {AREA_SQL.strip()}, {CUT_SQL.strip()}
    select l.patient_num, l.method, l.score > k.threshold as predicted
    from long l join cuts k on l.method = k.method where k.cutoff = 0.90::double
    """,
    ("scored",),
)
def specificity_cut(spark, sf_dir):
    rows = stage(long_scored(Inputs(spark, sf_dir)), "long")
    # One row per method.
    cuts = evaluate.cut_points(rows, [0.90]).select("method", "threshold")
    return rows.join(F.broadcast(cuts), "method").select(
        "patient_num", "method", (F.col("score") > F.col("threshold")).alias("predicted")
    )


LABELS_SQL = """
    rev as (select patient_num, min(case when ms in (2, 3) then 0 when ms = 1 then 1 end) as a
            from ann group by 1),
    regs as (select patient_num, min(case when enrollment_diagnosis in (7, 8, 11, 12) then 0
               when enrollment_diagnosis in (1, 2, 3, 4, 5, 6, 9, 10) then 1 end) as a
             from reg group by 1),
    lab as (
      select b.patient_num, coalesce(g.a, r.a) as is_case, g.patient_num is not null as is_registry,
        case when coalesce(g.a, r.a) is null then 0 else 1 end as is_labeled
      from (select distinct patient_num from ehr) b left join rev r on b.patient_num = r.patient_num
        left join regs g on b.patient_num = g.patient_num)"""


@query(
    "phenotype_list",
    f"""
    with {ROC_SQL.strip()}, {AREA_SQL.strip()}, {CUT_SQL.strip()}, {LABELS_SQL.strip()}
    select l.patient_num, l.is_labeled, l.is_case, l.is_registry,
      cast(s.score_b > (select threshold from cuts where method = 'score_b'
        and cutoff = 0.90::double) as int) as pred_90,
      cast(s.score_b > (select threshold from cuts where method = 'score_b'
        and cutoff = 0.95::double) as int) as pred_95
    from lab l left join scored s on l.patient_num = s.patient_num
    """,
    ("scored", "ehr", "ann", "reg"),
)
def phenotype_list(spark, sf_dir):
    data = Inputs(spark, sf_dir)
    patients = stage(labelled(data, data.ehr.select("patient_num").distinct()), "labels")
    cuts = stage(evaluate.cut_points(long_scored(data)), "cuts")
    scored = patients.drop("is_registry").join(
        data.scored.select("patient_num", F.col("score_b").alias("score")), "patient_num"
    )
    return evaluate.phenotype_list(patients, scored, cuts, "score_b")


@query(
    "phenotype_list_model",
    f"""
    with per_patient as ({COUNTS_SQL}), {LABELS_SQL.strip()},
    model as (select patient_num, ln(1 + code) as score from per_patient where code > 0),
    scored as (select l.patient_num, l.is_case as y, m.score as score_a, m.score as score_b
               from lab l join model m on l.patient_num = m.patient_num
               where l.is_labeled = 1 and not l.is_registry),
    {ROC_SQL.strip()}, {AREA_SQL.strip()}, {CUT_SQL.strip()}
    select l.patient_num, l.is_labeled, l.is_case, l.is_registry,
      cast(m.score > (select threshold from cuts where method = 'score_a'
        and cutoff = 0.90::double) as int) as pred_90,
      cast(m.score > (select threshold from cuts where method = 'score_a'
        and cutoff = 0.95::double) as int) as pred_95
    from lab l left join model m on l.patient_num = m.patient_num
    """,
    ("ehr", "ann", "reg"),
)
def phenotype_list_model(spark, sf_dir):
    """Patients with the main code scored by a model; cuts from labelled patients not in the registry."""
    data = Inputs(spark, sf_dir)
    patients = stage(labelled(data, data.ehr.select("patient_num").distinct()), "labels")
    score = scorers.baseline_scores()["log_code"].alias("score")
    model = counts(data).where(F.col("code") > 0).select("patient_num", score)
    scored = stage(patients.drop("is_registry").join(model, "patient_num"), "scored")
    known = scored.join(patients.where("not is_registry").select("patient_num"), "patient_num", "left_semi")
    long = known.where("is_labeled = 1").select("patient_num", F.col("is_case").alias("y"), "score", F.lit("model").alias("method"))
    cuts = stage(evaluate.cut_points(long), "cuts")
    return evaluate.phenotype_list(patients, scored, cuts, "model")


@query("phenotype_list_fitted")
def phenotype_list_fitted(spark, sf_dir):
    """All patients with predictions by the fitted covariance score of codes and concepts; cuts from
    labelled patients outside the registry."""
    data = Inputs(spark, sf_dir)
    patients = stage(labelled(data, data.ehr.select("patient_num").distinct()), "labels")
    fitted = stage(all_scores(data), "fitted").withColumn("score", F.col("cov_both"))
    outside = fitted.where((F.col("is_labeled") == 1) & ~F.col("is_registry"))
    long = outside.select("patient_num", F.col("is_case").alias("y"), "score", F.lit("cov_both").alias("method"))
    cuts = stage(evaluate.cut_points(long, [0.90, 0.95]), "cuts")
    scored = fitted.select("patient_num", "is_labeled", "is_case", "score")
    return evaluate.phenotype_list(patients, scored, cuts, "cov_both")


@query(
    "label_or_prediction",
    f"""
    with {LABELS_SQL.strip()}
    select l.patient_num, coalesce(l.is_case, case when s.score_a > 500 then 1 else 0 end) as outcome
    from lab l join scored s on l.patient_num = s.patient_num
    """,
    ("scored", "ehr", "ann", "reg"),
)
def label_or_prediction(spark, sf_dir):
    data = Inputs(spark, sf_dir)
    patients = labelled(data, data.ehr.select("patient_num").distinct())
    rows = patients.join(data.scored, "patient_num").withColumn(
        "prediction", F.when(F.col("score_a") > 500, 1).otherwise(0)
    )
    return cohort.label_or_prediction(rows, "is_case", "prediction", "outcome").select(
        "patient_num", "outcome"
    )


@query(
    "labelled_both_sources",
    "select patient_num from ann intersect select patient_num from reg",
    ("ann", "reg"),
)
def labelled_both_sources(spark, sf_dir):
    data = Inputs(spark, sf_dir)
    return data.ann.select("patient_num").intersect(data.reg.select("patient_num"))


@query(
    "case_only_bootstrap",
    f"""
    with {LONG_SQL.strip()},
    draws as (select *, unnest(range(1, 51)) as draw from long where y is not null and score is not null),
    units as (select *, cast(concat('0x', substr(md5(concat(patient_num, ':', draw, ':', 11)), 1, 13)) as bigint)
                / 4503599627370496.0::double as unit from draws),
    weighed as (select *, len(list_filter({evaluate.poisson_steps()}::double[], lambda s: s <= unit)) as w
                from units),
    g as (select method, draw, score, sum(w * y) as pos, sum(w * (1 - y)) as neg from weighed
          where w > 0 group by 1, 2, 3),
    ranked as (select *, sum(pos) over k as n_pos, sum(neg) over k as n_neg,
                 coalesce(sum(neg) over (partition by method, draw order by score
                   rows between unbounded preceding and 1 preceding), 0) as below
               from g window k as (partition by method, draw)),
    areas as (select method, draw, sum(pos * (below + neg / 2)) / nullif(max(n_pos * n_neg), 0) as auroc
              from ranked group by 1, 2)
    select method, round(avg(auroc), 6) as auroc_mean, round(stddev_samp(auroc), 6) as auroc_sd
    from areas group by 1
    """,
    ("scored",),
)
def case_only_bootstrap(spark, sf_dir):
    """Spread of the area over resamples of all scored patients."""
    areas = evaluate.bootstrap_areas(long_scored(Inputs(spark, sf_dir)), "patient_num")
    return rounded(areas, "auroc_mean", "auroc_sd")


@query(
    "case_only_evaluation",
    f"""
    with {LONG_SQL.strip()},
    cuts as (select method, quantile_cont(score, 0.8) as cut from long where score is not null group by 1),
    draws as (select patient_num, method, score, case when y = 1 and patient_num % 2 = 0 then 1 else 0 end as known,
                unnest(range(0, 51)) as round from long where score is not null),
    units as (select *, cast(concat('0x', substr(md5(concat(patient_num, ':', round, ':', 11)), 1, 13)) as bigint)
                / 4503599627370496.0::double as unit from draws),
    weighed as (select *, case when round = 0 then 1
                  else len(list_filter({evaluate.poisson_steps()}::double[], lambda s: s <= unit)) end as w from units),
    g as (select method, round, score, sum(w)::double as n_all, sum(w * known)::double as n_known
          from weighed group by 1, 2, 3 having sum(w) > 0),
    ranked as (select *, sum(n_all) over k as all_total, nullif(sum(n_known) over k, 0) as known_total,
                 coalesce(sum(n_all) over b, 0) as all_before, coalesce(sum(n_known) over b, 0) as known_before
               from g window k as (partition by method, round),
                 b as (partition by method, round order by score rows between unbounded preceding and 1 preceding)),
    tails as (select r.*, c.cut, (known_total - known_before) / known_total as tail, (all_total - all_before) / all_total as whole
              from ranked r join cuts c on r.method = c.method),
    parts as (select method, round, min(case when tail >= 0.1::double then least(whole / tail, 1) end) as p,
                sum(n_known * (all_before + n_all / 2) / known_total / all_total) as wins,
                sum(case when score > cut then n_known else 0 end / known_total) as sensitivity,
                sum(case when score > cut then n_all else 0 end / all_total) as rate from tails group by 1, 2),
    rates as (select *, (wins - p / 2) / nullif(1 - p, 0) as auroc, least(greatest((rate - p * sensitivity) / nullif(1 - p, 0), 0), 1) as fpr,
                least(p * sensitivity / nullif(rate, 0), 1) as ppv from parts),
    metrics as (select *, 2 * ppv * sensitivity / nullif(ppv + sensitivity, 0) as f_score from rates),
    values_of as ({" union all ".join(f"select method, round, '{m}' as metric, {m} as value from metrics" for m in evaluate.CASE_METRICS)})
    select method, metric, round(max(value) filter (round = 0), 6) as estimate, round(avg(value) filter (round > 0), 6) as mean,
      round(stddev_samp(value) filter (round > 0), 6) as sd, round(quantile_cont(value, 0.025) filter (round > 0), 6) as low,
      round(quantile_cont(value, 0.975) filter (round > 0), 6) as high
    from values_of group by 1, 2
    """,
    ("scored",),
)
def case_only_evaluation(spark, sf_dir):
    """Quality with intervals where half of the cases are known and all others are unlabelled."""
    known = (F.col("y") == 1) & (F.col("patient_num") % 2 == 0)
    out = evaluate.case_only_evaluation(long_scored(Inputs(spark, sf_dir)), "patient_num", known)
    return rounded(out, "estimate", "mean", "sd", "low", "high")


@query(
    "circular_chart",
    f"""
    with {ROC_SQL.strip()}, {AREA_SQL.strip()}, {CUT_SQL.strip()},
    q as (select distinct 'all' as site, method, auroc from metrics),
    r as (select *, row_number() over (order by auroc, site, method) as rn, count(*) over () as k
          from q)
    select concat(site, ' - ', method) as label, cast(rn as int) as id,
      round(90 - 360 * (rn - 0.5) / k, 6) as angle, auroc, round(auroc - 0.5, 6) as height
    from r
    """,
    ("scored",),
)
def circular_chart(spark, sf_dir):
    quality = metrics(Inputs(spark, sf_dir))
    bars = quality.select(F.lit("all").alias("site"), "method", "auroc").distinct()
    return rounded(report.circular_bars(bars, 0.5), "angle", "height")


RADAR = ["auroc", "auprc", "npv", "ppv", "sensitivity"]


@query(
    "radar_chart",
    f"""
    with {ROC_SQL.strip()}, {AREA_SQL.strip()}, {CUT_SQL.strip()}
    select cutoff, method as series,
      cast(row_number() over (partition by cutoff order by method) + 2 as int) as position,
      {', '.join(RADAR)} from metrics
    union all select distinct cutoff, 'max', 1, {', '.join('1.0::double' for _ in RADAR)} from metrics
    union all select distinct cutoff, 'min', 2, {', '.join('0.5::double' for _ in RADAR)} from metrics
    """,
    ("scored",),
)
def radar_chart(spark, sf_dir):
    quality = stage(metrics(Inputs(spark, sf_dir)), "metrics")
    return report.radar_rows(quality, "cutoff", "method", RADAR, 0.5, 1.0)
