"""Queries from raw events to features, vocabularies and prevalence."""

from __future__ import annotations

from pyspark.sql import functions as F

from longspan.operators import features, sparse, summary
from longspan.operators.scorers import covariance
from longspan.plans.base import Inputs, query, rounded
from longspan.sources.stages import load_table, save_clustered, scratch_path, stage
from longspan.sources.views import ANCHOR, CONCEPT

COUNTS_SQL = """
    select patient_num, count(*) as utl, cast(count_if(feature_id = 'PheCode:335') as bigint) as code,
      cast(count_if(feature_id = 'C0026769') as bigint) as concept,
      cast(count_if(feature_id in ('PheCode:335', 'C0026769')) as bigint) as code_concept
    from ehr group by 1"""

# The curated features of the given tables, for the SQL side; Spark reads them from the table.
CODED = [f"{space}:{k}" for space in ("PheCode", "RXNORM", "CCS-PCS") for k in range(1, 26)]
CONCEPTS = [f"C00000{k}" for k in range(10, 26)]

CARRIED = ["RXNORM:1", "RXNORM:2"]


def counts(data: Inputs):
    return features.patient_counts(data.ehr, ANCHOR, CONCEPT)


def curated(data: Inputs) -> tuple[list[str], list[str]]:
    """Flagged coded features and concepts."""
    return features.flagged(data.curated, "coded"), features.flagged(data.curated, "concept")


def wide(data: Inputs, chosen: list[str]):
    return features.wide_matrix(data.ehr, ANCHOR, CONCEPT, chosen)


@query("patient_counts", COUNTS_SQL, ("ehr",))
def patient_counts(spark, sf_dir):
    return counts(Inputs(spark, sf_dir))


@query(
    "feature_sets",
    """
    select feature_id from (
      select feature_id from ehr where feature_id like 'PheCode:%'
      union select feature_id from drug
      union select feature_id from ehr where feature_id like 'C0%')
    where feature_id not in ('PheCode:335', 'C0026769')
    """,
    ("ehr", "drug"),
)
def feature_sets(spark, sf_dir):
    data = Inputs(spark, sf_dir)
    coded = data.ehr.where(F.col("feature_id").startswith("PheCode:"))
    concepts = data.ehr.where(F.col("feature_id").startswith("C0"))
    return features.feature_set([coded, data.drug, concepts], [ANCHOR, CONCEPT])


@query(
    "wide_matrix",
    f"with c as ({COUNTS_SQL}), w as (select patient_num, "
    + ", ".join(f"cast(count_if(feature_id = '{f}') as bigint) as \"{f}\"" for f in CODED + CONCEPTS)
    + " from ehr group by 1) select c.*, "
    + ", ".join(f'w."{f}"' for f in CODED + CONCEPTS)
    + " from c join w on c.patient_num = w.patient_num",
    ("ehr",),
)
def wide_matrix(spark, sf_dir):
    data = Inputs(spark, sf_dir)
    coded, concepts = curated(data)
    return wide(data, coded + concepts)


@query(
    "sparse_covariance",
    """
    with places as (select feature_id, row_number() over (order by feature_id) as place
                    from (select distinct feature_id from curated where flag = 1 and feature_id is not null)),
    x as (select patient_num, place, ln(1 + count(*)) as x from ehr join places on ehr.feature_id = places.feature_id
          where patient_num is not null group by 1, 2),
    t as (select place, sum(x) as total from x group by 1),
    n as (select cast(count(distinct patient_num) as double) as n from ehr),
    p as (select a.place as a, b.place as b, count(*) as n_both, sum(a.x * b.x) as s
          from x a join x b on a.patient_num = b.patient_num and a.place <= b.place group by 1, 2)
    select cast(a as int) as a, cast(b as int) as b, n_both, round((s - u.total * v.total / n) / (n - 1), 6) as cov
    from p join t u on p.a = u.place join t v on p.b = v.place, n
    """,
    ("ehr", "curated"),
)
def sparse_covariance(spark, sf_dir):
    """Covariances of log counts over sparse rows, for pairs that some patient has both of."""
    data = Inputs(spark, sf_dir)
    rows = sparse.sparse_counts(data.ehr, sparse.feature_places(data.curated), ANCHOR, CONCEPT)
    return rounded(sparse.sparse_covariance(stage(rows, "sparse")), "cov")


@query(
    "log_corr",
    f"""
    with c as ({COUNTS_SQL})
    select round(corr(ln(1 + code), ln(1 + concept)), 6) as correlation from c where code > 0
    """,
    ("ehr",),
)
def log_corr(spark, sf_dir):
    rows = counts(Inputs(spark, sf_dir)).where(F.col("code") > 0)
    return rounded(summary.log_correlation(rows, "code", "concept"), "correlation")


COV_COLUMNS = ["utl", "code", "concept", "code_concept"]


@query(
    "covariance_long",
    f"with c as ({COUNTS_SQL}), x as (select patient_num % 3 <> 0 as is_train, "
    + ", ".join(f"ln(1 + {c}) as {c}" for c in COV_COLUMNS)
    + " from c) "
    + " union all ".join(
        f"select is_train, '{a}' as a, '{b}' as b, round(covar_samp({a}, {b}), 6) as cov,"
        " count(*) as n from x group by 1"
        for a in COV_COLUMNS
        for b in COV_COLUMNS
    ),
    ("ehr",),
)
def covariance_long(spark, sf_dir):
    rows = counts(Inputs(spark, sf_dir)).select(
        (F.col("patient_num") % 3 != 0).alias("is_train"),
        *[F.log1p(c).alias(c) for c in COV_COLUMNS],
    )
    return rounded(covariance(rows, COV_COLUMNS, "is_train").drop("mean_a"), "cov")


HARMONISED_SQL = """
    select patient_num, start_date, replace(feature_id, 'CCS-PCS:', 'CCS:') as feature_id,
      cast(year(start_date) as int) as year,
      split_part(replace(feature_id, 'CCS-PCS:', 'CCS:'), ':', 1) as namespace
    from ehr
    where split_part(replace(feature_id, 'CCS-PCS:', 'CCS:'), ':', 1)
      in ('RXNORM', 'PheCode', 'LOINC', 'CCS')"""


@query(
    "harmonise_codes",
    f"""
    with h as ({HARMONISED_SQL})
    select * from h where patient_num in (select patient_num from pe) and patient_num % 2 = 1
    union all select * from h where patient_num % 2 = 0 and patient_num not in
      (select patient_num from reg)
    """,
    ("ehr", "pe", "reg"),
)
def harmonise_codes(spark, sf_dir):
    return united_sites(Inputs(spark, sf_dir))


def united_sites(data: Inputs):
    """Two sites' events, one kept by a patient list and one by exclusion, under common codes."""
    site = F.col("patient_num") % 2
    first = features.keep_patients(data.ehr.where(site == 1), data.pe)
    second = features.drop_patients(data.ehr.where(site == 0), data.reg)
    return features.harmonise(first).unionByName(features.harmonise(second))


@query(
    "pseudo_events",
    """
    with coded as (select patient_num, feature_id, month, n, split_part(feature_id, ':', 1) as ns
                   from mc where contains(feature_id, ':')),
    kept as (select * from coded where ns in ('RXNORM', 'PheCode', 'LOINC', 'CCS')),
    origin as (select patient_num, min(month) as m0 from kept
               where feature_id = 'PheCode:335' group by 1),
    spread as (
      select k.patient_num, k.feature_id, k.ns, k.n, (k.month - o.m0) * 30 as base, pe.start_date,
        unnest(range(k.n)) as i
      from kept k join origin o on k.patient_num = o.patient_num
        join pe on pe.patient_num = k.patient_num),
    dated as (
      select patient_num, feature_id, ns,
        start_date + cast(base + round_even(cast(i as double) / n * 30, 0) as int) as start_date
      from spread)
    select patient_num, start_date, feature_id, cast(year(start_date) as int) as year, ns as namespace from dated
    """,
    ("mc", "pe"),
)
def pseudo_events(spark, sf_dir):
    data = Inputs(spark, sf_dir)
    return features.pseudo_events(data.mc, data.pe, ANCHOR)


@query(
    "vocabulary",
    """
    with c as (select feature_id, count(*) as n from ehr group by 1),
    k as (select * from c where feature_id in (select feature_id from drug) or n > 400)
    select feature_id, n, cast(row_number() over (order by feature_id) as int) as id from k
    """,
    ("ehr", "drug"),
)
def vocabulary(spark, sf_dir):
    data = Inputs(spark, sf_dir)
    return features.vocabulary(data.ehr, data.drug, 400)


@query(
    "event_ids",
    """
    with c as (select feature_id, count(*) as n from ehr group by 1),
    k as (select feature_id, cast(row_number() over (order by feature_id) as int) as id
          from c where feature_id in (select feature_id from drug) or n > 400)
    select e.patient_num, e.start_date, k.id from ehr e join k on e.feature_id = k.feature_id
    """,
    ("ehr", "drug"),
)
def event_ids(spark, sf_dir):
    """Events with the vocabulary id of their code: the first match, never more rows."""
    data = Inputs(spark, sf_dir)
    vocab = features.vocabulary(data.ehr, data.drug, 400)
    return features.with_ids(data.ehr, vocab).select("patient_num", "start_date", "id")


CARRIED_SQL = """
    select patient_num, feature_id, min(d) as start_date from (
      select patient_num, feature_id,
        cast(date_trunc('month', start_date) + to_months(k) + to_days(cast(day(start_date) - 1 as int))
          as date) as d
      from (select patient_num, feature_id, start_date, unnest(range(24)) as kk,
              cast(kk as int) as k
            from ehr where feature_id in ('RXNORM:1', 'RXNORM:2')))
    group by patient_num, feature_id, date_trunc('month', d)"""


@query(
    "carry_forward",
    f"""
    select patient_num, start_date, feature_id from ehr
    where feature_id not in ('RXNORM:1', 'RXNORM:2')
    union all select patient_num, start_date, feature_id from ({CARRIED_SQL})
    """,
    ("ehr",),
)
def carry_forward(spark, sf_dir):
    return features.carry_forward(Inputs(spark, sf_dir).ehr, CARRIED)


@query(
    "class_features",
    """
    with x as (
      select feature_id from ehr
      union all select d.treatment_class from ehr e join drug d on e.feature_id = d.feature_id),
    c as (select feature_id, count(*) as n from x group by 1)
    select feature_id, n, cast(row_number() over (order by feature_id) as int) as id from c
    """,
    ("ehr", "drug"),
)
def class_features(spark, sf_dir):
    data = Inputs(spark, sf_dir)
    return features.vocabulary(features.class_events(data.ehr, data.drug), least=0)


PREVALENCE_SQL = """
    select f.year, f.feature_id, f.n, a.npe, f.n / a.npe as freq, f.totalcount
    from (select cast(year(start_date) as int) as year, feature_id, count(distinct patient_num) as n,
            count(*) as totalcount from ehr group by 1, 2) f
      join (select cast(year(start_date) as int) as year, count(distinct patient_num) as npe
            from ehr group by 1) a on f.year = a.year"""


@query(
    "yearly_prevalence",
    f"""
    with p as ({PREVALENCE_SQL})
    select year, feature_id, n, npe, round(freq, 6) as freq, totalcount from p
    """,
    ("ehr",),
)
def yearly_prevalence(spark, sf_dir):
    return rounded(features.yearly_prevalence(Inputs(spark, sf_dir).ehr), "freq")


@query(
    "exclude_out_of_range",
    """
    select feature_id, cast(year(start_date) as int) as year, count(*) as n from ehr
    where patient_num not in (select patient_num from ehr where start_date < date '1995-02-01'
                              or start_date > date '2023-12-31')
    group by 1, 2
    """,
    ("ehr",),
)
def exclude_out_of_range(spark, sf_dir):
    return features.in_range_counts(Inputs(spark, sf_dir).ehr, "1995-02-01", "2023-12-31")


@query(
    "prevalence_of_years",
    f"""
    with p as ({PREVALENCE_SQL})
    select year, feature_id, n, npe, round(freq, 6) as freq, totalcount from p where year between 1994 and 1996
    """,
    ("ehr",),
)
def prevalence_of_years(spark, sf_dir):
    """Prevalence of some years, from events kept in files clustered by date: only these are read."""
    path = scratch_path(spark, "by-date")
    save_clustered(Inputs(spark, sf_dir).ehr, path, ["start_date", "patient_num"])
    return rounded(features.yearly_prevalence(load_table(spark, path), 1994, 1996), "freq")
