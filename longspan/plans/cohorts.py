"""Cohort, demographic and descriptive queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from longspan.functions import columns as C
from longspan.operators import cohort, summary
from longspan.operators.features import patient_counts
from longspan.operators.joins import first_per_key, lookup_join
from longspan.plans.base import Inputs, query, rounded
from longspan.sources import files
from longspan.sources.stages import load_table, save_table, scratch_path, stage
from longspan.sources.views import ANCHOR, CONCEPT

RACE_SQL = """
    case when race_title is null or race_title in ('OTHER', 'UNREPORTED', 'NOT SPECIFIED',
           'CHOSE NOT TO DISCLOSE RACE', 'Unknown or Not Reported',
           'UNREPORTED,CHOSE NOT TO DISCLOSE RACE', 'NA') then 'Unknown or Not Reported'
      when race_title in ('ALASKA NATIVE', 'AMERICAN INDIAN/ALASKA NATIVE')
        then 'American Indian/Alaska Native'
      when race_title in ('CHINESE', 'ASIAN INDIAN', 'FILIPINO', 'JAPANESE', 'KOREAN',
        'OTHER ASIAN') then 'Asian'
      when race_title in ('NATIVE HAWAIIAN', 'OTHER PACIFIC ISLANDER')
        then 'Native Hawaiian or Other Pacific Islander'
      else race_title end"""


@query(
    "scan_multi_union",
    """
    select patient_num, start_date, feature_id, cast(year(start_date) as int) as file_year from ehr
    union all
    select patient_num, start_date, feature_id, null as file_year from ev
    """,
    ("ehr", "ev"),
)
def scan_multi_union(spark, sf_dir):
    """Year files written as text, read back from a generated list of which some are missing."""
    data = Inputs(spark, sf_dir)
    path = scratch_path(spark, "years")
    dated = data.ehr.withColumn("year", F.year("start_date"))
    files.write_csv(dated, path, ["year"])
    first, last = dated.agg(F.min("year"), F.max("year")).first()
    names = [f"{path}/year={y}" for y in range(first - 3, last + 4)]
    events = files.with_file_year(
        files.read_batches(spark, names, files.EVENT_SCHEMA), "file_year"
    )
    return events.unionByName(data.ev, allowMissingColumns=True)


@query(
    "scan_name_pattern",
    """
    select feature_id, count(*) as n, cast(min(month) as int) as first_month, max(n) as most
    from mc group by feature_id
    """,
    ("mc",),
)
def scan_name_pattern(spark, sf_dir):
    """Monthly counts written tab-separated, found again by file name pattern."""
    path = scratch_path(spark, "monthly")
    Inputs(spark, sf_dir).mc.write.option("header", True).option("sep", "\t").csv(path)
    monthly = files.read_csv(
        spark, path, files.MONTHLY_SCHEMA, sep="\t", name_pattern="part-*"
    )
    return monthly.groupBy("feature_id").agg(
        F.count("*").alias("n"), F.min("month").alias("first_month"), F.max("n").alias("most")
    )


@query(
    "scan_filter_on_load",
    f"""
    select patient_num, start_date, feature_id from ehr where feature_id = '{ANCHOR}'
    """,
    ("ehr",),
)
def scan_filter_on_load(spark, sf_dir):
    """Batches of a thousand patients written as text; a generated list of them, some missing, is
    read with a filter on load."""
    data = Inputs(spark, sf_dir)
    path = scratch_path(spark, "batches")
    dealt = data.ehr.withColumn("batch", F.floor(F.col("patient_num") / 1000))
    files.write_csv(dealt.repartition("batch", "feature_id"), path, ["batch"])
    last = dealt.agg(F.max("batch")).first()[0] or 0
    names = [f"{path}/batch={k}" for k in range(-1, last + 3)]
    return files.read_batches(spark, names, files.EVENT_SCHEMA, F.col("feature_id") == ANCHOR)


@query(
    "dimension_scan",
    """
    select e.feature_id, d.generic_name, d.treatment_class
    from (select distinct feature_id from ehr where feature_id like 'RXNORM:%') e
      left join drug d on e.feature_id = d.feature_id
    """,
    ("ehr", "drug"),
)
def dimension_scan(spark, sf_dir):
    """A code sheet written and read as text under its schema, then looked up by code."""
    data = Inputs(spark, sf_dir)
    path = scratch_path(spark, "codes")
    files.write_csv(data.drug, path)
    codes = files.read_csv(spark, path, files.CODE_SCHEMA)
    wanted = data.ehr.where(F.col("feature_id").startswith("RXNORM:")).select("feature_id")
    return lookup_join(wanted.distinct(), codes, ["feature_id"])


@query(
    "period_partitions",
    """
    select year(start_date)::int as year, feature_id, count(*) as n from ehr
    where year(start_date) between 1996 and 1998 group by 1, 2
    """,
    ("ehr",),
)
def period_partitions(spark, sf_dir):
    """Yearly counts kept as one table partitioned by year, of which some years are read."""
    path = scratch_path(spark, "yearly")
    counts = (
        Inputs(spark, sf_dir)
        .ehr.groupBy(F.year("start_date").alias("year"), "feature_id")
        .agg(F.count("*").alias("n"))
    )
    save_table(counts, path, ["year"])
    return load_table(spark, path).where(F.col("year").between(1996, 1998))


@query(
    "complete_cases",
    """
    select patient_num, sex, race_title, ethnicity_code, firstdiag_year from pat
    where sex is not null and race_title is not null and ethnicity_code is not null
      and firstdiag_year is not null
    """,
    ("pat",),
)
def complete_cases(spark, sf_dir):
    columns = ["patient_num", "sex", "race_title", "ethnicity_code", "firstdiag_year"]
    return Inputs(spark, sf_dir).pat.select(*columns).dropna("any")


@query(
    "first_row_per_patient",
    """
    select patient_num, start_date, feature_id from (
      select *, row_number() over (partition by patient_num order by start_date, feature_id) as rn
      from ehr) where rn = 1
    """,
    ("ehr",),
)
def first_row_per_patient(spark, sf_dir):
    return first_per_key(Inputs(spark, sf_dir).ehr, ["patient_num"], ["start_date"])


@query(
    "cohort_build",
    """
    select f.patient_num, m.mapping_index, d.sex, d.race_code, d.ethnicity_code,
      case when d.race_code = 7 and d.ethnicity_code = 2 then 1
           when not (d.race_code = 7 and d.ethnicity_code = 2) then 0 end as majority
    from (select patient_num from ehr group by 1
          having count_if(feature_id = 'PheCode:335') >= 3) f
      left join (select patient_num, mapping_index from pat) m on f.patient_num = m.patient_num
      left join pat d on m.mapping_index = d.mapping_index
    where d.sex is not null
    """,
    ("ehr", "pat"),
)
def cohort_build(spark, sf_dir):
    """Patients flagged by three or more main-code events."""
    data = Inputs(spark, sf_dir)
    pat = data.pat
    flags = patient_counts(data.ehr, ANCHOR, CONCEPT).select(
        "patient_num", F.when(F.col("code") >= 3, 1).otherwise(0).alias("flagged")
    )
    return cohort.build_cohort(
        flags,
        pat.select("patient_num", "mapping_index"),
        pat.select("mapping_index", "sex", "race_code", "ethnicity_code"),
    ).select("patient_num", "mapping_index", "sex", "race_code", "ethnicity_code", "majority")


@query(
    "recode_impute",
    f"""
    select p.patient_num, {RACE_SQL} as race,
      case when p.race_title is null or p.race_title in ('UNREPORTED', 'Unknown')
        then q.race_imputed else p.race_title end as race_filled,
      nullif(p.sex, 'O') as sex, upper(p.race_imputed) as imputed_upper
    from pat p left join (select patient_num, race_imputed from pat where race_imputed <> 'Unknown') q
      on p.patient_num = q.patient_num
    """,
    ("pat",),
)
def recode_impute(spark, sf_dir):
    pat = Inputs(spark, sf_dir).pat
    second = pat.where(F.col("race_imputed") != "Unknown").select(
        "patient_num", F.col("race_imputed").alias("race_filled")
    )
    base = pat.select(
        "patient_num",
        cohort.recode_race(F.col("race_title")).alias("race"),
        F.col("race_title").alias("race_filled"),
        F.nullif(F.col("sex"), F.lit("O")).alias("sex"),
        F.upper("race_imputed").alias("imputed_upper"),
    )
    return cohort.impute_category(
        base, second, "patient_num", ["race_filled"], ["UNREPORTED", "Unknown"]
    ).select("patient_num", "race", "race_filled", "sex", "imputed_upper")


@query(
    "diag_date_duration",
    """
    with parts as (
      select patient_num, coalesce(firstdiag_year, firstsymp_year) as y,
        case when firstdiag_year is not null then coalesce(firstdiag_month, 7) else 7 end as m,
        case when firstdiag_year is not null then coalesce(firstdiag_day, 15) else 15 end as d
      from pat),
    dated as (
      select patient_num, case when y is null then null
        else try_cast(printf('%04d-%02d-%02d', y, m, d) as date) end as diag_date from parts)
    select patient_num, diag_date,
      round(date_diff('day', diag_date, date '2024-02-01') / 365.25, 6) as disease_duration
    from dated
    """,
    ("pat",),
)
def diag_date_duration(spark, sf_dir):
    pat = Inputs(spark, sf_dir).pat
    dated = pat.select(
        "patient_num",
        cohort.diagnosis_date(
            F.col("firstdiag_year"), F.col("firstdiag_month"), F.col("firstdiag_day"),
            F.col("firstsymp_year"),
        ).alias("diag_date"),
    )
    out = cohort.with_duration(dated, "diag_date", date(2024, 2, 1), "disease_duration")
    return rounded(out, "disease_duration")


@query(
    "date_parse_safe",
    """
    with texts as (
      select patient_num, case when patient_num % 2 = 0 and birth_text <> 'bad'
        then concat(substr(birth_text, 9, 2), '/', substr(birth_text, 6, 2), '/',
                    substr(birth_text, 1, 4)) else birth_text end as t from pat)
    select patient_num,
      cast(coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%d/%m/%Y')) as date) as birth_date,
      try_cast(substr(t, 1, 4) as bigint) as leading_number
    from texts
    """,
    ("pat",),
)
def date_parse_safe(spark, sf_dir):
    """Dates in two formats and ids as text, unusable ones null."""
    pat = Inputs(spark, sf_dir).pat
    text = F.col("birth_text")
    other = F.concat(
        F.substring(text, 9, 2), F.lit("/"), F.substring(text, 6, 2), F.lit("/"),
        F.substring(text, 1, 4),
    )
    mixed = F.when((F.col("patient_num") % 2 == 0) & (text != "bad"), other).otherwise(text)
    return pat.select("patient_num", mixed.alias("t")).select(
        "patient_num",
        C.parse_date(F.col("t"), "yyyy-MM-dd", "dd/MM/yyyy").alias("birth_date"),
        C.parse_id(F.substring("t", 1, 4)).alias("leading_number"),
    )


@query(
    "first_event_age",
    """
    with births as (select patient_num, try_cast(birth_text as date) as birth_date from pat),
    firsts as (select patient_num, min(start_date) as first_date from ehr
               where feature_id = 'PheCode:335' group by 1)
    select b.patient_num, first_date,
      round(date_diff('day', birth_date, first_date) / 365.25, 6) as age_at_diag,
      round(date_diff('day', first_date, date '2023-01-31') / 365.25, 6) as disease_duration
    from births b left join firsts f on b.patient_num = f.patient_num
    """,
    ("ehr", "pat"),
)
def first_event_age(spark, sf_dir):
    data = Inputs(spark, sf_dir)
    births = data.pat.select(
        "patient_num", C.parse_date(F.col("birth_text"), "yyyy-MM-dd").alias("birth_date")
    )
    out = cohort.ages_at_anchor(data.ehr, births, ANCHOR, date(2023, 1, 31)).drop("birth_date")
    return rounded(out, "age_at_diag", "disease_duration")


@query(
    "first_event_per_code",
    """
    select patient_num, feature_id, min(start_date) as first_date from ehr
    where feature_id in (select feature_id from drug) or feature_id = 'PheCode:335' group by 1, 2
    """,
    ("ehr", "drug"),
)
def first_event_per_code(spark, sf_dir):
    """First date per patient and code, for anchor events and listed drugs."""
    data = Inputs(spark, sf_dir)
    listed = data.drug.select("feature_id").union(
        spark.range(1).select(F.lit(ANCHOR).alias("feature_id"))
    )
    return cohort.first_dates(lookup_join(data.ehr, listed, ["feature_id"], "left_semi"))


@query(
    "ever_flag",
    """
    select patient_num,
      case when bool_or(feature_id in (select feature_id from drug)) then 'yes' else 'no' end
        as ever_treated
    from ehr group by 1
    """,
    ("ehr", "drug"),
)
def ever_flag(spark, sf_dir):
    data = Inputs(spark, sf_dir)
    return cohort.ever_flag(data.ehr, data.drug)


SITES_SQL = """
    with births as (select patient_num, try_cast(birth_text as date) as birth_date from pat),
    firsts as (select patient_num, min(start_date) as first_date from ehr
               where feature_id = 'PheCode:335' group by 1),
    ever as (select patient_num, case when bool_or(feature_id in (select feature_id from drug))
               then 'yes' else 'no' end as ever_treated from ehr group by 1),
    both_sides as (
      select coalesce(f.patient_num, e.patient_num) as patient_num, first_date, ever_treated
      from firsts f full join ever e on f.patient_num = e.patient_num),
    joined as (
      select b.patient_num, first_date, birth_date, ever_treated,
        case when b.patient_num % 2 = 1 then 'A' else 'B' end as site,
        case when b.patient_num % 2 = 1 then date '2022-11-30' else date '2023-01-31' end as ref
      from both_sides s right join births b on s.patient_num = b.patient_num)
    select patient_num, site, first_date, ever_treated,
      round(date_diff('day', birth_date, first_date) / 365.25, 6) as age_at_diag,
      round(date_diff('day', first_date, ref) / 365.25, 6) as disease_duration
    from joined"""


@query("site_summary_join", SITES_SQL, ("ehr", "pat", "drug"))
def site_summary_join(spark, sf_dir):
    return rounded(both_sites(Inputs(spark, sf_dir)), "age_at_diag", "disease_duration")


def both_sites(data: Inputs):
    """First main-code date, age then, duration and ever-treated flag of both sites' patients."""
    odd = F.col("patient_num") % 2 == 1
    patients = data.pat.select(
        "patient_num",
        C.parse_date(F.col("birth_text"), "yyyy-MM-dd").alias("birth_date"),
        F.when(odd, "A").otherwise("B").alias("site"),
        F.when(odd, F.lit(date(2022, 11, 30))).otherwise(F.lit(date(2023, 1, 31))).alias("reference"),
    )
    found = cohort.anchor_and_flag(data.ehr, ANCHOR, data.drug)
    return cohort.site_summary(found, patients).select(
        "patient_num", "site", "first_date", "ever_treated", "age_at_diag", "disease_duration"
    )


SITE_NUMBERS = ["age_at_diag", "disease_duration"]


def site_table_sql(site: str, where: str) -> str:
    return f"""
      select '{site}' as site, variable, null as level, count(value) as n, count(*) - count(value) as missing,
        round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, null as percent
      from numbers {where} group by variable
      union all
      select '{site}', 'ever_treated', ever_treated, count(*), (select count(*) - count(ever_treated) from s {where}),
        null, null, round(count(*) * 100.0 / (select count(ever_treated) from s {where}), 6)
      from s {where} {'and' if where else 'where'} ever_treated is not null group by ever_treated"""


@query(
    "table_one_sites",
    f"with s as ({SITES_SQL}), numbers as ("
    + " union all ".join(f"select site, '{c}' as variable, {c} as value from s" for c in SITE_NUMBERS)
    + ")"
    + " union all ".join(
        [site_table_sql("all", "")] + [site_table_sql(x, f"where site = '{x}'") for x in "AB"]
    ),
    ("ehr", "pat", "drug"),
)
def table_one_sites(spark, sf_dir):
    """Age at diagnosis, duration and treatment of each site's patients and of both together."""
    rows = stage(rounded(both_sites(Inputs(spark, sf_dir)), *SITE_NUMBERS), "sites")
    wanted = [*SITE_NUMBERS, "ever_treated"]
    tables = [
        summary.table_one(part, wanted, ["ever_treated"]).withColumn("site", F.lit(name))
        for name, part in [("all", rows)] + [(x, rows.where(F.col("site") == x)) for x in "AB"]
    ]
    out = tables[0].unionByName(tables[1]).unionByName(tables[2])
    return rounded(out, "mean", "sd", "percent")


@query(
    "recode_site_levels",
    f"""
    select patient_num, {RACE_SQL} as race,
      case when ethnicity_title is null or ethnicity_title in ('NOT SPECIFIED',
        'UNREPORTED/CHOSE NOT TO DISCLOSE', 'UNREPORTED', 'CHOSE NOT TO DISCLOSE') then 'unknown'
        else ethnicity_title end as ethnicity
    from pat
    """,
    ("pat",),
)
def recode_site_levels(spark, sf_dir):
    """Race and ethnicity titles of a site under the common levels."""
    return Inputs(spark, sf_dir).pat.select(
        "patient_num",
        cohort.recode_race(F.col("race_title")).alias("race"),
        cohort.recode_ethnicity(F.col("ethnicity_title")).alias("ethnicity"),
    )


@query(
    "freq_table",
    "select race_title as value, count(*) as n from pat where race_title is not null group by 1",
    ("pat",),
)
def freq_table(spark, sf_dir):
    return summary.frequency_table(Inputs(spark, sf_dir).pat, "race_title")


SUMMARY_COLUMNS = ["c_acctbal", "firstdiag_year", "firstdiag_month", "firstdiag_day"]


@query(
    "numeric_summary",
    """
    with v as ("""
    + " union all ".join(
        f"select '{c}' as variable, cast({c} as double) as value from pat" for c in SUMMARY_COLUMNS
    )
    + """)
    select variable, round(min(value), 6) as min, round(quantile_cont(value, 0.25), 6) as q1,
      round(quantile_cont(value, 0.5), 6) as median, round(avg(value), 6) as mean,
      round(quantile_cont(value, 0.75), 6) as q3, round(max(value), 6) as max,
      count(*) - count(value) as n_missing
    from v group by variable
    """,
    ("pat",),
)
def numeric_summary(spark, sf_dir):
    out = summary.numeric_summary(Inputs(spark, sf_dir).pat, SUMMARY_COLUMNS)
    return rounded(out, "min", "q1", "median", "mean", "q3", "max")


TABLE_NUMBERS = ["c_acctbal", "firstdiag_year"]
TABLE_FACTORS = ["sex", "race_title", "ethnicity_code"]


@query(
    "table_one",
    "with numbers as ("
    + " union all ".join(
        f"select '{c}' as variable, cast({c} as double) as value from pat" for c in TABLE_NUMBERS
    )
    + "), factors as ("
    + " union all ".join(
        f"select '{c}' as variable, cast({c} as string) as level from pat" for c in TABLE_FACTORS
    )
    + """), totals as (
      select variable, count(level) as known, count(*) - count(level) as missing
      from factors group by 1)
    select variable, cast(null as string) as level, count(value) as n,
      count(*) - count(value) as missing, round(avg(value), 6) as mean,
      round(stddev_samp(value), 6) as sd, cast(null as double) as percent
    from numbers group by 1
    union all
    select f.variable, f.level, count(*), max(t.missing), null, null,
      round(count(*) * 100.0 / max(t.known), 6)
    from factors f join totals t on f.variable = t.variable
    where f.level is not null group by 1, 2
    """,
    ("pat",),
)
def table_one(spark, sf_dir):
    out = summary.table_one(
        Inputs(spark, sf_dir).pat, [*TABLE_NUMBERS, *TABLE_FACTORS, "not_there"], TABLE_FACTORS
    )
    return rounded(out, "mean", "sd", "percent")


@query(
    "label_assignment",
    """
    with rev as (select patient_num, min(case when ms in (2, 3) then 0 when ms = 1 then 1 end) as a
                 from ann group by 1),
    regs as (select patient_num, min(case when enrollment_diagnosis in (7, 8, 11, 12) then 0
               when enrollment_diagnosis in (1, 2, 3, 4, 5, 6, 9, 10) then 1 end) as a
             from reg group by 1),
    base as (select distinct patient_num from ehr)
    select b.patient_num, coalesce(g.a, r.a) as is_case, g.patient_num is not null as is_registry,
      case when coalesce(g.a, r.a) is null then 0 else 1 end as is_labeled
    from base b left join rev r on b.patient_num = r.patient_num
      left join regs g on b.patient_num = g.patient_num
    """,
    ("ehr", "ann", "reg"),
)
def label_assignment(spark, sf_dir):
    data = Inputs(spark, sf_dir)
    return cohort.assign_labels(data.ehr.select("patient_num").distinct(), data.ann, data.reg)


@query(
    "missing_ehr_patients",
    "select patient_num from ann except select patient_num from pe",
    ("ann", "pe"),
)
def missing_ehr_patients(spark, sf_dir):
    data = Inputs(spark, sf_dir)
    return data.ann.select("patient_num").subtract(data.pe.select("patient_num"))


@query(
    "id_crosswalk",
    """
    select m.patient_num, p.mapping_index as study_id, r.enrollment_diagnosis
    from (select patient_num, mapping_index from pat) m
      join pat p on m.mapping_index = p.mapping_index
      join reg r on r.patient_num = p.patient_num
    where m.patient_num in (select patient_num from ehr)
    """,
    ("pat", "reg", "ehr"),
)
def id_crosswalk(spark, sf_dir):
    data = Inputs(spark, sf_dir)
    linkage = data.pat.select(F.col("mapping_index").alias("study_id"), "patient_num")
    clinical = data.reg.select(
        (F.col("patient_num") + 1000000).alias("study_id"), "enrollment_diagnosis"
    )
    return cohort.id_crosswalk(linkage, clinical, data.ehr.select("patient_num")).select(
        "patient_num", "study_id", "enrollment_diagnosis"
    )
