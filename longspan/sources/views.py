"""Event-record views over the given tables.

Each view is one SQL text that Spark and DuckDB both run. Braces name the tables or views it reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS = {
    "ehr": """
        select o_custkey as patient_num, cast(l_shipdate as date) as start_date,
          case p_type when 'ECONOMY' then 'PheCode:335'
            when 'SMALL' then case when length(p_brand) = 7 then 'C0026769'
              else concat('C00000', substr(p_brand, 7)) end
            when 'MEDIUM' then concat('CCS-PCS:', substr(p_brand, 7))
            when 'LARGE' then concat('LOINC:', substr(p_brand, 7))
            when 'PROMO' then concat('RXNORM:', substr(p_brand, 7))
            else concat('PheCode:', substr(p_brand, 7)) end as feature_id
        from {lineitem} join {orders} on l_orderkey = o_orderkey
          join {part} on l_partkey = p_partkey""",
    "pat": """
        select c_custkey as patient_num, c_custkey + 1000000 as mapping_index,
          case c_mktsegment when 'BUILDING' then 'F' when 'FURNITURE' then 'F'
            when 'MACHINERY' then 'M' when 'HOUSEHOLD' then 'M' end as sex,
          n_nationkey as race_code,
          case when n_nationkey % 6 = 0 then null else n_regionkey end as ethnicity_code,
          case when n_nationkey % 5 = 0 then 'CHINESE' when n_nationkey % 5 = 1 then 'ALASKA NATIVE'
            when n_nationkey % 5 = 2 then 'UNREPORTED' when n_nationkey % 5 = 3 then null
            else 'WHITE' end as race_title,
          case when n_nationkey % 4 = 0 then 'NOT SPECIFIED' when n_nationkey % 4 = 1 then 'HISPANIC'
            when n_nationkey % 4 = 2 then null else 'NON HISPANIC' end as ethnicity_title,
          case when c_custkey % 4 = 0 then 'Unknown' when c_custkey % 4 = 1 then 'ASIAN'
            else 'WHITE' end as race_imputed,
          case when c_custkey % 10 = 0 then null else 1995 + c_custkey % 5 end as firstdiag_year,
          case when c_custkey % 3 = 0 then null else 1 + c_custkey % 12 end as firstdiag_month,
          1 + c_custkey % 31 as firstdiag_day,
          case when c_custkey % 20 = 0 then null else 1990 + c_custkey % 5 end as firstsymp_year,
          case when c_custkey % 17 = 0 then 'bad'
            else concat(cast(1930 + c_custkey % 60 as string), '-',
              lpad(cast(1 + c_custkey % 12 as string), 2, '0'), '-',
              lpad(cast(1 + c_custkey % 28 as string), 2, '0')) end as birth_text,
          c_acctbal
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "drug": """
        select concat('RXNORM:', cast(k as string)) as feature_id,
          concat('generic_', cast(k as string)) as generic_name,
          concat('CLASS_', cast(k % 6 as string)) as treatment_class
        from (select distinct cast(substr(p_brand, 7) as int) as k from {part}) t where k <= 20""",
    # Curated features: coded ones and concepts, and which of them the models take.
    "curated": """
        select concat('PheCode:', brand) as feature_id, 'coded' as kind, 1 as flag from {brands}
        union all select concat('RXNORM:', brand), 'coded', 1 from {brands}
        union all select concat('CCS-PCS:', brand), 'coded', 1 from {brands}
        union all select concat('LOINC:', brand), 'coded', 0 from {brands}
        union all select concat('C00000', brand), 'concept', 1 from {brands} where length(brand) = 2""",
    "brands": "select distinct substr(p_brand, 7) as brand from {part}",
    # Only some codes are in the drug list, so that lookups also miss.
    "mc": """
        select patient_num, feature_id,
          (year(start_date) - 1995) * 12 + month(start_date) as month, count(*) as n
        from {ehr} group by 1, 2, 3""",
    "pe": """
        select patient_num, min(start_date) as start_date
        from {ehr} where feature_id = 'PheCode:335' group by 1""",
    "ann": """
        select doc_id as patient_num,
          case when quality = 1 then 1 when toxic = 1 then 3 else 2 end as ms from {labels}""",
    "reg": """
        select c_custkey as patient_num, 1 + c_custkey % 12 as enrollment_diagnosis
        from {customer} where c_custkey % 7 = 0""",
    "scored": """
        select l.doc_id as patient_num, quality as y, cast(n_chars as double) as score_a,
          round(ln(1.0 + n_chars) + l.doc_id % 3, 6) as score_b
        from {labels} l join {documents} d on l.doc_id = d.doc_id""",
    "ev": """
        select user_id as patient_num, cast(ts as date) as start_date,
          concat(event_type, ':', cast(event_id % 3 as string)) as feature_id from {events}""",
}

ANCHOR = "PheCode:335"
CONCEPT = "C0026769"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over given tables, as a DataFrame."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    inputs = {key: view(spark, sf_dir, key) for key in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **inputs)


def with_views(body: str, *names: str) -> str:
    """SQL text for DuckDB with the views a query reads put in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in re.findall(r"\{(\w+)\}", VIEWS[name]):
            if needed in VIEWS:
                add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    heads = [f"{name} as ({re.sub(r'[{}]', '', VIEWS[name])})" for name in order]
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {', '.join(heads)}, {body[5:]}"
    return f"with {', '.join(heads)} {body}"
