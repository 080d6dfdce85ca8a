"""Evidence tables from the test tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ADAPTERS = {
    "papers": """
select 'p' || cast(o_orderkey as string) as id,
  case when o_custkey % 5 = 0 then 'https://doi.org/10.5/C' || cast(o_custkey as string) || '/' when o_custkey % 5 = 1 then '' end as doi,
  case when o_custkey % 5 in (1, 2) then cast(o_custkey as string) end as pmid,
  'Studies of ' || cast(o_custkey as string) || ' (part)' as title,
  cast(year(o_orderdate) as int) as year,
  case when o_orderkey % 11 <> 0 then 'Author ' || cast(o_custkey % 70 as string) end as first_author,
  case o_orderpriority when '1-URGENT' then 'clinical_trial' when '2-HIGH' then 'human_cohort' when '3-MEDIUM' then 'animal' when '5-LOW' then 'review' end as study_type,
  case o_orderstatus when 'P' then true when 'F' then false end as is_preprint,
  case when o_orderkey % 97 = 0 then true when o_orderkey % 2 = 0 then false end as retracted
from {orders}""",
    "findings": """
select 'f' || cast(l_orderkey as string) || '_' || cast(l_linenumber as string) as id,
  'p' || cast(l_orderkey as string) as paper, 's' || cast(l_suppkey as string) as src,
  case l_linestatus when 'O' then 'activates' else 'inhibits' end as how, p_brand as dst,
  case l_returnflag when 'A' then 'yes' when 'R' then 'no' else 'no_effect' end as says,
  cast(year(l_shipdate) as string) as setting, case when l_partkey % 50 = 0 then null else l_discount < 0.08 end as is_own_result,
  l_tax >= 0.06 as hedged, 1 - l_discount as confidence, cast(year(l_shipdate) - 1991 as int) as round,
  case l_suppkey % 7 when 0 then null when 1 then false else true end as quote_verified,
  '“Effect”  of ' || p_brand as quote, 'k' || cast(l_partkey as string) as part, l_extendedprice as price, cast(l_shipdate as string) as shipped
from {lineitem} join {part} on l_partkey = p_partkey""",
    "things": """
select 's' || cast(s_suppkey as string) as id, s_name as name, 'small_molecule' as kind, cast(null as string) as uniprot_accession from {supplier}
union all select distinct p_brand, p_brand, 'protein', case when p_brand > 'Brand#3' then ' ' || lower(replace(p_brand, '#', '')) end from {part}
union all select 'n' || cast(n_nationkey as string), n_name, 'disease', null from {nation}""",
    "meta": """
select 'g_1' as graph_id, 2 as round, 'partial' as status, 'gone <b>away</b>' as error, cast((select count(*) from {orders}) as int) as found, 7 as read,
  cast(null as int) as used, true as truncated, 'budget' as stop_reason, 'standard' as depth, cast(null as string) as years, cast(null as int) as max_papers, 4 as max_queries,
  split('first query;second query', ';') as queries, split('years: all (not supplied);depth: standard', ';') as defaults_applied, cast(3 as bigint) as no_quote_discarded""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(ADAPTERS[name].format_map({t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def sql(*names: str) -> str:
    """The adapters as common table expressions for DuckDB."""
    own = {t: t for t in TABLES}
    return "with recursive " + ", ".join(f"{n} as ({ADAPTERS[n].format_map(own)})" for n in names)
