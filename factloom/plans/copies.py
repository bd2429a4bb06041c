"""Queries on the second system's copy of the extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.copydiff import Field, diff_copies
from factloom.session import table

FIELDS = (Field("value", numeric=True), Field("run_tag"), Field("extractor"))


def p1_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every difference between extractions and extractions_copy with both values as text."""
    names = {"missing_in_right": "missing_in_copy", "missing_in_left": "missing_in_extractions"}
    found = diff_copies(table(spark, sf_dir, "extractions"), table(spark, sf_dir, "extractions_copy"), ["extraction_id"], FIELDS)
    field = F.coalesce(*[F.when(F.col("field") == k, F.lit(v)) for k, v in names.items()], F.col("field"))
    return found.select("extraction_id", field.alias("field"), F.col("left_value").alias("original_value"), F.col("right_value").alias("copy_value"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(extraction_id, field) of every difference of rows that have an id."""
    return p1_differences(spark, sf_dir).where("field not like 'null_key%'").select("extraction_id", "field")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of differences by kind."""
    return p1_found(spark, sf_dir).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


_DIFF_SQL = """
with a as (select extraction_id, value as v, run_tag, extractor from extractions),
b as (select distinct extraction_id, value as t, try_cast(trim(value) as double) as v, run_tag, extractor from extractions_copy),
j as (
  select coalesce(a.extraction_id, b.extraction_id) as extraction_id, a.extraction_id is null as no_a, b.extraction_id is null as no_b,
    not coalesce(a.v = b.v or abs(a.v - b.v) <= 1e-9 * greatest(abs(a.v), abs(b.v)), a.v is null and b.t is null) as dv,
    a.run_tag is distinct from b.run_tag as dr, a.extractor is distinct from b.extractor as de
  from a full join b on a.extraction_id = b.extraction_id)
select distinct extraction_id, 'missing_in_copy' as field from j where no_b
union all select distinct extraction_id, 'missing_in_extractions' from j where no_a
union all select distinct extraction_id, 'value' from j where not no_a and not no_b and dv
union all select distinct extraction_id, 'run_tag' from j where not no_a and not no_b and dr
union all select distinct extraction_id, 'extractor' from j where not no_a and not no_b and de
"""

# Numbers of 10,000,000 and more print with an exponent in the engine.
_AS_TEXT = """case when abs(v) >= 1e7 then (case when v < 0 then '-' else '' end) || left(d, 1) || '.' || (case when length(d) > 1 then substr(d, 2) else '0' end) || 'E' || (length(i) - 1)::varchar else s end"""
_VALUES_SQL = f"""
with n as (select extraction_id, value as v, value::varchar as s, run_tag, extractor from extractions),
p as (select *, ltrim(split_part(s, '.', 1), '-') as i, rtrim(ltrim(split_part(s, '.', 1), '-') || split_part(s, '.', 2), '0') as d from n),
t as (select extraction_id, {_AS_TEXT} as v, run_tag, extractor from p),
c as (select distinct extraction_id, value as t, run_tag, extractor from extractions_copy),
f as ({_DIFF_SQL})
select f.extraction_id, field, case field when 'value' then t.v when 'run_tag' then t.run_tag when 'extractor' then t.extractor end as original_value,
  case field when 'value' then c.t when 'run_tag' then c.run_tag when 'extractor' then c.extractor end as copy_value
from f left join t on t.extraction_id = f.extraction_id left join c on c.extraction_id = f.extraction_id"""

QUERIES = {"p1_found": p1_found, "p1_differences": p1_differences, "p1_counts": p1_counts}
ORACLE = {"p1_found": _DIFF_SQL, "p1_differences": _VALUES_SQL, "p1_counts": f"select field, count(*) as n from ({_DIFF_SQL}) group by field"}
