"""SQL that says the same as queries of this package, where SQL can."""

from __future__ import annotations

_P5 = """
select 'report_pages' as src, page_id as row_id from report_pages
where length(text) > (select max_chars from size_limits where item = 'page_text')
union all
select 'report_tables', table_id from report_tables
where list_sum(list_transform(flatten(rows), lambda c: coalesce(length(c), 0))) > (select max_chars from size_limits where item = 'table_rows')
"""

_P5_COVERAGE = """
with t as (
  select 'report_pages' as src, page_id as row_id, length(text) as chars from report_pages where text is not null
  union all
  select 'report_tables', table_id, length(array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(coalesce(r, []), lambda c: coalesce(c, '')), chr(31))), chr(10))) from report_tables where rows is not null)
select src, row_id, chars, chars as reach, true as within_limit from t
"""

_P6_ROWS = """
with r as (
  select e.*, coalesce(len(flags), 0) as nf, value is not null as has, t.trust,
    regexp_replace(lower(company), '[\\s_\\-\\x{a0}]', '', 'g') as g
  from extractions e left join extractor_trust t using (extractor) where run_tag is not null)
"""

_P6_FOUND = (
    _P6_ROWS
    + """,
m as (
  select run_tag, report_year, kpi, g, count(*) as n, bool_or(has) as has, min(nf) as nf, max(confidence) as confidence, max(extracted_at) as extracted_at, max(trust) as trust
  from r group by all having count(*) > 1),
d as (
  select r.extraction_id, count(*) over (partition by run_tag, report_year, kpi, g) as k from r join m using (run_tag, report_year, kpi, g)
  where r.has = m.has and r.nf = m.nf and r.confidence is not distinct from m.confidence and r.extracted_at is not distinct from m.extracted_at and r.trust is not distinct from m.trust)
select extraction_id from d where k = 1
"""
)

_ORDER = "trust desc nulls last, extracted_at desc nulls last, confidence desc nulls last"


def _surviving(attribute: str) -> str:
    """SQL for the surviving value of an attribute: of the first row by non-null, trust, time, confidence and value."""
    return f"first_value({attribute}) over (partition by run_tag, report_year, kpi, g order by ({attribute} is not null) desc, {_ORDER}, {attribute} desc nulls last) as {attribute}"


def _of_quantity(part: str) -> str:
    return f"first_value(case when has then {part} end) over (partition by run_tag, report_year, kpi, g order by has desc, {_ORDER}, value desc nulls last, unit desc nulls last, reporting_year desc nulls last) as {part}"


_P6_SURVIVORS = (
    _P6_ROWS
    + f""",
k as (select * from r where report_year is not null and kpi is not null and g is not null),
m as (
  select run_tag, report_year, kpi, g, count(*) as n, bool_or(has) as has, min(nf) as nf, max(confidence) as confidence, max(extracted_at) as extracted_at, max(trust) as trust
  from k group by all),
d as (
  select run_tag, report_year, kpi, g, min(extraction_id) as id, count(*) as c from k join m using (run_tag, report_year, kpi, g)
  where k.has = m.has and k.nf = m.nf and k.confidence is not distinct from m.confidence and k.extracted_at is not distinct from m.extracted_at and k.trust is not distinct from m.trust group by all),
v as (
  select run_tag, report_year, kpi, g, first_value(extraction_id) over (partition by run_tag, report_year, kpi, g order by has desc, nf, confidence desc nulls last, extracted_at desc nulls last, trust desc nulls last, extraction_id) as best_id,
    {_of_quantity('value')}, {_of_quantity('unit')}, {_of_quantity('reporting_year')}, {_surviving('source_snippet')}, {_surviving('source_page')}, {_surviving('extractor')} from k)
select distinct v.run_tag, v.report_year, v.kpi, v.g as company, m.n, best_id, case when d.c = 1 then d.id end as dominant_id, v.value, v.unit, v.reporting_year, v.source_snippet, v.source_page, v.extractor
from v join m on m.run_tag = v.run_tag and m.report_year = v.report_year and m.kpi = v.kpi and m.g = v.g
  left join d on d.run_tag = v.run_tag and d.report_year = v.report_year and d.kpi = v.kpi and d.g = v.g"""
)

ORACLE = {"p5_found": _P5, "p5_coverage": _P5_COVERAGE, "p6_found": _P6_FOUND, "p6_survivors": _P6_SURVIVORS}
