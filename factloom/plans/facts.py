"""Queries of the fact extraction engine over the test tables, with the SQL that says the same."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import registry
from factloom.functions import numbers, tablecells, text, units
from factloom.operators import comparison, evaluation, model, ranking, rules
from factloom.operators.extractor import ModelExtractor, RuleExtractor, rank_pages
from factloom.session import bounded, shared_folder, small, table
from factloom.sources import reports

CELL_TRIM = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}]"
ALIASES = ", ".join(f"('{a}', '{u}')" for a, u in registry.UNIT_ALIASES.items())
FACTORS = ", ".join(f"('{a}', '{b}', {f!r}::double)" for (a, b), f in registry.CONVERSIONS.items())


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, one row each where a page was delivered twice: that of the least page_id."""
    pages = table(spark, sf_dir, "report_pages")
    first = pages.groupBy("report_id", "page_num").agg(F.min("page_id").alias("page_id"))
    return pages.join(first.select("page_id"), "page_id", "left_semi")


def _kpi_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "kpis").select(F.col("kpi").alias("query_id"), F.flatten(F.transform("queries", text.bm25_tokens)).alias("words"))


def parse_number_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers printed in table cells."""
    cells = table(spark, sf_dir, "report_tables").select("table_id", F.posexplode("rows").alias("row_idx", "row")).select("table_id", "row_idx", F.posexplode("row").alias("col_idx", "cell"))
    return cells.withColumn("value", numbers.parse_number(F.col("cell"))).where("value is not null").select("table_id", "row_idx", "col_idx", "value")


def unit_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical units of all spellings."""
    return table(spark, sf_dir, "extractions").where("unit is not null").groupBy("unit").agg(F.count(F.lit(1)).alias("n")).withColumn("canonical", units.canonical_unit(F.col("unit")))


def unit_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiplier and unit of all spellings, headers included."""
    spelled = table(spark, sf_dir, "extractions").select("unit").unionAll(table(spark, sf_dir, "report_tables").select(F.explode("headers").alias("unit")))
    found = spelled.where("unit is not null").groupBy("unit").agg(F.count(F.lit(1)).alias("n")).withColumn("r", units.canonical_unit_robust(F.col("unit")))
    return found.select("unit", "n", "r.multiplier", F.col("r.unit").alias("canonical"))


def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in the canonical unit of their indicator by the plain conversion."""
    facts = table(spark, sf_dir, "extractions").join(small(table(spark, sf_dir, "kpis").select("kpi", "canonical_unit")), "kpi")
    return facts.select("extraction_id", units.to_canonical_value(F.col("value"), F.col("unit"), F.col("canonical_unit")).alias("canonical_value")).where("canonical_value is not null")


def parse_value_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value and unit read from snippets."""
    known = table(spark, sf_dir, "kpis").select("kpi", units.family(F.col("unit_family")).alias("accepted"))
    facts = table(spark, sf_dir, "extractions").where("source_snippet is not null").select("extraction_id", "kpi", "source_snippet").join(small(known), "kpi")
    read = facts.withColumn("p", units.parse_value(F.col("source_snippet"), F.col("accepted"))).where("p.unit is not null")
    return read.select("extraction_id", "p.value", "p.unit")


def co2_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First cells and headers in which CO2e was brought together."""
    cells = table(spark, sf_dir, "report_tables").select("table_id", F.explode(F.concat(F.coalesce("headers", F.array().cast("array<string>")), F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda r: F.get(r, 0)))).alias("cell"))
    return cells.withColumn("normalised", text.normalize_co2(F.col("cell"))).where("normalised != cell").groupBy("cell", "normalised").agg(F.count(F.lit(1)).alias("n"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents by the plain rule: how many, their characters, and the longest."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.transform(text.split_sentences(F.col("text")), F.length).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("sentences"), F.aggregate("s", F.lit(0), lambda a, b: a + b).cast("long").alias("chars"), F.array_max("s").cast("long").alias("longest"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents as BM25 counts them."""
    found = table(spark, sf_dir, "documents").select("doc_id", text.bm25_tokens(F.col("text")).alias("w"))
    return found.select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("different"))


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of every page of every report for every indicator."""
    found = ranking.bm25(_pages(spark, sf_dir), _kpi_words(spark, sf_dir))
    return found.select("query_id", "report_id", "page_num", F.round("score", 6).alias("score"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    v = table(spark, sf_dir, "embeddings")
    return ranking.top_k(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), v, "vec_id", "embedding", 5)


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every fiftieth sentence that has a vector."""
    held = table(spark, sf_dir, "sentences").where("embedding is not null and sentence_id % 50 = 0")
    return held.select(F.col("sentence_id").alias("query_id"), F.col("embedding").alias("vector"))


def _similarity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    s = table(spark, sf_dir, "sentences").where("embedding is not null").select("report_id", "page_num", F.col("embedding").alias("vector"))
    return _pages(spark, sf_dir), s, _query_vectors(spark, sf_dir), ["MWh", "m3"]


def page_max_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest similarity of each page with each query, with the bonus for unit names."""
    return ranking.page_similarity(*_similarity(spark, sf_dir), decimals=6).select("query_id", "report_id", "page_num", "score")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the fusion of the rankings by all queries."""
    fused = ranking.fused_similarity(*_similarity(spark, sf_dir), decimals=6)
    return fused.select("report_id", "page_num", F.round("score", 9).alias("score"))


def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 pages of each report for every indicator by fusion of vectors and the indicator's words."""
    fused = ranking.fused_similarity(*_similarity(spark, sf_dir), decimals=6)
    lexical = ranking.bm25(_pages(spark, sf_dir), _kpi_words(spark, sf_dir)).select(F.col("query_id").alias("kpi"), "report_id", "page_num", F.round("score", 6).alias("score"))
    every = fused.join(bounded(table(spark, sf_dir, "kpis").select("kpi"), "the list of indicators"))
    found = ranking.hybrid(every, lexical, ["report_id", "kpi"], top=registry.RULE_PAGES, decimals=6)
    return found.select("report_id", "kpi", "page_num", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def majority_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of mostly empty pages."""
    return reports.majority_empty_reports(table(spark, sf_dir, "report_pages"))


def heading_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by their headings, and whether these hold a phrase of an indicator."""
    phrases = table(spark, sf_dir, "kpis").where("page_negative_phrases is not null").select("kpi", "page_negative_phrases")
    heads = table(spark, sf_dir, "report_pages").select("page_id", text.heading_text(F.col("text")).alias("heading")).where("heading != ''")
    return heads.join(bounded(phrases, "the list of phrases")).select("page_id", "kpi", "heading", text.holds_any(F.col("heading"), F.col("page_negative_phrases")).alias("rejected"))


def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data rows of tables with the section above them."""
    return rules.table_rows(table(spark, sf_dir, "report_tables")).select("table_id", "row_idx", "section", "cell")


def year_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year column and structural score of tables."""
    t = table(spark, sf_dir, "report_tables")
    e = tablecells.effective(F.coalesce("headers", F.array().cast("array<string>")), F.coalesce("rows", F.array().cast("array<array<string>>")))
    found = t.withColumn("e", e).select("table_id", "report_year", F.col("e.headers").alias("h"), F.size("e.rows").cast("long").alias("data_rows"))
    return found.select("table_id", "data_rows", tablecells.year_column(F.col("h"), F.col("report_year")).cast("long").alias("year_col"), tablecells.structural_score(F.col("h"), F.col("report_year")).alias("structure"))


def row_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of table rows scored for every indicator they have words of."""
    labels = table(spark, sf_dir, "report_tables").select("table_id", F.posexplode("rows").alias("row_idx", "row")).where("size(row) > 0").select("table_id", "row_idx", tablecells.label_cell(F.col("row")).alias("label"))
    asked = table(spark, sf_dir, "kpis").select("kpi", "query", "negative_tokens", text.tokens(F.col("query")).alias("wanted"))
    score = tablecells.row_score(F.col("query"), F.col("label"), F.col("wanted"), F.col("held"))
    # Labels repeat over tables, so each is scored once per indicator.
    pairs = labels.select("label").distinct().withColumn("held", text.tokens(F.col("label"))).join(bounded(asked, "the list of indicators"))
    scored = pairs.where(~text.holds_any(F.lower("label"), F.col("negative_tokens"))).select("label", "kpi", F.round(score, 6).alias("score")).where("score > 0")
    return labels.join(scored, "label").select("table_id", "row_idx", "kpi", "score")


def header_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each table is compared with queries."""
    return table(spark, sf_dir, "report_tables").select("table_id", text.header_string(F.col("headers"), F.col("rows")).alias("header_string"))


def keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages that pass the gates of an indicator, with their share of its words."""
    known = table(spark, sf_dir, "kpis").select("kpi", "negative_tokens", text.keywords(F.col("queries")).alias("words"))
    lines = table(spark, sf_dir, "report_pages").where("text is not null").select("page_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "line")).withColumn("line", F.lower(F.trim("line"))).where("length(line) >= 10")
    joined = lines.join(bounded(known, "the list of indicators")).withColumn("share", F.round(text.keyword_share(F.col("line"), F.col("words")), 6))
    return joined.where((F.col("share") >= registry.LEAST_KEYWORD_SHARE) & ~text.holds_any(F.col("line"), F.col("negative_tokens"))).select("page_id", "kpi", "line_idx", "share")


def _table_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kpis, tables = table(spark, sf_dir, "kpis"), table(spark, sf_dir, "report_tables")
    return rules.table_candidates(tables, _pages(spark, sf_dir), kpis, rules.table_similarity(tables, kpis))


def table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that rules find in tables."""
    return rules.table_choice(_table_candidates(spark, sf_dir)).drop("table_score", "table_idx")


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, kpi, page_num, rank): the first 25 pages by words and by sentences, for each indicator."""
    return rank_pages(_pages(spark, sf_dir), table(spark, sf_dir, "sentences"), table(spark, sf_dir, "report_tables"), table(spark, sf_dir, "kpis"))


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that rules find in lines of text."""
    return rules.line_choice(rules.line_candidates(_pages(spark, sf_dir), _ranking(spark, sf_dir), table(spark, sf_dir, "kpis")))


def extract_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact per report and indicator by all rules."""
    t = lambda name: table(spark, sf_dir, name)
    return RuleExtractor()(t("reports"), _pages(spark, sf_dir), t("report_tables"), t("kpis"), t("sentences"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of every indicator for every report."""
    t = lambda name: table(spark, sf_dir, name)
    passages = model.context(_pages(spark, sf_dir), t("report_tables"), _ranking(spark, sf_dir))
    return model.requests(t("reports"), passages, t("kpis"), "replay")


def context_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with their keys: pages retrieved, length, and key."""
    return _requests(spark, sf_dir).select("report_id", "company", "report_year", "kpi", "retrieved_pages", F.length("user").alias("chars"), "cache_key")


def model_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the model extractor for every report and indicator, asked through a client that answers from the recorded extractions.

    The client knows the latest record of each indicator; it goes the whole way of prompts,
    response layer, calls and validation.
    """
    t = lambda name: table(spark, sf_dir, name)
    latest = t("extractions").where("extractor = 'llm'").groupBy("kpi").agg(F.max(F.struct("extraction_id", "value", "unit", "reporting_year", "source_snippet", "confidence")).alias("r"))
    names = bounded(latest.select("kpi", "r.value", "r.unit", "r.reporting_year", "r.source_snippet", "r.confidence"), "the list of indicators")
    recorded = {r["kpi"]: {k: r[k] for k in ("value", "unit", "reporting_year", "source_snippet", "confidence")} for r in names.collect()}
    extractor = ModelExtractor(model.Provider("replay", "replay", 0.0), model.replay(recorded), f"{shared_folder(spark)}/responses/{uuid.uuid4().hex}", lanes=8)
    return extractor(t("reports"), _pages(spark, sf_dir), t("report_tables"), t("kpis"), t("sentences")).select("report_id", "kpi", "value", "unit", F.get("flags", F.lit(0)).alias("flag"))


def model_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from recorded answers: one per extraction of the llm, validated."""
    recorded = table(spark, sf_dir, "extractions").where("extractor = 'llm'").select("extraction_id", "company", "report_year", "kpi", "value", "unit", "reporting_year", "source_snippet", "confidence", (F.col("extraction_id") % 7 != 0).alias("answered"))
    found = model.validated(recorded.withColumn("company", F.col("extraction_id").cast("string")), table(spark, sf_dir, "kpis"))
    return found.select(F.col("company").cast("long").alias("extraction_id"), "value", "unit", F.get("flags", F.lit(0)).alias("flag"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.judged(table(spark, sf_dir, "gold_labels"), table(spark, sf_dir, "extractions"), table(spark, sf_dir, "kpis"), "extraction_id")


def evaluate_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every extractor and indicator."""
    scored = evaluation.metrics(_judged(spark, sf_dir), table(spark, sf_dir, "extractions").where("extractor is not null"), table(spark, sf_dir, "kpis"))
    return scored.select("extractor", "kpi", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "coverage")])


def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean f1 and true positives of every extractor."""
    return evaluation.macro(evaluate_slices(spark, sf_dir)).select("extractor", "tp", F.round("macro_f1", 9).alias("macro_f1"))


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest fact of each company and indicator."""
    facts = table(spark, sf_dir, "extractions").select("company", "kpi", "report_year", "value", "extraction_id")
    return comparison.latest_per_key(facts, ["company", "kpi"], "report_year", "extraction_id")


def kpi_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies by all indicators with their latest values."""
    facts = table(spark, sf_dir, "extractions").select("company", "kpi", "report_year", "value", "extraction_id")
    names = [r["kpi"] for r in bounded(table(spark, sf_dir, "kpis").select("kpi"), "the list of indicators", 1_000).orderBy("kpi").collect()]
    return comparison.grid(facts, names, "extraction_id")


def _first_runs(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r["run_tag"] for r in table(spark, sf_dir, "extractions").where("run_tag is not null").select("run_tag").distinct().orderBy("run_tag").limit(2).collect()]


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of all extractors in two runs side by side; which two is the operator's parameter, here the first."""
    facts = table(spark, sf_dir, "extractions")
    runs = _first_runs(spark, sf_dir)
    names = [r["extractor"] for r in bounded(table(spark, sf_dir, "extractor_trust").select("extractor"), "the list of extractors", 1_000).orderBy("extractor").collect()]
    return comparison.run_comparison([comparison.run_columns(facts.where(F.col("run_tag") == tag), f"run{i}", names, "extraction_id") for i, tag in enumerate(runs, 1)])


def run_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of all runs and extractors in long form."""
    return comparison.run_values(table(spark, sf_dir, "extractions"), "extraction_id")


def best_of_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that rules or model have right, by indicator."""
    return comparison.best_of_either(_judged(spark, sf_dir), ["baseline", "llm"])


QUERIES = {f.__name__: f for f in (parse_number_cells, unit_canonical, unit_robust, unit_convert, parse_value_snippets, co2_normalised, sentence_split, token_counts, bm25_scores, cosine_topk, page_max_similarity, rrf_fusion, hybrid_rank, majority_empty, heading_filter, section_fill, year_columns, row_scores, header_strings, keyword_lines, table_facts, line_facts, extract_end_to_end, context_build, model_facts, model_replay, evaluate_slices, macro_f1, latest_per_key, kpi_pivot, run_comparison, run_values, best_of_either)}

_CELLS = """
r as (select table_id, generate_subscripts(rows, 1) - 1 as row_idx, unnest(rows) as "row" from report_tables)
"""
_PAGES = "pages as (select * from report_pages qualify row_number() over (partition by report_id, page_num order by page_id) = 1)"
_WORDS = "asked as (select kpi as query_id, unnest(flatten(list_transform(queries, lambda q: regexp_extract_all(lower(q), '[a-z0-9]+')))) as word from kpis)"
_BM25 = f"""
{_PAGES},
w as (select report_id, page_num, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as word from pages),
tf as (select report_id, page_num, word, count(*) as tf from w group by all),
dl as (select p.report_id, p.page_num, coalesce(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')), 0) as dl from pages p),
n as (select report_id, count(*) as n, avg(dl) as avgdl from dl group by report_id),
df as (select report_id, word, count(*) as df from tf group by all),
idf as (select df.report_id, word, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) as idf from df join n on df.report_id = n.report_id),
mean as (select report_id, avg(idf) as mean_idf from idf group by report_id),
{_WORDS},
q as (select query_id, word, count(*) as times from asked group by all),
hits as (
  select q.query_id, tf.report_id, tf.page_num,
    sum(q.times * (case when idf.idf < 0 then 0.25::double * mean_idf else idf.idf end) * tf.tf * 2.5::double / (tf.tf + 1.5::double * (0.25::double + 0.75::double * dl.dl / idf.avgdl))) as s
  from tf join idf on tf.report_id = idf.report_id and tf.word = idf.word join mean on tf.report_id = mean.report_id join q on q.word = tf.word
    join dl on dl.report_id = tf.report_id and dl.page_num is not distinct from tf.page_num
  group by all),
bm as (
  select k.kpi as query_id, p.report_id, p.page_num, round(coalesce(h.s, 0), 6)::double as score
  from pages p cross join kpis k left join hits h on h.query_id = k.kpi and h.report_id = p.report_id and h.page_num is not distinct from p.page_num)
"""
_SIM = f"""
{_PAGES},
qv as (select sentence_id as query_id, embedding::double[] as v from sentences where embedding is not null and sentence_id % 50 = 0),
best as (
  select query_id, report_id, page_num, max(list_cosine_similarity(embedding::double[], v)) as s
  from sentences cross join qv where embedding is not null and page_num is not null group by all),
sim as (
  select qv.query_id, p.report_id, p.page_num, p.page_pos,
    coalesce(s, 0) + case when contains(lower(coalesce(p.text, '')), 'mwh') or contains(lower(coalesce(p.text, '')), 'm3') then 0.1::double else 0::double end as score
  from pages p cross join qv left join best b on b.query_id = qv.query_id and b.report_id = p.report_id and b.page_num = p.page_num),
ranked as (select *, row_number() over (partition by query_id, report_id order by round(score, 6) desc, page_pos) - 1 as rnk from sim),
fused as (select report_id, page_num, min(page_pos) as page_pos, sum(1::double / (60 + rnk)) as score from ranked group by report_id, page_num)
"""
_YEAR = "\\b((?:19|20)\\d\\d)\\b"
_NUMBER = r"[-+]?\d{1,3}(?:[,\s]\d{3})+(?:\.\d+)?|[-+]?\d+(?:[.,]\d+)?"
_EFFECTIVE = f"""
e as (
  select *, not coalesce(list_bool_or(list_transform(headers, lambda h: regexp_matches(coalesce(h, ''), '{_YEAR}'))), false)
      and coalesce(list_bool_or(list_transform(rows[1], lambda c: regexp_matches(coalesce(c, ''), '{_YEAR}'))), false) as promote
  from report_tables),
t as (select *, case when promote then rows[1] else headers end as h, case when promote then rows[2:] else rows end as body from e),
y as (
  select *, list_transform(h, lambda x: try_cast(nullif(regexp_extract(coalesce(x, ''), '{_YEAR}', 1), '') as integer)) as years from t),
c as (
  select *, list_max(list_filter(years, lambda v: v <= report_year)) as best from y)
"""
_LABEL = """case when lower(trim(coalesce("row"[1], ''))) in ('metric', 'metrics', 'indicator', 'indicators', 'description', 'descriptions', 'topic', 'kpi') and len("row") > 1
  then coalesce("row"[2], '') else coalesce("row"[1], '') end"""
_OUTCOMES = """
p as (select * from extractions where extractor is not null qualify row_number() over (partition by extractor, company, report_year, kpi order by extraction_id desc) = 1),
j as (
  select x.extractor, g.kpi, g.company, g.report_year, p.extraction_id is not null as matched, p.value as pv, g.value as gv,
    case when p.value is null and g.value is null then true when p.value is null or g.value is null then false
      else p.unit is not distinct from g.unit and p.reporting_year is not distinct from g.reporting_year
        and case when g.value = 0 then abs(p.value) < 0.01 else abs(p.value - g.value) / abs(g.value) <= 0.01 end end as ok
  from gold_labels g cross join (select distinct extractor from extractions where extractor is not null) x
    left join p on p.extractor = x.extractor and p.company = g.company and p.report_year = g.report_year and p.kpi = g.kpi
  where g.kpi in (select kpi from kpis)),
o as (
  select *, case when not matched then case when gv is null then 'tn' else 'fn' end when ok and pv is not null then 'tp' when ok then 'tn' when pv is not null then 'fp' else 'fn' end as outcome from j)
"""
_SCORES = (
    _OUTCOMES
    + """,
n as (select extractor, kpi, count(*) filter (outcome = 'tp') as tp, count(*) filter (outcome = 'fp') as fp, count(*) filter (outcome = 'fn') as fn, count(*) filter (outcome = 'tn') as tn,
    count(*) filter (matched) as m, count(*) filter (matched and pv is not null) as v from o group by all),
f as (select x.extractor, k.kpi, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn, coalesce(tn, 0) as tn, coalesce(m, 0) as m, coalesce(v, 0) as v
  from (select distinct extractor from extractions where extractor is not null) x cross join (select distinct kpi from kpis) k left join n on n.extractor = x.extractor and n.kpi = k.kpi),
s as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end::double as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end::double as r from f),
scored as (select extractor, kpi, tp, fp, fn, tn, round(p, 9) as precision, round(r, 9) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 9)::double as f1,
  round(case when m > 0 then v / m else 0 end, 9)::double as coverage from s)
"""
)

# The mass before CO, with what must not be a letter before it, and white space, as RE2 has them.
_MASS = "(^|[^A-Za-z])((?:M[tT]|[kKgG][tT]|[tT])?CO)"
_GAP = "[\\s\\x{a0}\\x{202f}\\x{2009}\\x{3000}]"


def _co2(cell: str) -> str:
    """SQL for `cell` with CO2e brought together."""
    found = cell
    for pattern, new, how in (
        (f"CO{_GAP}+2{_GAP}+eq", "CO2eq", "gi"),
        (f"CO{_GAP}+2{_GAP}+e", "CO2e", "gi"),
        (f"COe{_GAP}*q?{_GAP}*2", "CO2e", "gi"),
        (f"{_MASS}([^\\n]*)\\n{_GAP}*2eq", "\\1\\22eq\\3", "gi"),
        (f"{_MASS}([^\\n]*)\\n{_GAP}*2e", "\\1\\22e\\3", "gi"),
        (f"{_MASS}e([^\\n]*)\\n{_GAP}*2({_GAP}*\\n)", "\\1\\22e\\3\\4", "g"),
    ):
        found = f"regexp_replace({found}, '{pattern}', '{new}', '{how}')"
    return found


_ROBUST = f"""
a(alias, canonical) as (values {ALIASES}),
s as (select unit from extractions union all select unnest(headers) from report_tables),
u as (select unit, count(*) as n from s where unit is not null group by unit),
b as (select *, lower(trim(regexp_replace(trim({_co2('unit')}, ' ()[]{{}}*' || chr(9) || chr(10)), '\\.{_GAP}*(?:19|20)\\d{{2}}{_GAP}*$', ''), ' ' || chr(9) || chr(10) || chr(160))) as b from u),
t as (select *, regexp_replace(b, '{_GAP}+', '', 'g') as t from b),
w as (select *, regexp_extract(b, '^(thousand|million|billion)[ \\t().,]*([^ \\t().,].*?)[ \\t().,]*$', ['w', 'r']) as p, regexp_extract(t, '^(thousand|million|billion)[ \\t().,]*([^ \\t().,].*?)[ \\t().,]*$', ['w', 'r']) as q from t),
k as (select unit, n, p.w as w1, q.w as w2, rtrim(b, '.,;:') as k1, rtrim(t, '.,;:') as k2, rtrim(p.r, '.,;:') as k3, rtrim(regexp_replace(p.r, '{_GAP}+', '', 'g'), '.,;:') as k4, rtrim(q.r, '.,;:') as k5 from w),
f as (
  select unit, n, coalesce(a1.canonical, a2.canonical) as plain, case when w1 != '' then coalesce(a3.canonical, a4.canonical) end as worded, case when w2 != '' then a5.canonical end as tight, w1, w2
  from k left join a a1 on a1.alias = k1 left join a a2 on a2.alias = k2 left join a a3 on a3.alias = k3 left join a a4 on a4.alias = k4 left join a a5 on a5.alias = k5)
"""
# A number in text and the spellings of units, longest first, as RE2 has them.
_IN_TEXT = numbers.NUMBER_IN_TEXT.replace("'", "''")
_UNITS = "|".join(re.escape(u).replace("\\ ", " ") for u in sorted(registry.UNIT_ALIASES, key=lambda u: (-len(u), u)))
_SHAPES = (
    (f"({_IN_TEXT}){_GAP}*(?:(thousand|million|billion){_GAP}*)?({_UNITS})(?:[^A-Za-z0-9]|$)", 1, 2, 3),
    (f"(thousand|million|billion){_GAP}+({_UNITS})[^A-Za-z0-9]{{1,8}}({_IN_TEXT})", 3, 1, 2),
    (f"({_UNITS})[^A-Za-z0-9]{{1,8}}({_IN_TEXT})", 2, 0, 1),
)


def _matches(i: int) -> str:
    """SQL for (extraction_id, shape, number of the match, number, word, unit) of all matches of a shape."""
    pattern, n, w, u = _SHAPES[i]
    group = lambda k: f"regexp_extract_all(t, '{pattern}', {k}, 'i')"
    word = f"unnest({group(w)})" if w else "''"
    return f"select extraction_id, kpi, {i} as shape, generate_subscripts({group(n)}, 1) as nth, unnest({group(n)}) as n, lower({word}) as w, unnest({group(u)}) as u from s"


_PARSED = f"""
a(alias, canonical) as (values {ALIASES}),
k as (select kpi, list_distinct(list(canonical)) as accepted from (select kpi, unnest(unit_family) as unit from kpis) f join a on a.alias = lower(regexp_replace(trim(f.unit), '[.,;:]+$', '')) group by kpi),
s as (
  select extraction_id, kpi, regexp_replace(regexp_replace(regexp_replace(source_snippet, '\\b(thousand|million|billion)m{_GAP}*3\\b', '\\1 m3', 'gi'), '\\.000{_GAP}*m{_GAP}*3\\b', 'thousand m3', 'gi'), '\\bm{_GAP}+3\\b', 'm3', 'g') as t
  from extractions where source_snippet is not null),
m as ({_matches(0)} union all {_matches(1)} union all {_matches(2)}),
v as (
  select m.*, a.canonical, case when regexp_full_match(n, '-?\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?') then replace(n, ',', '') when regexp_full_match(n, '-?\\d{{1,3}}( \\d{{3}})+(\\.\\d+)?') then replace(n, ' ', '')
    when regexp_full_match(n, '-?\\d+,\\d{{1,2}}') then replace(n, ',', '.') when regexp_full_match(n, '-?\\d+(\\.\\d+)?') then n end as plain
  from m join k using (kpi) join a on a.alias = lower(regexp_replace(trim(u), '[.,;:]+$', '')) and list_contains(k.accepted, a.canonical)),
f as (select * from v where plain is not null qualify row_number() over (partition by extraction_id order by shape, nth) = 1)
"""
# The indicators and extractors of the test tables, for the SQL.
ALL_KPIS = "hazardous_waste nox_emissions purchased_electricity renewable_energy restored_land scope_1_emissions scope_2_emissions scope_3_emissions total_energy_consumption waste_generated water_consumption water_withdrawal".split()
ALL_EXTRACTORS = "baseline llm llm_large manual_review regex_legacy".split()


def _run_columns(i: int) -> str:
    return ", ".join(f"arg_min(value, extraction_id) filter (extractor = '{e}') as run{i}_{e}_value" for e in ALL_EXTRACTORS)


ORACLE = {
    "parse_number_cells": f"""
with {_CELLS}, c as (select table_id, row_idx, generate_subscripts("row", 1) - 1 as col_idx, unnest("row") as cell from r),
t as (select table_id, row_idx, col_idx, regexp_replace(regexp_replace(cell, '^{CELL_TRIM}+', ''), '{CELL_TRIM}+$', '') as t from c),
v as (select *, case when regexp_full_match(t, '-?\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?') then replace(t, ',', '') when regexp_full_match(t, '-?\\d{{1,3}}( \\d{{3}})+(\\.\\d+)?') then replace(t, ' ', '')
  when regexp_full_match(t, '-?\\d+,\\d{{1,2}}') then replace(t, ',', '.') when regexp_full_match(t, '-?\\d+(\\.\\d+)?') then t end as n from t)
select table_id, row_idx, col_idx, try_cast(n as double) as value from v where n is not null""",
    "unit_canonical": f"""
with a(alias, canonical) as (values {ALIASES}),
u as (select unit, count(*) as n from extractions where unit is not null group by unit)
select unit, n, canonical from u left join a on a.alias = lower(regexp_replace(trim(unit), '[.,;:]+$', ''))""",
    "unit_robust": f"""
with {_ROBUST}
select unit, n, coalesce(plain, worded, tight) as canonical,
  case when plain is not null then 1.0 when worded is not null or tight is not null then case case when worded is not null then w1 else w2 end when 'thousand' then 1e3 when 'million' then 1e6 else 1e9 end end::double as multiplier from f""",
    "parse_value_snippets": f"""
with {_PARSED}
select extraction_id, plain::double * case w when 'thousand' then 1e3 when 'million' then 1e6 when 'billion' then 1e9 else 1 end as value, canonical as unit from f""",
    "co2_normalised": f"""
with c as (select unnest(list_concat(coalesce(headers, []), list_transform(coalesce(rows, []), lambda r: r[1]))) as cell from report_tables),
n as (select cell, {_co2('cell')} as normalised from c)
select cell, normalised, count(*) as n from n where normalised != cell group by all""",
    "unit_convert": f"""
with a(alias, canonical) as (values {ALIASES}), f(a, b, factor) as (values {FACTORS}),
e as (select extraction_id, value, canonical_unit, lower(regexp_replace(trim(unit), '[.,;:]+$', '')) as u from extractions join kpis using (kpi)),
k as (select e.*, s.canonical as source, coalesce(t.canonical, canonical_unit) as target from e join a s on s.alias = e.u left join a t on t.alias = lower(canonical_unit))
select extraction_id, case when source = target then value else value * factor end as canonical_value from k left join f on f.a = source and f.b = target
where (case when source = target then value else value * factor end) is not null""",
    "sentence_split": f"""
with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){CELL_TRIM}+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
  lambda x: length(regexp_replace(regexp_replace(x, '^{CELL_TRIM}+', ''), '{CELL_TRIM}+$', ''))), lambda n: n > 0) as s from documents)
select doc_id, len(s) as sentences, coalesce(list_sum(s), 0)::bigint as chars, list_max(s) as longest from s""",
    "token_counts": """
with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents)
select doc_id, len(w) as words, len(list_distinct(w)) as different from w""",
    "bm25_scores": f"with {_BM25} select query_id, report_id, page_num, score from bm",
    "cosine_topk": """
with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 50 = 0),
s as (select query_id, vec_id, round(list_cosine_similarity(v, embedding::double[]), 9) as score from q cross join embeddings),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, vec_id, score, rank from r where rank <= 5""",
    "page_max_similarity": f"with {_SIM} select query_id, report_id, page_num, round(score, 6)::double as score from sim",
    "rrf_fusion": f"with {_SIM} select report_id, page_num, round(score, 9)::double as score from fused",
    "hybrid_rank": f"""
with {_BM25}, {_SIM.replace(_PAGES + ',', '', 1)},
b as (select f.report_id, bm.query_id as kpi, f.page_num, f.page_pos, f.score as a, bm.score as b from fused f join bm on bm.report_id = f.report_id and bm.page_num is not distinct from f.page_num),
m as (select *, min(a) over w as la, max(a) over w as ha, min(b) over w as lb, max(b) over w as hb from b window w as (partition by report_id, kpi)),
h as (select report_id, kpi, page_num, page_pos, 0.5::double * (case when ha - la < 1e-12 then 0 else (a - la) / (ha - la) end) + 0.5::double * (case when hb - lb < 1e-12 then 0 else (b - lb) / (hb - lb) end) as score from m),
k as (select *, row_number() over (partition by report_id, kpi order by round(score, 6) desc, page_pos) - 1 as rank from h)
select report_id, kpi, page_num, round(score, 6)::double as score, rank from k where rank < 25""",
    "majority_empty": f"""
with c as (select report_id, length(regexp_replace(regexp_replace(coalesce(text, ''), '^{CELL_TRIM}+', ''), '{CELL_TRIM}+$', '')) >= 100 as s from report_pages)
select report_id, count(*) as pages, count(*) filter (s) as substantive, count(*) filter (s) < 0.5 * count(*) as majority_empty from c group by report_id""",
    "heading_filter": """
with h as (select page_id, lower(list_aggregate(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*#')), 'string_agg', ' ')) as heading from report_pages where text is not null)
select page_id, kpi, heading, coalesce(list_bool_or(list_transform(page_negative_phrases, lambda p: contains(heading, lower(p)))), false) as rejected
from h cross join kpis where heading is not null and heading != '' and page_negative_phrases is not null""",
    "section_fill": f"""
with {_EFFECTIVE},
k as (select table_id, body, list_position(years, best) as yc from c where best is not null),
r as (select table_id, yc, generate_subscripts(body, 1) - 1 as row_idx, unnest(body) as "row" from k),
d as (select table_id, row_idx, coalesce("row"[yc], '') as cell, coalesce("row"[1], '') as first from r where len("row") >= yc),
g as (select *, regexp_matches(cell, '{_NUMBER.replace(chr(92) + "s", "[:space:]" + chr(92) + "x{a0}" + chr(92) + "x{202f}").replace("[,[:space:]", "[,[:space:]")}') as is_data from d),
s as (select *, last_value(case when not is_data and trim(first) != '' then first end ignore nulls) over (partition by table_id order by row_idx rows between unbounded preceding and 1 preceding) as section from g)
select table_id, row_idx, coalesce(section, '') as section, cell from s where is_data""",
    "year_columns": f"""
with {_EFFECTIVE}
select table_id, coalesce(len(body), 0) as data_rows, case when best is null then null else list_position(years, best) - 1 end::bigint as year_col,
  case when list_bool_or(list_transform(h, lambda x: regexp_matches(coalesce(x, ''), '{_YEAR}') and contains(coalesce(x, ''), report_year::varchar))) then 1.0 else 0.5 end::double as structure from c""",
    "row_scores": f"""
with {_CELLS}, l as (select table_id, row_idx, {_LABEL} as label from r where len("row") > 0),
w as (select l.*, k.kpi, k.query, list_distinct(list_filter(regexp_split_to_array(lower(label), '{CELL_TRIM}+'), lambda x: x != '')) as a, list_distinct(list_filter(regexp_split_to_array(lower(query), '{CELL_TRIM}+'), lambda x: x != '')) as b
  from l cross join kpis k where not coalesce(list_bool_or(list_transform(negative_tokens, lambda t: contains(lower(label), lower(t)))), false)),
s as (select table_id, row_idx, kpi, round(case when contains(lower(label), lower(query)) then 1 when len(list_intersect(a, b)) = len(b) then 0.8 else len(list_intersect(a, b)) / greatest(len(b), 1) * 0.6 end::double, 6) as score from w)
select table_id, row_idx, kpi, score from s where score > 0""",
    "header_strings": """
select table_id, coalesce(list_aggregate(list_filter(list_concat(coalesce(headers, []), list_transform(coalesce(rows, [])[1:5], lambda r: r[1])), lambda c: c is not null and c != ''), 'string_agg', ' | '), '') as header_string from report_tables""",
    "keyword_lines": """
with k as (select kpi, negative_tokens, list_distinct(list_filter(flatten(list_transform(queries, lambda q: regexp_extract_all(lower(q), '[a-z]+'))), lambda w: length(w) > 3)) as words from kpis),
x as (select page_id, string_split(text, chr(10)) as ls from report_pages where text is not null),
l as (select page_id, generate_subscripts(ls, 1) - 1 as line_idx, lower(trim(unnest(ls))) as line from x),
s as (select page_id, kpi, line_idx, round(len(list_filter(words, lambda w: contains(line, w))) / greatest(len(words), 1)::double, 6) as share from l cross join k
  where length(line) >= 10 and not coalesce(list_bool_or(list_transform(negative_tokens, lambda t: contains(line, lower(t)))), false))
select page_id, kpi, line_idx, share from s where share >= 0.15""",
    "model_replay": f"""
with a(alias, canonical) as (values {ALIASES}), f(a, b, factor) as (values {FACTORS}),
e as (select extraction_id, value, unit, canonical_unit, lo, hi, extraction_id % 7 != 0 as answered, lower(regexp_replace(trim(unit), '[.,;:]+$', '')) as u from extractions join kpis using (kpi) where extractor = 'llm'),
k as (select e.*, s.canonical as source, coalesce(t.canonical, canonical_unit) as target from e left join a s on s.alias = e.u left join a t on t.alias = lower(canonical_unit)),
v as (select k.*, case when source = target then value else value * factor end as v from k left join f on f.a = source and f.b = target),
r as (select *, case when not answered then 'api_error' when value is null then null when unit is null then 'llm_missing_unit' when source is null or v is null then 'unit_unknown' when not v between lo and hi then 'out_of_range' end as flag from v)
select extraction_id, case when answered and value is not null and flag is null then v end as value, case when answered and value is not null and flag is null then canonical_unit end as unit, flag from r""",
    "model_facts": f"""
with a(alias, canonical) as (values {ALIASES}), f(a, b, factor) as (values {FACTORS}),
l as (select * from extractions where extractor = 'llm' qualify row_number() over (partition by kpi order by extraction_id desc) = 1),
e as (select kpis.kpi, l.kpi is not null as answered, value, unit, canonical_unit, lo, hi, lower(regexp_replace(trim(unit), '[.,;:]+$', '')) as u from kpis left join l on l.kpi = kpis.kpi),
k as (select e.*, s.canonical as source, coalesce(t.canonical, canonical_unit) as target from e left join a s on s.alias = e.u left join a t on t.alias = lower(canonical_unit)),
v as (select k.*, case when source = target then value else value * factor end as v from k left join f on f.a = source and f.b = target),
r as (select *, case when not answered then 'api_error' when value is null then null when unit is null then 'llm_missing_unit' when source is null or v is null then 'unit_unknown' when not v between lo and hi then 'out_of_range' end as flag from v)
select report_id, kpi, case when value is not null and flag is null then v end as value, case when value is not null and flag is null then canonical_unit end as unit, flag from reports cross join r""",
    "evaluate_slices": f"with {_SCORES} select * from scored",
    "macro_f1": f"with {_SCORES} select extractor, sum(tp)::bigint as tp, round(avg(f1), 9) as macro_f1 from scored group by extractor",
    "latest_per_key": "select company, kpi, report_year, value, extraction_id from extractions qualify row_number() over (partition by company, kpi order by report_year desc nulls last, extraction_id) = 1",
    "kpi_pivot": """
with l as (select * from extractions qualify row_number() over (partition by company, kpi order by report_year desc nulls last, extraction_id) = 1)
select company, """
    + ", ".join(f"max(case when kpi = '{k}' then value end) as {k}" for k in ALL_KPIS)
    + " from l group by company",
    "run_comparison": f"""
with t as (select distinct run_tag from extractions where run_tag is not null order by run_tag limit 2),
n as (select run_tag, row_number() over (order by run_tag) as i from t),
f as (select e.*, n.i from extractions e join n using (run_tag) where value is not null),
a as (select company, report_year, kpi, {_run_columns(1)} from f where i = 1 group by all),
b as (select company, report_year, kpi, {_run_columns(2)} from f where i = 2 group by all)
select * from a full join b using (company, report_year, kpi)""",
    "run_values": "select run_tag, extractor, company, report_year, kpi, arg_min(value, extraction_id) as value from extractions where value is not null group by all",
    "best_of_either": f"""
with {_OUTCOMES}, c as (select kpi, company, report_year, bool_or(outcome in ('tp', 'tn')) as ok from o where extractor in ('baseline', 'llm') group by all)
select kpi, count(*) filter (ok) as "right", count(*) as labels from c group by kpi""",
}
