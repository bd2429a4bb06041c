"""The interface of extractors, the rule extractor as one of them, and the run over all."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import registry
from factloom.functions import text, vectors
from factloom.operators import model, ranking, rules
from factloom.session import bounded, exists, reliable_checkpoint, written


class Extractor(Protocol):
    """Gives one fact per report and indicator."""

    name: str

    def __call__(self, reports: DataFrame, pages: DataFrame, tables: DataFrame, kpis: DataFrame) -> DataFrame:
        """Facts with the columns of rules.extract; reports and tables carry report_id."""
        ...


def page_sentences(pages: DataFrame) -> DataFrame:
    """(report_id, page_num, text) of the sentences of normalised pages, by the plain rule."""
    return pages.where("text is not null").select("report_id", "page_num", F.explode(text.split_sentences(text.normalize_co2(F.col("text")))).alias("text"))


def rank_pages(pages: DataFrame, sentences: DataFrame, tables: DataFrame, kpis: DataFrame, top: int = registry.RULE_PAGES) -> DataFrame:
    """(report_id, kpi, page_num, rank from 0): the first `top` pages by fused similarity to all phrases of an indicator and by its words."""
    phrases = kpis.select("kpi", F.posexplode("queries").alias("no", "phrase")).select(F.concat_ws("#", "kpi", "no").alias("query_id"), "kpi", vectors.slots(F.col("phrase")).alias("b"))
    phrases = bounded(phrases, "the list of phrases")
    s = sentences.where("text is not null and page_num is not null").select("report_id", "page_num", vectors.slots(F.col("text")).alias("a"))
    h = rules.header_entries(tables, False).where("page_num is not null").select("report_id", "page_num", vectors.slots(F.col("header_string")).alias("a"))
    best = s.unionAll(h).join(phrases).groupBy("report_id", "page_num", "query_id").agg(F.max(vectors.slot_cosine(F.col("a"), F.col("b"))).alias("s"))
    every = pages.select("report_id", "page_num", "page_pos").join(F.broadcast(phrases.select("query_id", "kpi")))
    scores = every.join(best, ["report_id", "page_num", "query_id"], "left").withColumn("score", F.coalesce("s", F.lit(0.0)))
    fused = ranking.reciprocal_rank_fusion(ranking.ranked(scores, ["report_id", "query_id"]), ["report_id", "kpi"])
    words = kpis.select(F.col("kpi").alias("query_id"), F.flatten(F.transform("queries", text.bm25_tokens)).alias("words"))
    lexical = ranking.bm25(pages, words).withColumnRenamed("query_id", "kpi")
    return ranking.hybrid(fused, lexical, ["report_id", "kpi"], top=top).select("report_id", "kpi", "page_num", "rank")


class RuleExtractor:
    """Tables first, then lines of the best pages, then not reported."""

    name = "baseline"

    def __init__(self, threshold: float = registry.HEADER_SIMILARITY) -> None:
        self.threshold = threshold

    def __call__(self, reports: DataFrame, pages: DataFrame, tables: DataFrame, kpis: DataFrame, sentences: DataFrame | None = None) -> DataFrame:
        """One fact per report and indicator."""
        from_tables = rules.table_choice(rules.table_candidates(tables, pages, kpis, rules.table_similarity(tables, kpis), self.threshold))
        order = rank_pages(pages, page_sentences(pages) if sentences is None else sentences, tables, kpis)
        lines = reliable_checkpoint(rules.line_candidates(pages, order, kpis))
        return rules.extract(reports, kpis, from_tables, rules.line_choice(lines), lines.where("not plausible"), self.name)


class ModelExtractor:
    """Asks an external model with the best pages and tables of a report, through the response layer.

    `call` is a client as of model.ask, and may be None to use recorded responses alone.
    `log` of the last run has one entry per request.
    """

    name = "llm"

    def __init__(self, provider: model.Provider, call: Callable[[str, str, str], dict | None] | None, layer: str, **options: object) -> None:
        self.provider, self.call, self.layer, self.options = provider, call, layer, {"interval": provider.interval, **options}
        self.log: DataFrame | None = None

    def __call__(self, reports: DataFrame, pages: DataFrame, tables: DataFrame, kpis: DataFrame, sentences: DataFrame | None = None) -> DataFrame:
        """One fact per report and indicator."""
        order = rank_pages(pages, page_sentences(pages) if sentences is None else sentences, tables, kpis, registry.MODEL_PAGES)
        asked = written(model.requests(reports, model.context(pages, tables, order), kpis, self.provider.model))
        answers = model.answered(asked, model.cached_responses(reports.sparkSession, self.layer), self.call, self.layer, **self.options)
        self.log = model.prompt_log(answers, self.provider)
        return model.validated(answers, kpis, self.name)


INDEX = "report_id long, n_pages long, part string, page_num int, text string, embedding array<float>"


def index_layer(pages: DataFrame, tables: DataFrame, folder: str, embedder: str = "token-slots") -> DataFrame:
    """(INDEX) sentences and table headers of every report with their vectors by the named embedder.

    They are kept in `folder`, by embedder; reports that the layer holds with the same
    number of pages are taken from there, others are embedded and added.
    """
    spark, own = pages.sparkSession, f"{folder}/{embedder}"
    counts = pages.groupBy("report_id").agg(F.count(F.lit(1)).alias("n_pages"))
    held = spark.read.schema(INDEX).parquet(own) if exists(spark, own) else spark.createDataFrame([], INDEX)
    good = written(held.join(counts, ["report_id", "n_pages"], "left_semi"))
    missing = counts.join(good.select("report_id").distinct(), "report_id", "left_anti")
    sentences = page_sentences(pages).select("report_id", F.lit("sentence").alias("part"), "page_num", "text")
    headers = rules.header_entries(tables, False).select("report_id", F.lit("table").alias("part"), "page_num", F.col("header_string").alias("text"))
    added = sentences.unionByName(headers).join(missing, "report_id").withColumn("embedding", vectors.embedder(embedder)(F.col("text")))
    fresh = written(added.select(*[c.split()[0] for c in INDEX.split(", ")]))
    if not fresh.isEmpty():
        fresh.write.mode("append").parquet(own)
    return good.unionByName(fresh)


def run_extraction(reports: DataFrame, pages: DataFrame, tables: DataFrame, kpis: DataFrame, extractors: Sequence[Extractor], run_tag: str | None = None) -> DataFrame:
    """Facts of all extractors for every report and indicator, tagged with the run."""
    facts = reduce(DataFrame.unionByName, [e(reports, pages, tables, kpis) for e in extractors])
    return facts.withColumn("run_tag", F.lit(run_tag).cast("string"))
