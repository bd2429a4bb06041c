"""Reading report files into pages and tables, with parser fallback and quality gates.

Parsers are injected: a parser is a function of the file's bytes and a page range that
gives ([(page_num, text)], [(page_num, headers, rows)]). The repository holds one for
marked-up text; layout parsers need libraries of their own.
"""

from __future__ import annotations

import html
import os
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import registry
from factloom.session import exists, written

# How a file's name gives its key, and limits of the heavy parser.
FILE_NAME = r"(?i)^(.+)_(\d{4})\.[a-z0-9]+$"
MOST_BYTES = 100 * 1024 * 1024
PAGE_BATCH = 20
GOLD = "company string, report_year int, kpi string, value double, unit string, reporting_year int, source_page int, notes string"
FACTS = "company string, report_year int, kpi string, value double, unit string, reporting_year int, source_snippet string, source_page int, confidence double, extractor string, flags string, run_tag string"
PARSED = "path string, company string, report_year int, parser string, pages array<struct<page_num:int,text:string>>, tables array<struct<page_num:int,headers:array<string>,rows:array<array<string>>>>, seconds double, error string"
Parser = Callable[[bytes], tuple[list[tuple[int, str]], list[tuple[int, list[str], list[list[str]]]]]]


def scan(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, modified, length, content, company, report_year) of the files of a folder; an unfit name gives NULL keys."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    company = F.nullif(F.lower(F.regexp_extract(name, FILE_NAME, 1)), F.lit(""))
    year = F.regexp_extract(name, FILE_NAME, 2).try_cast("int")
    return files.select("path", F.col("modificationTime").alias("modified"), "length", "content", company.alias("company"), year.alias("report_year"))


def parse(files: DataFrame, parser: Parser, name: str, most_bytes: int | None = None) -> DataFrame:
    """One row (PARSED) per file; a failure, an unfit name or an oversized file gives an error and no pages instead of ending the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, company, year in zip(batch["path"], batch["content"], batch["company"], batch["report_year"], strict=True):
                error, pages, tables, begun = None, [], [], time.perf_counter()
                if company is None or pd.isna(year):
                    error = "file name isn't company_year"
                elif most_bytes is not None and len(content) > most_bytes:
                    error = "file is too large for this parser"
                else:
                    try:
                        pages, tables = parser(bytes(content))
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"[:500]
                rows.append((path, company, None if pd.isna(year) else int(year), name, [{"page_num": n, "text": t or ""} for n, t in pages], [{"page_num": n, "headers": h, "rows": r} for n, h, r in tables], time.perf_counter() - begun, error))
            out = pd.DataFrame(rows, columns=["path", "company", "report_year", "parser", "pages", "tables", "seconds", "error"])
            out["report_year"] = out["report_year"].astype("Int32")
            yield out

    return files.select("path", "content", "company", "report_year").mapInPandas(run, PARSED)


def batched(parse_range: Callable[[bytes, int, int], tuple[list, list]], count_pages: Callable[[bytes], int | None], size: int = PAGE_BATCH) -> Parser:
    """A parser that works page range by page range; any range that fails fails the file. Without a page count it runs once over all."""

    def run(content: bytes) -> tuple[list, list]:
        n = count_pages(content)
        if n is None:
            return parse_range(content, 1, -1)
        pages, tables = [], []
        for low in range(1, n + 1, size):
            high = min(low + size - 1, n)
            own_pages, own_tables = parse_range(content, low, high)
            own_pages, own_tables = renumbered(own_pages, own_tables, low, high)
            pages += own_pages
            tables += own_tables
        return pages, tables

    return run


def renumbered(pages: list[tuple[int, str]], tables: list[tuple[int, list[str], list[list[str]]]], low: int, high: int) -> tuple[list, list]:
    """Pages and tables of a range with absolute numbers: kept if they begin at `low` or later, else counted from `low`; tables beyond the range are dropped."""
    shift = 0 if not pages or min(n for n, _ in pages) >= low else None
    if shift is None:
        places = {n: low + i for i, n in enumerate(sorted({n for n, _ in pages}))}
        pages = [(places[n], t) for n, t in pages]
        tables = [(places.get(n, 0), h, r) for n, h, r in tables]
    return pages, [(n, h, r) for n, h, r in tables if low <= n <= high]


def markup_parser(content: bytes) -> tuple[list, list]:
    """Pages of UTF-8 text or HTML parted by form feeds, and their <table> elements: the first row for headers, cells stripped, empty tables skipped."""
    pages, tables = [], []
    for n, page in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        for body in re.findall(r"(?is)<table\b.*?</table>", page):
            rows = [[html.unescape(re.sub(r"<[^>]+>", "", c)).strip() for c in re.findall(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>", r)] for r in re.findall(r"(?is)<tr\b.*?</tr>", body)]
            if rows:
                tables.append((n, rows[0], rows[1:]))
        text = re.sub(r"(?is)<(script|style)\b.*?</\1>|<table\b.*?</table>", " ", page)
        text = re.sub(r"(?i)<(br|/p|/h\d|/div|/li)\b[^>]*>", "\n", text)
        pages.append((n, html.unescape(re.sub(r"<[^>]+>", "", text)).strip()))
    return pages, tables


def majority_empty(pages: Column) -> Column:
    """Whether fewer than half of an array of pages hold 100 characters, or there are none."""
    full = F.size(F.filter(pages, lambda p: F.length(F.regexp_replace(p["text"], r"(?U)^\s+|\s+$", "")) >= registry.SUBSTANTIVE_CHARS))
    return F.when(F.size(pages) > 0, full / F.size(pages) < registry.MAJORITY).otherwise(True)


def majority_empty_reports(pages: DataFrame) -> DataFrame:
    """(report_id, pages, substantive, majority_empty) per report of a table of pages."""
    filled = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")) >= registry.SUBSTANTIVE_CHARS
    counted = pages.groupBy("report_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(filled).alias("substantive"))
    return counted.withColumn("majority_empty", F.col("substantive") < registry.MAJORITY * F.col("pages"))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Of two parses (PARSED) of the same files the first where it has no error and isn't mostly empty, else the second."""
    good = first.where(F.col("error").isNull() & ~majority_empty(F.col("pages")))
    return good.unionByName(second.join(good.select("path"), "path", "left_anti"))


def fresh(cached: DataFrame, files: DataFrame) -> DataFrame:
    """Files (path, modified) that a parsed layer (path, parsed_at) doesn't hold as recent."""
    held = cached.groupBy("path").agg(F.max("parsed_at").alias("parsed_at"))
    return files.join(held, "path", "left").where(F.col("parsed_at").isNull() | (F.col("parsed_at") < F.col("modified"))).drop("parsed_at")


@dataclass(frozen=True)
class ParserChoice:
    """A parser by name, and the most bytes it takes, if that is limited."""

    name: str
    parse: Parser
    most_bytes: int | None = None


def enabled(choices: Sequence[ParserChoice]) -> list[ParserChoice]:
    """`choices` without those that FACTLOOM_DISABLED_PARSERS names, parted by commas."""
    disabled = {n.strip() for n in os.environ.get("FACTLOOM_DISABLED_PARSERS", "").split(",")}
    return [c for c in choices if c.name not in disabled]


def dispatched(spark: SparkSession, folder: str, pattern: str, choices: Sequence[ParserChoice], layer: str, only: str | None = None) -> DataFrame:
    """PARSED of every file of `folder` by the first of `choices` whose result has no error and isn't mostly empty, else the last.

    Results are kept in the parsed layer, and only files that are newer than what it holds
    are parsed. With `only` the layer's results of other parsers don't count.
    """
    usable = [c for c in enabled(choices) if only is None or c.name == only]
    if not usable:
        raise ValueError("no parser is left")
    files = scan(spark, folder, pattern)
    held = spark.read.schema(f"{PARSED}, parsed_at timestamp").parquet(layer) if exists(spark, layer) else spark.createDataFrame([], f"{PARSED}, parsed_at timestamp")
    held = held.where(F.col("parser").isin(*[c.name for c in usable]))
    stale = files if held.isEmpty() else fresh(held, files)
    found: DataFrame | None = None
    for choice in usable:
        own = stale if found is None else stale.join(found.where(F.col("error").isNull() & ~majority_empty(F.col("pages"))).select("path"), "path", "left_anti")
        result = written(parse(own, choice.parse, choice.name, choice.most_bytes))
        found = result if found is None else with_fallback(found, result)
    fresh_rows = written(found)
    fresh_rows.withColumn("parsed_at", F.current_timestamp()).write.mode("append").parquet(layer)
    names = [c.split()[0] for c in re.sub(r"<.*?>+", "", PARSED).split(", ")]
    latest = held.groupBy("path").agg(F.max_by(F.struct(*names[1:]), "parsed_at").alias("r")).select("path", "r.*")
    kept = latest.join(stale.select("path"), "path", "left_anti").join(files.select("path"), "path", "left_semi")
    return fresh_rows.select(*names).unionByName(kept.select(*names))


def timings(parsed: DataFrame) -> DataFrame:
    """(path, parser, n_pages, n_tables, parse_s, error) of each file."""
    return parsed.select("path", "parser", F.size("pages").alias("n_pages"), F.size("tables").alias("n_tables"), F.col("seconds").alias("parse_s"), "error")


def pages_of(parsed: DataFrame) -> DataFrame:
    """(path, company, report_year, parser, page_pos, page_num, text)."""
    return parsed.select("path", "company", "report_year", "parser", F.posexplode("pages").alias("page_pos", "p")).select("path", "company", "report_year", "parser", "page_pos", "p.page_num", "p.text")


def tables_of(parsed: DataFrame) -> DataFrame:
    """(path, company, report_year, parser, table_idx, page_num, headers, rows)."""
    return parsed.select("path", "company", "report_year", "parser", F.posexplode("tables").alias("table_idx", "t")).select("path", "company", "report_year", "parser", "table_idx", "t.page_num", "t.headers", "t.rows")


def gold_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a CSV file; blank is NULL, a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], GOLD)
    return spark.read.schema(GOLD).csv(path, header=True, multiLine=True, escape='"')


def run_facts(spark: SparkSession, path: str) -> DataFrame | None:
    """Facts of a run's CSV file, whose snippets may hold line breaks; None if it is missing."""
    return spark.read.schema(FACTS).csv(path, header=True, multiLine=True, escape='"') if exists(spark, path) else None
