"""Rule extraction of one value per report and indicator: from tables, else from lines, else not reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom import registry
from factloom.functions import tablecells, text
from factloom.functions.numbers import first_number, has_number, numbers_in_text
from factloom.functions.units import family, parse_value, to_canonical_value
from factloom.functions.vectors import slot_cosine, slots
from factloom.session import bounded, small

# Years of a header line, and where it is sought from a line, nearest above first.
LINE_YEAR = r"\b(20[1-3]\d)\b"
OFFSETS = [*range(-1, -26, -1), 1, 2, 3]
REPORT = ["report_id", "company", "report_year"]


def header_entries(tables: DataFrame, per_row: bool = True) -> DataFrame:
    """(report_id, table_id, page_num, hdr_idx, header_string): what is compared with a query, one per table.

    With `per_row`, the label of each row is an entry as well, which suits embedders that
    only see words.
    """
    whole = F.array(text.header_string(F.col("headers"), F.col("rows")))
    labels = F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), tablecells.label_cell) if per_row else F.array().cast("array<string>")
    entries = tables.select("report_id", "table_id", "page_num", F.posexplode(F.concat(whole, labels)).alias("hdr_idx", "header_string"))
    return entries.where("header_string != ''")


def table_similarity(tables: DataFrame, kpis: DataFrame, per_row: bool = True) -> DataFrame:
    """(table_id, kpi, sim): the best cosine of a table's entries with the indicator's query, by the in-repo embedder."""
    entries = header_entries(tables, per_row).select("table_id", slots(F.col("header_string")).alias("a"))
    asked = kpis.select("kpi", slots(F.col("query")).alias("b"))
    return entries.join(bounded(asked, "the list of indicators")).groupBy("table_id", "kpi").agg(F.max(slot_cosine(F.col("a"), F.col("b"))).alias("sim"))


def table_rows(tables: DataFrame) -> DataFrame:
    """Data rows with their table's effective headers, year column and section: the label of the last row above without a number there.

    Tables without a header year up to the report's and rows too short for that column
    are left out; such rows and blank labels set no section.
    """
    t = tables.withColumn("_e", tablecells.effective(F.coalesce("headers", F.array().cast("array<string>")), F.coalesce("rows", F.array().cast("array<array<string>>"))))
    t = t.withColumn("_h", F.col("_e.headers")).withColumn("year_col", tablecells.year_column(F.col("_h"), F.col("report_year"))).where("year_col is not null")
    rows = t.select(*REPORT, "table_id", "table_idx", "page_num", F.col("_h").alias("headers"), "year_col", F.posexplode("_e.rows").alias("row_idx", "row"))
    rows = rows.where(F.size("row") > F.col("year_col")).withColumn("cell", tablecells.text_of(F.get("row", F.col("year_col")))).withColumn("is_data", has_number(F.col("cell")))
    first = tablecells.text_of(F.get("row", F.lit(0)))
    before = W.partitionBy("table_id").orderBy("row_idx").rowsBetween(W.unboundedPreceding, -1)
    section = F.last(F.when(~F.col("is_data") & (F.trim(first) != ""), first), ignorenulls=True).over(before)
    return rows.withColumn("section", F.coalesce(section, F.lit(""))).where("is_data").drop("is_data")


def not_under_heading(tables: DataFrame, pages: DataFrame, kpis: DataFrame) -> DataFrame:
    """(table_id, kpi) of tables on pages whose headings hold one of the indicator's page_negative_phrases."""
    phrases = kpis.where("page_negative_phrases is not null").select("kpi", "page_negative_phrases")
    heads = pages.where("text is not null and contains(text, '#')").groupBy("report_id", "page_num").agg(F.max(text.heading_text(F.col("text"))).alias("heading"))
    on = tables.select("report_id", "page_num", "table_id").join(heads, ["report_id", "page_num"])
    return on.join(bounded(phrases, "the list of phrases")).where(text.holds_any(F.col("heading"), F.col("page_negative_phrases"))).select("table_id", "kpi")


def table_candidates(tables: DataFrame, pages: DataFrame, kpis: DataFrame, similarity: DataFrame, threshold: float = registry.HEADER_SIMILARITY) -> DataFrame:
    """At most one candidate per table and indicator: the best scored row that has a number, a unit, a conversion and a plausible value."""
    near = similarity.where(F.col("sim") >= threshold).join(not_under_heading(tables, pages, kpis), ["table_id", "kpi"], "left_anti")
    rows = table_rows(tables).withColumn("label", tablecells.label_cell(F.col("row")))
    known = kpis.select("kpi", "query", text.tokens(F.col("query")).alias("wanted"), "canonical_unit", "lo", "hi", "negative_tokens", family(F.col("unit_family")).alias("accepted"))
    labelled = rows.join(near, "table_id")
    # Labels repeat over tables and years, so each is scored once per indicator.
    pairs = labelled.select("label", "kpi").distinct().withColumn("held", text.tokens(F.col("label"))).join(small(known.select("kpi", "query", "wanted")), "kpi")
    scores = pairs.select("label", "kpi", tablecells.row_score(F.col("query"), F.col("label"), F.col("wanted"), F.col("held")).alias("row_score")).where("row_score > 0")
    joined = labelled.join(scores, ["label", "kpi"]).join(small(known), "kpi")
    haystack = F.lower(F.concat_ws(" ", "section", "label", F.when(F.size("row") > 1, tablecells.text_of(F.get("row", F.lit(1)))).otherwise(F.lit(""))))
    scored = joined.where(~text.holds_any(haystack, F.col("negative_tokens")))
    read = scored.withColumn("unit", tablecells.infer_unit(F.col("headers"), F.col("row"), F.col("year_col"), F.col("accepted"))).where("unit.unit is not null")
    read = read.withColumn("value", to_canonical_value(first_number(F.col("cell")) * F.col("unit.multiplier"), F.col("unit.unit"), F.col("canonical_unit"))).where(F.col("value").between(F.col("lo"), F.col("hi")))
    best = read.withColumn("rn", F.row_number().over(W.partitionBy("table_id", "kpi").orderBy(F.desc("row_score"), "row_idx"))).where("rn = 1")
    year_shaped = F.trim("cell").rlike(r"^(19|20)\d{2}$")
    score = F.col("sim") * tablecells.structural_score(F.col("headers"), F.col("report_year"))
    return best.select(
        *REPORT,
        "kpi",
        "table_idx",
        score.alias("table_score"),
        (score * F.col("row_score") * F.when(year_shaped, registry.YEAR_SHAPED_PENALTY).otherwise(1.0)).alias("confidence"),
        "value",
        F.col("canonical_unit").alias("unit"),
        F.concat(F.lit("table@page "), F.coalesce(F.col("page_num").cast("string"), F.lit("None")), F.lit(": "), F.col("label"), F.lit(" | "), F.col("cell")).alias("source_snippet"),
        F.col("page_num").alias("source_page"),
        F.when(year_shaped, F.array(F.lit("year_shaped_value"))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )


def table_choice(candidates: DataFrame) -> DataFrame:
    """One candidate per report and indicator: of those within 5 per cent of the best score the one of the greatest value, first of equals."""
    w = W.partitionBy("report_id", "kpi")
    best = F.max("confidence").over(w)
    tied = candidates.withColumn("best", best).where((F.col("best") == 0) | ((F.col("best") - F.col("confidence")) / F.nullif(F.col("best"), F.lit(0.0)) <= registry.TABLE_TIE))
    order = w.orderBy(F.desc("value"), F.desc("table_score"), "table_idx")
    return tied.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn", "best")


def year_column_value(lines: Column, at: Column, line: Column, raw: Column) -> Column:
    """`raw` scaled to the latest year's column by a header line near the line `at` of `lines`, or NULL.

    A header line holds at least two years without gap or repeat; as many last numbers of
    the line are its columns. A line too short or beginning with 0 passes on to the next.
    """
    own = numbers_in_text(line)
    candidates = F.transform(
        F.array(*[F.lit(o) for o in OFFSETS]),
        lambda o: F.struct(F.transform(F.regexp_extract_all(F.when((at + o >= 0) & (at + o < F.size(lines)), F.get(lines, at + o)), F.lit(LINE_YEAR), F.lit(1)), lambda y: y.cast("int")).alias("years")),
    )
    n = lambda c: F.size(c["years"])
    usable = F.filter(
        candidates,
        lambda c: c["years"].isNotNull()
        & (n(c) >= 2)
        & (F.array_max(c["years"]) - F.array_min(c["years"]) == n(c) - 1)
        & (F.size(own) >= n(c))
        & (F.coalesce(F.get(own, F.size(own) - n(c)), F.lit(0.0)) != 0.0),
    )
    def scaled(c: Column) -> Column:
        first = F.size(own) - n(c)
        target = F.get(own, (first + F.array_position(c["years"], F.array_max(c["years"])) - 1).cast("int"))
        return raw * (target / F.get(own, first))

    return F.get(F.transform(F.slice(usable, 1, 1), scaled), 0)


def line_candidates(pages: DataFrame, ranking: DataFrame, kpis: DataFrame) -> DataFrame:
    """Gated lines of the ranked pages (report_id, kpi, page_num, rank) with a value in an accepted unit, and whether it is plausible."""
    known = kpis.select("kpi", "canonical_unit", "lo", "hi", "negative_tokens", family(F.col("unit_family")).alias("accepted"), text.keywords(F.coalesce(F.nullif("queries", F.array().cast("array<string>")), F.array("query"))).alias("words"))
    sized = ranking.withColumn("n_pages", F.count(F.lit(1)).over(W.partitionBy("report_id", "kpi")))
    trimmed = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    lines = pages.where("text is not null").select(*REPORT, "page_num", F.split(text.normalize_co2(F.col("text")), "\n").alias("lines"))
    lines = lines.withColumn("_s", F.transform("lines", lambda t, i: F.struct(i.alias("line_idx"), trimmed(t).alias("line"))))
    lines = lines.withColumn("_s", F.transform(F.filter("_s", lambda x: F.length(x["line"]) >= 10), lambda x: F.struct(x["line_idx"], x["line"], F.lower(x["line"]).alias("low"))))
    each = lines.join(sized, ["report_id", "page_num"]).join(small(known), "kpi")
    least = registry.LEAST_KEYWORD_SHARE
    kept = F.filter("_s", lambda x: (text.keyword_share(x["low"], F.col("words")) >= least) & ~text.holds_any(x["low"], F.col("negative_tokens")))
    gated = each.select(*REPORT, "page_num", "kpi", "rank", "n_pages", "canonical_unit", "lo", "hi", "words", "accepted", F.explode(kept).alias("g")).select("*", F.col("g.line").alias("line"), F.col("g.line_idx").alias("line_idx"), F.col("g.low").alias("low"))
    # A value needs a digit and some unit's letters; the reader sees only such lines, and none the rest of its page.
    read = gated.where(F.col("line").rlike(r"\d")).withColumn("kw", text.keyword_share(F.col("low"), F.col("words"))).withColumn("p", parse_value(F.col("line"), F.col("accepted"))).where("p.unit is not null")
    read = read.select(*REPORT, "page_num", "kpi", "rank", "n_pages", "canonical_unit", "lo", "hi", "line", "line_idx", "kw", "p")
    read = read.join(lines.select("report_id", "page_num", "lines"), ["report_id", "page_num"])
    raw = F.coalesce(year_column_value(F.col("lines"), F.col("line_idx"), F.col("line"), F.col("p.value")), F.col("p.value"))
    valued = read.withColumn("value", to_canonical_value(raw, F.col("p.unit"), F.col("canonical_unit"))).where("value is not null")
    total = F.when(F.regexp_replace(F.lower("line"), r"^\|*\s*", "").startswith("total "), registry.TOTAL_BONUS).otherwise(0.0)
    score = F.col("kw") + registry.RANK_BONUS * (1.0 - F.col("rank") / F.greatest("n_pages", F.lit(1))) + total
    return valued.select(*REPORT, "kpi", "page_num", "rank", "line_idx", "line", "kw", score.alias("confidence"), "value", F.col("canonical_unit").alias("unit"), F.col("value").between(F.col("lo"), F.col("hi")).alias("plausible"))


def line_choice(candidates: DataFrame) -> DataFrame:
    """One line per report and indicator: of those with as many keywords as the best scored one that of the greatest value.

    `out_of_range` is true where any gated line had an implausible value, chosen or not;
    where all had, only that is known and the value is NULL.
    """
    w = W.partitionBy("report_id", "kpi")
    order = w.orderBy(F.desc("confidence"), "rank", "line_idx")
    marked = candidates.withColumn("out_of_range", F.max((~F.col("plausible")).cast("int")).over(w) == 1)
    good = marked.where("plausible").withColumn("best_kw", F.first("kw").over(order))
    tied = good.where(F.abs(F.col("kw") - F.col("best_kw")) < registry.LINE_TIE)
    chosen = tied.withColumn("rn", F.row_number().over(w.orderBy(F.desc("value"), F.desc("confidence"), "rank", "line_idx"))).where("rn = 1")
    snippet = F.concat(F.lit("line@page "), F.col("page_num").cast("string"), F.lit(": "), F.substring("line", 1, registry.SNIPPET_CHARS))
    flags = F.when(F.col("out_of_range"), F.array(F.lit("out_of_range"))).otherwise(F.array().cast("array<string>"))
    return chosen.select(*REPORT, "kpi", "confidence", "value", "unit", snippet.alias("source_snippet"), F.col("page_num").alias("source_page"), flags.alias("flags"))


def extract(reports: DataFrame, kpis: DataFrame, from_tables: DataFrame, from_lines: DataFrame, tainted: DataFrame | None = None, name: str = "baseline") -> DataFrame:
    """One row per report and indicator: the table's value, else the line's, else not reported (NULL value).

    `tainted` (report_id, kpi) lists pairs whose lines were all implausible; their rows
    carry the flag out_of_range.
    """
    facts = ["confidence", "value", "unit", "source_snippet", "source_page", "flags"]
    lines = from_lines.join(from_tables.select("report_id", "kpi"), ["report_id", "kpi"], "left_anti")
    found = from_tables.select("report_id", "kpi", *facts).unionByName(lines.select("report_id", "kpi", *facts))
    every = reports.select(*REPORT).join(bounded(kpis.select("kpi"), "the list of indicators"))
    joined = every.join(found, ["report_id", "kpi"], "left")
    empty = F.array().cast("array<string>")
    if tainted is not None:
        joined = joined.join(tainted.select("report_id", "kpi", F.lit(True).alias("_t")).distinct(), ["report_id", "kpi"], "left")
        empty = F.when(F.col("_t"), F.array(F.lit("out_of_range"))).otherwise(empty)
    return joined.select(
        "report_id", "company", "report_year", "kpi", "value", "unit", F.when(F.col("value").isNotNull(), F.col("report_year")).alias("reporting_year"), "source_snippet", "source_page", "confidence", F.lit(name).alias("extractor"), F.coalesce("flags", empty).alias("flags"), F.lit(None).cast("string").alias("run_tag")
    )
