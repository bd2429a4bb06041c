"""Queries of the operators for training text over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import encoding, mixing, packing, pages, sentences, splitting, survivors
from factloom.llm.tokens import with_sizes
from factloom.session import reliable_checkpoint, small, table


def _limit(spark: SparkSession, sf_dir: str, item: str) -> tuple[int, int]:
    row = table(spark, sf_dir, "size_limits").where(F.col("item") == item).first()
    return row["max_chars"], row["overlap_chars"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of noise of every page and snippet."""
    return pages.find_noise(table(spark, sf_dir, "report_pages"), table(spark, sf_dir, "extractions"))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and snippet as continuous readable paragraphs."""
    return pages.repair(table(spark, sf_dir, "report_pages"), table(spark, sf_dir, "extractions"))


def _sentence_rows(spark: SparkSession, sf_dir: str, units: bool) -> DataFrame:
    whole, rows = table(spark, sf_dir, "report_pages").select("page_id", "text"), table(spark, sf_dir, "sentences").select("sentence_id", "text")
    model = sentences.learn_thai(whole.select("text", F.lit(False).alias("whole")).unionAll(rows.select("text", F.lit(True).alias("whole"))))
    tagged = lambda df, src, key: df.select(F.lit(src).alias("src"), F.col(key).alias("row_id"), "sentence_no", "start_pos", "end_pos", *["text"] * units)
    return tagged(sentences.split_documents(whole, "page_id", "text", model, units), "report_pages", "page_id").unionAll(
        tagged(sentences.split_documents(rows, "sentence_id", "text", model, units), "sentences", "sentence_id")
    )


def p4_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every page and row; a unit that breaks off has no end_pos."""
    return _sentence_rows(spark, sf_dir, True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every end of a sentence."""
    return _sentence_rows(spark, sf_dir, False).select("src", "row_id", "end_pos")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every page and table: src, row_id, n_pieces, piece_no, start, chars, piece."""
    texts = splitting.split_texts(table(spark, sf_dir, "report_pages"), "page_id", "text", *_limit(spark, sf_dir, "page_text"))
    tables = splitting.split_tables(table(spark, sf_dir, "report_tables"), "table_id", "rows", *_limit(spark, sf_dir, "table_rows"))
    tagged = lambda df, src, key: df.select(F.lit(src).alias("src"), F.col(key).alias("row_id"), "n_pieces", "piece_no", "start", "chars", "piece")
    return tagged(texts, "report_pages", "page_id").unionAll(tagged(tables, "report_tables", "table_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and tables over their limit: those of which the operator made more than one piece."""
    return p5_pieces(spark, sf_dir).where("n_pieces > 1 and piece_no = 0").select("src", "row_id")


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page and table how far its pieces reach without a gap, and whether each piece keeps the limit or is the whole."""
    limits = table(spark, sf_dir, "size_limits").select(F.when(F.col("item") == "page_text", "report_pages").otherwise("report_tables").alias("src"), "max_chars", "overlap_chars")
    each = p5_pieces(spark, sf_dir).join(small(limits), "src")
    added = F.col("chars") - F.when(F.col("piece_no") > 0, F.col("overlap_chars")).otherwise(0)
    found = each.groupBy("src", "row_id").agg(F.sum(added).alias("chars"), F.max(F.col("start") + F.col("chars")).alias("reach"), F.bool_and((F.col("chars") <= F.col("max_chars")) | (F.col("n_pieces") == 1)).alias("within_limit"))
    return found.select("src", "row_id", F.col("chars").cast("long").alias("chars"), F.col("reach").cast("long").alias("reach"), "within_limit")


def p6_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per fact of a run, built field by field; value, unit and year stay together."""
    records = table(spark, sf_dir, "extractions").withColumn("quantity", F.when(F.col("value").isNotNull(), F.struct("value", "unit", "reporting_year")))
    group = {"run_tag": F.col("run_tag"), "report_year": F.col("report_year"), "kpi": F.col("kpi"), "company": survivors.even_spelling(F.col("company"))}
    attributes = ["quantity", "source_snippet", "source_page", "extractor"]
    found = survivors.survivors(survivors.with_trust(records, table(spark, sf_dir, "extractor_trust")), group, "extraction_id", attributes)
    return found.select(*group, "n", "best_id", "dominant_id", "quantity.value", "quantity.unit", "quantity.reporting_year", *attributes[1:])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records at least as good as every other one of their group in every respect."""
    return p6_survivors(spark, sf_dir).where("n >= 2 and dominant_id is not null").select(F.col("dominant_id").alias("extraction_id"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of each piece of one that exceeds the capacity."""
    capacity = table(spark, sf_dir, "containers").where("container = 'long_context'").first()["capacity_tokens"]
    return packing.pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", capacity)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents the operator had to cut because they alone exceed the capacity."""
    return p7_containers(spark, sf_dir).where("n_pieces > 1 and piece_no = 0").select("doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    capacity = table(spark, sf_dir, "containers").where("container = 'long_context'").first()["capacity_tokens"]
    each = p7_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.max("tokens").alias("fullest"), (F.sum("tokens") / (F.count(F.lit(1)) * capacity)).alias("filled"))


def _mix_parts(spark: SparkSession, sf_dir: str, exact_shares: bool = False) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = reliable_checkpoint(with_sizes(documents, "text"))
    return sized, mixing.plan(sized, table(spark, sf_dir, "mix_targets"), "doc_id", exact_shares=exact_shares)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with repeats, in shuffled order."""
    return mixing.mix(*_mix_parts(spark, sf_dir), "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, attainable and actual share of every source in a mix as large as all documents together."""
    sized, planned = _mix_parts(spark, sf_dir)
    return mixing.shares(mixing.mix(sized, planned, "doc_id"), planned)


def p8_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the largest mix in which every source can hold its target."""
    sized, planned = _mix_parts(spark, sf_dir, True)
    return mixing.shares(mixing.mix(sized, planned, "doc_id"), planned)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that can't reach their target share."""
    return p8_shares(spark, sf_dir).where("not reachable").select("source")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected documents with their text restored as far as it can be had."""
    documents = table(spark, sf_dir, "documents")
    return encoding.restore_texts(documents, "doc_id", "text", encoding.train(documents))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents decoded with a wrong character encoding, whole or in part."""
    return p9_restored(spark, sf_dir).select("doc_id")


QUERIES = {
    "p2_found": p2_found,
    "p2_repaired": p2_repaired,
    "p4_found": p4_found,
    "p4_units": p4_units,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_coverage": p5_coverage,
    "p6_found": p6_found,
    "p6_survivors": p6_survivors,
    "p7_found": p7_found,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_exact_shares": p8_exact_shares,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}
