"""Writing runs, timings and prompt logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_run(facts: DataFrame, scored: DataFrame | None, folder: str, run_tag: str, file_format: str = "parquet") -> None:
    """Facts, and metrics if there are any, under `folder`/`run_tag`; CSV holds flags as JSON."""
    kept = facts.withColumn("run_tag", F.lit(run_tag))
    if file_format == "csv":
        kept = kept.withColumn("flags", F.to_json("flags"))
    options = {"header": True, "escape": '"'} if file_format == "csv" else {}
    kept.write.mode("overwrite").format(file_format).options(**options).save(f"{folder}/{run_tag}/extractions")
    if scored is not None:
        scored.write.mode("overwrite").format(file_format).options(**options).save(f"{folder}/{run_tag}/metrics")


def write_timings(timings: DataFrame, folder: str, run_tag: str) -> None:
    """Timings of parsing and indexing as CSV."""
    timings.write.mode("overwrite").csv(f"{folder}/{run_tag}/parse_timings", header=True)


def write_prompt_log(log: DataFrame, folder: str, run_tag: str) -> None:
    """Log entries (path, json), one file per key of company, year and indicator; a key logged twice keeps one of them."""
    parts = log.groupBy("path").agg(F.max("json").alias("json"))
    parts.write.mode("overwrite").partitionBy("path").text(f"{folder}/{run_tag}/prompt_log")


