"""Facts as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def fact_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """New parquet files of facts as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def latest_stream(facts: DataFrame, keys: list[str], year: str, position: str) -> DataFrame:
    """Running latest fact of each key, for output mode complete or update; the same result as over all facts at once."""
    rest = [c for c in facts.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(F.col(year).alias("y"), F.col(position).isNotNull().alias("h"), (-F.col(position)).alias("p")))
    return facts.groupBy(*keys).agg(top.alias("_t")).select(*keys, *[F.col(f"_t.{c}").alias(c) for c in rest])
