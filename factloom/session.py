"""Reading tables, cutting lineage and sending small tables, the same on a laptop and on a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the data set in `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, as the session names it.

    Only a session on one machine that names none, as in tests, gets a temporary one; on a
    cluster that is an error, as no executor could read what another wrote there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", "")
        if not named and not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="factloom-checkpoint-"))
    return context.getCheckpointDir()


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: smaller than a checkpoint, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `limit` rows; at most `limit` + 1 rows are counted."""
    return df.limit(limit + 1).count() <= limit


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder `path` on whatever file system it names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def bounded(df: DataFrame, what: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, a parameter table that every row is compared with, marked for broadcast; more than `limit` rows are an error, never cut."""
    if not fits_broadcast(df, limit):
        raise ValueError(f"{what} has more than {limit:,} rows")
    return F.broadcast(df)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has at most `limit` rows; a larger one is whole too and joined as the planner sees fit."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df
