"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    at = "file://" + tempfile.mkdtemp(prefix="linkwright-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage, survives the loss of executors.

    Results may be read from the files until the driver ends, so they stay as
    long; then those on a mounted folder are removed. Elsewhere release() or
    the folder's own upkeep clears them.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    if path.startswith(("file:/", "/")):
        atexit.register(shutil.rmtree, "/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_checked(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left", most_rows: int = 300_000) -> DataFrame:
    """left joined with a stored table right: broadcast if it was counted and has at most most_rows, else joined as the planner chooses."""
    return left.join(F.broadcast(right) if right.count() <= most_rows else right, on, how)


def release(spark: SparkSession) -> None:
    """Remove every table that stored() wrote under this session's shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tables")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
