"""Intermediate tables in the shared folder: written once where several results read them, so that lineage ends there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary folder of this process where it is unset and the session is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="evalloom-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evalloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted, at most one more of them); else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def met(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` for a join with rows that are partitioned by its keys already: sent to all tasks if it is small, else hashed in their partitions.

    Sizes that Spark takes from files are too low for tables that are packed well or made from smaller ones, so it gets no choice.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("shuffle_hash")
