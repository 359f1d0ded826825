"""What the operators share: reading tables, scratch tables in the shared folder, hashing folds, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.sources.scratch import shared_dir

#: Rows of a table that may be broadcast; a table beyond it is joined by a shuffle.
BROADCAST_ROWS = 100_000


def materialize(df: DataFrame, name: str = "table", compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evalloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, column: str, buckets: int, name: str = "table") -> DataFrame:
    """Like ``materialize``, in buckets of ``column``: grouping by it later moves no row of the table.

    There are no more buckets than Spark allows for a table (spark.sql.sources.bucketing.maxBuckets, 100,000 if unset): beyond that they grow.
    """
    spark = df.sparkSession
    buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("compression", "zstd").option("path", f"{shared_dir(spark)}/evalloom/{table}").saveAsTable(table)
    return spark.table(table)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Batches of at most ``rows`` rows go to Python in what is written meanwhile: batches of whole texts are large, and both sides hold them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted, at most rows + 1 of them)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Smallest reachable id of every vertex of ``edges`` (src, dst long): columns id, component.

    Large-star and small-star rounds alternate until the edges no longer change; each round is a group-by on one
    column whose groups are never gathered (min, then a join back), and ends in a table in the shared folder.
    An empty input gives an empty result. Raises if ``max_rounds`` rounds do not suffice.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = both.join(lowest, "a")
        if large:
            return linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    def digest(pairs: DataFrame) -> tuple:
        row = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    pairs = materialize(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a <> b").distinct(), "edges")
    seen = digest(pairs)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        pairs = materialize(star(star(pairs, True), False), "edges")
        now = digest(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    alone = pairs.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).union(alone)
