"""Chains of rows that each name another: which of them never end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.sources.scratch import stored


def endless(links: DataFrame) -> DataFrame:
    """id, at: the rows of ``links`` (id, at) whose chain never ends, being on a cycle or leading to one, with a row that it comes to.

    Each round lets every row point as far again as it did (pointer doubling), so a chain of n rows takes log n rounds of one join. A row whose
    chain is at its end leaves; once a round lets none leave, none that is left will: of a chain with an end each round takes some.
    """
    first = links.filter("id is not null and at is not null").groupBy("id").agg(F.min("at").alias("at"))
    now = stored(first, "links")
    n = now.count()
    while n:
        further = now.select(F.col("id").alias("at"), F.col("at").alias("next"))
        after = stored(now.join(further, "at").select("id", F.col("next").alias("at")), "links")
        left = after.count()
        if left == n:
            return after
        now, n = after, left
    return now
