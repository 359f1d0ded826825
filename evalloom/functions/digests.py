"""Digests of ordered rows for groups of any size.

Rows are dealt by range of (group, order), so a large group lies over many tasks. A row's place in its group follows from its
place in its task and the number of the group's rows in the tasks before. Places are cut into parts of PART rows; a part's digest is the
SHA-256 of its lines, and the digests of parts are the lines of the next level until one is left. A group of up to PART rows is
one part, so its digest is that of its joined lines; and the result depends on neither tasks nor partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.sources.scratch import stored

PART = 4_096


def placed(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds place: the number of rows of the group that come before in ``order`` (ties must not matter to the caller)."""
    parts = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_id", F.monotonically_increasing_id())
    rows = stored(rows, "placed").withColumn("_task", F.shiftright("_id", 33))
    tasks = rows.groupBy(*group, "_task").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))  # a row for each group and task that has some
    tasks = tasks.withColumn("_before", F.coalesce(F.sum("_n").over(parts), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    here, there = rows.alias("r"), tasks.alias("t")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in group] + [F.col("r._task") == F.col("t._task")]
    joined = here.join(there, reduce(lambda a, b: a & b, same))
    return joined.select(*(f"r.{c}" for c in df.columns), (F.col("_before") + F.col("_id")).alias("place"))


def ordered_digest(df: DataFrame, group: list[str], order: list[str], line: Column, part: int = PART) -> DataFrame:
    """group, digest (``sha256:`` and hexadecimal digits) and n of each group's lines in ``order``, rows equal in it by their lines."""
    names = [f"_o{k}" for k in range(len(order))]
    rows = df.select(*group, *(F.col(o).alias(n) for o, n in zip(order, names)), line.alias("_line"))
    rows = placed(rows, group, [*names, "_line"]).select(*group, "place", F.coalesce("_line", F.lit("")).alias("_line"), F.lit(1).cast("long").alias("n"))
    done = None
    while True:
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_line"))), lambda x: x["_line"]), "\n")
        level = rows.groupBy(*group, F.floor(F.col("place") / part).alias("place")).agg(F.sha2(lines.cast("binary"), 256).alias("_line"), F.sum("n").alias("n"))
        level = stored(level, "digests")
        size = level.groupBy(*group).agg(F.max("place").alias("last"))
        same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group], F.lit(True))
        whole = level.alias("l").join((size if group else F.broadcast(size)).alias("s"), same)  # without a group: one row
        whole = whole.select(*(f"l.{c}" for c in group), "place", "_line", "n", "last")
        ends = whole.filter("last = 0").select(*group, F.concat(F.lit("sha256:"), "_line").alias("digest"), "n")
        done = ends if done is None else done.union(ends)
        rows = whole.filter("last > 0").drop("last")
        if rows.isEmpty():
            return done
