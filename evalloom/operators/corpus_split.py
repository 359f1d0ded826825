"""Development / holdout splits balanced over strata: exact search for small corpora, quotas for large ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.digests import ordered_digest, placed

DIMENSIONS = ("repository", "defect_category", "context_size_band")
#: Selections that the exact search looks at at most.
EXACT_LIMIT = 5_000_000


def context_band(a: Column, b: Column) -> Column:
    larger = F.greatest(a, b)
    return F.when(larger <= 2000, "small").when(larger <= 8000, "medium").otherwise("large")


def order_key(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), "case_id").cast("binary"), 256)


def check_split_input(cases: DataFrame, locked: DataFrame, holdout: int) -> DataFrame:
    """Violations: repeated cases, locks without a case, a holdout larger than what is not locked."""
    out = cases.groupBy("case_id").count().filter("count > 1").select(F.lit("repeated").alias("rule"), F.col("case_id").alias("key"))
    out = out.union(locked.join(cases, "case_id", "left_anti").select(F.lit("unknown_lock"), "case_id"))
    free = cases.join(locked, "case_id", "left_anti").agg(F.count("*").alias("n"))
    return out.union(free.filter((F.col("n") < holdout) | (F.lit(holdout) < 1)).select(F.lit("infeasible"), F.col("n").cast("string")))


def check_roles(cases: DataFrame, split: DataFrame) -> DataFrame:
    """Violations: cases whose role is not that of the frozen split."""
    joined = cases.select("case_id", "role").join(split.select("case_id", F.col("role").alias("frozen")), "case_id", "full_outer")
    return joined.filter("not role <=> frozen").select(F.lit("role").alias("rule"), F.col("case_id").alias("key"))


def balance(split: DataFrame) -> DataFrame:
    """total, development and holdout of every value of every dimension."""
    long = split.select("role", F.inline(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS))))
    return long.groupBy("dimension", "value").agg(F.count("*").alias("total"), F.count_if(F.col("role") == "development").alias("development"), F.count_if(F.col("role") == "holdout").alias("holdout"))


def split_objective(split: DataFrame) -> DataFrame:
    """Sum over dimensions and values of (holdout x N - total x H) squared, an exact integer."""
    cells, size = balance(split), split.agg(F.count("*").alias("n"), F.count_if(F.col("role") == "holdout").alias("h"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    gap = wide("holdout") * wide("n") - wide("total") * wide("h")
    gap = gap.cast("decimal(19,0)")
    return cells.join(F.broadcast(size)).agg(F.sum((gap * gap).cast("decimal(38,0)")).alias("objective"), F.max("n").alias("cases"), F.max("h").alias("holdout"))


def stratified_holdout(cases: DataFrame, seed: int, holdout: int, locked: DataFrame | None = None) -> DataFrame:
    """Roles by largest-remainder quotas over joint strata, in seeded hash order within each; locked cases stay in development.

    A stratum may be large: its cases are ranked over many tasks.
    """
    rows = cases.withColumns({"stratum": F.concat_ws("\1", *DIMENSIONS), "order": order_key(seed)})
    free = rows if locked is None else rows.join(locked.select("case_id"), "case_id", "left_anti")
    sizes = free.groupBy("stratum").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("all"))
    share = F.col("n") * F.lit(holdout).cast("decimal(10,0)")  # of all: integers, so that no remainder is rounded
    quotas = sizes.join(F.broadcast(total)).withColumns({"base": ((share - share % F.col("all")) / F.col("all")).cast("long"), "rest": share % F.col("all")})
    spare = quotas.agg((F.lit(holdout) - F.sum("base")).alias("spare"))
    ranked = quotas.join(F.broadcast(spare)).withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), "stratum")))  # a row for each stratum
    quotas = ranked.select("stratum", (F.col("base") + F.when(F.col("r") <= F.col("spare"), 1).otherwise(0)).alias("quota"))
    ranks = placed(free.select("stratum", "order", "case_id"), ["stratum"], ["order", "case_id"])
    chosen = ranks.join(quotas, "stratum").filter("place < quota").select("case_id", F.lit("holdout").alias("role_new"))
    return cases.drop("role").join(chosen, "case_id", "left").withColumn("role", F.coalesce("role_new", F.lit("development"))).drop("role_new")


def best_holdout_exact(cases: DataFrame, seed: int, holdout: int, locked: tuple[str, ...] = ()) -> tuple[list[str], int]:
    """The selection of least objective (ties by the SHA-256 of seed and members), over all combinations, which tasks share."""
    size = cases.count()
    if not 0 < comb(max(0, size - len(set(locked))), holdout) <= EXACT_LIMIT:
        raise ValueError(f"{size} cases: selections are not from 1 to {EXACT_LIMIT}")
    rows = cases.select("case_id", *DIMENSIONS).orderBy("case_id").toPandas()  # few, as their selections are
    names = rows["case_id"].tolist()
    free = [i for i, n in enumerate(names) if n not in set(locked)]
    count = comb(len(free), holdout) if 0 < holdout <= len(free) else 0
    if not 0 < count <= EXACT_LIMIT:
        raise ValueError(f"{count} selections: not from 1 to {EXACT_LIMIT}")
    codes = [pd.factorize(rows[d])[0] for d in DIMENSIONS]
    n = len(names)

    def unrank(k: int) -> list[int]:
        out, at = [], 0
        for left in range(holdout, 0, -1):
            while (c := comb(len(free) - at - 1, left - 1)) <= k:
                k -= c
                at += 1
            out.append(free[at])
            at += 1
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        totals = [np.bincount(c) for c in codes]
        for batch in batches:
            for k in batch["id"].tolist():
                members = unrank(k)
                score = sum(int(((np.bincount(c[members], minlength=len(t)) * n - t * holdout) ** 2).sum()) for c, t in zip(codes, totals))
                if best is None or score <= best[0]:
                    chosen = [names[i] for i in members]
                    found = (score, hashlib.sha256((f"{seed}\n" + "\n".join(chosen)).encode()).hexdigest(), chosen)
                    best = found if best is None else min(best, found)
        if best:
            yield pd.DataFrame([best], columns=["score", "tie", "members"])

    ids = cases.sparkSession.range(count)
    row = ids.mapInPandas(run, "score long, tie string, members array<string>").orderBy("score", "tie").first()
    return list(row["members"]), row["score"]


def order_holdout(split: DataFrame, seed: int) -> DataFrame:
    """Holdout cases with their seeded position."""
    rows = split.filter("role = 'holdout'").select("case_id", order_key(seed).alias("order"))
    return placed(rows, [], ["order", "case_id"]).select("case_id", (F.col("place") + 1).cast("int").alias("position"))


def split_proof(split: DataFrame, seed: int) -> DataFrame:
    """Counts and a checksum of the ordered membership that does not disclose it."""
    held = split.filter("role = 'holdout'").select("case_id", order_key(seed).alias("order"))
    proof = ordered_digest(held, [], ["order"], F.col("case_id")).select(F.col("digest").alias("ordered_holdout_checksum"))
    return split.agg(F.count("*").alias("case_count"), F.count_if(F.col("role") == "holdout").alias("holdout_count")).join(F.broadcast(proof), how="left")
