"""Run records and attempts: terminal rule, completeness, identity, recovery, stages, attempt chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The validation errors of an output-limit failure.
OUTPUT_LIMIT = (
    ("OUTPUT_LIMIT_EXCEEDED",),
    ("OUTPUT_LIMIT_EXCEEDED", "STDOUT_LIMIT_EXCEEDED"),
    ("OUTPUT_LIMIT_EXCEEDED", "STDERR_LIMIT_EXCEEDED"),
    ("OUTPUT_LIMIT_EXCEEDED", "STDOUT_LIMIT_EXCEEDED", "STDERR_LIMIT_EXCEEDED"),
)


def is_terminal(max_attempts: int, retryable: tuple[str, ...], invalid_output_policy: str = "retry") -> Column:
    """Whether a record (status, attempt) is the last of its run."""
    status = F.col("status")
    out = status.isin("succeeded", "configuration_error", "adapter_error") | (F.col("attempt") >= max_attempts) | ~status.isin(*retryable)
    return out | (status == "invalid_output") if invalid_output_policy == "fail_run" else out


def check_complete(plan: DataFrame, records: DataFrame, gold: DataFrame) -> DataFrame:
    """Violations: runs without exactly one record, records outside the plan, cases without exactly one gold record, gold outside the plan."""

    def compare(want: DataFrame, got: DataFrame, key: str, name: str) -> DataFrame:
        sides = want.select(key).distinct().withColumn("w", F.lit(1)).join(got.groupBy(key).agg(F.count("*").alias("n")), key, "full_outer")
        bad = sides.filter("w is null or n is null or n > 1")
        return bad.select(F.when(F.col("w").isNull(), f"{name}_unplanned").when(F.col("n").isNull(), f"{name}_missing").otherwise(f"{name}_repeated").alias("rule"), F.col(key).alias("key"))

    return compare(plan, records, "run_id", "record").union(compare(plan, gold, "case_id", "gold"))


def check_identity(records: DataFrame, plan: DataFrame, columns: list[str]) -> DataFrame:
    """Violations: records whose columns are not those of their planned run (nulls agree with nulls)."""
    wanted = plan.select("run_id", *(F.col(c).alias(f"want_{c}") for c in columns))
    joined = records.join(wanted, "run_id")
    wrong = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"want_{c}")), c) for c in columns)))
    return joined.select(F.explode(wrong).alias("rule"), F.col("run_id").alias("key"))


def select_recovery(records: DataFrame, max_attempts: int) -> DataFrame:
    """run_id and reason of the failed runs that a recovery may run again."""
    errors = F.col("validation_errors")
    limit = (F.col("status") == "adapter_error") & F.array_contains(F.array(*(F.array(*map(F.lit, e)) for e in OUTPUT_LIMIT)), errors)
    spent = F.col("attempt") >= max_attempts
    invalid = (F.col("status") == "invalid_output") & spent & (errors == F.array(F.lit("OUTPUT_SCHEMA_INVALID")))
    provider = (F.col("status") == "provider_error") & spent & (errors == F.array(F.lit("PROCESS_NONZERO")))
    reason = F.when(limit, "output_limit").when(invalid, "invalid_output").when(provider, "provider")
    return records.withColumn("reason", reason).filter("reason is not null").select("experiment_id", "run_id", "reason")


def overlay_recovery(source: DataFrame, recovery: DataFrame) -> DataFrame:
    """Source records, replaced by their recovery record where that succeeded; ``recovered`` tells which."""
    columns = [c for c in source.columns if c != "run_id"]
    new = recovery.filter("status = 'succeeded'").select("run_id", F.struct(*columns).alias("new"))
    joined = source.join(new, "run_id", "left")
    return joined.select("run_id", *(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in columns), F.col("new").isNotNull().alias("recovered"))


def combine_stages(development: DataFrame, holdout: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both stages' records, and violations: runs in both, planned runs in neither."""
    both = development.select("run_id").intersect(holdout.select("run_id")).select(F.lit("overlap").alias("rule"), F.col("run_id").alias("key"))
    joined = development.unionByName(holdout)
    return joined, both.union(plan.join(joined, "run_id", "left_anti").select(F.lit("uncovered"), "run_id"))


def check_attempt_chain(attempts: DataFrame) -> DataFrame:
    """Violations: attempts that don't run from 1 on without a gap, or whose retry history is not what came before (run_id, attempt, status, retry_history)."""
    before = Window.partitionBy("run_id").orderBy("attempt")
    rows = attempts.withColumns({"n": F.row_number().over(before), "seen": F.collect_list(F.struct("attempt", "status")).over(before.rowsBetween(Window.unboundedPreceding, -1))})
    gap = rows.filter("n <> attempt").select(F.lit("gap").alias("rule"), "run_id", "attempt")
    other = F.to_json("seen") != F.to_json(F.coalesce("retry_history", F.array().cast(attempts.schema["retry_history"].dataType)))
    return gap.union(rows.filter(other).select(F.lit("history"), "run_id", "attempt"))


def check_metadata(metadata: DataFrame, terminal: DataFrame) -> DataFrame:
    """Violations of attempt metadata (run_id, attempt) against the last attempt of each run (run_id, terminal_attempt).

    The first attempts of a run may lack metadata; from the first that has it on to the last none may. Rules: gap, beyond, repeated, unknown_run.
    """
    runs = metadata.groupBy("run_id").agg(F.min("attempt").alias("lo"), F.max("attempt").alias("hi"), F.count_distinct("attempt").alias("n"), F.count("*").alias("rows")).join(terminal, "run_id", "left")
    c = F.col
    rules = F.array_compact(F.array(
        F.when(c("terminal_attempt").isNull(), "unknown_run"),
        F.when(c("hi") > c("terminal_attempt"), "beyond"),
        F.when((c("hi") < c("terminal_attempt")) | (c("hi") - c("lo") + 1 != c("n")), "gap"),
        F.when(c("rows") > c("n"), "repeated"),
    ))
    return runs.select(F.explode(rules).alias("rule"), c("run_id").alias("key"))


def reconcile_attempts(attempts: DataFrame, terminal: Column) -> DataFrame:
    """The latest attempt of each run, and whether it is terminal."""
    latest = attempts.groupBy("experiment_id", "run_id").agg(F.max_by(F.struct("attempt", "status"), "attempt").alias("last"))
    return latest.select("experiment_id", "run_id", "last.*").withColumn("terminal", terminal)


def check_linked(source: DataFrame, linked: DataFrame, columns: list[str]) -> DataFrame:
    """Violations: protocol columns in which a linked experiment differs from its source (source_id, columns)."""
    wanted = source.select(F.col("experiment_id").alias("source_id"), *(F.col(c).alias(f"want_{c}") for c in columns))
    wrong = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"want_{c}")), c) for c in columns)))
    return linked.join(wanted, "source_id").select(F.explode(wrong).alias("rule"), F.col("experiment_id").alias("key"))
