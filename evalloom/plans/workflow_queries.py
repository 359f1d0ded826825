"""Queries of plans, run records, costs, adjudication, discovery and report over the demonstration views, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators import adjudication, bootstrap, constraints, cost, discovery, report, run_records, scoring, stats
from evalloom.operators import experiment_plan as plans
from evalloom.plans import scoring_queries as base
from evalloom.plans.demo import view, with_views
from evalloom.sources.scratch import met, stored


def by_experiment():
    return F.col("experiment_id")


def expanded_plan(spark, sf_dir):
    cases = view(spark, sf_dir, "cases").select("experiment_id", "case_id")
    rows = plans.derive_run_ids(plans.order_plan(plans.expand_plan(cases, 3), by_experiment()), "ns", by_experiment())
    return rows.select("experiment_id", "case_id", "snapshot", "condition", "repetition", "plan_pos", "run_id", F.col("request_seed").cast("string").alias("request_seed"))


def plan_violations(spark, sf_dir):
    """A plan whose holdout cases lack the candidate."""
    cases = view(spark, sf_dir, "cases").select("experiment_id", "case_id", "role")
    rows = plans.derive_run_ids(plans.expand_plan(cases, 3), "ns", by_experiment()).filter("not (role = 'holdout' and condition = 'candidate')")
    return plans.check_plan(rows, cases, 3)


def pair_violations(spark, sf_dir):
    rows = view(spark, sf_dir, "plan").filter("not (role = 'holdout' and condition = 'candidate' and repetition = 3)").withColumn("band", F.expr("run_no div 12"))
    return plans.check_pairs(rows, ["band"])


def plan_summary(spark, sf_dir):
    rows = view(spark, sf_dir, "records").join(view(spark, sf_dir, "cases").select("case_id", "role"), "case_id")
    return plans.plan_summary(rows, False, 3, 10_000, 2_000, 2.5, 15.0, 0.1)


def execution_summary(spark, sf_dir):
    return plans.execution_summary(view(spark, sf_dir, "plan"), view(spark, sf_dir, "records").filter("status <> 'provider_error'"))


def case_digests(spark, sf_dir):
    rows = view(spark, sf_dir, "plan").withColumn("run", F.col("run_id"))
    return plans.row_digests(rows, "case_id", "run_no", ["run", "snapshot", "condition"]).withColumn("n", F.col("n").cast("long"))


def experiment_digests(spark, sf_dir):
    """Groups of more rows than a part of a digest holds."""
    rows = view(spark, sf_dir, "plan").withColumn("run", F.col("run_id"))
    return plans.row_digests(rows, "experiment_id", "run_no", ["run", "snapshot", "condition"]).withColumn("n", F.col("n").cast("long"))


def terminal_records(spark, sf_dir):
    rows = view(spark, sf_dir, "records").withColumn("terminal", run_records.is_terminal(3, ("provider_error", "timeout", "invalid_output")))
    return rows.groupBy("experiment_id", "status", "attempt", "terminal").agg(F.count("*").alias("n"))


def completeness_violations(spark, sf_dir):
    records = view(spark, sf_dir, "records").filter("status <> 'provider_error'")
    gold = view(spark, sf_dir, "mechanisms").filter("mechanism_id = 'm1'")
    return run_records.check_complete(view(spark, sf_dir, "plan"), records, gold)


def identity_violations(spark, sf_dir):
    records = view(spark, sf_dir, "records").withColumn("condition", F.expr("case when run_no % 101 = 7 then 'other' else condition end"))
    return run_records.check_identity(records, view(spark, sf_dir, "plan"), ["case_id", "snapshot", "condition", "repetition"])


def _with_errors(records):
    errors = F.expr("case status when 'adapter_error' then array('OUTPUT_LIMIT_EXCEEDED') when 'invalid_output' then array('OUTPUT_SCHEMA_INVALID') when 'provider_error' then array('PROCESS_NONZERO') else cast(array() as array<string>) end")
    return records.withColumn("validation_errors", errors)


def recovery_selection(spark, sf_dir):
    return run_records.select_recovery(_with_errors(view(spark, sf_dir, "records")), 3)


def recovery_overlay(spark, sf_dir):
    records = view(spark, sf_dir, "records").select("run_id", "status", "latency_ms")
    recovery = records.filter("status <> 'succeeded'").withColumns({"status": F.expr("case when cast(substr(run_id, 5) as bigint) % 2 = 0 then 'succeeded' else status end"), "latency_ms": F.lit(9876.0)})
    return run_records.overlay_recovery(records, recovery)


def stage_violations(spark, sf_dir):
    records = view(spark, sf_dir, "records").join(view(spark, sf_dir, "cases").select("case_id", "role"), "case_id").select("run_id", "role", "repetition")
    development, holdout = records.filter("role = 'development' or repetition = 1"), records.filter("role = 'holdout' and repetition < 3")
    return run_records.combine_stages(development, holdout, view(spark, sf_dir, "plan"))[1]


def attempt_chain_violations(spark, sf_dir):
    rows = view(spark, sf_dir, "records").select("snapshot", "run_id", F.explode(F.sequence(F.lit(1), F.col("attempt"))).alias("attempt")).filter("not (snapshot = 'fixed' and attempt = 2)")
    rows = rows.withColumn("status", F.lit("timeout")).withColumn("retry_history", F.expr("case when attempt > 1 then transform(sequence(1, attempt - 1), a -> named_struct('attempt', a, 'status', 'timeout')) else cast(array() as array<struct<attempt:int,status:string>>) end"))
    return run_records.check_attempt_chain(rows)


PRICE = "select 'p' as provider, 'm' as model, cast(2.5 as decimal(14,6)) as input_rate, cast(0.25 as decimal(14,6)) as cached_rate, cast(15 as decimal(14,6)) as output_rate, cast(200000 as bigint) as threshold_input_tokens, cast(2 as decimal(10,4)) as input_multiplier, cast(1.5 as decimal(10,4)) as output_multiplier"


def _billed(spark, sf_dir):
    rows = view(spark, sf_dir, "records").selectExpr("*", "'p' as provider", "'m' as model", "case when run_no % 5 = 0 then cast(null as string) else 'v1' end as price_table_version", "case when run_no % 10 = 0 then cast(run_no % 100 as double) / 100 end as provider_cost_usd", "cast(case when run_no % 7 = 0 then 1 else 0 end as bigint) as retries")
    return rows


def run_costs(spark, sf_dir):
    rows = _billed(spark, sf_dir)
    out = cost.account_costs(rows, rows.filter("status <> 'succeeded'"), spark.sql(PRICE), "v1")
    return out.withColumn("known_cost", F.round(F.col("known_cost").cast("double"), 9))


def cost_totals(spark, sf_dir):
    rows = _billed(spark, sf_dir)
    out = cost.cost_totals(cost.account_costs(rows, rows.filter("status <> 'succeeded'"), spark.sql(PRICE), "v1"))
    return out.withColumns({"known_cost": F.round("known_cost", 6), "actual_cost": F.round("actual_cost", 6)})


def remaining_projection(spark, sf_dir):
    rows = _billed(spark, sf_dir)
    out = cost.project_remaining(rows.withColumn("attempts_started", F.lit(1)), rows.filter("status = 'succeeded'"), spark.sql(PRICE), 2000, 3, 0.1)
    return out.withColumn("projected_cost", F.round("projected_cost", 6))


def attempt_costs(spark, sf_dir):
    rows = _billed(spark, sf_dir)
    terminal = rows.select("experiment_id", "run_id", "provider", "model", F.col("attempt").alias("terminal_attempt"), "condition", "input_tokens", "cached_input_tokens", "output_tokens")
    attempts = terminal.withColumn("attempt", F.explode(F.sequence(F.lit(1), "terminal_attempt"))).filter("not (condition = 'candidate' and attempt = 2)").withColumn("provider_cost_usd", F.lit(None).cast("double"))
    out = cost.reconcile_attempt_costs(terminal.select("experiment_id", "run_id", "provider", "model", "terminal_attempt"), attempts, spark.sql(PRICE))
    return out.withColumn("known_cost", F.round("known_cost", 9))


def _attempted(spark, sf_dir):
    """Planned runs, terminal records of those that are finished, and attempt rows with faults."""
    rows = view(spark, sf_dir, "records").select("experiment_id", "run_id", "run_no", F.col("attempt").alias("last"), "latency_ms", "input_tokens").withColumns({"provider": F.lit("p"), "model": F.lit("m")})
    terminal = rows.filter("run_no % 13 <> 5").withColumn("terminal_attempt", F.col("last"))
    attempts = rows.withColumn("attempt", F.explode(F.expr("sequence(1, last + case when run_no % 41 = 7 then 1 else 0 end)")))
    attempts = attempts.filter("not (run_no % 17 = 3 and attempt = 2)").unionByName(attempts.filter("run_no % 43 = 9 and attempt = 1"))
    attempts = attempts.withColumns({
        "provider": F.expr("case when run_no % 47 = 11 then 'q' when run_no % 5 = 0 then 'unreported' else provider end"), "model": F.expr("case when run_no % 53 = 13 then 'x' else model end"),
        "run_id": F.expr("case when run_no % 59 = 17 then concat('z-', run_id) else run_id end"), "latency_ms": F.expr("latency_ms + case when run_no % 61 = 19 then 1 else 0 end"), "input_tokens": F.expr("case when run_no % 67 = 23 then null else input_tokens end"),
    })
    return rows.drop("last", "latency_ms", "input_tokens"), terminal, attempts


def attempt_metadata_violations(spark, sf_dir):
    plan, terminal, attempts = _attempted(spark, sf_dir)
    return cost.check_attempt_metadata(plan, terminal, attempts, ["experiment_id", "model"], ["latency_ms", "input_tokens"], 3, "p")


def accounted_attempts(spark, sf_dir):
    """Attempts that finished and unfinished runs must account for, and those that they don't."""
    plan, terminal, attempts = _attempted(spark, sf_dir)
    expected = cost.expected_attempts(plan, terminal, attempts)
    seen = attempts.select("run_id", "attempt").distinct()
    every = expected.select("run_id", "finished", "terminal_attempt", F.explode(F.sequence(F.lit(1), "terminal_attempt")).alias("attempt"))
    gone = every.join(seen, ["run_id", "attempt"], "left_anti").groupBy("run_id").agg(F.count("*").alias("missing"))
    return expected.join(gone, "run_id", "left").select("run_id", "finished", F.col("terminal_attempt").cast("long").alias("expected"), F.coalesce("missing", F.lit(0)).alias("missing"))


def _items(spark, sf_dir, got=None):
    """Items as stored by their ids; hashes are made from these again, as they take more room than all else."""
    got = got or base.inputs(spark, sf_dir)
    items = adjudication.packet_items(got["records"], got["findings"], got["mechanisms"], F.col("experiment_id")).select("experiment_id", "run_id", "finding_id", "mechanism_id")
    return stored(items, "items").withColumn("assignment_id", adjudication.assignment_id(F.col("experiment_id")))


def packet_items(spark, sf_dir):
    rows = adjudication.shuffle_and_calibrate(_items(spark, sf_dir), "experiment_id", F.col("experiment_id"), 40)
    return rows.select("experiment_id", "assignment_id", "run_id", "finding_id", "mechanism_id", "calibration")


def _decisions(items):
    """Primary decisions for most items, calibration for calibration items, resolutions for some disagreements; items are read once."""
    h = F.conv(F.substr("assignment_id", F.lit(1), F.lit(6)), 16, 10).cast("long")
    label = lambda x: F.element_at(F.array(*map(F.lit, ("match", "no_match", "uncertain", "symptom_only"))), ((x % 4) + 1).cast("int"))
    row = lambda role, cond, cls, resolves, hour: F.when(cond, F.struct(F.lit(role).alias("role"), F.concat(F.lit(f"{role}-"), "assignment_id").alias("decision_id"), cls.alias("classification"), F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hour)).alias("decided_at"), resolves.alias("resolves")))
    none, h_ = F.array().cast("array<string>"), F.col("h")
    rows = F.array(
        row("primary", h_ % 10 != 0, label(F.floor(h_ / 10)), none, 0),
        row("calibration", F.col("calibration") & (h_ % 8 != 1), label(F.floor(h_ / 10) + F.when(h_ % 3 == 0, 1).otherwise(0)), none, 1),
        row("resolution", F.col("calibration") & (h_ % 6 == 0) & (h_ % 10 != 0) & (h_ % 8 != 1), label(F.floor(h_ / 10)), F.array(F.concat(F.lit("primary-"), "assignment_id"), F.concat(F.lit("calibration-"), "assignment_id")), 2),
    )
    out = items.withColumn("h", h).select("experiment_id", "assignment_id", F.explode(F.array_compact(rows)).alias("d"))
    return out.select("experiment_id", "d.role", "d.decision_id", "assignment_id", "d.classification", "d.decided_at", F.lit(None).cast("string").alias("supersedes"), "d.resolves")


def _assigned(spark, sf_dir, got=None):
    items = adjudication.shuffle_and_calibrate(_items(spark, sf_dir, got), "experiment_id", F.col("experiment_id"), 400)
    return items, adjudication.by_assignment(items, adjudication.active_decisions(_decisions(items)))


def calibration_agreement(spark, sf_dir):
    """Agreement on the calibration items; of all decisions those on them go on."""
    items = adjudication.shuffle_and_calibrate(_items(spark, sf_dir), "experiment_id", F.col("experiment_id"), 400)
    chosen = stored(items.filter("calibration"), "calibration")
    active = adjudication.active_decisions(_decisions(items)).join(met(chosen.select("assignment_id")), "assignment_id", "left_semi")
    return adjudication.agreement(adjudication.by_assignment(chosen, active))


def derived_adjudications(spark, sf_dir):
    got = base.inputs(spark, sf_dir)
    items, joined = _assigned(spark, sf_dir, got)
    prior = scoring.current_adjudications(got["adjudications"])  # made of the findings that are stored already
    return adjudication.derive_adjudications(joined, prior).select("run_id", "finding_id", "expected_mechanism_id", "adjudication_id", "decision", "supersedes")


def decision_gaps(spark, sf_dir):
    return adjudication.check_decisions_complete(_assigned(spark, sf_dir)[1])


def decision_violations(spark, sf_dir):
    """Decisions, some with successors that do not fit: unknown targets, two for one, one without a later time."""
    items = adjudication.shuffle_and_calibrate(_items(spark, sf_dir), "experiment_id", F.col("experiment_id"), 400)
    h = F.when(F.col("role") == "primary", F.conv(F.substr("assignment_id", F.lit(1), F.lit(6)), 16, 10).cast("long") % 97)
    row = lambda name, target, at: F.struct(name.alias("decision_id"), target.alias("supersedes"), at.alias("decided_at"))
    after = lambda n, name, target, hours: F.when(h == n, row(F.concat(F.lit(f"{name}-"), "assignment_id"), target, F.col("decided_at") + F.expr(f"interval {hours} hours")))
    own = F.col("decision_id")
    versions = F.array(row(own, F.col("supersedes"), F.col("decided_at")), after(1, "u", F.lit("gone"), 1), after(2, "t", own, 0), after(3, "f", own, 1), after(3, "g", own, 1))
    rows = _decisions(items).withColumn("v", F.explode(F.array_compact(versions)))
    return adjudication.check_decisions(rows.select("experiment_id", "role", "v.decision_id", "assignment_id", "classification", "v.decided_at", "v.supersedes", "resolves"))


def discovery_summary(spark, sf_dir):
    s = base.scored(spark, sf_dir)
    out = discovery.discovery_summary(discovery.discovery_findings(s["scored_pairs"]), discovery.discovery_units(s["mechanism_outcomes"]))
    return out.withColumns({c: F.round(c, 10) for c in ("precision", "recall", "f1", "coverage")})


_ASSESSED = """select f.experiment_id, f.case_id, 'm1' as mechanism_id, condition, snapshot, l_suppkey,
  case when l_suppkey % 9 = 0 then 'uncertain' when l_suppkey % 3 = 1 then 'match' else 'no_match' end as mechanism_decision,
  case when l_suppkey % 9 = 0 then 'uncertain' when l_suppkey % 3 = 1 then case when snapshot = 'vulnerable' then 'valid' else 'false_positive' end when l_suppkey % 4 < 3 then 'valid' else 'false_positive' end as validity,
  case when l_suppkey % 9 = 0 then 'uncertain' when l_suppkey % 3 = 1 or l_suppkey % 5 < 3 then 'code' else 'documentation' end as issue_kind,
  case when l_suppkey % 9 <> 0 and l_suppkey % 3 <> 1 and l_suppkey % 4 < 3 then concat('g', cast(l_suppkey % 6 as string)) end as additional_issue_group
from findings f"""


def issue_discovery(spark, sf_dir):
    view(spark, sf_dir, "findings").createOrReplaceTempView("findings")
    out = discovery.issue_discovery(spark.sql(_ASSESSED))
    return out.withColumns({c: F.round(c, 10) for c in ("resolved_precision", "false_positive_rate")})


def raw_detection(spark, sf_dir):
    out = discovery.raw_detection(view(spark, sf_dir, "records"), view(spark, sf_dir, "findings"))
    return out.withColumns({c: F.round(c, 10) for c in ("precision", "recall", "f1")})


def corpus_table(spark, sf_dir):
    return report.corpus_table(view(spark, sf_dir, "cases"))


def public_breakdowns(spark, sf_dir):
    cells = view(spark, sf_dir, "cases").groupBy("experiment_id", "repository", "cat_a").agg(F.count("*").alias("cases"))
    return report.suppress_small_cells(cells, "cases", 5)


def report_violations(spark, sf_dir):
    """Tables of a report after some of their numbers were changed."""
    s = base.scored(spark, sf_dir)
    modes = stats.to_modes(s["scored_runs"])
    counts = stored(stats.outcome_counts(modes), "counts")
    effects = stats.differences(counts).withColumn("numerator", F.expr("numerator + case when mode = 'optimistic' and effect = 'net_useful_lift' then 1 else 0 end"))
    status = stats.status_counts(s["scored_runs"]).withColumn("n", F.expr("n + case when experiment_id = 'exp-1' and status = 'succeeded' then 1 else 0 end"))
    changed = counts.withColumn("positive", F.expr("positive + case when mode = 'pessimistic' and snapshot = 'fixed' and condition = 'baseline' then 1 else 0 end"))
    quality = stats.quality(s["scored_runs"], s["scored_findings"], s["scored_pairs"]).withColumn("unresolved", F.expr("unresolved + case when metric = 'path' and condition = 'all' then total else 0 end"))
    return report.check_report(changed, effects, stats.discordance(modes), status, quality)


def report_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of a report over the demonstration experiments."""
    got = base.inputs(spark, sf_dir)
    s, cases = base.stored_scores(got), view(spark, sf_dir, "cases")
    modes, tags = stats.to_modes(s["scored_runs"]), stats.case_tags(cases, got["mechanisms"], got["records"])
    billed = _billed(spark, sf_dir)
    got["findings"].createOrReplaceTempView("findings")
    tables = {
        "corpus": report.corpus_table(cases), "counts": stats.outcome_counts(modes), "discordance": stats.discordance(modes), "stability": stats.repetition_stability(s["scored_runs"]),
        "intervals": bootstrap.bootstrap_intervals(stats.case_effects(modes), "convolution"), "quality": stats.quality(s["scored_runs"], s["scored_findings"], s["scored_pairs"]),
        "operations": stats.distributions(got["records"]), "breakdown_counts": stats.breakdown_counts(modes, tags), "status": stats.status_counts(s["scored_runs"]),
        "runs": modes.groupBy("experiment_id", "mode").agg(F.count("*").alias("n")),
        "discovery": discovery.discovery_summary(discovery.discovery_findings(s["scored_pairs"]), discovery.discovery_units(s["mechanism_outcomes"])),
        "issues": discovery.issue_discovery(spark.sql(_ASSESSED)), "costs": cost.cost_totals(cost.account_costs(billed, billed.filter("status <> 'succeeded'"), spark.sql(PRICE), "v1")),
    }
    tables |= {"differences": stats.differences(tables["counts"]), "breakdowns": stats.differences(tables["breakdown_counts"], "dimension", "tag")}
    return base.stored_tables(tables)


def sound_report(spark, sf_dir):
    """Rows of each table of a report, and the constraints that they break."""
    tables = report_tables(spark, sf_dir)
    faults = constraints.check_constraints(tables).agg(F.count("*").alias("faults"))
    rows = reduce(DataFrame.union, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items() if name in ("corpus", "counts", "differences", "stability", "operations", "breakdown_counts", "breakdowns", "status")))
    return rows.crossJoin(F.broadcast(faults))


def report_constraints(spark, sf_dir):
    """Tables of a report after some of their numbers were changed, a change for each kind of constraint."""
    t = report_tables(spark, sf_dir)

    def change(table: str, where: str, **values: str) -> None:
        t[table] = t[table].withColumns({c: F.expr(f"case when {where} then {v} else {c} end") for c, v in values.items()})

    change("differences", "mode = 'optimistic' and effect = 'vulnerable_lift'", value="5.0")
    change("intervals", "mode = 'optimistic' and effect = 'net_useful_lift'", upper="lower - 0.5")
    t["intervals"] = t["intervals"].filter("not (experiment_id = 'exp-2' and mode = 'pessimistic')")
    change("stability", "snapshot = 'vulnerable' and condition = 'baseline'", complete_cases="complete_cases + 1")
    change("stability", "snapshot = 'fixed' and condition = 'candidate'", mean_variance="0.5")
    change("quality", "metric = 'category' and condition = 'baseline'", correct="total + 1")
    change("operations", "metric = 'latency_ms' and condition = 'all'", p95="max + 1")
    change("operations", "metric = 'output_tokens' and condition = 'candidate'", missing="missing + 1")
    change("operations", "metric = 'input_tokens' and condition = 'baseline'", mean="mean * 2")
    change("operations", "metric = 'cached_input_tokens' and condition = 'baseline'", median="null")
    change("discovery", "condition = 'baseline' and snapshot = 'fixed'", finding_unrelated="finding_unrelated + 1")
    change("discovery", "condition = 'candidate' and snapshot = 'vulnerable'", precision="2.0", coverage="2.0")
    change("issues", "condition = 'baseline' and snapshot = 'fixed'", known_instances="known_instances + 1")
    change("issues", "condition = 'candidate' and snapshot = 'fixed'", false_positive_rate="2.0")
    change("costs", "true", provider_usage_runs="completed_runs + 1")
    change("breakdown_counts", "dimension = 'repository' and tag = 'repo-11' and mode = 'optimistic' and snapshot = 'fixed' and condition = 'baseline'", negative="negative + 1", total="total + 1", value="5.0")
    t["status"] = t["status"].withColumn("n", F.expr("n + case when experiment_id = 'exp-1' and status = 'timeout' then 1 else 0 end"))
    return constraints.check_constraints(t)


def decisions(spark, sf_dir):
    """Decisions on experiments of which two are resolved, one by its optimistic and one by its pessimistic outcomes."""
    outcome = F.expr("case experiment_id when 'exp-0' then optimistic_outcome when 'exp-1' then pessimistic_outcome else primary_outcome end")
    runs = stored(base.scored(spark, sf_dir)["scored_runs"].withColumn("primary_outcome", outcome), "runs")
    modes = stats.to_modes(runs)
    bounds = bootstrap.bootstrap_intervals(stats.case_effects(modes), "convolution")
    return report.decide(runs, stats.differences(stats.outcome_counts(modes)), bounds)


def oracle() -> dict[str, str]:
    z = "chr(0)"
    plan, records, adj = with_views("plan"), with_views("records"), with_views("adjudications") + base._SCORED
    label = lambda x: f"(['match', 'no_match', 'uncertain', 'symptom_only'])[({x}) % 4 + 1]"
    h = lambda *parts: "sha256(" + f" || {z} || ".join(parts) + ")"
    rep = "repetition::varchar"
    price = "((input_tokens - cached_input_tokens) * 2.5 + cached_input_tokens * 0.25) * case when input_tokens > 200000 then 2 else 1 end + output_tokens * 15 * case when input_tokens > 200000 then 1.5 else 1 end"
    billed = records + f""", billed as (select *, case when run_no % 5 = 0 then null else 'v1' end as version, case when run_no % 10 = 0 then (run_no % 100)::double / 100 end as provider_cost, case when run_no % 7 = 0 then 1 else 0 end as retries,
        case when cached_input_tokens <= input_tokens and output_tokens is not null then ({price}) / 1e6 end as priced from records)"""
    costs = billed + """, doubled as (select * from billed union all select * from billed where status <> 'succeeded'), lines as (select *, case when version is null then provider_cost else priced end as cost, input_tokens is not null and cached_input_tokens is not null and output_tokens is not null as whole from doubled),
        runs_cost as (select experiment_id, run_id, count(*) as records, bool_and(whole) as complete_usage, round(sum(cost), 9) as known_cost, bool_or(cost is null) as unknown, sum(retries)::bigint as unaccounted_retries from lines group by all)"""
    ratio = lambda a, b: f"({a})::double / nullif({b}, 0)"
    f1 = lambda p, r: f"case when {p} = 0 and {r} = 0 then 0.0 else 2 * {p} * {r} / nullif({p} + {r}, 0) end"
    findings_class = """, fclass as (select experiment_id, condition, snapshot, run_id, finding_id, case when not bool_or(evaluation_role = 'supplemental' and expected_status <> 'unverified') then case when bool_or(evaluation_role = 'supplemental') then 'unverified' else 'unrelated' end
        when bool_or(evaluation_role = 'supplemental' and expected_status <> 'unverified' and disposition = 'unresolved') or (bool_or(evaluation_role = 'supplemental' and disposition = 'expected_match') and bool_or(evaluation_role = 'supplemental' and disposition in ('unexpected_claim', 'partial'))) then 'unresolved'
        when bool_or(evaluation_role = 'supplemental' and disposition = 'expected_match') then 'true_positive' when bool_or(evaluation_role = 'supplemental' and disposition in ('unexpected_claim', 'partial')) then 'false_positive' else 'unrelated' end as class
        from pairs where duplicate_of is null group by all),
      uclass as (select experiment_id, condition, snapshot, case_id, mechanism_id, case when expected_status = 'unverified' then 'unverified' when bool_or(classification = 'unresolved') then 'unresolved' when expected_status = 'present' then case when bool_or(classification = 'true_positive') then 'detected' else 'missed' end when bool_or(classification = 'false_positive') then 'unexpected' else 'clear' end as class
        from outcomes where evaluation_role = 'supplemental' group by experiment_id, condition, snapshot, case_id, mechanism_id, expected_status)"""
    many = lambda src, prefix, classes: f"select experiment_id, coalesce(condition, 'all') as condition, coalesce(snapshot, 'all') as snapshot, " + ", ".join(f"count(*) filter (class = '{c}') as {prefix}{c}" for c in classes) + f" from {src} group by grouping sets ((experiment_id), (experiment_id, condition, snapshot))"  # noqa: E731, F541
    decided = adj + f""", items as (select experiment_id, run_id, finding_id, mechanism_id, substr({h("experiment_id", "finding_id", "mechanism_id", "run_id")}, 1, 32) as assignment_id from pairs where expected_status <> 'unverified'),
      drawn as (select *, row_number() over (partition by experiment_id order by {h("experiment_id", "'adjudication-packet'", "assignment_id")}) <= 400 as calibration, ('0x' || substr(assignment_id, 1, 6))::bigint as h from items),
      decided as (select *, case when h % 10 <> 0 then {label('h // 10')} end as p, case when calibration and h % 8 <> 1 then {label('h // 10 + (h % 3 = 0)::int')} end as c, case when calibration and h % 6 = 0 and h % 10 <> 0 and h % 8 <> 1 then {label('h // 10')} end as r from drawn)"""
    issue = "case when validity = 'valid' then case when mechanism_decision = 'match' then 'known:' || case_id || ':m1' else issue_kind || ':' || case_id || ':' || additional_issue_group end end"
    return {
        "expanded_plan": plan + f""", hashed as (select experiment_id, case_id, snapshot, condition, repetition, {h("experiment_id", "'block'", "case_id", "snapshot", rep)} as bh, ('0x' || substr({h("experiment_id", "'orientation'", "case_id", "snapshot", rep)}, 1, 2))::bigint % 2 as odd from plan)
          select experiment_id, case_id, snapshot, condition, repetition, row_number() over (partition by experiment_id order by bh, case_id, snapshot, repetition, case when (odd = 0) = (condition = 'candidate') then 1 else 0 end) as plan_pos,
            'run-' || substr({h("'ns'", "case_id", "snapshot", "condition", rep)}, 1, 32) as run_id, ('0x' || substr({h("experiment_id", "'request'", "case_id", "snapshot", rep)}, 1, 16))::ubigint::varchar as request_seed from hashed""",
        "pair_violations": plan + " select 'incomplete' as rule, case_id || '/' || snapshot || '/' || repetition as key from plan where not (role = 'holdout' and condition = 'candidate' and repetition = 3) group by case_id, snapshot, repetition having count(*) <> 2",
        "plan_violations": plan + " select 'missing' as rule, concat_ws('/', case_id, snapshot, condition, repetition) as key from plan where role = 'holdout' and condition = 'candidate'",
        "plan_summary": records + " select experiment_id, count(distinct case_id) as cases, count(*) as runs, count(*) filter (estimated_input_tokens is null) as unestimated, sum(estimated_input_tokens)::bigint as estimated_input_tokens, count(*) * 3 as maximum_calls, count(*) * 3 * 10000 as maximum_input_tokens, count(*) * 3 * 2000 as maximum_output_tokens, round((count(*) * 3 * 10000 * 2.5 + count(*) * 3 * 2000 * 15.0) / 1e6 * 1.1, 6) as projected_cost_usd from records join cases using (experiment_id, case_id) where role <> 'holdout' group by experiment_id",
        "execution_summary": records + " select p.experiment_id, count(*) as planned, count(status) as terminal, count(*) filter (status = 'succeeded') as succeeded, count(*) filter (status <> 'succeeded') as failed, count(*) = count(status) as complete from plan p left join (select run_id, status from records where status <> 'provider_error') r using (run_id) group by 1",
        "experiment_digests": plan + """, lines as (select experiment_id, (row_number() over (partition by experiment_id order by run_no) - 1) // 4096 as part, run_no, sha256('{"run":"' || run_id || '","snapshot":"' || snapshot || '","condition":"' || condition || '"}') as line from plan),
          parts as (select experiment_id, part, sha256(string_agg(line, chr(10) order by run_no)) as line, count(*) as n from lines group by all)
          select experiment_id, 'sha256:' || case when count(*) = 1 then max(line) else sha256(string_agg(line, chr(10) order by part)) end as digest, sum(n)::bigint as n from parts group by all""",
        "case_digests": plan + """ select case_id, 'sha256:' || sha256(string_agg(sha256('{"run":"' || run_id || '","snapshot":"' || snapshot || '","condition":"' || condition || '"}'), chr(10) order by run_no)) as digest, count(*) as n from plan group by case_id""",
        "terminal_records": records + " select experiment_id, status, attempt, status in ('succeeded', 'configuration_error', 'adapter_error') or attempt >= 3 or status not in ('provider_error', 'timeout', 'invalid_output') as terminal, count(*) as n from records group by all",
        "completeness_violations": records + " select 'record_missing' as rule, run_id as key from plan where run_id not in (select run_id from records where status <> 'provider_error')",
        "identity_violations": records + " select 'condition' as rule, run_id as key from records where run_no % 101 = 7",
        "recovery_selection": records + " select experiment_id, run_id, case status when 'adapter_error' then 'output_limit' when 'invalid_output' then 'invalid_output' else 'provider' end as reason from records where status = 'adapter_error' or (status in ('invalid_output', 'provider_error') and attempt >= 3)",
        "recovery_overlay": records + " select run_id, case when status <> 'succeeded' and run_no % 2 = 0 then 'succeeded' else status end as status, case when status <> 'succeeded' and run_no % 2 = 0 then 9876.0 else latency_ms end as latency_ms, status <> 'succeeded' and run_no % 2 = 0 as recovered from records",
        "stage_violations": records + ", tagged as (select run_id, repetition, role from records join cases using (experiment_id, case_id)) select 'overlap' as rule, run_id as key from tagged where role = 'holdout' and repetition = 1 union all select 'uncovered', run_id from tagged where role = 'holdout' and repetition = 3",
        "attempt_chain_violations": records + " select rule, run_id, 3 as attempt from records cross join (values ('gap'), ('history')) as v(rule) where snapshot = 'fixed' and attempt = 3",
        "run_costs": costs + " select * from runs_cost",
        "cost_totals": costs + ", totals as (select experiment_id, count(*) as completed_runs, count(*) filter (complete_usage) as provider_usage_runs, count(*) filter (unknown) as unknown_runs, sum(unaccounted_retries)::bigint as unaccounted_retries, round(sum(known_cost), 6) as known_cost from runs_cost group by 1) select *, case when unknown_runs = 0 and unaccounted_retries = 0 then known_cost end as actual_cost from totals",
        "remaining_projection": records + ", open as (select experiment_id, estimated_input_tokens * 2.5 / 1e6 + 2000 * 15 / 1e6 as c from records where status <> 'succeeded') select experiment_id, count(*) as unfinished_runs, count(*) - count(c) as unpriced, case when count(*) = count(c) then round(sum(c * 2) * 1.1, 6) end as projected_cost from open group by 1",
        "attempt_metadata_violations": (attempted := with_views("records") + """, r as (select run_id, run_no, attempt as last, latency_ms, input_tokens, run_no % 13 <> 5 as done from records),
            s as (select *, unnest(range(1, last + 1 + case when run_no % 41 = 7 then 1 else 0 end)) as attempt from r), t as (select *, case when run_no % 59 = 17 then 'z-' else '' end || run_id as rid from s where not (run_no % 17 = 3 and attempt = 2)),
            a as (select * from t union all select * from t where run_no % 43 = 9 and attempt = 1)""") + """
          select 'duplicate' as rule, rid || '/' || attempt as key, count(*)::varchar as detail from a group by rid, attempt having count(*) > 1
          union all select 'foreign', rid || '/' || attempt, '' from a where run_no % 59 = 17 or run_no % 47 = 11 or run_no % 53 = 13
          union all select 'stale', rid || '/' || attempt, (case when done and run_no % 59 <> 17 then last else 3 end)::varchar from a where attempt > case when done and run_no % 59 <> 17 then last else 3 end
          union all select 'gap', rid, count(distinct attempt)::varchar from a where not done or run_no % 59 = 17 group by rid having max(attempt) - min(attempt) + 1 <> count(distinct attempt)
          union all select 'conflict', rid || '/' || attempt, 'latency_ms' from a where done and run_no % 59 <> 17 and attempt = last and run_no % 61 = 19
          union all select 'conflict', rid || '/' || attempt, 'input_tokens' from a where done and run_no % 59 <> 17 and attempt = last and run_no % 67 = 23 and input_tokens is not null""",
        "accounted_attempts": attempted + """, own as (select run_id, max(attempt) as latest, count(distinct attempt) as n from a where run_no % 59 <> 17 group by 1),
            e as (select r.run_id, done, case when done then last else latest end as expected, last, run_no, latest from r left join own using (run_id))
          select run_id, done as finished, expected::bigint as expected, expected - (select count(distinct attempt) from a where a.rid = e.run_id and a.attempt <= e.expected) as missing from e where expected >= 1""",
        "attempt_costs": billed + ", spread as (select *, unnest(range(1, attempt + 1)) as a from billed) select experiment_id, run_id, count(*) as expected, count(*) filter (condition = 'candidate' and a = 2) as missing, count(*) filter (condition = 'candidate' and a = 2 and a < attempt) as missing_retries, round(sum(priced) filter (not (condition = 'candidate' and a = 2)), 9) as known_cost, bool_or(priced is null or condition = 'candidate' and a = 2) as unknown from spread group by all",
        "packet_items": adj + f""", items as (select experiment_id, run_id, finding_id, mechanism_id, substr({h("experiment_id", "finding_id", "mechanism_id", "run_id")}, 1, 32) as assignment_id from pairs where expected_status <> 'unverified')
          select experiment_id, assignment_id, run_id, finding_id, mechanism_id, row_number() over (partition by experiment_id order by {h("experiment_id", "'adjudication-packet'", "assignment_id")}) <= 40 as calibration from items""",
        "discovery_summary": adj + findings_class + f", f as ({many('fclass', 'finding_', ('true_positive', 'false_positive', 'unrelated', 'unverified', 'unresolved'))}), u as ({many('uclass', 'unit_', ('detected', 'missed', 'unexpected', 'clear', 'unverified', 'unresolved'))})"
        + f", pr as (select *, {ratio('finding_true_positive', 'finding_true_positive + finding_false_positive')} as p, {ratio('unit_detected', 'unit_detected + unit_missed')} as r, {ratio('unit_detected + unit_missed + unit_unexpected + unit_clear', 'unit_detected + unit_missed + unit_unexpected + unit_clear + unit_unresolved')} as cv from f full join u using (experiment_id, condition, snapshot)) select * exclude (p, r, cv), round(p, 10) as precision, round(r, 10) as recall, round({f1('p', 'r')}, 10) as f1, round(cv, 10) as coverage from pr",
        "issue_discovery": with_views("findings") + f""", assessed as ({_ASSESSED}), keyed as (select *, {issue} as key from assessed)
          select *, round(valid_instances::double / nullif(total_findings - uncertain, 0), 10) as resolved_precision, round(false_positives::double / nullif(total_findings - uncertain, 0), 10) as false_positive_rate from (
          select experiment_id, coalesce(condition, 'all') as condition, coalesce(snapshot, 'all') as snapshot, count(*) as total_findings, count(*) filter (validity = 'valid') as valid_instances, count(*) filter (validity = 'valid' and mechanism_decision = 'match') as known_instances, count(*) filter (validity = 'valid' and mechanism_decision <> 'match') as additional_instances,
            count(*) filter (validity = 'false_positive') as false_positives, count(*) filter (validity = 'false_positive' and mechanism_decision = 'match' and snapshot = 'fixed') as repaired_false_positives, count(*) filter (issue_kind = 'code') as code_findings, count(*) filter (validity = 'uncertain') as uncertain, count(distinct key) as distinct_valid, count(distinct key) filter (mechanism_decision = 'match') as distinct_known
          from keyed group by grouping sets ((experiment_id), (experiment_id, condition, snapshot)))""",
        "raw_detection": with_views("findings") + f""", hit as (select r.*, run_id in (select run_id from findings) as hit from records r), c as (select experiment_id, coalesce(condition, 'all') as condition, count(*) filter (snapshot = 'vulnerable' and hit) as tp, count(*) filter (snapshot = 'fixed' and hit) as fp, count(*) filter (snapshot = 'vulnerable' and not hit) as fn, count(*) filter (snapshot = 'fixed' and not hit) as tn from hit group by grouping sets ((experiment_id), (experiment_id, condition))),
          pr as (select *, {ratio('tp', 'tp + fp')} as p, {ratio('tp', 'tp + fn')} as r from c) select experiment_id, condition, tp, fp, fn, tn, round(p, 10) as precision, round(r, 10) as recall, round({f1('p', 'r')}, 10) as f1 from pr""",
        "corpus_table": with_views("cases") + " select experiment_id, coalesce(role, 'all') as role, count(*) as cases, count(distinct repository) as repositories from cases group by grouping sets ((experiment_id), (experiment_id, role))",
        "public_breakdowns": with_views("cases") + " select experiment_id, repository, cat_a, count(*) as cases from cases group by all having count(*) >= 5",
        "report_violations": adj + f""", counts as (select experiment_id, mode, snapshot, condition, {base._COUNTS} from modes group by all), bad as (select * from counts where mode = 'pessimistic' and snapshot = 'fixed' and condition = 'baseline')
          select 'parts' as rule, concat_ws('/', experiment_id, mode, snapshot, condition) as key from bad union all select 'value', concat_ws('/', experiment_id, mode, snapshot, condition) from bad where unresolved = 0
          union all select 'effect', experiment_id || '/pessimistic/fixed_false_positive_increase' from bad union all select 'discordance', experiment_id || '/pessimistic/fixed' from bad where (select sum(unresolved) from counts c where c.experiment_id = bad.experiment_id and mode = 'pessimistic' and snapshot = 'fixed') = 0
          union all select 'net', experiment_id || '/optimistic' from bad union all select * from (values ('status', 'exp-1'), ('valid_output', 'exp-1')) where exists (select 1 from bad where experiment_id = 'exp-1')
          union all select 'quality', experiment_id || '/all/path' from bad where exists (select 1 from found f where f.experiment_id = bad.experiment_id and duplicate_of is null and path_match <> 'none')""",
        "decisions": adj + """, r as (select *, case experiment_id when 'exp-0' then optimistic_outcome when 'exp-1' then pessimistic_outcome else primary_outcome end as o, case condition when 'candidate' then 1 else -1 end as s from runs),
          lifts as (select experiment_id, count(*) filter (lift > 0) as positive_strata from (select experiment_id, repetition, sum(o::int * s) as lift from r where snapshot = 'vulnerable' group by all) group by 1),
          t as (select experiment_id, count(*) filter (o is null) as unresolved, bool_and(status = 'succeeded') as good, sum(o::int * s) filter (snapshot = 'vulnerable')::bigint as lift, sum(o::int * s) filter (snapshot = 'fixed')::bigint as rise from r group by 1)
          select experiment_id, unresolved, positive_strata, lift - rise as net, rise, case when unresolved > 0 then 'insufficient_evidence' when lift - rise <= 0 or rise > 0 then 'reject' when not good then 'revise' end as decision from t join lifts using (experiment_id)""",
        "sound_report": adj + """, t as (select experiment_id, count(*) as n from cases group by all), tags as (select count(distinct (experiment_id, repository)) as r from cases),
          """ + base.breakdown_tags() + """ select *, 0::bigint as faults from (select 'corpus' as table_name, (select count(*) from t) + (select count(distinct (experiment_id, role)) from cases) as n union all select 'counts', count(*) * 12 from t union all select 'differences', count(*) * 9 from t union all select 'stability', count(*) * 4 from t union all select 'operations', count(*) * 18 from t
            union all select 'status', count(*) * 6 from t union all select 'breakdown_counts', count(*) * 12 from tagged_experiments union all select 'breakdowns', count(*) * 9 from tagged_experiments)""",
        "report_constraints": with_views("cases") + """, e as (select distinct experiment_id from cases)
          select rule, case when k = '' then experiment_id else experiment_id || '/' || k end as key from e cross join (values ('differences/value', 'optimistic/vulnerable_lift'), ('intervals/order', 'optimistic/net_useful_lift'), ('stable_cases', ''), ('stability/variance', 'fixed/candidate'), ('quality/parts', 'baseline/category'), ('quality/value', 'baseline/category'), ('quality/totals', 'category'), ('operations/order', 'all/latency_ms'), ('operations/totals', 'output_tokens'), ('operations/mean', 'baseline/input_tokens'), ('operations/present', 'baseline/cached_input_tokens'), ('operations/order', 'baseline/cached_input_tokens'), ('discovery/totals', ''), ('discovery/precision', 'candidate/vulnerable'), ('discovery/coverage', 'candidate/vulnerable'), ('issues/valid', 'baseline/fixed'), ('issues/totals', ''), ('issues/rate', 'candidate/fixed'), ('costs/usage', '')) as v(rule, k)
          union all select 'interval_present', 'exp-2/pessimistic' from e where experiment_id = 'exp-2' union all select unnest(['runs_observed', 'cost_runs']), experiment_id from e where experiment_id = 'exp-1'
          union all select 'breakdown_counts/value', experiment_id || '/repository/repo-11/optimistic/fixed/baseline' from (select distinct experiment_id from cases where repository = 'repo-11')
          union all select 'breakdown_repository', experiment_id || '/optimistic/fixed/baseline' from (select distinct experiment_id from cases where repository = 'repo-11')""",
        "decision_violations": decided + """, pri as (select *, h % 97 as k from decided where p is not null) select 'unknown_target' as rule, 'u-' || assignment_id as key from pri where k = 1 union all select 'time', 't-' || assignment_id from pri where k = 2 union all select 'fork', 'primary-' || assignment_id from pri where k = 3 union all select 'chain', 'primary/' || assignment_id from pri where k in (1, 3) union all select 'fork', 'gone' from pri where k = 1 having count(*) > 1""",
        "decision_gaps": decided + """ select case when p is null then 'no_primary' when calibration and c is null then 'no_calibration' else 'unresolved' end as rule, assignment_id as key from decided where p is null or (calibration and (c is null or (p <> c and r is null)))""",
        "calibration_agreement": decided + """ select count(*) filter (p is not null and c is not null) as completed, count(*) filter (p = c) as agreements, count(*) filter (p <> c) as disagreements, count(*) filter (p <> c and r is null) as unresolved, round(count(*) filter (p = c) / nullif(count(*) filter (p is not null and c is not null), 0), 10) as rate from decided where calibration""",
        "derived_adjudications": decided + f""", chosen as (select *, case when not calibration then p when p is not null and r is not null then r when p is not null and c is not null then case when p = c then p else 'uncertain' end end as class,
            case when not calibration then 'primary-' || assignment_id when r is not null and p is not null then 'calibration-' || assignment_id || ',primary-' || assignment_id || ',resolution-' || assignment_id else 'calibration-' || assignment_id || ',primary-' || assignment_id end as sources from decided),
          named as (select run_id, finding_id, mechanism_id as expected_mechanism_id, 'adjudication-' || substr({h("assignment_id", "class", "sources")}, 1, 32) as adjudication_id, case when class in ('symptom_only', 'incorrect_cause') then 'no_match' else class end as decision from chosen where class is not null)
          select n.*, l.adjudication_id as supersedes from named n left join live l using (run_id, finding_id, expected_mechanism_id) where l.adjudication_id is null or l.adjudication_id <> n.adjudication_id""",
    }


QUERIES = {f.__name__: f for f in (expanded_plan, plan_violations, pair_violations, plan_summary, execution_summary, case_digests, experiment_digests, terminal_records, completeness_violations, identity_violations, recovery_selection, recovery_overlay, stage_violations, attempt_chain_violations, run_costs, cost_totals, remaining_projection, attempt_costs, attempt_metadata_violations, accounted_attempts, packet_items, calibration_agreement, derived_adjudications, decision_gaps, decision_violations, discovery_summary, issue_discovery, raw_detection, corpus_table, public_breakdowns, report_violations, report_constraints, sound_report, decisions)}
ORACLE_SQL = oracle()
