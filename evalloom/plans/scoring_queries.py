"""Queries of scoring and statistics over the demonstration views, with their SQL."""

from __future__ import annotations

import uuid
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators import analysis, bootstrap, run_records, scoring, stats
from evalloom.plans.demo import view, with_views
from evalloom.sources import scored_store
from evalloom.sources.scratch import shared_dir, stored


def inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Inputs of scoring; findings are written first, as adjudications are made from them twice."""
    got = {n: view(spark, sf_dir, n) for n in ("records", "mechanisms", "locations")}
    findings = stored(view(spark, sf_dir, "findings"), "findings")
    got["adjudications"] = view(spark, sf_dir, "adjudications", {"findings": findings})
    got["findings"] = findings.withColumn("evidence", F.array(F.struct(F.lit("file").alias("source_type"), F.col("reference").alias("reference")))).drop("reference")
    got["mechanisms"] = got["mechanisms"].withColumn("categories", F.array("cat_a", "cat_b")).drop("cat_a", "cat_b")
    got["locations"] = got["locations"].withColumn("aliases", F.when(F.col("alias").isNotNull(), F.array("alias")).otherwise(F.array().cast("array<string>"))).drop("alias")
    return got


def evidence(got: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Inputs without what only the views need: scoring moves and writes all columns of a finding but its texts."""
    return got | {"findings": got["findings"].drop("l_suppkey")}


def scored(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return scoring.score_experiment(**evidence(inputs(spark, sf_dir)))


def modes(spark, sf_dir):
    return stats.to_modes(scored(spark, sf_dir)["scored_runs"])


def scored_pairs(spark, sf_dir):
    return scored(spark, sf_dir)["scored_pairs"].select("run_id", "finding_id", "mechanism_id", "duplicate_of", "path_match", "accepted_path", "location_match", "category_match", "severity_match", "decision", "disposition")


def scored_findings(spark, sf_dir):
    return scored(spark, sf_dir)["scored_findings"].select("run_id", "finding_id", "duplicate_of", "path_match", "location_match", "category_match", "severity_match", "disposition")


def mechanism_outcomes(spark, sf_dir):
    return scored(spark, sf_dir)["mechanism_outcomes"].select("run_id", "mechanism_id", "expected_status", "classification")


def run_outcomes(spark, sf_dir):
    return scored(spark, sf_dir)["scored_runs"].select("experiment_id", "run_id", "status", "primary_outcome", "pessimistic_outcome", "optimistic_outcome")


def current_adjudications(spark, sf_dir):
    return scoring.current_adjudications(view(spark, sf_dir, "adjudications")).select("adjudication_id", "run_id", "decision")


def adjudication_violations(spark, sf_dir):
    return scoring.check_adjudications(view(spark, sf_dir, "planted_adjudications"))


def scoring_gates(spark, sf_dir):
    """All gates before scoring, over inputs with faults. Each input is written first: the gates read it many times, and as plans they don't fit the driver."""
    findings = stored(view(spark, sf_dir, "findings").select("run_id", "finding_id", "case_id", "snapshot", "l_suppkey"), "findings")
    log = stored(view(spark, sf_dir, "planted_adjudications", {"findings": findings}), "log")
    plan, records, gold, mechanisms = (stored(view(spark, sf_dir, n), n) for n in ("plan", "planted_records", "planted_gold", "mechanisms"))
    terminal = run_records.is_terminal(3, ("provider_error", "timeout", "invalid_output"))
    return scoring.check_experiment(plan, records, gold, findings, mechanisms, log, ["case_id", "snapshot", "condition", "repetition"], terminal)


def scored_violations(spark, sf_dir):
    """Scored tables after some of their values were changed; they are written before, as the checks read each of them many times."""
    s = stored_scores(inputs(spark, sf_dir))
    n = "cast(substr(run_id, 5) as bigint)"
    change = lambda table, column, value: {table: s[table].withColumn(column, F.expr(value))}
    s |= change("scored_pairs", "accepted_path", f"case when {n} % 13 = 0 then null else accepted_path end")
    s |= change("scored_findings", "disposition", f"case when {n} % 11 = 0 and disposition = 'partial' then 'unmatched' else disposition end")
    s |= change("scored_pairs", "disposition", f"case when {n} % 23 = 0 and disposition = 'unmatched' then 'partial' else disposition end")
    s |= change("scored_findings", "duplicate_of", f"case when {n} % 37 = 0 and duplicate_of is not null then 'F0' else duplicate_of end")
    s |= change("mechanism_outcomes", "classification", f"case when {n} % 19 = 0 and evaluation_role = 'supplemental' and classification = 'true_negative' then 'unverified' else classification end")
    s |= change("mechanism_outcomes", "evaluation_role", f"case when {n} % 29 = 0 and evaluation_role = 'supplemental' or {n} % 43 = 0 and evaluation_role = 'primary' then 'other' else evaluation_role end")
    s["mechanism_outcomes"] = s["mechanism_outcomes"].filter(f"not ({n} % 41 = 0 and mechanism_id = 'm2')")
    s |= change("scored_runs", "optimistic_outcome", f"case when status = 'succeeded' and {n} % 17 = 0 then not optimistic_outcome else optimistic_outcome end")
    s |= change("scored_runs", "primary_outcome", f"case when status <> 'succeeded' and {n} % 2 = 0 then true else primary_outcome end")
    return scoring.check_scored(s)


def outcome_counts(spark, sf_dir):
    return stats.outcome_counts(modes(spark, sf_dir)).withColumn("value", F.round("value", 10))


def paired_result(spark, sf_dir):
    return stats.differences(stats.outcome_counts(modes(spark, sf_dir))).withColumn("value", F.round("value", 10))


def discordance(spark, sf_dir):
    return stats.discordance(modes(spark, sf_dir))


def case_effects(spark, sf_dir):
    return stats.case_effects(modes(spark, sf_dir)).select("experiment_id", "mode", "case_id", *((F.round(e, 10) + F.lit(0.0)).alias(e) for e in bootstrap.EFFECTS))


def bootstrap_hash(spark, sf_dir):
    return bootstrap.bootstrap_intervals(stats.case_effects(modes(spark, sf_dir)), "hash", resamples=100, seed=7)


def bootstrap_multinomial(spark, sf_dir):
    return bootstrap.bootstrap_intervals(stats.case_effects(modes(spark, sf_dir)), "multinomial")


def bootstrap_convolution(spark, sf_dir):
    """Intervals of infinitely many resamples."""
    found = bootstrap.bootstrap_intervals(stats.case_effects(modes(spark, sf_dir)), "convolution")
    return found.select("experiment_id", "mode", "effect", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


def result_digests(spark, sf_dir):
    return scoring.result_digests(scored(spark, sf_dir)).withColumn("n", F.col("n").cast("long"))


def stored_store(spark: SparkSession, sf_dir: str) -> str:
    """A store of two experiments, written one after the other; the first is then written again, after a version without its failed runs."""
    tables, path = stored_scores(inputs(spark, sf_dir)), f"{shared_dir(spark)}/evalloom/store-{uuid.uuid4().hex}"
    of = lambda e, where="true": {n: df.filter(F.col("experiment_id") == e).filter(where if n == "scored_runs" else "true") for n, df in tables.items()}
    for part in (of("exp-0", "status = 'succeeded'"), of("exp-1"), of("exp-0")):
        scored_store.write_scored(part, path)
    return path


def stored_runs(spark, sf_dir):
    """Runs of the experiments of a store."""
    return scored_store.read_scored(spark, stored_store(spark, sf_dir), "scored_runs").select("experiment_id", "run_id", "status", "primary_outcome")


def stored_entries(spark, sf_dir):
    """What a store's manifest says, and whether the files agree with it."""
    path = stored_store(spark, sf_dir)
    faults = scored_store.check_store(spark, path).groupBy("table", "experiment_id").agg(F.count("*").alias("faults"))
    rows = scored_store.manifest(spark, path).join(faults, ["table", "experiment_id"], "left")
    return rows.select(F.col("table").alias("table_name"), "experiment_id", "rows", F.coalesce("faults", F.lit(0)).alias("faults"))


def repetition_stability(spark, sf_dir):
    return stats.repetition_stability(scored(spark, sf_dir)["scored_runs"]).withColumn("mean_variance", F.round("mean_variance", 10))


def cell_violations(spark, sf_dir):
    """Runs of which some are left out."""
    return stats.check_cells(view(spark, sf_dir, "records").filter("run_no % 101 <> 3 and not (snapshot = 'fixed' and condition = 'candidate' and run_no % 97 < 6)"), 3)


def combined_outcomes(spark, sf_dir):
    """Outcomes of two stages that are scored together."""
    got = inputs(spark, sf_dir)
    records = got.pop("records").join(view(spark, sf_dir, "cases").select("case_id", "role"), "case_id")
    out = analysis.score_combined(records.filter("role = 'development'").drop("role"), records.filter("role = 'holdout'").drop("role"), view(spark, sf_dir, "plan"), **evidence(got))
    return out["scored_runs"].select("run_id", "primary_outcome").join(out["violations"].agg(F.count("*").alias("violations")))


#: Tables of the statistics: the query that shows one by itself, what names its rows, and its measures.
STATISTICS = {
    "outcome_counts": ("outcome_counts", ("experiment_id", "mode", "snapshot", "condition"), ("positive", "negative", "unresolved", "total", "value")),
    "differences": ("paired_result", ("experiment_id", "mode", "effect"), ("numerator", "denominator", "unresolved", "value")),
    "discordance": ("discordance", ("experiment_id", "mode", "snapshot"), ("both", "candidate_only", "baseline_only", "neither", "unresolved")),
    "case_effects": ("case_effects", ("experiment_id", "mode", "case_id"), bootstrap.EFFECTS),
    "intervals": ("bootstrap_convolution", ("experiment_id", "mode", "effect"), ("lower", "upper")),
    "cr1": ("cr1_bounds", ("experiment_id", "mode", "effect"), ("cases", "projects", "unresolved", "mean", "standard_error", "lower", "upper")),
    "stability": ("repetition_stability", ("experiment_id", "snapshot", "condition"), ("complete_cases", "unresolved_cases", "discordant_cases", "mean_variance")),
    "quality": ("quality_rates", ("experiment_id", "condition", "metric"), ("correct", "unresolved", "total", "value")),
    "distributions": ("operation_distributions", ("experiment_id", "condition", "metric"), ("observations", "missing", "min", "median", "p95", "max", "mean", "total")),
    "breakdown_counts": ("breakdown_counts", ("experiment_id", "dimension", "tag", "mode", "snapshot", "condition"), ("positive", "negative", "unresolved", "total", "value")),
    "breakdowns": ("breakdowns", ("experiment_id", "dimension", "tag", "mode", "effect"), ("numerator", "denominator", "unresolved", "value")),
    "breakdown_discordance": ("breakdown_discordance", ("experiment_id", "dimension", "tag", "mode", "snapshot"), ("both", "candidate_only", "baseline_only", "neither", "unresolved")),
    "status_counts": ("status_counts", ("experiment_id", "status"), ("n",)),
}


def statistics_tables(spark, sf_dir):
    """All tables of the statistics, with every value: table_name, key, measure, value (rounded, null where it is suppressed)."""
    got = inputs(spark, sf_dir)
    tables = analysis.calculate_statistics(stored_scores(got), got["records"], view(spark, sf_dir, "cases"), got["mechanisms"], 3)
    long = lambda key, names: F.inline(F.array(*(F.struct(F.concat_ws("/", *key).alias("key"), F.lit(m).alias("measure"), (F.round(F.col(m).cast("double"), 6) + F.lit(0.0)).alias("value")) for m in names)))
    parts = [tables[t].select(F.lit(t).alias("table_name"), long(key, names)) for t, (_, key, names) in STATISTICS.items()]
    return reduce(DataFrame.union, parts)


def stored_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: stored(df, name) for name, df in tables.items()}


def stored_scores(got: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Scored tables of the inputs, written; the pairs are already, when they come from scoring."""
    tables = scoring.score_experiment(**evidence(got))
    pairs = {"scored_pairs": tables.pop("scored_pairs")}
    return pairs | stored_tables(tables)


def breakdown_counts(spark, sf_dir):
    """Outcome counts by tag."""
    got = inputs(spark, sf_dir)
    tags = stats.case_tags(view(spark, sf_dir, "cases"), got["mechanisms"], got["records"])
    return stats.breakdown_counts(modes_of(got), tags).withColumn("value", F.round("value", 10))


def breakdown_discordance(spark, sf_dir):
    """Discordance by tag."""
    got = inputs(spark, sf_dir)
    return stats.breakdown_discordance(modes_of(got), stats.case_tags(view(spark, sf_dir, "cases"), got["mechanisms"], got["records"]))


def modes_of(got: dict[str, DataFrame]) -> DataFrame:
    return stats.to_modes(scoring.score_experiment(**evidence(got))["scored_runs"])


def quality_rates(spark, sf_dir):
    s = scored(spark, sf_dir)
    return stats.quality(s["scored_runs"], s["scored_findings"], s["scored_pairs"]).withColumn("value", F.round("value", 10))


def operation_distributions(spark, sf_dir):
    rows = stats.distributions(view(spark, sf_dir, "records"))
    return rows.select("experiment_id", "condition", "metric", "observations", "missing", *(F.round(c, 6).alias(c) for c in ("min", "median", "p95", "max", "mean", "total")))


def breakdowns(spark, sf_dir):
    got = inputs(spark, sf_dir)
    tags = stats.case_tags(view(spark, sf_dir, "cases"), got["mechanisms"], got["records"])
    return stats.breakdowns(modes_of(got), tags).withColumn("value", F.round("value", 10))


def status_counts(spark, sf_dir):
    return stats.status_counts(view(spark, sf_dir, "records"))


def cr1_bounds(spark, sf_dir):
    effects = stats.case_effects(modes(spark, sf_dir))
    projects = view(spark, sf_dir, "cases").select("case_id", F.col("repository").alias("project"))
    rows = stats.cr1_bounds(effects, projects)
    return rows.select("experiment_id", "mode", "effect", "cases", "projects", "unresolved", *(F.round(c, 9).alias(c) for c in ("mean", "standard_error", "lower", "upper")))


_SCORED = """,
marked as materialized (select *, min(finding_id) over (partition by run_id, title, explanation, file_path, start_line, end_line, severity, defect_category, failure_mechanism, confidence, reference) as first_id from findings),
live as materialized (select * from adjudications a where not exists (select 1 from adjudications b where b.supersedes = a.adjudication_id)),
loc as (select case_id, mechanism_id, loc_pos, path as file_path, path as accepted, 0 as kind, start_line as ls, end_line as le from locations
  union all select case_id, mechanism_id, loc_pos, alias, path, 1, start_line, end_line from locations where alias is not null),
crossed as materialized (select f.*, case when first_id <> finding_id then first_id end as duplicate_of, m.mechanism_id, evaluation_role, cat_a, cat_b, severity_min, severity_max,
    case when snapshot = 'vulnerable' then expect_vulnerable else expect_fixed end as expected_status from marked f join mechanisms m on m.case_id = f.case_id),
hits as materialized (select c.run_id, c.finding_id, c.mechanism_id, accepted, kind, loc_pos,
    case when ls is null then true when c.start_line is null then false else c.start_line <= coalesce(le, ls) and coalesce(c.end_line, c.start_line) >= ls end as hit
  from crossed c join loc on loc.case_id = c.case_id and loc.mechanism_id = c.mechanism_id and loc.file_path = c.file_path),
best as materialized (select * from (select *, row_number() over (partition by run_id, finding_id, mechanism_id order by kind, case when hit then 0 else 1 end, loc_pos) as rn from hits) where rn = 1),
checked as (select c.*, case when b.kind is null then 'none' when b.kind = 0 then 'exact' else 'alias' end as path_match, accepted as accepted_path, coalesce(hit, false) as location_match,
    defect_category in (cat_a, cat_b) as category_match,
    list_position(['low','medium','high','critical'], severity) between list_position(['low','medium','high','critical'], severity_min) and list_position(['low','medium','high','critical'], severity_max) as severity_match,
    coalesce(l.decision, 'unadjudicated') as decision
  from crossed c left join best b using (run_id, finding_id, mechanism_id) left join live l on l.run_id = c.run_id and l.finding_id = c.finding_id and l.expected_mechanism_id = c.mechanism_id),
pairs as (select *, path_match <> 'none' and location_match and category_match and severity_match as ok,
    case when expected_status = 'unverified' then 'unscored' when decision in ('uncertain', 'unadjudicated') then 'unresolved'
      when expected_status = 'absent' then case when decision = 'match' then 'unexpected_claim' else 'unrelated' end
      when decision <> 'match' then 'unmatched' when path_match <> 'none' and location_match and category_match and severity_match then 'expected_match' else 'partial' end as disposition from checked),
found as (select *, case when duplicate_of is not null then 'duplicate' when decision = 'match' and snapshot = 'fixed' then 'repaired_mechanism_claim' when decision = 'match' and ok then 'matched'
      when snapshot = 'fixed' and decision = 'no_match' and not ok then 'unrelated' when path_match <> 'none' or location_match or category_match or severity_match or decision = 'match' then 'partial' else 'unmatched' end as finding_disposition
  from pairs where evaluation_role = 'primary'),
outcomes as (select r.experiment_id, r.run_id, r.case_id, r.snapshot, r.condition, r.repetition, r.status, m.mechanism_id, m.evaluation_role,
    case when r.snapshot = 'vulnerable' then expect_vulnerable else expect_fixed end as expected_status,
    case when case when r.snapshot = 'vulnerable' then expect_vulnerable else expect_fixed end = 'unverified' then 'unverified' when status <> 'succeeded' then 'unresolved'
      when case when r.snapshot = 'vulnerable' then expect_vulnerable else expect_fixed end = 'present'
        then case when coalesce(bool_or(p.disposition = 'expected_match'), false) then 'true_positive' when coalesce(bool_or(p.disposition = 'unresolved'), false) then 'unresolved' else 'false_negative' end
      else case when coalesce(bool_or(p.disposition = 'unexpected_claim'), false) then 'false_positive' when coalesce(bool_or(p.disposition = 'unresolved'), false) then 'unresolved' else 'true_negative' end end as classification
  from records r join mechanisms m on m.case_id = r.case_id left join (select * from pairs where duplicate_of is null) p on p.run_id = r.run_id and p.mechanism_id = m.mechanism_id
  group by r.experiment_id, r.run_id, r.case_id, r.snapshot, r.condition, r.repetition, r.status, m.mechanism_id, m.evaluation_role, expect_vulnerable, expect_fixed),
runs as (select experiment_id, run_id, case_id, snapshot, condition, repetition, status, o as primary_outcome, coalesce(o, snapshot = 'fixed') as pessimistic_outcome, coalesce(o, snapshot = 'vulnerable') as optimistic_outcome
  from (select *, case classification when 'unresolved' then null else classification in ('true_positive', 'false_positive') end as o from outcomes where evaluation_role = 'primary')),
modes as (select *, 'primary' as mode, primary_outcome as outcome from runs union all select *, 'pessimistic', pessimistic_outcome from runs union all select *, 'optimistic', optimistic_outcome from runs)"""

_COUNTS = """count(*) filter (outcome) as positive, count(*) filter (not outcome) as negative, count(*) filter (outcome is null) as unresolved, count(*) as total"""


def _differences(by: str, source: str) -> str:
    cell = lambda s, c, what: f"count(*) filter (snapshot = '{s}' and condition = '{c}'{what})"
    pos, opened = " and outcome", " and outcome is null"
    lift = f"{cell('vulnerable', 'candidate', pos)} - {cell('vulnerable', 'baseline', pos)}"
    rise = f"{cell('fixed', 'candidate', pos)} - {cell('fixed', 'baseline', pos)}"
    ov, of = f"count(*) filter (snapshot = 'vulnerable'{opened})", f"count(*) filter (snapshot = 'fixed'{opened})"
    row = lambda name, n, d, u: f"select {by}, mode, '{name}' as effect, {n} as numerator, {d} as denominator, {u} as unresolved from {source} group by {by}, mode"
    vb, fb = cell("vulnerable", "baseline", ""), cell("fixed", "baseline", "")
    parts = [row("vulnerable_lift", lift, vb, ov), row("fixed_false_positive_increase", rise, fb, of), row("net_useful_lift", f"({lift}) - ({rise})", vb, f"{ov} + {of}")]
    return "select *, case when unresolved = 0 then round(numerator / nullif(denominator, 0), 10) end as value from (" + " union all ".join(parts) + ")"


_EFFECTS = """,
cells as (select experiment_id, mode, case_id, snapshot, condition, case when count(*) filter (outcome is null) = 0 then avg(outcome::int) end as m from modes group by all),
wide as (select experiment_id, mode, case_id, max(m) filter (snapshot = 'vulnerable' and condition = 'baseline') as vb, max(m) filter (snapshot = 'vulnerable' and condition = 'candidate') as vc,
  max(m) filter (snapshot = 'fixed' and condition = 'baseline') as fb, max(m) filter (snapshot = 'fixed' and condition = 'candidate') as fc from cells group by all),
effects as (select experiment_id, mode, case_id, vc - vb as vulnerable_lift, fc - fb as fixed_false_positive_increase, (vc - vb) - (fc - fb) as net_useful_lift from wide)"""


def _convolved(bits: int = 16) -> str:
    """Quantiles of the sum of n thirds by repeated squaring, for up to 2 ** bits - 1 cases."""
    steps = [""", whole as (select * from effects e where not exists (select 1 from effects o where o.experiment_id = e.experiment_id and o.mode = e.mode and o.net_useful_lift is null)),
      long as (select experiment_id, mode, unnest(['vulnerable_lift', 'fixed_false_positive_increase', 'net_useful_lift']) as effect, unnest([vulnerable_lift, fixed_false_positive_increase, net_useful_lift]) as x from whole),
      sized as (select experiment_id, mode, effect, count(*) as n from long group by all),
      p0 as materialized (select experiment_id, mode, effect, any_value(n) as n, round(3 * x)::bigint as k, count(*)::double / any_value(n) as p from long join sized using (experiment_id, mode, effect) group by experiment_id, mode, effect, round(3 * x)),
      t0 as (select experiment_id, mode, effect, n, 0::bigint as k, 1.0::double as p from sized)"""]
    product = lambda a, b, where: f"select a.experiment_id, a.mode, a.effect, any_value(a.n) as n, a.k + b.k as k, sum(a.p * b.p) as p from {a} a join {b} b using (experiment_id, mode, effect) where {where} group by a.experiment_id, a.mode, a.effect, a.k + b.k having sum(a.p * b.p) > 1e-22"
    for i in range(bits):
        steps.append(f"t{i + 1} as materialized ({product(f't{i}', f'p{i}', f'(a.n >> {i}) & 1 = 1')} union all select * from t{i} where (n >> {i}) & 1 = 0)")
        steps.append(f"p{i + 1} as materialized ({product(f'p{i}', f'p{i}', f'a.n >> {i + 1} > 0')})")
    return ",\n".join(steps) + f""", reached as (select *, sum(p) over (partition by experiment_id, mode, effect order by k) + 1e-12 as c from t{bits})
      select experiment_id, mode, effect, round(min(k) filter (c >= 0.025) / 3.0 / any_value(n), 9) as lower, round(min(k) filter (c >= 0.975) / 3.0 / any_value(n), 9) as upper from reached group by all"""


def breakdown_tags() -> str:
    """Each tag of each experiment, once."""
    return """tagged_experiments as (select distinct experiment_id, dimension, tag from cases join (select case_id, 'repository' as dimension, repository as tag from cases union select case_id, 'category', cat_a from cases union select case_id, 'category', cat_b from cases
      union select case_id, 'severity', case when severity_min = severity_max then severity_min else concat(severity_min, '-to-', severity_max) end from cases
      union select case_id, 'context_size', case when max(estimated_input_tokens) is null then 'unknown' when max(estimated_input_tokens) <= 2000 then 'small' when max(estimated_input_tokens) <= 8000 then 'medium' else 'large' end from records group by case_id) using (case_id))"""


@cache
def oracle() -> dict[str, str]:
    base = with_views("adjudications") + _SCORED
    rate = lambda name, source, good, opened: f"select experiment_id, coalesce(condition, 'all') as condition, '{name}' as metric, count(*) filter ({good}) as correct, count(*) filter ({opened}) as unresolved, count(*) as total from {source} group by grouping sets ((experiment_id), (experiment_id, condition))"
    flagged = "(select experiment_id, condition, run_id, finding_id, bool_or(decision = 'match') as hit, bool_or(decision in ('uncertain', 'unadjudicated')) as opened from pairs where duplicate_of is null and expected_status <> 'unverified' group by all)"
    unique = "(select * from found where duplicate_of is null)"
    rates = " union all ".join([rate("valid_output", "runs", "status = 'succeeded'", "false"), rate("path", unique, "path_match <> 'none'", "false"), rate("category", unique, "category_match", "false"), rate("severity", unique, "severity_match", "false"), rate("mechanism", flagged, "hit", "not hit and opened")])
    long = " union all ".join(f"select experiment_id, condition, '{m}' as metric, {m}::double as x, {m}::decimal(38,6) as d from records" for m in stats.METRICS)
    tags = """, tags as (select distinct case_id, 'repository' as dimension, repository as tag from cases union select case_id, 'category', cat_a from cases union select case_id, 'category', cat_b from cases
      union select case_id, 'severity', case when severity_min = severity_max then severity_min else concat(severity_min, '-to-', severity_max) end from cases
      union select case_id, 'context_size', case when max(estimated_input_tokens) is null then 'unknown' when max(estimated_input_tokens) <= 2000 then 'small' when max(estimated_input_tokens) <= 8000 then 'medium' else 'large' end from records group by case_id),
      tagged as (select * from modes join tags using (case_id))"""
    z = 1.959963984540054
    log = with_views("planted_adjudications") + """, linked as (select a.*, p.adjudication_id as pid, p.run_id as pr, p.finding_id as pf, p.expected_mechanism_id as pm from planted_adjudications a left join planted_adjudications p on p.adjudication_id = a.supersedes where a.supersedes is not null),
      log_faults as (select 'unknown_target' as rule, adjudication_id as key, supersedes as detail from linked where pid is null
        union all select 'changed_identity', adjudication_id, supersedes from linked where run_id <> pr or finding_id <> pf or expected_mechanism_id <> pm
        union all select 'two_current', min(adjudication_id), count(*)::varchar from planted_adjudications where not exists (select 1 from planted_adjudications s where s.supersedes = planted_adjudications.adjudication_id) group by run_id, finding_id, expected_mechanism_id having count(*) > 1
        union all select 'cycle', adjudication_id, adjudication_id from planted_adjudications where expected_mechanism_id = 'mc')"""
    return {
        "scored_pairs": base + " select run_id, finding_id, mechanism_id, duplicate_of, path_match, accepted_path, location_match, category_match, severity_match, decision, disposition from pairs",
        "scored_findings": base + " select run_id, finding_id, duplicate_of, path_match, location_match, category_match, severity_match, finding_disposition as disposition from found",
        "mechanism_outcomes": base + " select run_id, mechanism_id, expected_status, classification from outcomes",
        "run_outcomes": base + " select experiment_id, run_id, status, primary_outcome, pessimistic_outcome, optimistic_outcome from runs",
        "current_adjudications": base + " select adjudication_id, run_id, decision from live",
        "adjudication_violations": log + " select * from log_faults",
        "scoring_gates": log + """, wanted as (select experiment_id, case_id, snapshot, condition, repetition, run_id from plan),
          now as (select * from planted_adjudications where not exists (select 1 from planted_adjudications s where s.supersedes = planted_adjudications.adjudication_id)),
          aimed as (select n.adjudication_id, m.mechanism_id, case when f.snapshot = 'vulnerable' then m.expect_vulnerable else m.expect_fixed end as expected from now n join findings f using (run_id, finding_id) left join mechanisms m on m.case_id = f.case_id and m.mechanism_id = n.expected_mechanism_id)
          select 'complete' as gate, 'record_missing' as rule, run_id as key from plan where run_id not in (select run_id from planted_records)
          union all select 'complete', 'record_repeated', run_id from planted_records group by run_id having count(*) > 1
          union all select 'complete', 'gold_missing', case_id from cases where case_id not in (select case_id from planted_gold)
          union all select 'identity', 'condition', run_id from planted_records where condition = 'other'
          union all select 'terminal', 'not_last', run_id from planted_records where not (status in ('succeeded', 'configuration_error', 'adapter_error') or attempt >= 3 or status not in ('provider_error', 'timeout', 'invalid_output'))
          union all select 'gold', 'mixed_versions', experiment_id from planted_gold group by experiment_id having count(distinct gold_version) > 1
          union all select 'adjudication', rule, key from log_faults
          union all select 'target', 'run', adjudication_id from now where run_id not in (select run_id from planted_records where status = 'succeeded')
          union all select 'target', 'finding', adjudication_id from now where (run_id, finding_id) not in (select (run_id, finding_id) from findings)
          union all select 'target', case when mechanism_id is null then 'mechanism' else 'unverified' end, adjudication_id from aimed where mechanism_id is null or expected = 'unverified'""",
        "scored_violations": base + """, n as (select *, substr(run_id, 5)::bigint as n from pairs), fails as (select *, substr(run_id, 5)::bigint as n from runs where status <> 'succeeded'), good as (select *, substr(run_id, 5)::bigint as n from runs where status = 'succeeded')
          select 'path' as rule, run_id || '/' || finding_id || '/' || mechanism_id as key from n where n % 13 = 0 and path_match <> 'none'
          union all select 'disposition', run_id || '/' || finding_id || '/' || mechanism_id from n where n % 23 = 0 and disposition = 'unmatched'
          union all select 'duplicate', run_id || '/' || finding_id from found where substr(run_id, 5)::bigint % 37 = 0 and duplicate_of is not null
          union all select 'labels', run_id || '/' || finding_id || '/' || mechanism_id from n where mechanism_id = 'm2' and (n % 29 = 0 or n % 41 = 0) or mechanism_id = 'm1' and n % 43 = 0
          union all select distinct 'cover', run_id || '/' || finding_id from n where mechanism_id = 'm2' and n % 41 = 0
          union all select distinct 'mechanism_set', case_id from outcomes where mechanism_id = 'm2' and substr(run_id, 5)::bigint % 41 = 0
          union all select 'primary', run_id from runs where substr(run_id, 5)::bigint % 43 = 0
          union all select 'finding', run_id || '/' || finding_id from found where substr(run_id, 5)::bigint % 11 = 0 and finding_disposition = 'partial'
          union all select 'class', run_id || '/' || mechanism_id from outcomes where substr(run_id, 5)::bigint % 19 = 0 and substr(run_id, 5)::bigint % 41 <> 0 and evaluation_role = 'supplemental' and classification = 'true_negative'
          union all select 'bounds', run_id from good where n % 17 = 0 and n % 43 <> 0 union all select 'failed', run_id from fails where n % 2 = 0 union all select unnest(['outcome', 'bounds']), run_id from fails where n % 2 = 0 and n % 43 <> 0""",
        "outcome_counts": base + f" select *, case when unresolved = 0 then round(positive / total, 10) end as value from (select experiment_id, mode, snapshot, condition, {_COUNTS} from modes group by all)",
        "paired_result": base + " " + _differences("experiment_id", "modes"),
        "discordance": base + """, sides as (select experiment_id, mode, snapshot, case_id, repetition, max(coalesce(outcome::int, -1)) filter (condition = 'baseline') as b, max(coalesce(outcome::int, -1)) filter (condition = 'candidate') as c from modes group by all)
          select experiment_id, mode, snapshot, count(*) filter (b = 1 and c = 1) as both, count(*) filter (b = 0 and c = 1) as candidate_only, count(*) filter (b = 1 and c = 0) as baseline_only, count(*) filter (b = 0 and c = 0) as neither, count(*) filter (coalesce(b, -1) = -1 or coalesce(c, -1) = -1) as unresolved from sides group by all""",
        "case_effects": base + _EFFECTS + " select experiment_id, mode, case_id, round(vulnerable_lift, 10) + 0.0 as vulnerable_lift, round(fixed_false_positive_increase, 10) + 0.0 as fixed_false_positive_increase, round(net_useful_lift, 10) + 0.0 as net_useful_lift from effects",
        "bootstrap_hash": base + _EFFECTS + """, numbered as (select *, row_number() over (partition by experiment_id, mode order by case_id) - 1 as i, count(*) over (partition by experiment_id, mode) as n from effects e where not exists (select 1 from effects o where o.experiment_id = e.experiment_id and o.mode = e.mode and o.net_useful_lift is null)),
          draws as (select experiment_id, mode, n, b, unnest(range(n)) as slot from (select distinct experiment_id, mode, n from numbered), range(100) as r(b)),
          drawn as (select d.experiment_id, d.mode, b, vulnerable_lift, fixed_false_positive_increase, net_useful_lift from (select *, ('0x' || substr(md5('7:' || b || ':' || slot), 1, 8))::bigint % n as i from draws) d join numbered using (experiment_id, mode, i)),
          means as (select experiment_id, mode, b, round(avg(vulnerable_lift), 10) as v, round(avg(fixed_false_positive_increase), 10) as f, round(avg(net_useful_lift), 10) as l from drawn group by all),
          long as (select experiment_id, mode, 'vulnerable_lift' as effect, v as x from means union all select experiment_id, mode, 'fixed_false_positive_increase', f from means union all select experiment_id, mode, 'net_useful_lift', l from means)
          select experiment_id, mode, effect, quantile_disc(x, 0.025) as lower, quantile_disc(x, 0.975) as upper from long group by all""",
        "bootstrap_convolution": base + _EFFECTS + _convolved(),
        "result_digests": base + """, lines as (select experiment_id, row_number() over (partition by experiment_id order by case_id, repetition, snapshot, condition, run_id) - 1 as place,
            '{"run_id":"' || run_id || '","status":"' || status || '","primary_outcome":' || coalesce(primary_outcome::varchar, 'null') || ',"pessimistic_outcome":' || pessimistic_outcome || ',"optimistic_outcome":' || optimistic_outcome || '}' as line from runs),
          parts as (select experiment_id, place // 4096 as part, sha256(string_agg(line, chr(10) order by place)) as line, count(*) as n from lines group by all)
          select experiment_id, 'sha256:' || case when count(*) = 1 then max(line) else sha256(string_agg(line, chr(10) order by part)) end as digest, sum(n)::bigint as n from parts group by all""",
        "stored_runs": base + " select experiment_id, run_id, status, primary_outcome from runs where experiment_id in ('exp-0', 'exp-1')",
        "stored_entries": base + """, every as (select 'scored_pairs' as table_name, experiment_id from pairs union all select 'scored_findings', experiment_id from found union all select 'mechanism_outcomes', experiment_id from outcomes union all select 'scored_runs', experiment_id from runs)
          select table_name, experiment_id, count(*) as rows, 0::bigint as faults from every where experiment_id in ('exp-0', 'exp-1') group by all""",
        "repetition_stability": base + """, cells as (select experiment_id, snapshot, condition, case_id, count(*) filter (primary_outcome is null) as opened, var_pop(primary_outcome::int) as v, min(primary_outcome::int) <> max(primary_outcome::int) as split from runs group by all)
          select experiment_id, snapshot, condition, count(*) filter (opened = 0) as complete_cases, count(*) filter (opened > 0) as unresolved_cases, count(*) filter (opened = 0 and split) as discordant_cases, round(avg(v) filter (opened = 0), 10) as mean_variance from cells group by all""",
        "cell_violations": with_views("records") + """, r as (select * from records where run_no % 101 <> 3 and not (snapshot = 'fixed' and condition = 'candidate' and run_no % 97 < 6)), k as (select case_id, snapshot, condition, count(*) as n from r group by all)
          select 'repetitions' as rule, case_id as key, snapshot || '/' || condition as detail from k where n <> 3 union all select 'cells', case_id, count(*)::varchar from k group by case_id having count(*) <> 4""",
        "combined_outcomes": base + " select run_id, primary_outcome, 0::bigint as violations from runs",
        "breakdown_counts": base + tags + f" select *, case when unresolved = 0 then round(positive / total, 10) end as value from (select experiment_id, dimension, tag, mode, snapshot, condition, {_COUNTS} from tagged group by all)",
        "breakdown_discordance": base + tags + """, sides as (select experiment_id, dimension, tag, mode, snapshot, case_id, repetition, max(coalesce(outcome::int, -1)) filter (condition = 'baseline') as b, max(coalesce(outcome::int, -1)) filter (condition = 'candidate') as c from tagged group by all)
          select experiment_id, dimension, tag, mode, snapshot, count(*) filter (b = 1 and c = 1) as both, count(*) filter (b = 0 and c = 1) as candidate_only, count(*) filter (b = 1 and c = 0) as baseline_only, count(*) filter (b = 0 and c = 0) as neither, count(*) filter (coalesce(b, -1) = -1 or coalesce(c, -1) = -1) as unresolved from sides group by all""",
        "quality_rates": base + f" select *, round(correct / nullif(total - unresolved, 0), 10) as value from ({rates})",
        "operation_distributions": with_views("records") + f", long as ({long}) select experiment_id, coalesce(condition, 'all') as condition, metric, count(x) as observations, count(*) - count(x) as missing, round(min(x), 6) as min, round(quantile_cont(x, 0.5), 6) as median, round(quantile_disc(x, 0.95), 6) as p95, round(max(x), 6) as max, round(sum(d)::double / count(x), 6) as mean, round(sum(d)::double, 6) as total from long group by grouping sets ((experiment_id, metric), (experiment_id, metric, condition))",
        "breakdowns": base + tags + " " + _differences("experiment_id, dimension, tag", "tagged"),
        "status_counts": with_views("records") + " select experiment_id, status, (select count(*) from records r where r.experiment_id = e.experiment_id and r.status = s.status) as n from (select distinct experiment_id from records) e cross join (values " + ", ".join(f"('{s}')" for s in stats.STATUSES) + ") as s(status)",
        "cr1_bounds": base + _EFFECTS + f""", long as (select experiment_id, mode, repository, unnest(['vulnerable_lift', 'fixed_false_positive_increase']) as effect, unnest([vulnerable_lift, fixed_false_positive_increase]) as x from effects join cases using (experiment_id, case_id)),
          clusters as (select experiment_id, mode, effect, repository, sum(x) as s, count(*) as n, count(*) - count(x) as opened from long group by all),
          means as (select experiment_id, mode, effect, sum(s) / sum(n) as m, sum(n)::bigint as cases, count(*) as projects, sum(opened)::bigint as unresolved from clusters group by all),
          sums as (select experiment_id, mode, effect, cases, projects, unresolved, case when unresolved = 0 then m end as m, case when unresolved = 0 then sqrt(projects / (projects - 1) * sum((s - n * m) * (s - n * m))) / cases end as se from clusters join means using (experiment_id, mode, effect) group by experiment_id, mode, effect, m, cases, projects, unresolved)
          select experiment_id, mode, effect, cases, projects, unresolved, round(m, 9) as mean, round(se, 9) as standard_error, round(m - {z} * se, 9) as lower, round(m + {z} * se, 9) as upper from sums""",
    }


def _statistics(texts: dict[str, str]) -> str:
    """All tables of the statistics as one text: what the tables' own texts have in common is computed once."""
    shared, records, parts = with_views("adjudications") + _SCORED, with_views("records"), []
    for table, (query, key, names) in STATISTICS.items():
        text = texts[query]
        rest = text.removeprefix(shared) if text.startswith(shared) else text.removeprefix(records)
        rest = "with" + rest.lstrip()[1:] if rest.lstrip().startswith(",") else rest
        measures, values = ", ".join(f"'{m}'" for m in names), ", ".join(f'round("{m}"::double, 6) + 0.0' for m in names)
        parts.append(f"select '{table}' as table_name, concat_ws('/', {', '.join(key)}) as key, unnest([{measures}]) as measure, unnest([{values}]) as value from ({rest})")
    return shared + " " + "\nunion all ".join(parts)


QUERIES = {f.__name__: f for f in (scored_pairs, scored_findings, mechanism_outcomes, run_outcomes, current_adjudications, adjudication_violations, scoring_gates, scored_violations, combined_outcomes, statistics_tables, breakdown_counts, breakdown_discordance, outcome_counts, paired_result, discordance, case_effects, bootstrap_hash, bootstrap_multinomial, bootstrap_convolution, result_digests, stored_runs, stored_entries, repetition_stability, cell_violations, quality_rates, operation_distributions, breakdowns, status_counts, cr1_bounds)}
ORACLE_SQL = oracle() | {"statistics_tables": _statistics(oracle())}
