"""Typed reading of contract documents and rule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas by contract name; unknown fields are not read, missing ones are null.
SCHEMAS = {
    "run_record": "experiment_id string, run_id string, attempt int, status string, started_at timestamp, ended_at timestamp, monotonic_latency_ms double, provider_request_id string, seed decimal(20,0), validation_errors array<string>, usage struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,reasoning_tokens:bigint>, price_table_version string, cost struct<currency:string,input:double,output:double,total:double>, subprocess struct<exit_status:int,stderr_classification:string>, retry_history array<struct<attempt:int,classification:string>>, identity struct<experiment_content_digest:string,source_commit:string,profile_digest:string,reviewer_config_digest:string,adapter_capabilities_digest:string,request_digest:string,reviewer_output_digest:string>, content_digest string",
    "finding": "run_id string, finding_id string, title string, explanation string, file_path string, start_line int, end_line int, severity string, defect_category string, failure_mechanism string, confidence double, evidence array<struct<source_type:string,reference:string>>",
    "adjudication": "adjudication_id string, run_id string, finding_id string, expected_mechanism_id string, decision string, rubric_version string, adjudicator string, decided_at timestamp, rationale string, supersedes string",
    "decision": "batch_id string, packet_id string, role string, adjudicator string, decision_id string, assignment_id string, classification string, decided_at timestamp, supersedes string, resolves array<string>",
    "price": "version string, effective_date date, provider string, model string, currency string, input_rate decimal(14,6), cached_rate decimal(14,6), output_rate decimal(14,6), threshold_input_tokens bigint, input_multiplier decimal(10,4), output_multiplier decimal(10,4)",
    "case_record": "case_id string, display_name string, defect_category string, repository string, pull_request int, commits struct<base:string,vulnerable:string,repair:string,fixed:string>, eligibility string, verification_status string, vulnerable_tokens bigint, fixed_tokens bigint",
    "assessment": "packet_id string, assignment_id string, mechanism_decision string, validity string, issue_kind string, additional_issue_group string",
}
_PRICE = "provider:string,model:string,input_rate:decimal(14,6),cached_rate:decimal(14,6),output_rate:decimal(14,6),threshold_input_tokens:bigint,input_multiplier:decimal(10,4),output_multiplier:decimal(10,4)"
_PLACE = "path:string,aliases:array<string>,start_line:int,end_line:int"
SCHEMAS |= {
    "price_table": f"schema_version string, version string, effective_date date, currency string, source string, entries array<struct<{_PRICE}>>",
    "gold": f"case_id string, gold_version string, mechanisms array<struct<mechanism_id:string,evaluation_role:string,vulnerable:string,fixed:string,severity_min:string,severity_max:string,locations:array<struct<{_PLACE}>>>>",
    "catalog_record": "case_id string, repository string, disposition string, pull_request struct<number:int,url:string>, commits struct<base:string,vulnerable:string,repairs:array<string>,fixed:string>",
    "attempt_metadata": "run_id string, attempt int, status string, started_at timestamp, ended_at timestamp, usage struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,reasoning_tokens:bigint>, provider_cost_usd double, run_record_digest string, content_digest string",
}
_SHA = "^[0-9a-f]{40}$"
_SEVERITY = "array_position(array('low', 'medium', 'high', 'critical'), {})"
_ALIASES, _PATHS = "flatten(transform(m.locations, x -> coalesce(x.aliases, array())))", "transform(m.locations, x -> x.path)"
_OWNED = "flatten(transform(m.locations, x -> transform(coalesce(x.aliases, array()), a -> struct(x.path as p, a as a))))"
#: Rules by contract: (name, condition that a sound row fulfils); null conditions count as fulfilled.
RULES = {
    "run_record": (
        ("identity", "run_id is not null and experiment_id is not null and attempt >= 1"),
        ("times", "ended_at >= started_at"),
        ("success", "status <> 'succeeded' or (subprocess.exit_status = 0 and subprocess.stderr_classification = 'none')"),
        ("cached", "usage.cached_input_tokens <= usage.input_tokens"),
        ("cost", "abs(cost.input + cost.output - cost.total) <= 1e-9"),
        ("history", "coalesce(size(retry_history), 0) = attempt - 1 and (attempt = 1 or transform(retry_history, x -> x.attempt) = sequence(1, greatest(attempt - 1, 1)))"),
        ("latency", "monotonic_latency_ms >= 0"),
        ("output", "(status = 'succeeded') = (identity.reviewer_output_digest is not null)"),
        ("identity_digests", " and ".join(f"coalesce(identity.{c} rlike '^sha256:[0-9a-f]{{64}}$', false)" for c in ("experiment_content_digest", "profile_digest", "reviewer_config_digest", "request_digest"))),
        ("status", "status in ('succeeded', 'timeout', 'provider_error', 'configuration_error', 'adapter_error', 'invalid_output')"),
    ),
    "finding": (
        ("lines", "(start_line is not null or end_line is null) and (end_line is null or end_line >= start_line) and (start_line is null or start_line >= 1)"),
        ("severity", "severity in ('low', 'medium', 'high', 'critical')"),
        ("confidence", "confidence between 0 and 1"),
        ("path", r"file_path is not null and not file_path rlike '^/|\\\\|(^|/)[.]{1,2}(/|$)'"),
    ),
    "adjudication": (("self", "supersedes is null or supersedes <> adjudication_id"), ("decision", "decision in ('match', 'no_match', 'uncertain')")),
    "decision": (("self", "supersedes is null or supersedes <> decision_id"), ("resolves", "(role = 'resolution') = (coalesce(size(resolves), 0) = 2)")),
    "price": (("currency", "currency = 'USD'"), ("cached", "cached_rate <= input_rate"), ("multiplier", "coalesce(input_multiplier, 1) >= 1 and coalesce(output_multiplier, 1) >= 1")),
    "case_record": (("commits", f"commits.vulnerable rlike '{_SHA}' and commits.fixed rlike '{_SHA}' and commits.vulnerable <> commits.fixed"), ("tokens", "vulnerable_tokens >= 0 and fixed_tokens >= 0")),
    "price_table": (
        ("version", "schema_version = '1.0' and length(version) between 1 and 100"),
        ("currency", "currency = 'USD'"),
        ("source", "source like 'https://%'"),
        ("entries", "size(entries) > 0 and size(array_distinct(transform(entries, e -> struct(e.provider, e.model)))) = size(entries)"),
        ("order", "transform(entries, e -> struct(e.provider, e.model)) = array_sort(transform(entries, e -> struct(e.provider, e.model)))"),
    ),
    "gold": (
        ("unique", "size(array_distinct(transform(mechanisms, m -> m.mechanism_id))) = size(mechanisms)"),
        ("one_primary", "gold_version <> '2.0' or size(filter(mechanisms, m -> m.evaluation_role = 'primary')) = 1"),
        ("primary_expectation", "gold_version <> '2.0' or forall(mechanisms, m -> m.evaluation_role <> 'primary' or (m.vulnerable = 'present' and m.fixed = 'absent'))"),
        ("verified", "forall(mechanisms, m -> m.vulnerable <> 'unverified' or m.fixed <> 'unverified')"),
        ("severity_range", f"forall(mechanisms, m -> {_SEVERITY.format('m.severity_min')} <= {_SEVERITY.format('m.severity_max')})"),
        ("alias_self", "forall(mechanisms, m -> forall(m.locations, x -> not coalesce(array_contains(x.aliases, x.path), false)))"),
        ("alias_shadow", f"forall(mechanisms, m -> size(array_intersect({_ALIASES}, {_PATHS})) = 0)"),
        ("alias_owner", f"forall(mechanisms, m -> size(array_distinct({_ALIASES})) = size(array_distinct({_OWNED})))"),
        ("location_lines", "forall(mechanisms, m -> forall(m.locations, x -> x.end_line is null or (x.start_line is not null and x.end_line >= x.start_line)))"),
    ),
    "catalog_record": (
        ("url", "pull_request.url = concat('https://github.com/', repository, '/pull/', pull_request.number)"),
        ("base", "commits.base <> commits.vulnerable"),
        ("paired", "disposition <> 'paired_draft' or (coalesce(size(commits.repairs), 0) > 0 and commits.fixed is not null)"),
        ("final_repair", "disposition <> 'paired_draft' or commits.fixed = try_element_at(commits.repairs, -1)"),
        ("repair_order", "disposition <> 'paired_draft' or not array_contains(commits.repairs, commits.vulnerable)"),
        ("special", "disposition = 'paired_draft' or (coalesce(size(commits.repairs), 0) = 0 and commits.fixed is null)"),
    ),
    "attempt_metadata": (("times", "ended_at >= started_at"), ("cached", "usage.cached_input_tokens <= usage.input_tokens")),
    "assessment": (("kind", "issue_kind in ('code', 'documentation', 'uncertain')"), ("validity", "validity in ('valid', 'false_positive', 'uncertain')")),
}
#: Columns that a contract's rows must fill.
REQUIRED = {
    "run_record": ("experiment_id", "run_id", "attempt", "status", "started_at", "ended_at", "monotonic_latency_ms", "subprocess", "identity", "content_digest"),
    "finding": ("run_id", "finding_id", "title", "explanation", "file_path", "severity", "defect_category", "failure_mechanism", "confidence"),
    "adjudication": ("adjudication_id", "run_id", "finding_id", "expected_mechanism_id", "decision"),
    "decision": ("role", "decision_id", "assignment_id", "classification", "decided_at"),
    "price": ("provider", "model", "currency", "input_rate", "cached_rate", "output_rate"),
    "case_record": ("case_id", "repository", "defect_category", "commits"),
    "assessment": ("assignment_id", "mechanism_decision", "validity", "issue_kind"),
    "price_table": ("schema_version", "version", "effective_date", "currency", "source", "entries"),
    "gold": ("case_id", "gold_version", "mechanisms"),
    "catalog_record": ("case_id", "repository", "disposition", "pull_request", "commits"),
    "attempt_metadata": ("run_id", "attempt", "started_at", "ended_at", "content_digest"),
}
KEYS = {"run_record": ("run_id", "attempt"), "finding": ("run_id", "finding_id"), "adjudication": ("adjudication_id",), "decision": ("decision_id",), "price": ("provider", "model"), "case_record": ("case_id",), "assessment": ("assignment_id",), "price_table": ("version",), "gold": ("case_id",), "catalog_record": ("case_id",), "attempt_metadata": ("run_id", "attempt")}


def read_contract(spark: SparkSession, name: str, path: str) -> DataFrame:
    """JSON documents of a contract with its fixed schema; fails on other extensions and on documents that are not objects of that shape."""
    if not path.rstrip("/*").endswith((".json", ".jsonl")) and "*" not in path:
        raise ValueError(f"{path}: a contract is read from .json or .jsonl")
    return spark.read.schema(SCHEMAS[name]).option("multiLine", path.endswith(".json")).option("mode", "FAILFAST").json(path)


def check_contract(df: DataFrame, name: str) -> DataFrame:
    """Violations (rule, key) of a contract: rules that a row breaks, required columns that are null or not there, keys that repeat."""
    key = F.concat_ws("/", *KEYS[name]).alias("key")
    empty = [F.when(F.col(c).isNull(), F.lit(f"required_{c}")) if c in df.columns else F.lit(f"required_{c}") for c in REQUIRED[name]]
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(rule), F.lit(True)), F.lit(n)) for n, rule in RULES[name]), *empty))
    out = df.select(F.explode(broken).alias("rule"), key)
    return out.union(df.groupBy(*KEYS[name]).count().filter("count > 1").select(F.lit("repeated"), key))


def require_sound(violations: DataFrame) -> None:
    """Raise if there is any violation."""
    some = violations.limit(5).collect()
    if some:
        raise ValueError(f"contract violations: {[tuple(r) for r in some]}")


def check_digest(df: DataFrame, stored: str, computed: Column, key: str) -> DataFrame:
    """Violations: stored digests that are not the computed one."""
    return df.filter(~F.col(stored).eqNullSafe(computed)).select(F.lit("digest").alias("rule"), F.col(key).alias("key"))
