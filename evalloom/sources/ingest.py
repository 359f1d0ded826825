"""Ingest of raw reviewer responses, and failure classes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a standard error text holds, and its class; the first that holds wins.
STDERR = (
    ("timeout", ("timed out", "timeout")),
    ("provider", ("rate limit", "provider", "transport", "network", "connection reset", "connection refused")),
    ("usage", ("usage:", "unknown option", "unrecognized argument")),
    ("configuration", ("configuration", "config file", "missing setting", "not configured")),
    ("internal", ("traceback", "internal error", "assertionerror")),
)
RESPONSE_SCHEMA = "run_id string, status string, error string, findings string, input_tokens long, output_tokens long, cost double"


def stderr_class(text: Column) -> Column:
    """none, timeout, provider, usage, configuration, internal or redacted_unknown."""
    lower = F.lower(text)
    out = F.when(F.coalesce(text, F.lit("")) == "", "none")
    for name, parts in STDERR:
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(lower, F.lit(p))
        out = out.when(hit, name)
    return out.otherwise("redacted_unknown")


def classify_failures() -> Column:
    """Status of an attempt from timed_out, output_limit, capture_error, exit_status, stderr, parse_error; in that order."""
    nonzero = stderr_class(F.col("stderr"))
    return (
        F.when(F.col("timed_out"), "timeout")
        .when(F.col("output_limit") | F.col("capture_error"), "adapter_error")
        .when(F.col("exit_status") != 0, F.when(nonzero.isin("usage", "configuration"), "configuration_error").when(nonzero == "provider", "provider_error").when(nonzero == "timeout", "timeout").otherwise("adapter_error"))
        .when(F.col("parse_error").isNotNull(), "invalid_output")
        .otherwise("succeeded")
    )


def _pairs(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate key")
    return out


def _constant(name: str):
    raise ValueError(name)


def parse_one(text: str | None) -> tuple:
    """status, error, findings (JSON), input tokens, output tokens, cost of one response: a single JSON object, perhaps in a provider's envelope."""
    load = lambda t: json.loads(t, object_pairs_hook=_pairs, parse_constant=_constant)
    tokens_in = tokens_out = cost = None
    try:
        document = load((text or "").strip())
        if isinstance(document, dict) and "result" in document:
            usage = document.get("modelUsage") or {}
            if usage:  # input counts what was read from and written to the cache
                tokens_in = sum(int(u.get("inputTokens", 0)) + int(u.get("cacheCreationInputTokens", 0)) + int(u.get("cacheReadInputTokens", 0)) for u in usage.values())
                tokens_out = sum(int(u.get("outputTokens", 0)) for u in usage.values())
            cost = document.get("total_cost_usd")
            cost = float(cost) if isinstance(cost, (int, float)) else None
            inner = document["result"]
            document = load(inner) if isinstance(inner, str) else inner
        if not isinstance(document, dict) or not isinstance(document.get("findings"), list):
            return "invalid_output", "OUTPUT_SCHEMA_INVALID", None, tokens_in, tokens_out, cost
        return "succeeded", None, json.dumps(document["findings"], sort_keys=True, separators=(",", ":"), ensure_ascii=False), tokens_in, tokens_out, cost
    except (ValueError, TypeError, AttributeError):
        return "invalid_output", "OUTPUT_JSON_INVALID", None, tokens_in, tokens_out, cost


def parse_responses(responses: DataFrame) -> DataFrame:
    """Parse ``response`` of every run_id; billing stays even where the payload is invalid. Built-in JSON readers keep the last of duplicate keys, so a parser runs in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *parse_one(t)) for i, t in zip(batch["run_id"], batch["response"])]
            out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RESPONSE_SCHEMA.split(", ")])
            yield out.astype({"input_tokens": "Int64", "output_tokens": "Int64", "cost": "Float64"})

    return responses.select("run_id", "response").mapInPandas(run, RESPONSE_SCHEMA)


def explode_findings(parsed: DataFrame, finding_schema: str) -> DataFrame:
    """A row for each finding of succeeded responses."""
    rows = parsed.filter("status = 'succeeded'").select("run_id", F.explode(F.from_json("findings", f"array<struct<{finding_schema}>>")).alias("f"))
    return rows.select("run_id", "f.*")
