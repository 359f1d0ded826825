"""Leakage, bundles, splits, ingest and adjudication."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from evalloom.functions.text import normal_phrase
from evalloom.operators import adjudication, bundles, corpus_split, experiment_plan, leakage, report
from evalloom.sources import contracts, ingest

COMPONENT = "case_id string, request_id string, pos int, location_class string, text string"
INDEX = "case_id string, rule_id string, mode string, value string"


def test_sha_and_token_boundaries(spark):
    sha = "0123456789abcdef0123456789abcdef01234567"
    texts = ["x 0123456 y", "x 012345 y", "xx0123456", "deadbeef0123456", sha.upper(), "see pr42.", "spr42 pr42_x", "c-1 here", "ac-1"]
    components = spark.createDataFrame([("c-1", f"r{i}", 0, "prompt", t) for i, t in enumerate(texts)], COMPONENT)
    index = spark.createDataFrame([("c-1", "s", "sha", sha), ("c-1", "l", "token", "c-1"), ("c-1", "l", "pull_request_token", "pr<digits>")], INDEX)
    assert {r["request_id"] for r in leakage.scan_shas(components, index).collect()} == {"r0", "r2", "r4"}
    assert {(r["request_id"], r["match"]) for r in leakage.scan_tokens(components, index).collect()} == {("r5", "pr42"), ("r7", "c-1")}


def test_phrases_against_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["Straße", "ﬁn", "alpha", "b", "c-d", "É", "x1"])
    phrases = [" ".join(word() for _ in range(rnd.randint(1, 5))) for _ in range(40)]
    texts = [", ".join(word() for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    components = spark.createDataFrame([("c", f"r{i}", 0, "prompt", t) for i, t in enumerate(texts)], COMPONENT)
    index = spark.createDataFrame([("c", f"p{i}", "phrase", normal_phrase(p)) for i, p in enumerate(phrases)], INDEX)
    got = {(r["request_id"], r["rule_id"]) for r in leakage.scan_phrases(components, index).collect()}
    want = {(f"r{i}", f"p{j}") for i, t in enumerate(texts) for j, p in enumerate(phrases) if f" {normal_phrase(p)} " in f" {normal_phrase(t)} "}
    assert got == want and want


def test_labels_of_repository_content_are_no_leak(spark):
    schema = "case_id string, request_id string, prompt string, profile string, entries array<struct<path:string,content:string,reason:string>>, config map<string,string>"
    rows = [("c", "r0", "look", "p", [("vulnerable.py", "fixed", "n")], {"m": "x"}), ("c", "r1", "the fixed one", "p", [("a.py", None, "n")], {"m": "x"}), ("c", "r2", None, None, [("fixed.py", "x", "in the vulnerable state")], {"m": "Fixed!"}), ("c", "r3", "look", "p", [], {})]
    index = spark.createDataFrame([("c", leakage.LABEL_RULE, "phrase", v) for v in leakage.LABELS], INDEX)
    got = leakage.scan_labels(leakage.request_components(spark.createDataFrame(rows, schema)), index).collect()
    assert {(r["request_id"], r["location_class"], r["match"]) for r in got} == {("r1", "serialized_request", "fixed"), ("r2", "serialized_request", "vulnerable"), ("r2", "serialized_request", "fixed"), ("r2", "tool_configuration", "fixed")}
    assert sum(r["request_id"] == "r1" for r in got) == 2  # the whole request and its prompt


def test_exceptions_are_exact_and_unexpired(spark):
    matches = spark.createDataFrame([("c", "r", 0, "prompt", "rule", "x"), ("d", "r", 0, "prompt", "rule", "x")], "case_id string, request_id string, pos int, location_class string, rule_id string, match string")
    none = spark.createDataFrame([], "case_id string, rule_id string, location_class string, match_digest string, expires_at timestamp")
    digest = leakage.audit(matches, none, F.timestamp_seconds(F.lit(100)), b"k").first()["match_digest"]
    live = spark.createDataFrame([("c", "rule", "prompt", digest, 200), ("d", "rule", "prompt", digest, 100)], "case_id string, rule_id string, location_class string, match_digest string, t long").withColumn("expires_at", F.timestamp_seconds("t"))
    got = leakage.audit_verdict(matches.select("case_id"), leakage.audit(matches, live, F.timestamp_seconds(F.lit(100)), b"k"))
    assert {r["case_id"]: r["passed"] for r in got.collect()} == {"c": True, "d": False}


@pytest.mark.parametrize("policy", ["head", "head_tail"])
def test_truncation_against_all_candidates(policy):
    rnd = random.Random(371)
    for _ in range(60):
        text = "".join(rnd.choice("ab é.\n") for _ in range(rnd.randint(0, 90)))
        n_bytes, tokens = rnd.randint(12, 100), rnd.randint(1, 25)
        part = lambda k: text[: k - (k // 2 if policy == "head_tail" else 0)] + bundles.MARKER + (text[len(text) - k // 2 :] if policy == "head_tail" and k // 2 else "")  # noqa: B023, E731
        fits = lambda t: len(t.encode()) <= n_bytes and bundles.count_words(t) <= tokens  # noqa: B023, E731
        want = (text, False) if fits(text) else next(((part(k), True) for k in range(len(text), -1, -1) if fits(part(k))), None) if fits(bundles.MARKER) else None
        assert bundles.truncate(text, n_bytes, tokens, policy) == want


def test_budget_rolls_over(spark):
    files = spark.createDataFrame([("c", "v", "a", "x " * 3), ("c", "v", "b", "y " * 200), ("d", "v", "a", "z")], "case_id string, snapshot string, path string, content string")
    got = {(r["case_id"], r["path"]): (r["token_count"], r["truncated"]) for r in bundles.fit_budget(files, 10_000, 500, 50).collect()}
    assert got["c", "a"] == (3, False) and got["d", "a"] == (1, False) and got["c", "b"][1] and 40 < got["c", "b"][0] <= 47


def test_exact_split_is_the_optimum(spark):
    cases = [(f"c{i}", "ab"[i % 2], "xy"[i // 3 % 2], "small") for i in range(7)]
    df = spark.createDataFrame(cases, "case_id string, repository string, defect_category string, context_size_band string")

    def score(sel):
        out = 0
        for d in range(1, 4):
            for v in {c[d] for c in cases}:
                out += (sum(c[d] == v for c in cases if c[0] in sel) * 7 - sum(c[d] == v for c in cases) * 3) ** 2
        return out

    best = min(itertools.combinations([c[0] for c in cases if c[0] != "c2"], 3), key=lambda s: (score(s), hashlib.sha256(("10\n" + "\n".join(s)).encode()).hexdigest()))
    assert corpus_split.best_holdout_exact(df, 10, 3, ("c2",)) == (list(best), score(best))
    got = corpus_split.stratified_holdout(df, 10, 3)
    assert got.filter("role = 'holdout'").count() == 3 and corpus_split.check_split_input(df, df.limit(0).select("case_id"), 3).count() == 0


def test_plan_checks(spark):
    cases = spark.createDataFrame([("e", "a"), ("e", "b")], "experiment_id string, case_id string")
    plan = experiment_plan.derive_run_ids(experiment_plan.order_plan(experiment_plan.expand_plan(cases, 2), "5"), "n", "5")
    assert experiment_plan.check_plan(plan, cases, 2).count() == 0
    assert {r["rule"] for r in experiment_plan.check_plan(plan.filter("plan_pos <> 1"), cases, 2).collect()} == {"missing"}
    rows = plan.orderBy("plan_pos").collect()
    assert [r["plan_pos"] for r in rows] == list(range(1, 17)) and all(a["case_id"] == b["case_id"] and a["condition"] != b["condition"] for a, b in zip(rows[::2], rows[1::2]))


def test_responses():
    parse = ingest.parse_one
    assert parse('{"findings": []}')[:3] == ("succeeded", None, "[]")
    assert parse('{"findings": [], "findings": []}')[0] == parse('{"findings": [NaN]}')[0] == parse('{"findings": []} {}')[0] == parse(None)[0] == "invalid_output"
    assert parse('{"result": "oops", "total_cost_usd": 0.5, "modelUsage": {"m": {"inputTokens": 1, "cacheReadInputTokens": 2, "cacheCreationInputTokens": 3, "outputTokens": 4}}}') == ("invalid_output", "OUTPUT_JSON_INVALID", None, 6, 4, 0.5)


def test_contracts(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"run_id": "r", "finding_id": "a", "file_path": "../x", "start_line": 5, "end_line": 4, "severity": "odd", "confidence": 0.5}\n{"run_id": "r", "finding_id": "a", "file_path": "x", "severity": "low", "confidence": 1.0}\n')
    df = contracts.read_contract(spark, "finding", str(tmp_path / "f.jsonl"))
    empty = [f"required_{c}" for c in ("defect_category", "explanation", "failure_mechanism", "title") for _ in range(2)]
    assert sorted(r["rule"] for r in contracts.check_contract(df, "finding").collect()) == ["lines", "path", "repeated", *empty, "severity"]
    with pytest.raises(ValueError):
        contracts.require_sound(contracts.check_contract(df, "finding"))


def test_decision_history_and_agreement(spark):
    at = lambda h: F.timestamp_seconds(F.lit(h))
    rows = [("primary", "p1", "x", "match", 1, None, []), ("calibration", "k1", "x", "no_match", 2, None, []), ("resolution", "s1", "x", "symptom_only", 3, None, ["p1", "k1"]), ("primary", "p2", "y", "match", 1, None, []), ("primary", "p3", "y", "no_match", 2, "p2", []), ("calibration", "k2", "y", "no_match", 1, None, [])]
    d = spark.createDataFrame(rows, "role string, decision_id string, assignment_id string, classification string, h long, supersedes string, resolves array<string>").withColumn("decided_at", F.timestamp_seconds("h"))
    assert adjudication.check_decisions(d).count() == 0
    assert {r["rule"] for r in adjudication.check_decisions(d.withColumn("decided_at", at(5))).collect()} == {"time", "resolution"}
    items = spark.createDataFrame([("x", True, "r", "F1", "m"), ("y", True, "r", "F2", "m"), ("z", False, "r", "F3", "m")], "assignment_id string, calibration boolean, run_id string, finding_id string, mechanism_id string")
    joined = adjudication.by_assignment(items, adjudication.active_decisions(d))
    row = adjudication.agreement(joined).first()
    assert (row["completed"], row["agreements"], row["disagreements"], row["unresolved"], row["rate"]) == (2, 1, 1, 0, 0.5)
    prior = spark.createDataFrame([("old", "r", "F2", "m")], "adjudication_id string, run_id string, finding_id string, expected_mechanism_id string")
    got = {r["finding_id"]: (r["decision"], r["supersedes"]) for r in adjudication.derive_adjudications(joined, prior).collect()}
    assert got == {"F1": ("no_match", None), "F2": ("no_match", "old")}
    assert {(r["rule"], r["key"]) for r in adjudication.check_decisions_complete(joined).collect()} == {("no_primary", "z")}


def test_redaction_and_public_scan(spark):
    schema = "packet_id string, assignment_id string, title string, evidence array<struct<source_type:string,reference:string>>"
    rows = [("p", "1", "F001 and F0012 in Baseline  condition " + "a" * 40, [("file", "F0012")]), ("q", "2", "F001 stays", None), ("p", "3", None, []), ("p", "4", "it was fixed", [("a", "FIXED")])]
    df = spark.createDataFrame(rows, schema)
    ids = spark.createDataFrame([("p", "F001"), ("p", "F0012"), ("q", "F.01")], "packet_id string, finding_id string")
    out = {r["assignment_id"]: r for r in adjudication.redact(df, ["title", "evidence"], ids).collect()}
    assert out["1"]["title"].startswith("[redacted finding reference] and [redacted finding reference] in") and out["1"]["evidence"][0]["reference"] == "[redacted finding reference]"
    assert out["2"]["title"] == "F001 stays" and out["3"]["title"] is None and out["4"]["title"] == "it was fixed"
    identities = spark.createDataFrame([("q", "stays"), ("p", "it"), ("p", "")], "packet_id string, identity string")
    found = {(r["rule"], r["key"], r["detail"]) for r in adjudication.scan_blinding(df.withColumn("snapshot", F.lit("x")), ["title", "evidence"], identities).collect()}
    assert {f for f in found if f[0] != "blind_field"} == {("full_sha", "1", "title"), ("blind_label", "1", "title"), ("blind_label", "4", "evidence"), ("identity", "2", "title"), ("identity", "4", "title"), ("identity", "1", "title")} - ({("identity", "1", "title")} if "it" not in rows[0][2] else set())
    assert ("blind_field", "1", "snapshot") in found
    shown = spark.createDataFrame([("1", "a" * 40, "see src/x.py"), ("2", "https://example.org/a/b", "a/b"), ("3", "fine", "./x")], "id string, text string, model string")
    assert {(r["rule"], r["key"]) for r in report.scan_public(shown, "id", ["text", "model"]).collect()} == {("full_sha", "1"), ("repository_path", "1"), ("repository_path", "3")}
    assert [r["rule"] for r in report.scan_public(shown.withColumnRenamed("model", "path"), "id", []).collect()] == ["forbidden_field"] * 3


def test_paths_in_composed_form(spark):
    paths = ["a/b", "a/../b", "/a", "a//b", "e\u0301", "\u00e9", "", None, "a\\b"]
    got = {r["key"] for r in bundles.check_paths(spark.createDataFrame([(x,) for x in paths], "path string")).collect()}
    assert got == {"a/../b", "/a", "a//b", "e\u0301", "", "a\\b"}
