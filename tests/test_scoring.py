"""Golden cases of scoring, statistics and costs, re-derived by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from evalloom.operators import analysis, bootstrap, cost, report, run_records, scoring, stats

FINDINGS = "experiment_id string, run_id string, case_id string, snapshot string, condition string, finding_id string, file_path string, start_line int, end_line int, defect_category string, severity string, confidence double"
MECHANISMS = "case_id string, gold_version string, mechanism_id string, evaluation_role string, expect_vulnerable string, expect_fixed string, categories array<string>, severity_min string, severity_max string"
LOCATIONS = "case_id string, mechanism_id string, loc_pos int, path string, aliases array<string>, start_line int, end_line int"
RECORDS = "experiment_id string, run_id string, case_id string, snapshot string, condition string, repetition int, status string"
ADJUDICATIONS = "adjudication_id string, run_id string, finding_id string, expected_mechanism_id string, decision string, supersedes string"


def finding(run, fid, path="src/a.py", start=4, end=8, category="correctness", severity="medium", snapshot="vulnerable"):
    return ("e", run, "c", snapshot, "baseline", fid, path, start, end, category, severity, 0.5)


def tables(spark, findings, records, decisions, mechanisms=None):
    mechanisms = mechanisms or [("c", "2.0", "m1", "primary", "present", "absent", ["correctness"], "low", "high")]
    return scoring.score_experiment(
        spark.createDataFrame(records, RECORDS), spark.createDataFrame(findings, FINDINGS), spark.createDataFrame(mechanisms, MECHANISMS),
        spark.createDataFrame([("c", m[2], 0, "src/a.py", ["old/a.py"], 4, 8) for m in mechanisms], LOCATIONS), spark.createDataFrame(decisions, ADJUDICATIONS),
    )


def test_six_findings(spark):
    rows = [
        finding("r", "F001"), finding("r", "F002"), finding("r", "F003", path="old/a.py"), finding("r", "F004", start=40, end=41),
        finding("r", "F005", severity="critical"), finding("r", "F006", path="x.py", start=1, end=1, category="docs", severity="critical"),
    ]
    rows[2] = rows[2][:11] + (0.6,)
    decisions = [(f"a{i}", "r", f"F00{i}", "m1", "match" if i < 6 else "no_match", None) for i in range(1, 7)]
    out = tables(spark, rows, [("e", "r", "c", "vulnerable", "baseline", 1, "succeeded")], decisions)
    got = {r["finding_id"]: r["disposition"] for r in out["scored_findings"].collect()}
    assert got == {"F001": "matched", "F002": "duplicate", "F003": "matched", "F004": "partial", "F005": "partial", "F006": "unmatched"}
    assert out["scored_runs"].first()["primary_outcome"] is True
    assert scoring.check_scored(out).count() == 0


def test_findings_that_differ_in_text_are_no_duplicates(spark):
    rows = [finding("r", f"F{k}") + (title, [("file", ref)]) for k, title, ref in ((1, "SQL injection", "x"), (2, "Race in cache", "x"), (3, "SQL injection", "x"), (4, "SQL injection", "y"), (5, None, "x"), (6, None, "x"))]
    df = spark.createDataFrame(rows, FINDINGS + ", title string, evidence array<struct<source_type:string,reference:string>>")
    assert {r["finding_id"]: r["duplicate_of"] for r in scoring.mark_duplicates(df).collect()} == {"F1": None, "F2": None, "F3": "F1", "F4": None, "F5": None, "F6": "F5"}


def test_recovered_runs_replace_failed_ones(spark):
    base = [("e", "a", "c", "vulnerable", "baseline", 1, "timeout"), ("e", "b", "c", "vulnerable", "baseline", 2, "timeout")]
    frames = [spark.createDataFrame(x, s) for x, s in (([], FINDINGS), ([("c", "2.0", "m1", "primary", "present", "absent", ["correctness"], "low", "high")], MECHANISMS), ([], LOCATIONS), ([], ADJUDICATIONS))]
    recovery = spark.createDataFrame([base[0][:6] + ("succeeded",), base[1]], RECORDS)
    out = scoring.score_experiment(spark.createDataFrame(base, RECORDS), *frames, recovery=recovery)
    assert {r["run_id"]: r["primary_outcome"] for r in out["scored_runs"].collect()} == {"a": False, "b": None}


def test_empty_failed_and_unresolved_runs(spark):
    records = [("e", "ok", "c", "vulnerable", "baseline", 1, "succeeded"), ("e", "bad", "c", "fixed", "baseline", 1, "timeout"), ("e", "open", "c", "vulnerable", "candidate", 1, "succeeded")]
    out = tables(spark, [finding("open", "F1")], records, [])
    got = {r["run_id"]: (r["primary_outcome"], r["pessimistic_outcome"], r["optimistic_outcome"]) for r in out["scored_runs"].collect()}
    assert got == {"ok": (False, False, False), "bad": (None, True, False), "open": (None, False, True)}


def test_supplemental_does_not_touch_the_outcome(spark):
    mechanisms = [("c", "2.0", "m1", "primary", "present", "absent", ["correctness"], "low", "high"), ("c", "2.0", "m2", "supplemental", "unverified", "present", ["correctness"], "low", "high")]
    decisions = [("a", "r", "F1", "m1", "no_match", None), ("b", "r", "F1", "m2", "match", None)]
    out = tables(spark, [finding("r", "F1", snapshot="fixed")], [("e", "r", "c", "fixed", "baseline", 1, "succeeded")], decisions, mechanisms)
    assert out["scored_runs"].first()["primary_outcome"] is False
    assert {r["mechanism_id"]: r["classification"] for r in out["mechanism_outcomes"].collect()} == {"m1": "true_negative", "m2": "true_positive"}


@pytest.mark.parametrize("lines, location, hit", [((8, 9), (4, 8), True), ((9, 9), (4, 8), False), ((None, None), (4, 8), False), ((None, None), (None, None), True), ((3, None), (4, None), False), ((4, None), (4, None), True)])
def test_line_overlap(spark, lines, location, hit):
    args = [F.lit(x).cast("int") for x in (*lines, *location)]
    assert spark.range(1).select(scoring.overlaps(*args)).first()[0] is hit


def test_adjudication_log(spark):
    rows = [("a1", "r", "f", "m", "match", None), ("a2", "r", "f", "m", "no_match", "a1"), ("b", "r", "g", "m", "match", "zzz"), ("c1", "r", "h", "m", "match", "c2"), ("c2", "r", "h", "m", "match", "c1"), ("c3", "r", "h", "m", "match", None)]
    log = spark.createDataFrame(rows, ADJUDICATIONS)
    assert {r[0] for r in scoring.current_adjudications(log).select("adjudication_id").collect()} == {"a2", "b", "c3"}
    assert {(r["rule"], r["key"]) for r in scoring.check_adjudications(log).collect()} >= {("unknown_target", "b"), ("cycle", "c1"), ("cycle", "c2")}


def test_targets_and_whole_analysis(spark):
    records = [("e", "ok", "c", "vulnerable", "baseline", 1, "succeeded"), ("e", "bad", "c", "fixed", "baseline", 1, "timeout")]
    mechanisms = spark.createDataFrame([("c", "2.0", "m1", "primary", "present", "absent", ["correctness"], "low", "high"), ("c", "2.0", "m2", "supplemental", "unverified", "present", ["testing"], "low", "high")], MECHANISMS)
    records, findings = spark.createDataFrame(records, RECORDS), spark.createDataFrame([finding("ok", "F1"), finding("bad", "F2")], FINDINGS)
    log = spark.createDataFrame([("a", "ok", "F1", "m1", "match", None), ("b", "ok", "F9", "m1", "match", None), ("c", "ok", "F1", "m2", "match", None), ("d", "ok", "F1", "m3", "match", None), ("f", "bad", "F2", "m1", "match", None)], ADJUDICATIONS)
    assert {(r["rule"], r["key"]) for r in scoring.check_targets(log, records, findings, mechanisms).collect()} == {("finding", "b"), ("unverified", "c"), ("mechanism", "d"), ("run", "f")}
    locations = spark.createDataFrame([("c", "m1", 0, "src/a.py", [], None, None)], LOCATIONS)
    scored = analysis.score_combined(records.filter("run_id = 'ok'"), records.filter("run_id = 'bad'"), records, findings, mechanisms, locations, log.filter("adjudication_id = 'a'"))
    assert scored["violations"].count() == 0 and scored["scored_runs"].count() == 2
    cases = spark.createDataFrame([("repo-pr1-f1",)], "case_id string")
    more = {m: F.lit(1) for m in stats.METRICS}
    out = analysis.calculate_statistics(scored, records.withColumns(more), cases, mechanisms, 1)
    assert out["violations"].count() == 1 and out["status_counts"].filter("n = 1").count() == 2 and out["distributions"].count() == 12


def replay():
    """Two cases, two repetitions: one positive only in vulnerable/candidate, two in both vulnerable cells and fixed/candidate."""
    positive = {("one", "vulnerable", "candidate"), ("two", "vulnerable", "baseline"), ("two", "vulnerable", "candidate"), ("two", "fixed", "candidate")}
    return [("e", f"{c}{s}{k}{r}", c, s, k, r, "succeeded", *[(c, s, k) in positive] * 3) for c, s, k, r in itertools.product(("one", "two"), ("vulnerable", "fixed"), ("baseline", "candidate"), (1, 2))]


RUNS = RECORDS + ", primary_outcome boolean, pessimistic_outcome boolean, optimistic_outcome boolean"


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_paired_replay(spark, parts):
    rows = replay()
    random.Random(parts).shuffle(rows)
    runs = spark.createDataFrame(rows, RUNS).repartition(parts)
    modes = stats.to_modes(runs)
    got = {r["effect"]: (r["numerator"], r["denominator"]) for r in stats.differences(stats.outcome_counts(modes)).filter("mode = 'primary'").collect()}
    assert got == {"vulnerable_lift": (2, 4), "fixed_false_positive_increase": (2, 4), "net_useful_lift": (0, 4)}
    assert stats.check_cells(runs, 2).count() == 0 and stats.check_cells(runs.filter("repetition = 1"), 2).count() == 8
    for method in ("exact", "multinomial"):
        spans = {r["effect"]: (r["lower"], r["upper"]) for r in bootstrap.bootstrap_intervals(stats.case_effects(modes), method, 5000).filter("mode = 'primary'").collect()}
        assert spans == {"vulnerable_lift": (0, 1), "fixed_false_positive_increase": (0, 1), "net_useful_lift": (-1, 1)}
    assert {r["unresolved"] for r in stats.discordance(modes).collect()} == {0}


def test_an_unresolved_run_hides_values_but_not_counts(spark):
    rows = replay()
    rows[0] = rows[0][:7] + (None, True, False)
    modes = stats.to_modes(spark.createDataFrame(rows, RUNS))
    effects = {(r["mode"], r["effect"]): r["value"] for r in stats.differences(stats.outcome_counts(modes)).collect()}
    assert effects["primary", "vulnerable_lift"] is None and effects["primary", "net_useful_lift"] is None and effects["pessimistic", "vulnerable_lift"] == 0.25
    assert bootstrap.bootstrap_intervals(stats.case_effects(modes), "multinomial", 100).filter("mode = 'primary'").count() == 0
    assert {r["decision"] for r in report.decide(spark.createDataFrame(rows, RUNS), stats.differences(stats.outcome_counts(modes)), bootstrap.bootstrap_intervals(stats.case_effects(modes), "multinomial", 100)).collect()} == {"insufficient_evidence"}


def test_price_and_recovery(spark):
    price = spark.createDataFrame([("p", "m", 2.5, 0.25, 15.0, 1000, 2.0, 1.5)], "provider string, model string, input_rate double, cached_rate double, output_rate double, threshold_input_tokens bigint, input_multiplier double, output_multiplier double")
    rows = [("a", 1000, 100, 200), ("b", 1001, 0, 10), ("c", 5, 9, 1), ("d", None, 1, 1)]
    usage = spark.createDataFrame(rows, "id string, input_tokens long, cached_input_tokens long, output_tokens long").withColumns({"provider": F.lit("p"), "model": F.lit("m")})
    got = {r["id"]: r["usd"] and float(r["usd"]) for r in usage.join(price, ["provider", "model"]).withColumn("usd", cost.price_usage()).collect()}
    assert got == {"a": (900 * 2.5 + 100 * 0.25 + 200 * 15) / 1e6, "b": (1001 * 5 + 10 * 22.5) / 1e6, "c": None, "d": None}
    source = spark.createDataFrame([("x", "timeout", 1.0), ("y", "timeout", 1.0)], "run_id string, status string, latency_ms double")
    again = spark.createDataFrame([("x", "succeeded", 9876.0), ("y", "timeout", 2.0)], "run_id string, status string, latency_ms double")
    assert {r["run_id"]: (r["status"], r["latency_ms"], r["recovered"]) for r in run_records.overlay_recovery(source, again).collect()} == {"x": ("succeeded", 9876.0, True), "y": ("timeout", 1.0, False)}


def test_nothing_is_scored_behind_a_gate_that_fails(spark):
    frames = [spark.createDataFrame(x, s) for x, s in (([("e", "r", "c", "vulnerable", "baseline", 1, "succeeded")], RECORDS), ([], FINDINGS), ([("c", "2.0", "m1", "primary", "present", "absent", ["correctness"], "low", "high")], MECHANISMS), ([], LOCATIONS), ([], ADJUDICATIONS))]
    gates = spark.createDataFrame([("complete", "record_missing", "r2")], "gate string, rule string, key string")
    with pytest.raises(ValueError, match="record_missing"):
        scoring.score_experiment(*frames, gates=gates)
    out = scoring.score_experiment(*frames, gates=gates.limit(0))
    assert [tuple(r)[::2] for r in scoring.result_digests(out).collect()] == [("e", 1)]
