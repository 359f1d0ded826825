"""Plans that hold at size: what is moved, and what is sent to all tasks."""

from pyspark.sql import functions as F

from evalloom.operators import adjudication, bootstrap, scoring, stats
from evalloom.operators import experiment_plan as plans
from evalloom.plans import scoring_queries
from evalloom.plans.demo import view

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_views_wait_for_no_subquery(spark):
    assert "subquery" not in plan_of(view(spark, SMALL, "findings")).lower()


def test_plan_checks_join_nothing(spark):
    cases = spark.createDataFrame([("e", f"c{k}", "r") for k in range(5)] + [("e", None, "r")], "experiment_id string, case_id string, role string")
    plan = plans.derive_run_ids(plans.expand_plan(cases, 2), "ns", F.col("experiment_id"))
    odd = plan.filter("case_id = 'c1' and repetition = 1 and snapshot = 'fixed'")
    bad = plan.filter("not (case_id = 'c0' and condition = 'baseline')").union(odd).union(odd.withColumn("repetition", F.lit(9))).union(odd.withColumn("repetition", F.lit(9)))
    found = plans.check_plan(bad, cases, 2)
    assert "Join" not in plan_of(found)
    n = {r["rule"]: r["n"] for r in found.filter("rule in ('missing', 'extra', 'repeated_cell')").groupBy("rule").agg(F.count("*").alias("n")).collect()}
    assert n == {"missing": 4 + 8, "extra": 4 + 4, "repeated_cell": 4}  # a case without an id is like no other


def test_resamples_send_no_case_to_all_tasks(spark):
    rows = [("e", m, f"c{k:03}", float(k % 3), 1.0, float(k % 3) - 1.0) for k in range(300) for m in ("primary", "optimistic")] + [("f", "primary", "c", None, None, None)]
    effects = spark.createDataFrame(rows, "experiment_id string, mode string, case_id string, vulnerable_lift double, fixed_false_positive_increase double, net_useful_lift double")
    found = bootstrap.bootstrap_intervals(effects, "hash", resamples=20, seed=7)
    assert "BroadcastHashJoin [experiment_id" not in plan_of(found).split("i#")[0] and "ShuffledHashJoin" in plan_of(found)
    got = {(r["mode"], r["effect"]): (r["lower"], r["upper"]) for r in found.collect()}
    assert len(got) == 6 and got["primary", "fixed_false_positive_increase"] == (1.0, 1.0) and got["primary", "net_useful_lift"] == got["optimistic", "net_useful_lift"]


def test_scored_runs_meet_by_case(spark):
    found = scoring_queries.run_outcomes(spark, SMALL)
    plan = plan_of(found)
    assert "hashpartitioning(run_id" not in plan and "hashpartitioning(experiment_id" not in plan  # runs and outcomes stay where their case is


def test_decisions_that_supersede_those_of_another_finding(spark):
    findings = spark.createDataFrame([("e", "r", "c", "vulnerable", "baseline", f"F{k}", "a", k, k, "x", "low", 0.5) for k in (1, 2, 3)], "experiment_id string, run_id string, case_id string, snapshot string, condition string, finding_id string, file_path string, start_line int, end_line int, defect_category string, severity string, confidence double")
    mechanisms = spark.createDataFrame([("c", "2.0", "m1", "primary", "present", "absent", ["x"], "low", "high")], "case_id string, gold_version string, mechanism_id string, evaluation_role string, expect_vulnerable string, expect_fixed string, categories array<string>, severity_min string, severity_max string")
    locations = spark.createDataFrame([("c", "m1", 0, "a", [], 1, 9)], "case_id string, mechanism_id string, loc_pos int, path string, aliases array<string>, start_line int, end_line int")
    log = [("1", "F1", "match", None), ("1b", "F1", "no_match", "1"), ("2", "F2", "match", None), ("3", "F3", "match", None)]
    for more, want in (([], ["no_match", "match", "match"]), ([("9", "F9", "match", "2"), ("3b", "F1", "match", "3")], None)):
        rows = [(i, "c", "r", f, "m1", d, s) for i, f, d, s in log + more]
        decided = spark.createDataFrame(rows, "adjudication_id string, case_id string, run_id string, finding_id string, expected_mechanism_id string, decision string, supersedes string")
        for df in (decided, decided.drop("case_id")):
            got = {r["finding_id"]: r["decision"] for r in scoring.score_pairs(findings, mechanisms, locations, df).collect()}
            assert list(got) and sorted(got) == ["F1", "F2", "F3"]
            assert [got[f] for f in ("F1", "F2", "F3")] == want if want else (got["F2"], got["F3"]) == ("unadjudicated", "unadjudicated")


def test_calibration_moves_no_packet_as_a_whole(spark):
    items = spark.range(3000).selectExpr("case when id < 2990 then 'big' else 'small' end as packet", "cast(id as string) as assignment_id")
    found = adjudication.shuffle_and_calibrate(items, "packet", F.col("packet"), 40)
    assert "Exchange hashpartitioning(packet" not in plan_of(found) and "Window" not in plan_of(found)
    rows = found.collect()
    for packet, n in (("big", 40), ("small", 10)):
        own = sorted((r for r in rows if r["packet"] == packet), key=lambda r: r["order_hash"])
        assert [r["calibration"] for r in own] == [k < n for k in range(len(own))]
    assert not adjudication.shuffle_and_calibrate(items, "packet", F.col("packet"), 0).filter("calibration").count()


def test_intervals_read_their_effects_once(spark):
    from evalloom.operators import bootstrap

    rows = [("e", m, f"c{i}", x, 0.0, x) for m in ("primary", "optimistic") for i, x in enumerate((0.5, -0.5, None if m == "primary" else 1.0))]
    effects = spark.createDataFrame(rows, "experiment_id string, mode string, case_id string, vulnerable_lift double, fixed_false_positive_increase double, net_useful_lift double")
    got = bootstrap.bootstrap_intervals(effects, "convolution")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert {r["mode"] for r in got.collect()} == {"optimistic"}


def test_runs_are_counted_before_they_meet_tags(spark):
    cells = [(s, c) for s in ("vulnerable", "fixed") for c in ("baseline", "candidate")]
    rows = [("e", case, s, c, r, "primary", None if (case, r) == ("y", 3) else (r + len(s) + len(c)) % 2 == 0) for case in ("x", "y") for s, c in cells for r in (1, 2, 3)]
    modes = spark.createDataFrame(rows, "experiment_id string, case_id string, snapshot string, condition string, repetition int, mode string, outcome boolean")
    tags = spark.createDataFrame([("x", "repository", "a"), ("x", "category", "p"), ("x", "category", "q"), ("y", "repository", "a")], "case_id string, dimension string, value string")
    for got, whole in ((stats.breakdown_counts(modes, tags), stats.outcome_counts), (stats.breakdown_discordance(modes, tags), stats.discordance)):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" in plan.split("Join")[-1]
        want = whole(modes.join(tags.withColumnRenamed("value", "tag"), "case_id"), "dimension", "tag")
        assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_findings_are_dealt_by_case_once(spark):
    plan = plan_of(view(spark, SMALL, "findings"))
    assert "Exchange hashpartitioning(run_no" not in plan and plan.count("REPARTITION_BY_COL") == 1
    assert "l_suppkey" not in scoring_queries.scored(spark, SMALL)["scored_pairs"].columns


def test_gates_read_stored_inputs(spark):
    plan = plan_of(scoring_queries.scoring_gates(spark, SMALL))
    assert "NestedLoop" not in plan and "sf0.001" not in plan  # no view is made again for each gate that reads it


def test_scored_tables_are_stored_before_they_are_checked(spark):
    assert "sf0.001" not in plan_of(scoring_queries.scored_violations(spark, SMALL))


def test_decisions_meet_by_assignment(spark):
    import random

    schema = "role string, decision_id string, assignment_id string, classification string, h long, supersedes string, resolves array<string>"
    rnd, name = random.Random(5), lambda k: f"d{k}"
    rows = []
    for k in range(400):
        role = rnd.choice(["primary", "calibration", "resolution", "primary", None])
        near = [name(j) for j in range(max(0, k - 6), k + 2)]
        rows.append((role, name(k), rnd.choice([f"a{k // 4}"] * 8 + [f"a{rnd.randrange(100)}", None]), "match", k + rnd.randint(-3, 3), rnd.choice([None] * 3 + [rnd.choice(near), "nowhere"]), rnd.sample(near, 2) if role == "resolution" else rnd.choice([[], None])))
    rows += [("primary", "alone", "z", "match", 1, None, []), ("calibration", "thief", "a0", "match", 2, "alone", [])]  # its leaf is taken from another assignment
    rows += [(r, f"{r}-{k}", f"s{k}", "match", k, None, ["primary-" + str(k), "calibration-" + str(k)] if r == "resolution" else []) for k in range(9) for r in ("primary", "calibration", "resolution")]
    sound = lambda rows: spark.createDataFrame(rows, schema).withColumn("decided_at", F.timestamp_seconds("h"))
    whole = [r for r in rows if r[2] is not None]
    for some in (whole, whole[:50], rows[-27:], [*whole, ("primary", "d7", "a9", "match", 1, None, [])]):
        got, want = (sorted(map(tuple, f(sound(some)).collect()), key=str) for f in (adjudication.check_decisions, adjudication._check_decisions_by_id))
        assert got == want and got
    every = {r["rule"] for r in adjudication.check_decisions(sound(whole)).collect()}
    assert every == {"unknown_target", "foreign_target", "time", "fork", "chain", "resolution"}
    assert "Exchange hashpartitioning(decision_id" not in plan_of(adjudication.check_decisions(sound(whole)))  # the history is not joined by id
    assert {(r["rule"], r["key"]) for r in adjudication.check_decisions(sound(rows)).collect()} >= {("chain", "primary/z")}


def test_items_and_decisions_move_once(spark):
    items = spark.createDataFrame([("x", True, "r"), ("y", False, "r"), ("z", False, "r"), (None, False, "r")], "assignment_id string, calibration boolean, run_id string")
    rows = [("primary", "p", "x"), ("calibration", "k", "x"), ("resolution", "s", "x"), ("primary", "no item", None), ("primary", "q", "y"), ("primary", "q2", "y"), ("primary", "lost", "w")]
    active = spark.createDataFrame(rows, "role string, decision_id string, assignment_id string").withColumns({"classification": F.lit("match"), "decided_at": F.timestamp_seconds(F.lit(1)), "resolves": F.expr("case when role = 'resolution' then array('p', 'k') else array('p') end")})
    joined = adjudication.by_assignment(items, active)
    plan = plan_of(joined)
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(assignment_id") == 1
    got = sorted(((r["assignment_id"], r["is_calibration"], r["run_id"], *(r[c] and r[c]["decision_id"] for c in ("primary", "calibration", "resolution"))) for r in joined.collect()), key=str)
    assert got == [("x", True, "r", "p", "k", "s"), ("y", False, "r", "q", None, None), ("y", False, "r", "q2", None, None), ("z", False, "r", None, None, None), (None, False, "r", None, None, None)]


def test_a_location_is_sought_once_for_each_pair(spark):
    pairs = scoring_queries.scored(spark, SMALL)["scored_pairs"]
    assert pairs.count() and "sf0.001" not in plan_of(pairs)
    rows = spark.createDataFrame([("a", 5, 6), ("b", 9, 9), ("old", 1, 1), ("x", 1, 1), (None, 1, 1)], "path string, s int, e int")
    at = "array(named_struct('loc_pos', 0, 'path', 'a', 'aliases', array('old', 'b'), 'start_line', 8, 'end_line', 9), named_struct('loc_pos', 1, 'path', 'a', 'aliases', array('old'), 'start_line', 5, 'end_line', null), named_struct('loc_pos', 2, 'path', 'b', 'aliases', array(), 'start_line', 1, 'end_line', 2))"
    got = rows.select("path", scoring.match_location(F.col("path"), F.col("s"), F.col("e"), F.expr(at)).alias("m")).collect()
    assert {r["path"]: r["m"] and tuple(r["m"]) for r in got} == {"a": (0, 0, 1, "a"), "b": (0, 1, 2, "b"), "old": (1, 1, 0, "a"), "x": None, None: None}
