"""Scoring findings against gold mechanisms into three-valued outcomes of runs.

A run's outcome is true, false or null (unresolved); a failed run is null. Tables are keyed by run_id; gold tables by case_id.
Supplemental mechanisms never touch the primary outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.chains import endless
from evalloom.functions.digests import ordered_digest
from evalloom.operators import run_records
from evalloom.sources.contracts import require_sound
from evalloom.sources.scratch import met, stored

#: Severities from the lowest to the highest.
SEVERITIES = ("low", "medium", "high", "critical")
#: What a finding says: all of its contract but the ids.
CONTENT = ("title", "explanation", "file_path", "start_line", "end_line", "severity", "defect_category", "failure_mechanism", "confidence", "evidence")
#: Content that scoring needs for duplicates only.
TEXTS = ("title", "explanation", "failure_mechanism", "evidence")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def content_key(findings: DataFrame) -> Column:
    """SHA-256 of all that a finding says, so that texts need not be moved to be compared."""
    content = F.struct(*(c for c in CONTENT if c in findings.columns))
    return F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256)


def mark_duplicates(findings: DataFrame) -> DataFrame:
    """Adds duplicate_of: the first finding of the run that says the same in every column of ``CONTENT`` there is, null for that one itself."""
    first = F.min("finding_id").over(Window.partitionBy("run_id", "_says"))
    marked = findings.withColumn("_says", content_key(findings)).withColumn("_first", first)
    return marked.withColumn("duplicate_of", F.when(F.col("_first") != F.col("finding_id"), F.col("_first"))).drop("_says", "_first")


def overlaps(start: Column, end: Column, loc_start: Column, loc_end: Column) -> Column:
    """Inclusive overlap of line ranges: an unbounded location takes any, a bounded one needs a line, a missing end is the start."""
    finding_end, upper = F.coalesce(end, start), F.coalesce(loc_end, loc_start)
    bounded = (start <= upper) & (finding_end >= loc_start)
    return F.when(loc_start.isNull(), F.lit(True)).when(start.isNull(), F.lit(False)).otherwise(bounded)


def pack_gold(mechanisms: DataFrame, locations: DataFrame) -> DataFrame:
    """case_id, gold: a case's mechanisms as one array, each with its locations in their order (a case has few of both)."""
    place = [c for c in ("loc_pos", "path", "aliases", "start_line", "end_line")]
    packed = locations.groupBy("case_id", "mechanism_id").agg(F.array_sort(F.collect_list(F.struct(*place))).alias("locations"))
    whole = mechanisms.join(packed, ["case_id", "mechanism_id"], "left")
    return whole.groupBy("case_id").agg(F.collect_list(F.struct(*(c for c in mechanisms.columns if c != "case_id"), "locations")).alias("gold"))


def match_location(path: Column, start: Column, end: Column, locations: Column) -> Column:
    """The location that a finding meets among a mechanism's, in the row: alias (0: by its path), miss (0: lines overlap), loc_pos, path; null: none.

    Exact paths come before aliases; among candidates the first that overlaps, else the first.
    """
    at = lambda x, alias: F.struct(F.lit(alias).alias("alias"), F.when(overlaps(start, end, x["start_line"], x["end_line"]), 0).otherwise(1).alias("miss"), x["loc_pos"].alias("loc_pos"), x["path"].alias("path"))
    return F.array_min(F.transform(locations, lambda x: F.when(x["path"] == path, at(x, 0)).when(F.array_contains(x["aliases"], path), at(x, 1))))


def current_adjudications(adjudications: DataFrame) -> DataFrame:
    """Rows that no other row supersedes."""
    gone = adjudications.select(F.col("supersedes").alias("adjudication_id")).filter("adjudication_id is not null").distinct()
    return adjudications.join(gone, "adjudication_id", "left_anti")


def check_adjudications(adjudications: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Violations (rule, key, detail) of an append-only log: unknown target, changed identity, two current rows, cycle.

    A cycle is a chain of one (run, finding, mechanism) that never ends (see ``chains.endless``). ``current``: the log's current rows,
    where they have been taken already.
    """
    current = current_adjudications(adjudications) if current is None else current
    identity = ["run_id", "finding_id", "expected_mechanism_id"]
    prior = adjudications.select(F.col("adjudication_id").alias("supersedes"), *(F.col(c).alias(f"old_{c}") for c in identity), F.lit(True).alias("known"))
    linked = adjudications.filter("supersedes is not null").join(prior, "supersedes", "left")
    unknown = linked.filter("known is null").select(F.lit("unknown_target").alias("rule"), F.col("adjudication_id").alias("key"), F.col("supersedes").alias("detail"))
    moved = linked.filter(F.expr(" or ".join(f"{c} <> old_{c}" for c in identity))).select(F.lit("changed_identity").alias("rule"), F.col("adjudication_id").alias("key"), F.col("supersedes").alias("detail"))
    twice = current.groupBy(*identity).agg(F.count("*").alias("n"), F.min("adjudication_id").alias("key")).filter("n > 1").select(F.lit("two_current").alias("rule"), "key", F.col("n").cast("string").alias("detail"))
    links = linked.filter("known").filter(F.expr(" and ".join(f"{c} <=> old_{c}" for c in identity)))
    cycle = endless(links.select(F.col("adjudication_id").alias("id"), F.col("supersedes").alias("at"))).select(F.lit("cycle").alias("rule"), F.col("id").alias("key"), F.col("at").alias("detail"))
    return unknown.union(moved).union(twice).union(cycle)


def check_targets(adjudications: DataFrame, records: DataFrame, findings: DataFrame, mechanisms: DataFrame) -> DataFrame:
    """Violations: adjudications of runs that did not succeed, of findings or mechanisms that are not there, or of an unverified expectation."""
    key = F.col("adjudication_id").alias("key")
    out = adjudications.join(records.filter("status = 'succeeded'"), "run_id", "left_anti").select(F.lit("run").alias("rule"), key)
    there = findings.select("run_id", "finding_id", "case_id", "snapshot")
    out = out.union(adjudications.join(there, ["run_id", "finding_id"], "left_anti").select(F.lit("finding"), key))
    expected = F.when(F.col("snapshot") == "vulnerable", F.col("expect_vulnerable")).otherwise(F.col("expect_fixed"))
    gold = mechanisms.select("case_id", F.col("mechanism_id").alias("expected_mechanism_id"), "expect_vulnerable", "expect_fixed")
    aimed = adjudications.join(there, ["run_id", "finding_id"]).join(gold, ["case_id", "expected_mechanism_id"], "left")
    rule = F.when(F.col("expect_fixed").isNull(), "mechanism").when(expected == "unverified", "unverified")
    return out.union(aimed.withColumn("rule", rule).filter("rule is not null").select("rule", key))


def mechanism_disposition(expected: Column, decision: Column, all_checks: Column) -> Column:
    return (
        F.when(expected == "unverified", "unscored")
        .when(decision.isin("uncertain", "unadjudicated"), "unresolved")
        .when(expected == "absent", F.when(decision == "match", "unexpected_claim").otherwise("unrelated"))
        .when(decision != "match", "unmatched")
        .otherwise(F.when(all_checks, "expected_match").otherwise("partial"))
    )


def score_pairs(findings: DataFrame, mechanisms: DataFrame, locations: DataFrame, adjudications: DataFrame) -> DataFrame:
    """A row for each finding and mechanism of its case, with matches, decision and disposition; written to the shared folder.

    findings carry case_id and snapshot; mechanisms: categories array; locations: aliases array. Adjudications may carry the case_id of
    their finding: all of a case then meets in one exchange. Which decisions are superseded is told among those of a finding; only if
    some row supersedes one of another finding are the current ones taken from the whole log first.
    """
    pairs = stored(_pairs(findings, mechanisms, locations, adjudications), "pairs")
    if not pairs.filter("elsewhere is not null").isEmpty():
        pairs = stored(_pairs(findings, mechanisms, locations, current_adjudications(adjudications).withColumn("supersedes", F.lit(None).cast("string"))), "pairs")
    return pairs.filter("mechanism_id is not null and told").drop("told", "elsewhere")


def _pairs(findings: DataFrame, mechanisms: DataFrame, locations: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Pairs, with ``elsewhere`` set where a decision supersedes one that is not its finding's; such rows are there without a finding or mechanism too."""
    whole = [c for c in findings.columns if c not in TEXTS]
    home = "case_id" if "case_id" in adjudications.columns else "run_id"
    keys = list(dict.fromkeys((home, "run_id", "finding_id")))
    says = F.unhex(F.substr(content_key(findings), F.lit(1), F.lit(32)))  # half of the digest: findings of one run are told apart
    own = [c for c in whole if c not in keys]
    told = findings.select(*keys, says.alias("says"), F.struct(*own).alias("f"))
    decided = adjudications.select(*keys, F.struct("adjudication_id", "supersedes", F.col("expected_mechanism_id").alias("mechanism_id"), "decision").alias("d"))
    # findings and decisions meet in the partitions of their cases (or runs), and stay there
    rows = told.unionByName(decided, allowMissingColumns=True).repartition(home)
    rows = rows.withColumn("log", F.collect_list("d").over(Window.partitionBy(*keys)))
    rows = rows.withColumn("gone", F.array_compact(F.transform("log", lambda d: d["supersedes"])))
    rows = rows.withColumn("elsewhere", F.when(F.size("gone") > 0, F.when(F.size(F.array_except("gone", F.transform("log", lambda d: d["adjudication_id"]))) > 0, True)))
    rows = rows.filter("f is not null or elsewhere")
    current = F.when(F.size("gone") == 0, F.col("log")).otherwise(F.filter("log", lambda d: ~F.coalesce(F.array_contains("gone", d["adjudication_id"]), F.lit(False))))
    rows = rows.withColumn("first", F.min("finding_id").over(Window.partitionBy(*keys[:-1], "says")))
    rows = rows.select(*keys, "f.*", "elsewhere", current.alias("decisions"), F.when(F.col("first") != F.col("finding_id"), F.col("first")).alias("duplicate_of"), F.col("f").isNotNull().alias("told"))
    # what is found of a mechanism is made in its element of the array, once: columns that name each other would make it again each time
    of = lambda m: F.get(F.filter("decisions", lambda d: d["mechanism_id"] == m["mechanism_id"]), F.lit(0))["decision"]
    named = [c for c in mechanisms.columns if c != "case_id"]
    judged = lambda m: F.struct(*(m[c].alias(c) for c in named), match_location(F.col("file_path"), F.col("start_line"), F.col("end_line"), m["locations"]).alias("at"), of(m).alias("decision"))
    pairs = rows.join(met(pack_gold(mechanisms, locations)), "case_id", "left").withColumn("m", F.explode_outer(F.transform("gold", judged))).filter("m is not null and told or elsewhere")
    path = F.when(F.col("m.at").isNull(), "none").when(F.col("m.at.alias") == 0, "exact").otherwise("alias")
    overlap = F.coalesce(F.col("m.at.miss") == 0, F.lit(False))
    pairs = pairs.select(*whole, "told", "elsewhere", "duplicate_of", *(f"m.{c}" for c in named), path.alias("path_match"), F.col("m.at.path").alias("accepted_path"), overlap.alias("location_match"), F.coalesce("m.decision", F.lit("unadjudicated")).alias("decision"))
    rank = severity_rank(F.col("severity"))
    pairs = pairs.withColumns({
        "expected_status": F.when(F.col("snapshot") == "vulnerable", F.col("expect_vulnerable")).otherwise(F.col("expect_fixed")),
        "category_match": F.coalesce(F.array_contains("categories", F.col("defect_category")), F.lit(False)),
        "severity_match": F.coalesce(rank.between(severity_rank(F.col("severity_min")), severity_rank(F.col("severity_max"))), F.lit(False)),
    })
    pairs = pairs.withColumn("all_checks", (F.col("path_match") != "none") & F.col("location_match") & F.col("category_match") & F.col("severity_match"))
    return pairs.withColumn("disposition", mechanism_disposition(F.col("expected_status"), F.col("decision"), F.col("all_checks")))


def score_findings(pairs: DataFrame) -> DataFrame:
    """A row for each finding: its checks are those of the first primary mechanism."""
    primary = pairs.filter("evaluation_role = 'primary'")
    keys = ["experiment_id", "run_id", "condition", "snapshot", "finding_id"]
    checks = F.struct("duplicate_of", "path_match", "accepted_path", "location_match", "category_match", "severity_match", "all_checks")
    rows = primary.groupBy(*keys).agg(
        F.min_by(checks, "mechanism_id").alias("c"),
        F.bool_or(F.col("decision") == "match").alias("matched"),
        F.every(F.col("decision") == "no_match").alias("none"),
    )
    some = (F.col("c.path_match") != "none") | F.col("c.location_match") | F.col("c.category_match") | F.col("c.severity_match") | F.col("matched")
    disposition = (
        F.when(F.col("c.duplicate_of").isNotNull(), "duplicate")
        .when(F.col("matched") & (F.col("snapshot") == "fixed"), "repaired_mechanism_claim")
        .when(F.col("matched") & F.col("c.all_checks"), "matched")
        .when((F.col("snapshot") == "fixed") & F.col("none") & ~F.col("c.all_checks"), "unrelated")
        .when(some, "partial")
        .otherwise("unmatched")
    )
    return rows.select(*keys, "c.*", "matched", disposition.alias("disposition"))


def classified(expected: Column, status: Column) -> Column:
    """Class of a mechanism in a run from the flags expected_match, unexpected_claim and unresolved of its findings (null: none)."""
    is_set = lambda c: F.coalesce(c, F.lit(False))
    hit, clean = F.when(expected == "present", F.lit("true_positive")).otherwise("false_positive"), F.when(expected == "present", F.lit("false_negative")).otherwise("true_negative")
    found = is_set(F.when(expected == "present", F.col("expected_match")).otherwise(F.col("unexpected_claim")))
    return F.when(expected == "unverified", "unverified").when(status != "succeeded", "unresolved").when(found, hit).when(is_set(F.col("unresolved")), "unresolved").otherwise(clean)


def mechanism_outcomes(records: DataFrame, mechanisms: DataFrame, pairs: DataFrame) -> DataFrame:
    """classification of every (run, mechanism); findings that are duplicates count not; a failed run is unresolved. Pairs have their run's case_id."""
    said = ("expected_match", "unexpected_claim", "unresolved")
    flags = pairs.filter(F.col("duplicate_of").isNull() & F.col("disposition").isin(*said)).select("case_id", "run_id", F.struct("mechanism_id", "disposition").alias("s"))
    run = ("experiment_id", "snapshot", "condition", "repetition", "status")
    # runs and what was said in them meet by case, as mechanisms do, and outcomes of runs are made there
    rows = records.select("case_id", "run_id", F.struct(*run).alias("r")).unionByName(flags, allowMissingColumns=True).repartition("case_id")
    rows = rows.withColumn("said", F.collect_set("s").over(Window.partitionBy("case_id", "run_id"))).filter("r is not null").select("case_id", "run_id", "r.*", "said")
    rows = rows.join(met(mechanisms.select("case_id", "gold_version", "mechanism_id", "evaluation_role", "expect_vulnerable", "expect_fixed")), "case_id")
    rows = rows.withColumns({d: F.array_contains("said", F.struct("mechanism_id", F.lit(d).alias("disposition"))) for d in said})
    expected = F.when(F.col("snapshot") == "vulnerable", F.col("expect_vulnerable")).otherwise(F.col("expect_fixed"))
    classification = classified(expected, F.col("status"))
    return rows.select("experiment_id", "run_id", "case_id", "snapshot", "condition", "repetition", "status", "gold_version", "mechanism_id", "evaluation_role", expected.alias("expected_status"), classification.alias("classification"))


def run_outcomes(outcomes: DataFrame, pairs: DataFrame) -> DataFrame:
    """primary, pessimistic and optimistic outcome of every run; null is unresolved.

    Gold 2.0: the primary mechanism's class decides. Gold 1.x: checks and match need only occur on one finding, over all mechanisms.
    """
    keys = ["experiment_id", "run_id", "case_id", "snapshot", "condition", "repetition", "status"]
    primary = F.col("evaluation_role") == "primary"
    rows = outcomes.groupBy(*keys, "gold_version").agg(F.max(F.when(primary, F.col("classification"))).alias("class"), F.max(F.when(primary, F.col("expected_status"))).alias("expected"))
    old_pairs = pairs.filter("duplicate_of is null and gold_version < '2.0'")
    if old_pairs.isEmpty():  # then nothing is moved for them
        rows = rows.withColumns({c: F.lit(None).cast("boolean") for c in ("hit", "open")})
    else:
        legacy = old_pairs.groupBy("run_id", "finding_id", "snapshot").agg(F.bool_or(F.col("decision") == "match").alias("m"), F.min_by("all_checks", "mechanism_id").alias("c"), F.bool_or(F.col("decision").isin("uncertain", "unadjudicated")).alias("o"))
        legacy = legacy.groupBy("run_id").agg(F.bool_or(F.col("m") & ((F.col("snapshot") == "fixed") | F.col("c"))).alias("hit"), F.bool_or("o").alias("open"))
        rows = rows.join(legacy, "run_id", "left")
    new = F.when(F.col("class").isin("true_positive", "false_positive"), True).when(F.col("class") == "unresolved", F.lit(None)).otherwise(False)
    old = F.when(F.col("hit"), True).when(F.col("open"), F.lit(None)).otherwise(False)
    value = F.when(F.col("status") != "succeeded", F.lit(None).cast("boolean")).when(F.col("gold_version") >= "2.0", new).otherwise(old)
    absent = F.when(F.col("gold_version") >= "2.0", F.col("expected") == "absent").otherwise(F.col("snapshot") == "fixed")
    present = F.when(F.col("gold_version") >= "2.0", F.col("expected") == "present").otherwise(F.col("snapshot") == "vulnerable")
    rows = rows.withColumn("primary_outcome", value)
    return rows.select(*keys, "primary_outcome", F.coalesce("primary_outcome", absent).alias("pessimistic_outcome"), F.coalesce("primary_outcome", present).alias("optimistic_outcome"))


def check_experiment(plan: DataFrame, records: DataFrame, gold: DataFrame, findings: DataFrame, mechanisms: DataFrame, adjudications: DataFrame, identity: list[str], terminal: Column | None = None) -> DataFrame:
    """All that must be sound before scoring, as violations (gate, rule, key).

    complete: one record for each planned run, one gold record for each planned case; terminal: records are the last of their
    run (``terminal``: see run_records.is_terminal); identity: records agree with the plan in the columns ``identity``;
    gold: no mix of gold 2.0 with earlier versions; adjudication: a sound log; target: current decisions are on runs,
    findings and mechanisms that are there. Inputs are read several times, so they should be stored.
    """
    gate = lambda name, df: df.select(F.lit(name).alias("gate"), "rule", "key")
    out = gate("complete", run_records.check_complete(plan, records, gold)).union(gate("identity", run_records.check_identity(records, plan, identity)))
    if terminal is not None:
        out = out.union(records.filter(~terminal).select(F.lit("terminal"), F.lit("not_last"), "run_id"))
    mixed = gold.groupBy("experiment_id").agg(F.count_if(F.col("gold_version") == "2.0").alias("new"), F.count("*").alias("n")).filter("new > 0 and new < n")
    out = out.union(mixed.select(F.lit("gold"), F.lit("mixed_versions"), "experiment_id"))
    current = stored(current_adjudications(adjudications), "current")
    return out.union(gate("adjudication", check_adjudications(adjudications, current))).union(gate("target", check_targets(current, records, findings, mechanisms)))


#: The order of scored runs.
RUN_ORDER = ("case_id", "repetition", "snapshot", "condition", "run_id")


def result_digests(tables: dict[str, DataFrame]) -> DataFrame:
    """experiment_id, digest, n: of each experiment's scored runs in RUN_ORDER, with their statuses and outcomes."""
    line = F.to_json(F.struct("run_id", "status", "primary_outcome", "pessimistic_outcome", "optimistic_outcome"), {"ignoreNullFields": "false"})
    return ordered_digest(tables["scored_runs"], ["experiment_id"], list(RUN_ORDER), line)


def score_experiment(records: DataFrame, findings: DataFrame, mechanisms: DataFrame, locations: DataFrame, adjudications: DataFrame, recovery: DataFrame | None = None, gates: DataFrame | None = None) -> dict[str, DataFrame]:
    """scored_pairs, scored_findings, mechanism_outcomes and scored_runs of one or many experiments.

    Records of ``recovery`` that succeeded replace their run's. The pairs are written to the shared folder, as all else is
    made from them. ``gates`` are the violations of ``check_experiment``: if there are any, nothing is scored.
    """
    if gates is not None:
        require_sound(gates)
    if recovery is not None:
        records = run_records.overlay_recovery(records, recovery)
    pairs = score_pairs(findings, mechanisms, locations, adjudications)
    outcomes = mechanism_outcomes(records, mechanisms, pairs)
    return {"scored_pairs": pairs, "scored_findings": score_findings(pairs), "mechanism_outcomes": outcomes, "scored_runs": run_outcomes(outcomes, pairs)}


def check_scored(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations (rule, key) of stored scored tables against what follows from their evidence. They are read many times, so they must not be plans yet.

    disposition and finding: of pairs and findings; path: an accepted path without a match or the reverse; duplicate: a
    target that is not an earlier finding of the run; failed: a failed run with an outcome or findings; bounds: of resolved
    and unresolved runs; primary: not one primary mechanism in a run; labels: a pair whose role or expectation is not its
    outcome's; class and outcome: of mechanisms and runs; mechanism_set: sets that differ within a case; cover: findings
    without a pair for each mechanism of their run.
    """
    pairs, runs, outcomes, findings = (tables[t] for t in ("scored_pairs", "scored_runs", "mechanism_outcomes", "scored_findings"))
    c, run, mechanism = F.col, ["run_id"], ["run_id", "mechanism_id"]
    out = []

    def add(rule: str, rows: DataFrame, *key: str) -> None:
        out.append(rows.select(F.lit(rule).alias("rule"), F.concat_ws("/", *key).alias("key")))

    pair = ("run_id", "finding_id", "mechanism_id")
    add("disposition", pairs.filter(~c("disposition").eqNullSafe(mechanism_disposition(c("expected_status"), c("decision"), c("all_checks")))), *pair)
    add("path", pairs.filter((c("path_match") == "none") != c("accepted_path").isNull()), *pair)
    add("duplicate", pairs.select("run_id", "finding_id", "duplicate_of").distinct().filter("duplicate_of >= finding_id"), "run_id", "finding_id")
    there = pairs.select("run_id", c("finding_id").alias("duplicate_of")).distinct()
    add("duplicate", findings.filter("duplicate_of is not null").join(there, ["run_id", "duplicate_of"], "left_anti"), "run_id", "finding_id")
    want = score_findings(pairs).select("run_id", "finding_id", c("disposition").alias("want"))
    add("finding", findings.join(want, ["run_id", "finding_id"]).filter("not disposition <=> want"), "run_id", "finding_id")
    failed = runs.filter("status <> 'succeeded'")
    add("failed", failed.filter("primary_outcome is not null"), "run_id")
    add("failed", findings.join(failed.select("run_id"), "run_id", "left_semi"), "run_id", "finding_id")
    primary = outcomes.filter("evaluation_role = 'primary'").groupBy("run_id").agg(F.count("*").alias("n"), F.first("expected_status").alias("expected"), F.first("classification").alias("class"), F.first("gold_version").alias("version"))
    add("primary", runs.join(primary, "run_id", "left").filter("coalesce(n, 0) <> 1"), "run_id")
    judged = runs.join(primary.filter("version >= '2.0'"), "run_id")
    value = F.when(c("status") != "succeeded", F.lit(None)).when(c("class").isin("true_positive", "false_positive"), True).when(c("class") == "unresolved", F.lit(None)).otherwise(False)
    add("outcome", judged.filter(~c("primary_outcome").eqNullSafe(value)), "run_id")
    low, high = F.coalesce("primary_outcome", c("expected") == "absent"), F.coalesce("primary_outcome", c("expected") == "present")
    add("bounds", judged.filter(~c("pessimistic_outcome").eqNullSafe(low) | ~c("optimistic_outcome").eqNullSafe(high)), "run_id")
    labels = pairs.join(outcomes.select(*mechanism, c("evaluation_role").alias("role"), c("expected_status").alias("expected")), mechanism, "left")
    add("labels", labels.filter(~c("evaluation_role").eqNullSafe(c("role")) | ~c("expected_status").eqNullSafe(c("expected"))), *pair)
    flags = pairs.filter("duplicate_of is null").groupBy(*mechanism).agg(*(F.bool_or(c("disposition") == d).alias(d) for d in ("expected_match", "unexpected_claim", "unresolved")))
    rows = outcomes.join(flags, mechanism, "left")
    add("class", rows.filter(c("classification") != classified(c("expected_status"), c("status"))), "run_id", "mechanism_id")
    sets = outcomes.groupBy("case_id", *run).agg(F.array_sort(F.collect_set("mechanism_id")).alias("set")).groupBy("case_id").agg(F.count_distinct("set").alias("n")).filter("n > 1")
    add("mechanism_set", sets, "case_id")
    of_run = outcomes.groupBy("run_id").agg(F.count("*").alias("wanted"))
    add("cover", pairs.groupBy("run_id", "finding_id").agg(F.count_distinct("mechanism_id").alias("n")).join(of_run, "run_id", "left").filter("not n <=> wanted"), "run_id", "finding_id")
    found = out[0]
    for rows in out[1:]:
        found = found.union(rows)
    return found
