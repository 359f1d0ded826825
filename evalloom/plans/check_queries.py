"""Queries of the checks and of smaller operators over demonstration inputs with faults, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalloom.operators import adjudication, bundles, corpus_split, cost, discovery, leakage, run_records
from evalloom.operators import experiment_plan as plans
from evalloom.plans.demo import view, with_views
from evalloom.plans.text_queries import read
from evalloom.sources import contracts, documents
from evalloom.sources.scratch import shared_dir, stored

_AT = "timestamp '2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, {h}, 0, 0)"


def _noted(spark, sf_dir):
    """Findings as packet items, a packet for each case, with notes that disclose something; findings are stored, as several results read them."""
    note = """case l_suppkey % 11 when 0 then 'Seen in the  Vulnerable snapshot' when 1 then 'It was fixed yesterday' when 2 then 'FIXED' when 3 then repeat('ab12', 10) when 4 then concat('as in ', case_id, '.') else 'plain' end"""
    findings = stored(view(spark, sf_dir, "findings").select("run_id", "finding_id", "case_id", "l_suppkey"), "findings")
    return findings.selectExpr("concat(run_id, '/', finding_id) as assignment_id", "case_id as packet_id", "finding_id as id", f"{note} as note", "concat('see ', finding_id, ', F1000 and F10010') as title", "array(named_struct('source_type', 'file', 'reference', concat('x ', finding_id))) as evidence")


def redacted_items(spark, sf_dir):
    items = _noted(spark, sf_dir)
    ids = items.select("packet_id", F.col("id").alias("finding_id"))
    return adjudication.redact(items.drop("id", "note"), ["title", "evidence"], ids).select("assignment_id", "title", F.col("evidence")[0]["reference"].alias("reference"))


def blinding_violations(spark, sf_dir):
    items = _noted(spark, sf_dir)
    identities = items.select("packet_id", F.col("packet_id").alias("identity")).distinct()
    return adjudication.scan_blinding(items.select("assignment_id", "packet_id", "note", "evidence"), ["note", "evidence"], identities)


def _rubrics(spark, sf_dir):
    return view(spark, sf_dir, "mechanisms").select("case_id", "mechanism_id", F.concat(F.lit("severity "), "severity_min").alias("adjudication_rubric"))


def rubric_violations(spark, sf_dir):
    """Approvals that are missing, of another rubric set, without an approver, or late."""
    sets = adjudication.rubric_sets(adjudication.rubric_bindings(_rubrics(spark, sf_dir)))
    part = view(spark, sf_dir, "cases").select("case_id", (F.col("p_partkey") % 17).alias("k"))
    approvals = sets.join(part, "case_id").filter("k <> 0").selectExpr("case_id", "case when k = 1 then 'sha256:other' else rubric_set_digest end as rubric_set_digest", "case when k <> 2 then 'approver' end as approved_by", f"{_AT.format(h='k')} as approved_at", f"{_AT.format(h='12')} as exported_at")
    records = view(spark, sf_dir, "records").selectExpr("case_id", "snapshot", "repetition", f"{_AT.format(h='14')} as ended_at")
    return adjudication.check_rubric_approval(approvals, sets, records)


def stale_bindings(spark, sf_dir):
    """Stored rubric digests, after some rubrics changed and some went."""
    named = lambda df: df.withColumn("assignment_id", F.concat_ws("/", "case_id", "mechanism_id")).select("assignment_id", "rubric_digest")
    before = _rubrics(spark, sf_dir)
    after = before.filter("mechanism_id = 'm1' or adjudication_rubric <> 'severity low'").withColumn("adjudication_rubric", F.expr("case when case_id like '%7-f001' then 'new' else adjudication_rubric end"))
    return adjudication.check_bindings(named(adjudication.rubric_bindings(before)), named(adjudication.rubric_bindings(after)), ["rubric_digest"])


def batch_violations(spark, sf_dir):
    """A batch of primary decisions and resolutions that does not quite fit what is current."""
    rows = view(spark, sf_dir, "plan").selectExpr("run_id as assignment_id", "run_no")
    decide = lambda role, h, cls: rows.selectExpr(f"'{role}' as role", "assignment_id", f"concat('{role}-', assignment_id) as decision_id", f"{cls} as classification", f"{_AT.format(h=h)} as decided_at", "run_no")
    active = decide("primary", 1, "'match'").unionByName(decide("calibration", 2, "case when run_no % 5 = 0 then 'match' else 'no_match' end"))
    before = decide("resolution", 4, "'match'").filter("run_no % 23 = 11").withColumn("decision_id", F.concat("decision_id", F.lit("-0")))
    active = active.unionByName(before)  # dated after what amends it
    new = decide("resolution", 3, "'match'").filter("run_no % 29 <> 4").withColumns({
        "adjudicator": F.expr("case when run_no % 31 = 6 then 'someone' else 'judge' end"), "supersedes": F.expr("case when run_no % 37 = 8 then 'x' when run_no % 23 = 11 then concat('resolution-', assignment_id, '-0') end"),
        "resolves": F.expr("case when run_no % 41 = 9 then array(concat('primary-', assignment_id)) else array(concat('primary-', assignment_id), concat('calibration-', assignment_id)) end"),
    })
    expected = rows.filter("run_no % 43 <> 10").select("assignment_id")
    actors = spark.sql("select 'resolution' as role, 'judge' as adjudicator union all select 'primary', 'one'")
    return adjudication.check_batch(new, expected, active, actors)


def expected_assignments(spark, sf_dir):
    """What batches of each role must decide: with disagreements that are open, and after all are settled."""
    rows = view(spark, sf_dir, "plan").selectExpr("run_id as assignment_id", "run_no", "run_no % 4 = 0 as calibration")
    decide = lambda role, cls, where: rows.filter(where).selectExpr(f"'{role}' as role", "assignment_id", f"concat('{role}-', assignment_id) as decision_id", f"{cls} as classification", "cast(null as array<string>) as resolves")
    blind = decide("primary", "'match'", "true").union(decide("calibration", "case when run_no % 5 = 0 then 'match' else 'no_match' end", "calibration"))
    two = F.expr("array(concat('primary-', assignment_id), concat('calibration-', assignment_id))")
    settled = lambda where: blind.union(decide("resolution", "'match'", f"calibration and {where}").withColumn("resolves", two))
    batch, out = rows.filter("run_no % 7 = 0"), None
    for name, role, active in (("primary", "primary", blind), ("calibration", "calibration", blind), ("open", "resolution", settled("run_no % 3 = 0")), ("settled", "resolution", settled("true"))):
        found = adjudication.expected_assignments(rows, active, batch, role).select(F.lit(name).alias("batch"), "assignment_id")
        out = found if out is None else out.union(found)
    return out


def resolved_identities(spark, sf_dir):
    """Opaque identities of requests, resolved among candidates of which some are missing and some are there twice."""
    cases = view(spark, sf_dir, "cases").selectExpr("case_id", "p_partkey", "concat(repository, cat_a) as material")
    own = leakage.request_identity(cases.select("case_id", "material"), b"demo")
    found = own.join(cases.select("case_id", "p_partkey"), "case_id")
    candidates = found.filter("p_partkey % 11 <> 0").drop("p_partkey").union(found.filter("p_partkey % 7 = 1 and p_partkey % 11 <> 0").drop("p_partkey"))
    resolved = leakage.resolve_identity(own, candidates).withColumnsRenamed({"case_id": "resolved_case", "snapshot": "resolved_snapshot"})
    return own.join(resolved, "identity").select("case_id", "snapshot", "n", "resolved_case", "resolved_snapshot")


def latest_attempts(spark, sf_dir):
    attempts = view(spark, sf_dir, "records").withColumn("last", F.col("attempt")).select("experiment_id", "run_id", F.explode(F.sequence(F.lit(1), "last")).alias("attempt"), "last", F.col("status").alias("s")).withColumn("status", F.expr("case when attempt < last then 'timeout' else s end"))
    return run_records.reconcile_attempts(attempts, run_records.is_terminal(3, ("provider_error", "timeout", "invalid_output")))


def linked_violations(spark, sf_dir):
    """Each case's protocol and that of a linked run of it, which differs for some."""
    source = view(spark, sf_dir, "cases").selectExpr("case_id as experiment_id", "cat_a as policy", "vulnerable_tokens as token_limit", "p_partkey")
    linked = source.selectExpr("concat(experiment_id, '-linked') as experiment_id", "experiment_id as source_id", "case when p_partkey % 13 = 2 then null else policy end as policy", "case when p_partkey % 11 = 3 then token_limit + 1 else token_limit end as token_limit")
    return run_records.check_linked(source, linked, ["policy", "token_limit"])


_PRICES = "select p_brand as provider, concat('m', cast(p_partkey as string)) as model, p_partkey, case when p_partkey % 19 = 1 then 'EUR' else 'USD' end as currency, cast(p_size as decimal(14,6)) as input_rate, cast(case when p_partkey % 23 = 2 then p_size + 1 else p_size / 10 end as decimal(14,6)) as cached_rate, cast(case when p_partkey % 29 = 3 then -1 else p_size * 4 end as decimal(14,6)) as output_rate, cast(case when p_partkey % 31 = 4 then 0.5 else 2 end as decimal(10,4)) as input_multiplier, cast(1.5 as decimal(10,4)) as output_multiplier from part"


def _prices(spark, sf_dir):
    read(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(_PRICES)


def price_violations(spark, sf_dir):
    prices = _prices(spark, sf_dir)
    return cost.check_prices(prices.union(prices.filter("p_partkey % 37 = 5"))).select("rule", "key")


def frozen_price_violations(spark, sf_dir):
    prices = _prices(spark, sf_dir).withColumn("version", F.lit("v1"))
    frozen = prices.selectExpr("concat('e', cast(p_partkey as string)) as experiment_id", "provider", "case when p_partkey % 7 = 1 then 'none' else model end as model", "case when p_partkey % 11 = 2 then 'v0' else version end as price_table_version", "case when p_partkey % 13 = 3 then input_rate + 1 else input_rate end as input_rate", "case when p_partkey % 17 = 4 then null else output_rate end as output_rate")
    return cost.check_frozen_prices(frozen, prices)


def price_identity_violations(spark, sf_dir):
    stage = lambda n: _prices(spark, sf_dir).selectExpr("concat('e', cast(p_partkey as string)) as experiment_id", f"case when p_partkey % 41 = 6 and {n} = 2 then 'v2' else 'v1' end as price_table_version", "'2026-01-01' as price_effective_date", "'list' as price_source", "provider", f"case when p_partkey % 43 = 7 and {n} = 2 then 'other' else model end as model")
    return cost.check_price_identity(stage(1), stage(2))


def worst_case_costs(spark, sf_dir):
    rows = view(spark, sf_dir, "cases").selectExpr("case_id as experiment_id", "p_partkey", "cast(vulnerable_tokens as double) / 1000 as source_cost", "explode(array('source', 'recovery')) as stage").filter("stage = 'source' or p_partkey % 5 <> 0")
    rows = rows.selectExpr("experiment_id", "stage", "case when stage = 'source' then source_cost else source_cost / 10 end as projected_cost", "case when p_partkey % 2 = 0 then 2 end as attempt_ceiling", "12 as planned_runs", "10000 as input_limit", "2000 as output_limit", "2.5D as input_rate", "15.0D as output_rate", "0.1D as contingency")
    return cost.worst_case(rows).withColumn("worst_case_cost", F.round("worst_case_cost", 9))


def _assessed(spark, sf_dir):
    view(spark, sf_dir, "findings").createOrReplaceTempView("findings")
    return spark.sql(_ASSESSED)


_ASSESSED = """select concat(run_id, '/', finding_id) as assignment_id, run_id, finding_id, snapshot, l_suppkey, 'sha256:a1' as assessment_digest,
  case when l_suppkey % 3 = 1 then 'match' when l_suppkey % 23 = 5 then 'uncertain' else 'no_match' end as mechanism_decision,
  case when l_suppkey % 3 = 1 and l_suppkey % 13 <> 4 then case when snapshot = 'vulnerable' then 'valid' else 'false_positive' end else 'valid' end as validity,
  case when l_suppkey % 17 = 7 then 'documentation' else 'code' end as issue_kind, case when l_suppkey % 3 <> 1 and l_suppkey % 19 <> 6 then 'g' end as additional_issue_group
from findings"""


def assessment_violations(spark, sf_dir):
    rows = _assessed(spark, sf_dir)
    return discovery.check_assessments(rows.filter("l_suppkey % 29 <> 8").drop("snapshot"), rows.select("assignment_id", "snapshot"))


def assessment_adjudications(spark, sf_dir):
    rows = _assessed(spark, sf_dir)
    assessments = rows.selectExpr("assessment_digest", "assignment_id", "mechanism_decision", "validity", "'a' as assessor", f"{_AT.format(h='1')} as assessed_at", "'because' as rationale")
    bindings = rows.filter("l_suppkey % 29 <> 8").selectExpr("assignment_id", "run_id", "finding_id", "'m1' as expected_mechanism_id", "'1' as rubric_version")
    return discovery.assessment_records(assessments, bindings).select("adjudication_id", "run_id", "finding_id", "decision", "adjudicator")


def leaked_tokens(spark, sf_dir):
    """Documents of a source that name it, a pull request or a fingerprint."""
    docs = read(spark, sf_dir, "documents").filter("doc_id is not null").selectExpr("source as case_id", "concat('doc-', cast(doc_id as string)) as request_id", "0 as pos", "'prompt' as location_class", "concat(case doc_id % 5 when 0 then upper(source) when 1 then concat('x', source) when 2 then concat('(pr', cast(doc_id as string), ')') when 3 then concat('sha256:', repeat('0a', 32)) else 'none' end, ' and more') as text")
    cases = docs.select("case_id").distinct()
    fingerprints = cases.select("case_id", F.concat(F.lit("sha256:"), F.repeat(F.lit("0A"), 32)).alias("value"))
    none = cases.select("case_id", F.lit("r").alias("rule_id"), F.lit("x").alias("value")).limit(0)
    return leakage.scan_tokens(docs, leakage.build_index(cases, none, none, fingerprints.limit(0), fingerprints))


def label_leaks(spark, sf_dir):
    """Conversations as requests: labels in paths and contents are the repository's own, those in prompts are not."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    requests = turns.select(F.lit("c").alias("case_id"), F.col("conv_id").alias("request_id"), F.expr("case when conv_id % 5 = 0 then 'is it VULNERABLE?' else 'look' end").alias("prompt"), F.lit("p").alias("profile"), F.transform("t", lambda x: F.struct(F.lit("fixed/a.py").alias("path"), F.lit("the vulnerable one").alias("content"), x["role"].alias("role"))).alias("entries"), F.create_map(F.lit("model"), F.expr("case when conv_id % 7 = 0 then 'fixed' else 'm' end")).alias("config"))
    index = leakage.build_index(spark.sql("select 'c' as case_id"), *[spark.sql("select 'c' as case_id, 'r' as rule_id, 'x' as value").limit(0)] * 2, *[spark.sql("select 'c' as case_id, 'x' as value").limit(0)] * 2)
    return leakage.scan_labels(leakage.request_components(requests), index).groupBy("request_id", "location_class", "match").agg(F.count("*").alias("n"))


def path_violations(spark, sf_dir):
    files = read(spark, sf_dir, "documents").filter("doc_id is not null").selectExpr("concat(case doc_id % 9 when 0 then '/' when 1 then 'a/../' when 2 then 'b\\\\' when 3 then 'é/' when 4 then 'c//' else 'd/' end, cast(doc_id as string)) as path")
    return bundles.check_paths(files)


def empty_includes(spark, sf_dir):
    files = read(spark, sf_dir, "documents").filter("doc_id is not null").selectExpr("concat('case-', cast(doc_id div 40 as string)) as case_id", "concat('src/', source, '/d', cast(doc_id as string)) as path")
    includes = files.select("case_id").distinct().select("case_id", F.explode(F.array(*(F.lit(f"src/src{k}") for k in range(30)))).alias("entry"))
    return bundles.check_includes(files, includes)


def issue_summary_violations(spark, sf_dir):
    """An issue summary that counts some findings twice, against the scored pairs."""
    from evalloom.plans import scoring_queries as base

    pairs = base.scored(spark, sf_dir)["scored_pairs"]
    each = pairs.groupBy("experiment_id", "run_id", "finding_id", "snapshot").agg(F.bool_or(F.col("decision") == "match").alias("hit"))
    issues = each.groupBy("experiment_id").agg((F.count("*") + F.expr("case when experiment_id = 'exp-1' then 1 else 0 end")).alias("total_findings"), F.count_if(F.expr("hit and snapshot = 'vulnerable'")).alias("known_instances"), F.lit(0).cast("long").alias("repaired_false_positives"), F.lit(0).alias("uncertain")).withColumn("condition", F.lit("all"))
    return discovery.check_issue_summary(issues, pairs)


_GOLD = """select case_id, case when p_partkey % 5 = 0 then '1.1' else '2.0' end as gold_version, array(
  named_struct('mechanism_id', 'm1', 'evaluation_role', case when k = 2 then 'supplemental' else 'primary' end, 'vulnerable', 'present', 'fixed', case when k = 3 then 'present' else 'absent' end, 'severity_min', case when k = 5 then 'critical' else 'low' end, 'severity_max', 'high', 'locations', array(
    named_struct('path', 'a.py', 'aliases', array(case k when 6 then 'a.py' when 7 then 'b.py' else 'old.py' end), 'start_line', 3, 'end_line', case when k = 9 then 2 else 8 end),
    named_struct('path', 'b.py', 'aliases', case when k = 8 then array('old.py') else array() end, 'start_line', cast(null as int), 'end_line', cast(null as int)))),
  named_struct('mechanism_id', case when k = 1 then 'm1' else 'm2' end, 'evaluation_role', 'supplemental', 'vulnerable', 'unverified', 'fixed', case when k = 4 then 'unverified' else 'present' end, 'severity_min', 'low', 'severity_max', 'low', 'locations', array())) as mechanisms
from (select *, p_partkey % 31 as k from cases) as c"""
_CATALOG = """select case_id, repository, case when k = 6 then 'special' else 'paired_draft' end as disposition,
  named_struct('number', cast(p_partkey as int), 'url', concat('https://github.com/', repository, '/pull/', case when k = 1 then 0 else p_partkey end)) as pull_request,
  named_struct('base', case when k = 2 then 'v' else 'b' end, 'vulnerable', 'v', 'repairs', case k when 3 then array() when 5 then array('v', 'f') else array('r', 'f') end, 'fixed', case when k = 4 then 'x' else 'f' end) as commits
from (select *, p_partkey % 29 as k from cases) as c"""


def gold_violations(spark, sf_dir):
    """Gold records and catalog records of the cases, with a fault of each kind."""
    view(spark, sf_dir, "cases").createOrReplaceTempView("cases")
    out = None
    for name, text in (("gold", _GOLD), ("catalog_record", _CATALOG)):
        rows = spark.sql(text)
        found = contracts.check_contract(rows, name).select(F.lit(name).alias("contract"), "rule", "key")
        out = found if out is None else out.union(found)
    return out


#: Documents of the contract finding, made of events: some have a field that it doesn't know, some are no object, some have a bad value.
_FINDING = """concat('{"run_id": "r', cast(event_id as string), '", "finding_id": "F1", "start_line": ', case when event_id % 13 = 0 then '"x"' else cast(event_id % 90 as string) end, case when event_id % 7 = 0 then ', "extra": {"a": 1}' else '' end,
  ', "evidence": [{"source_type": "file", "reference": "a"}', case when event_id % 11 = 0 then ', {"source_type": "file", "line": 3}' else '' end, ']}')"""
_LINE = f"case when event_id % 17 = 0 then concat('[', cast(event_id as string), ']') when event_id % 19 = 0 then concat('{{\"run_id\": ', cast(event_id as string)) else {_FINDING} end"


def document_violations(spark, sf_dir):
    """Documents of a contract, written as lines and read again."""
    path = f"{shared_dir(spark)}/evalloom/findings-{uuid.uuid4().hex}.jsonl"
    read(spark, sf_dir, "events").select(F.expr(_LINE).alias("value")).write.text(path)
    return documents.check_documents(documents.read_documents(spark, "finding", path), "finding")


def read_findings(spark, sf_dir):
    """Typed rows of the documents that are objects."""
    path = f"{shared_dir(spark)}/evalloom/findings-{uuid.uuid4().hex}.jsonl"
    read(spark, sf_dir, "events").select(F.expr(_LINE).alias("value")).write.text(path)
    rows = documents.read_documents(spark, "finding", path).filter("document.run_id is not null")
    return rows.select("document.run_id", "document.start_line", F.size("document.evidence").cast("long").alias("evidence"))


def _tree(spark, sf_dir):
    """Texts of documents as a tree of 40 files, some with a NUL byte, read again."""
    path = f"{shared_dir(spark)}/evalloom/tree-{uuid.uuid4().hex}"
    line = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\r\\n]+", " "), F.when(F.col("doc_id") % 200 == 7, F.lit("\0")).otherwise(F.lit("")))
    rows = read(spark, sf_dir, "documents").filter("doc_id is not null").select((F.col("doc_id") % 40).alias("part"), "doc_id", line.alias("value"))
    rows.repartition(8, "part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    files = documents.read_tree(spark, path)
    return files.withColumn("path", F.regexp_extract("path", "^(part=[0-9]+)/", 1))


def tree_files(spark, sf_dir):
    """Files of a tree that are text: sizes and digests."""
    return bundles.decode_content(_tree(spark, sf_dir)).select("path", "size", F.sha2("content", 256).alias("digest"))


def tree_violations(spark, sf_dir):
    """Modes from a listing, and files that are not text."""
    files = _tree(spark, sf_dir).withColumn("mode", F.expr("case cast(substr(path, 6) as int) % 10 when 3 then '120000' when 4 then '160000' when 5 then '100755' else mode end"))
    return documents.check_tree(files, "reject", "reject")


def _oracle() -> dict[str, str]:
    from evalloom.plans.scoring_queries import _SCORED

    found, cases, plan = with_views("findings"), with_views("cases"), with_views("plan")
    key = "run_id || '/' || finding_id"
    text = "'sha256:' || sha256(case_id || chr(0) || mechanism_id || chr(0) || 'severity ' || severity_min)"
    prices = f"with prices as ({_PRICES})"
    pr = "provider || '/' || model"
    rows = lambda *parts: " union all ".join(parts)
    return {
        "gold_violations": cases + """, g as (select *, p_partkey % 31 as k from cases), c as (select *, p_partkey % 29 as k from cases) select 'gold' as contract, 'unique' as rule, case_id as key from g where k = 1 union all select 'gold' as contract, 'one_primary' as rule, case_id as key from g where k = 2 and p_partkey % 5 <> 0 union all select 'gold' as contract, 'primary_expectation' as rule, case_id as key from g where k = 3 and p_partkey % 5 <> 0 union all select 'gold' as contract, 'verified' as rule, case_id as key from g where k = 4 union all select 'gold' as contract, 'severity_range' as rule, case_id as key from g where k = 5 union all select 'gold' as contract, 'alias_self' as rule, case_id as key from g where k = 6 union all select 'gold' as contract, 'alias_shadow' as rule, case_id as key from g where k in (6, 7) union all select 'gold' as contract, 'alias_owner' as rule, case_id as key from g where k = 8 union all select 'gold' as contract, 'location_lines' as rule, case_id as key from g where k = 9 union all select 'catalog_record', 'url', case_id from c where k = 1 union all select 'catalog_record', 'base', case_id from c where k = 2 union all select 'catalog_record', 'paired', case_id from c where k = 3 union all select 'catalog_record', 'final_repair', case_id from c where k = 4 union all select 'catalog_record', 'repair_order', case_id from c where k = 5 union all select 'catalog_record', 'special', case_id from c where k = 6""",
        "document_violations": f"""with l as (select event_id, {_LINE} as v from events), ok as (select event_id, sha256(v) as key from l where event_id % 17 <> 0 and event_id % 19 <> 0)
          select 'not_object' as rule, sha256(v) as key, '' as detail from l where event_id % 17 = 0 or event_id % 19 = 0
          union all select 'unknown_field', key, '$.extra' from ok where event_id % 7 = 0 union all select 'unknown_field', key, '$.evidence[].line' from ok where event_id % 11 = 0 union all select 'bad_value', key, 'start_line' from ok where event_id % 13 = 0""",
        "read_findings": "select 'r' || event_id as run_id, case when event_id % 13 <> 0 then (event_id % 90)::int end as start_line, 1::bigint + (event_id % 11 = 0)::int as evidence from events where event_id % 17 <> 0 and event_id % 19 <> 0",
        "tree_files": """with l as (select doc_id % 40 as part, doc_id, regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g') as v from documents where doc_id is not null), f as (select part, string_agg(v || chr(10), '' order by doc_id) as content from l group by 1)
          select 'part=' || part as path, strlen(content) as size, sha256(content) as digest from f where part not in (select part from l where doc_id % 200 = 7)""",
        "tree_violations": """with p as (select doc_id % 40 as part, bool_or(doc_id % 200 = 7) as nul from documents where doc_id is not null group by 1)
          select 'symlink' as rule, 'part=' || part as key from p where part % 10 = 3 union all select 'unsupported', 'part=' || part from p where part % 10 = 4 union all select 'binary', 'part=' || part from p where nul""",
        "redacted_items": found + f" select {key} as assignment_id, 'see [redacted finding reference], F1000 and [redacted finding reference]0' as title, 'x [redacted finding reference]' as reference from findings",
        "blinding_violations": found + f" select case l_suppkey % 11 when 3 then 'full_sha' when 4 then 'identity' else 'blind_label' end as rule, {key} as key, 'note' as detail from findings where l_suppkey % 11 in (0, 2, 3, 4)",
        "rubric_violations": cases + " select case p_partkey % 17 when 0 then 'missing' when 1 then 'stale' when 2 then 'approver' else 'late' end as rule, case_id as key from cases where p_partkey % 17 in (0, 1, 2, 13, 14, 15, 16)",
        "stale_bindings": with_views("mechanisms") + " select case when mechanism_id = 'm2' and severity_min = 'low' then 'gone' else 'rubric_digest' end as rule, case_id || '/' || mechanism_id as key from mechanisms where (mechanism_id = 'm2' and severity_min = 'low') or case_id like '%7-f001'",
        "batch_violations": plan + ", b as (select * from plan where run_no % 29 <> 4) " + rows("select 'unexpected' as rule, run_id as key from b where run_no % 43 = 10", "select 'missing', run_id from plan where run_no % 43 <> 10 and run_no % 29 = 4", "select 'supersedes', run_id from b where run_no % 37 = 8", "select 'time', run_id from b where run_no % 23 = 11", "select 'actor', run_id from b where run_no % 31 = 6", "select 'resolution', run_id from b where run_no % 5 = 0 or run_no % 41 = 9"),
        "expected_assignments": plan + ", c as (select * from plan where run_no % 4 = 0) " + rows("select 'primary' as batch, run_id as assignment_id from plan", "select 'calibration', run_id from c", "select 'open', run_id from c where run_no % 5 <> 0 and run_no % 3 <> 0", "select 'settled', run_id from c where run_no % 5 <> 0 and run_no % 7 = 0"),
        "resolved_identities": cases + """ select case_id, snapshot, n, case when n = 1 then case_id end as resolved_case, case when n = 1 then snapshot end as resolved_snapshot
          from (select case_id, unnest(['vulnerable', 'fixed']) as snapshot, case when p_partkey % 11 = 0 then 0 when p_partkey % 7 = 1 then 2 else 1 end::bigint as n from cases)""",
        "latest_attempts": with_views("records") + " select experiment_id, run_id, attempt, status, status in ('succeeded', 'configuration_error', 'adapter_error') or attempt >= 3 or status not in ('provider_error', 'timeout', 'invalid_output') as terminal from records",
        "linked_violations": cases + " " + rows("select 'policy' as rule, case_id || '-linked' as key from cases where p_partkey % 13 = 2", "select 'token_limit', case_id || '-linked' from cases where p_partkey % 11 = 3"),
        "price_violations": f"{prices}, twice as (select * from prices union all select * from prices where p_partkey % 37 = 5) " + rows(f"select 'currency' as rule, {pr} as key from twice where currency <> 'USD'", f"select 'cached_rate', {pr} from twice where cached_rate > input_rate", f"select 'multiplier', {pr} from twice where input_multiplier < 1", f"select 'negative', {pr} from twice where output_rate < 0", f"select 'unique', {pr} from prices where p_partkey % 37 = 5"),
        "frozen_price_violations": "with e as (select 'e' || p_partkey as key, * from part), k as (select * from e where p_partkey % 7 <> 1) " + rows("select 'price' as rule, key from e where p_partkey % 7 = 1", "select 'version', key from k where p_partkey % 11 = 2", "select 'input_rate', key from k where p_partkey % 13 = 3", "select 'output_rate', key from k where p_partkey % 17 = 4"),
        "price_identity_violations": rows("select 'price_table_version' as rule, 'e' || p_partkey as key from part where p_partkey % 41 = 6", "select 'model', 'e' || p_partkey from part where p_partkey % 43 = 7"),
        "worst_case_costs": cases + " select case_id as experiment_id, case when p_partkey % 5 <> 0 then round(vulnerable_tokens / 1000.0::double + case when p_partkey % 2 = 0 then (24.0 * 10000 * 2.5 + 24.0 * 2000 * 15) / 1e6 * 1.1 else vulnerable_tokens / 1000.0::double / 10 end, 9) end as worst_case_cost from cases",
        "assessment_violations": found + f", a as ({_ASSESSED}), b as (select * from a where l_suppkey % 29 <> 8) " + rows("select 'issue_group' as rule, assignment_id as key from b where (validity = 'valid' and mechanism_decision = 'no_match') <> (additional_issue_group is not null)", "select 'uncertainty', assignment_id from b where (mechanism_decision = 'uncertain') <> (validity = 'uncertain')", "select 'match_kind', assignment_id from b where mechanism_decision = 'match' and issue_kind <> 'code'", "select 'match_validity', assignment_id from b where mechanism_decision = 'match' and validity <> case when snapshot = 'vulnerable' then 'valid' else 'false_positive' end", "select 'coverage', assignment_id from a where l_suppkey % 29 = 8"),
        "assessment_adjudications": found + f""", a as ({_ASSESSED}) select 'adjudication-' || substr(sha256('{{"assessment_digest":"sha256:a1","assignment_id":"' || assignment_id || '"}}'), 1, 32) as adjudication_id, run_id, finding_id, mechanism_decision as decision, 'a' as adjudicator from a where l_suppkey % 29 <> 8""",
        "leaked_tokens": rows("select source as case_id, 'doc-' || doc_id as request_id, 0 as pos, 'prompt' as location_class, 'snapshot_label' as rule_id, lower(source) as match from documents where doc_id % 5 = 0", "select source, 'doc-' || doc_id, 0, 'prompt', 'snapshot_label', 'pr' || doc_id from documents where doc_id % 5 = 2", "select source, 'doc-' || doc_id, 0, 'prompt', 'fixed_fingerprint', repeat('0a', 32) from documents where doc_id % 5 = 3"),
        "label_leaks": "with c as (select distinct conv_id from conversations) " + rows("select conv_id as request_id, 'serialized_request' as location_class, 'vulnerable' as match, 2::bigint as n from c where conv_id % 5 = 0", "select conv_id, 'serialized_request', 'fixed', 1 from c where conv_id % 7 = 0", "select conv_id, 'tool_configuration', 'fixed', 2 from c where conv_id % 7 = 0"),
        "split_violations": cases + " " + rows("select 'repeated' as rule, case_id as key from cases where p_partkey % 47 = 1", "select 'unknown_lock', case_id || 'x' from cases where p_partkey % 53 = 2 and p_partkey % 2 = 1", "select 'role', case_id from cases where p_partkey % 59 = 3", "select 'infeasible', (count(*) + count(*) filter (p_partkey % 47 = 1) - count(*) filter (p_partkey % 53 = 2 and p_partkey % 2 = 0) - count(*) filter (p_partkey % 53 = 2 and p_partkey % 2 = 0 and p_partkey % 47 = 1))::varchar from cases"),
        "linked_plan_violations": plan + ", h as (select * from plan where role = 'holdout') select 'not_in_source' as rule, run_id as key from h where run_no % 61 = 4 union all select 'not_in_source', run_id from h where run_no % 61 = 4 and run_no % 67 = 5 union all select 'repeated', run_id from h where run_no % 67 = 5",
        "metadata_violations": with_views("records") + """, a as (select run_id, run_no, attempt as last, unnest(range(1, attempt + 1 + (run_no % 71 = 6)::int)) as attempt from records), m as (select * from a where not (run_no % 5 = 0 and attempt = 1) and not (run_no % 5 = 1 and attempt = 2)),
          g as (select run_id, run_no, last, min(attempt) as lo, max(attempt) as hi, count(*) as n from m group by all), k as (select *, run_no % 79 = 8 as lost from g)
          select 'unknown_run' as rule, run_id as key from k where lost union all select 'beyond', run_id from k where not lost and hi > last union all select 'gap', run_id from k where (not lost and hi < last) or hi - lo + 1 <> n union all select 'repeated', run_id from k where run_no % 73 = 7""",
        "record_violations": with_views("records") + """, k as (select *, concat_ws('/', run_id, case when run_no % 83 = 9 then null else attempt end) as key from records)
          select 'required_attempt' as rule, key from k where run_no % 83 = 9 union all select 'times', key from k where run_no % 89 = 10 union all select 'success', key from k where status = 'succeeded' and run_no % 97 = 11
          union all select 'identity_digests', key from k where run_no % 101 = 12 union all select 'cached', key from k where cached_input_tokens > input_tokens""",
        "path_violations": "select 'unsafe_path' as rule, (['/', 'a/../', 'b\\', 'é/', 'c//'])[doc_id % 9 + 1] || doc_id as key from documents where doc_id % 9 < 5",
        "empty_includes": "with f as (select distinct doc_id // 40 as c, source from documents where doc_id is not null), w as (select c, 'src' || k as source from (select distinct c from f), range(30) as r(k)) select 'empty_include' as rule, 'case-' || c || '/src/' || source as key from w where (c, source) not in (select (c, source) from f)",
        "issue_summary_violations": with_views("adjudications") + _SCORED + f""" select 'unadjudicated' as rule, {key} || '/' || mechanism_id as key from pairs where expected_status <> 'unverified' and decision not in ('match', 'no_match') union all select 'total_findings', 'exp-1' from pairs where experiment_id = 'exp-1' group by 2
          union all select 'repaired_false_positives', experiment_id from pairs where snapshot = 'fixed' and decision = 'match' group by experiment_id""",
    }


def linked_plan_violations(spark, sf_dir):
    """A holdout plan of which some runs are not the source's and some repeat."""
    plan = view(spark, sf_dir, "plan").select("experiment_id", "case_id", "role", "snapshot", "condition", "repetition", "run_id", "run_no")
    linked = plan.filter("role = 'holdout'").withColumns({"experiment_id": F.lit("linked"), "condition": F.expr("case when run_no % 61 = 4 then 'other' else condition end")})
    return plans.check_linked_plan(linked.union(linked.filter("run_no % 67 = 5")), plan)


def metadata_violations(spark, sf_dir):
    """Attempt metadata with gaps, attempts beyond the last, repeats and unknown runs; missing first attempts are none."""
    records = view(spark, sf_dir, "records").select("run_id", "run_no", F.col("attempt").alias("terminal_attempt"))
    rows = records.select("run_id", "run_no", "terminal_attempt", F.explode(F.sequence(F.lit(1), F.expr("case when run_no % 71 = 6 then terminal_attempt + 1 else terminal_attempt end"))).alias("attempt"))
    rows = rows.filter("not (run_no % 5 = 0 and attempt = 1) and not (run_no % 5 = 1 and attempt = 2)")
    rows = rows.union(rows.filter("run_no % 73 = 7"))
    return run_records.check_metadata(rows, records.filter("run_no % 79 <> 8").select("run_id", "terminal_attempt"))


def record_violations(spark, sf_dir):
    """Run records with faults, under their contract."""
    digest = "concat('sha256:', sha2(run_id, 256))"
    rows = view(spark, sf_dir, "records").selectExpr(
        "experiment_id", "run_id", "case when run_no % 83 = 9 then null else attempt end as attempt", "status", f"{_AT.format(h='1')} as started_at", f"{_AT.format(h='case when run_no % 89 = 10 then 0 else 2 end')} as ended_at", "latency_ms as monotonic_latency_ms",
        "named_struct('exit_status', case when status = 'succeeded' and run_no % 97 <> 11 then 0 else 1 end, 'stderr_classification', 'none') as subprocess",
        "named_struct('input_tokens', input_tokens, 'cached_input_tokens', cached_input_tokens) as usage", "cast(null as struct<input:double,output:double,total:double>) as cost",
        "case when attempt > 1 then transform(sequence(1, attempt - 1), x -> named_struct('attempt', x)) end as retry_history",
        f"named_struct('experiment_content_digest', {digest}, 'profile_digest', {digest}, 'reviewer_config_digest', {digest}, 'request_digest', case when run_no % 101 = 12 then 'x' else {digest} end, 'reviewer_output_digest', case when status = 'succeeded' then {digest} end) as identity", f"{digest} as content_digest")
    return contracts.check_contract(rows, "run_record").filter("key is not null")


def split_violations(spark, sf_dir):
    """Inputs and roles of a split with faults."""
    cases = view(spark, sf_dir, "cases").select("case_id", "role", "p_partkey")
    twice = cases.union(cases.filter("p_partkey % 47 = 1"))
    locked = cases.filter("p_partkey % 53 = 2").select(F.expr("case when p_partkey % 2 = 0 then case_id else concat(case_id, 'x') end").alias("case_id"))
    frozen = cases.withColumn("role", F.expr("case when p_partkey % 59 = 3 then 'other' else role end"))
    return corpus_split.check_split_input(twice, locked, 0).unionByName(corpus_split.check_roles(cases, frozen))


QUERIES = {f.__name__: f for f in (expected_assignments, resolved_identities, gold_violations, document_violations, read_findings, tree_files, tree_violations, redacted_items, blinding_violations, rubric_violations, stale_bindings, batch_violations, latest_attempts, linked_violations, price_violations, frozen_price_violations, price_identity_violations, worst_case_costs, assessment_violations, assessment_adjudications, leaked_tokens, label_leaks, path_violations, empty_includes, issue_summary_violations, split_violations, linked_plan_violations, metadata_violations, record_violations)}
ORACLE_SQL = _oracle()
