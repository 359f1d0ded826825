"""Queries of leakage scans, bundles, splits, ingest and public scans over the text tables, with their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.text import canonical_digest, canonical_json
from evalloom.operators import bundles, corpus_split, leakage, report
from evalloom.plans.demo import view, with_views
from evalloom.sources import contracts, ingest


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _scan_input(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), F.concat(F.lit("doc-"), "doc_id").alias("request_id"), F.lit(0).alias("pos"), F.lit("prompt").alias("location_class"), "text")
    index = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), "item_id").alias("case_id"), F.lit("expected_phrase").alias("rule_id"), F.col("text").alias("value"))
    empty = spark.createDataFrame([], T.StructType([T.StructField("case_id", T.StringType()), T.StructField("value", T.StringType())]))
    cases = index.select("case_id").limit(0)
    return docs, leakage.build_index(cases, index, index.limit(0), empty, empty)


def leaked_phrases(spark, sf_dir):
    docs, index = _scan_input(spark, sf_dir)
    return leakage.scan_phrases(docs.drop("case_id"), index, scope=None).select("case_id", "request_id")


def leaked_shas(spark, sf_dir):
    """Every document's first 40-hex token is forbidden in all documents of its source."""
    docs, _ = _scan_input(spark, sf_dir)
    sha = F.lower(F.regexp_extract("text", r"(?i)(?<![0-9a-f])([0-9a-f]{40})(?![0-9a-f])", 1))
    index = docs.select("case_id", F.lit("sensitive_sha").alias("rule_id"), F.lit("sha").alias("mode"), sha.alias("value")).filter("value <> ''").distinct()
    return leakage.scan_shas(docs, index).select("case_id", "request_id", "match")


def leakage_audit(spark, sf_dir):
    docs, index = _scan_input(spark, sf_dir)
    matches = leakage.scan_phrases(docs.drop("case_id"), index, scope=None)
    at = lambda seconds: F.timestamp_seconds(F.lit(seconds))
    digit = F.substr(F.md5(F.col("case_id").cast("binary")), F.lit(1), F.lit(1))
    seen = leakage.audit(matches, index.sparkSession.createDataFrame([], "case_id string, rule_id string, location_class string, match_digest string, expires_at timestamp"), at(0), b"demo")
    # exceptions of half of the cases, of which half have expired
    exceptions = seen.filter(digit < "8").select("case_id", "rule_id", "location_class", "match_digest", F.when(digit < "4", at(2_000_000_000)).otherwise(at(1_800_000_000)).alias("expires_at"))
    audited = leakage.audit(matches, exceptions, at(1_900_000_000), b"demo")
    return leakage.audit_verdict(index.select("case_id").distinct(), audited)


def request_components(spark, sf_dir):
    """Conversations as requests: first turn the prompt, the others entries."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    requests = turns.select(F.lit("c").alias("case_id"), F.col("conv_id").alias("request_id"), F.col("t")[0]["text"].alias("prompt"), F.col("t")[0]["role"].alias("profile"), F.transform(F.slice("t", F.lit(2), F.size("t")), lambda x: F.struct(F.concat(F.lit("turn/"), x["turn"].cast("string")).alias("path"), x["text"].alias("content"))).alias("entries"), F.create_map(F.lit("model"), F.lit("demo")).alias("config"))
    return leakage.request_components(requests).groupBy("request_id", "location_class").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.length("label_text")).alias("label_chars"))


def public_scan(spark, sf_dir):
    return report.scan_public(read(spark, sf_dir, "documents"), "doc_id", ["text"]).select("rule", "key")


def canonical_digests(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.select("doc_id", canonical_digest("lang", "n_chars", "source").alias("digest"))


def canonical_events(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", canonical_json(F.col("props")).alias("props"))


def _files(spark, sf_dir):
    """Documents as the files of cases, forty to a case, so that a case doesn't grow with the table."""
    return read(spark, sf_dir, "documents").filter("doc_id is not null").select(F.expr("concat('case-', cast(doc_id div 40 as string))").alias("case_id"), F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id"), F.lit(".txt")).alias("path"), "text", "doc_id")


def selected_context(spark, sf_dir):
    files = _files(spark, sf_dir)
    cases = files.select("case_id").distinct()
    includes = cases.select("case_id", F.inline(F.array(F.struct(F.lit("src/src1").alias("entry"), F.lit(0).alias("include_index")), F.struct(F.lit("src").alias("entry"), F.lit(1).alias("include_index")))))
    excludes = cases.select("case_id", F.explode(F.array(F.lit("src/src2"), F.lit("src/src3/en"))).alias("entry"))
    return bundles.select_context(files, includes, excludes)


def limited_texts(spark, sf_dir):
    out = _files(spark, sf_dir).withColumn("e", bundles.limit_text(F.col("text"), F.lit(4000), F.lit(400), "head_tail"))
    return out.select("doc_id", "e.truncated", "e.byte_count", "e.token_count")


def bundle_budgets(spark, sf_dir):
    files = _files(spark, sf_dir).select("case_id", (F.col("doc_id") % 8).cast("string").alias("snapshot"), "path", F.col("text").alias("content"))
    return bundles.bundle_manifest(bundles.fit_budget(files, 20_000, 1_000, 3_000))


def tree_digests(spark, sf_dir):
    return bundles.tree_digest(_files(spark, sf_dir).withColumn("content", F.coalesce("text", F.lit(""))), "case_id")


def _cases(spark, sf_dir):
    return view(spark, sf_dir, "cases").select("case_id", "repository", F.col("cat_a").alias("defect_category"), corpus_split.context_band(F.col("vulnerable_tokens"), F.col("fixed_tokens")).alias("context_size_band"), "role")


def split_balance(spark, sf_dir):
    return corpus_split.balance(_cases(spark, sf_dir))


def split_objective(spark, sf_dir):
    return corpus_split.split_objective(_cases(spark, sf_dir))


def stratified_split(spark, sf_dir):
    cases = _cases(spark, sf_dir).drop("role")
    return corpus_split.stratified_holdout(cases, 10, cases.count() // 5).select("case_id", "role")


def holdout_order(spark, sf_dir):
    return corpus_split.order_holdout(_cases(spark, sf_dir), 10)


def split_proof(spark, sf_dir):
    return corpus_split.split_proof(_cases(spark, sf_dir), 10)


def failure_classes(spark, sf_dir):
    """Documents' first words as standard error."""
    docs = read(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.element_at(F.array(*map(F.lit, ("Connection Reset ", "usage: x ", "Traceback ", "request timed out ", "no config file ", "odd "))), (F.col("page_id") % 6 + 1).cast("int")), F.lower(F.substr("url", F.lit(1), F.lit(4))))).alias("stderr"))
    rows = docs.withColumns({"timed_out": F.col("page_id") % 31 == 0, "output_limit": F.col("page_id") % 29 == 0, "capture_error": F.lit(False), "exit_status": F.when(F.col("page_id") % 3 == 0, 1).otherwise(0), "parse_error": F.when(F.col("page_id") % 5 == 0, "x")})
    return rows.select("page_id", ingest.stderr_class(F.col("stderr")).alias("stderr_class"), ingest.classify_failures().alias("status"))


def parsed_responses(spark, sf_dir):
    """Events as responses in an envelope, some with duplicate keys or cut short."""
    raw = F.concat(F.lit('{"total_cost_usd": 0.5, "modelUsage": {"m": {"inputTokens": '), F.col("event_id").cast("string"), F.lit(', "cacheReadInputTokens": 5, "outputTokens": 7}}, "result": {"findings": ['), F.when(F.col("event_id") % 4 == 0, F.col("props")).otherwise(F.lit("")), F.lit(']'), F.when(F.col("event_id") % 9 == 0, F.lit(', "findings": []')).otherwise(F.lit("")), F.lit("}}"))
    text = F.when(F.col("event_id") % 11 == 0, F.substr(raw, F.lit(1), F.lit(60))).otherwise(raw)
    parsed = ingest.parse_responses(read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("run_id"), text.alias("response")))
    return parsed.select("run_id", "status", "error", "input_tokens", "output_tokens", F.length("findings").cast("long").alias("chars"))


def contract_violations(spark, sf_dir):
    """Demonstration findings under the finding contract, some of them broken."""
    rows = view(spark, sf_dir, "findings").withColumns({"severity": F.expr("case when l_suppkey % 37 = 5 then 'odd' else severity end"), "end_line": F.expr("case when l_suppkey % 41 = 7 then start_line - 1 else end_line end"), "title": F.expr("case when l_suppkey % 43 = 9 then null else title end")})
    return contracts.check_contract(rows, "finding").select("rule", "key")


def _normal_sql(table: str, rows: str) -> str:
    """CTE ``table`` with the columns of ``rows`` and ``normal``: the form of ``normal_phrase`` of its column text, between blanks.

    DuckDB composes (NFC), but has neither compatibility forms nor case folding: the first come from a list of characters for texts that
    have some, the second by replacing what does not fold to its lower case.
    """
    form, every = unicodedata.normalize, [chr(i) for i in range(0x80, 0x20000) if not 0xD800 <= i < 0xE000]
    compat = [(c, form("NFKD", c)) for c in every if form("NFKD", c) != form("NFD", c)]
    fold = [(c, c.casefold()) for c in every if form("NFKC", c) == c and (c.casefold() != c.lower() or len(c.casefold()) > 1)]
    single, folded_text = [f for f in fold if len(f[1]) == 1], "n"
    for c, to in fold:
        folded_text = folded_text if len(to) == 1 else f"replace({folded_text}, '{c}', '{to}')"
    folded_text = f"translate({folded_text}, '{''.join(c for c, _ in single)}', '{''.join(to for _, to in single)}')"
    some, pairs = "".join(c for c, _ in compat), ", ".join("('{}', '{}')".format(c, to.replace("'", "''")) for c, to in compat)
    return f"""{table}_r as materialized (select *, row_number() over () as r from ({rows})), {table}_k(ch, d) as (values {pairs}),
      {table}_c as (select r, unnest(regexp_extract_all(text, '(?s).')) as ch, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) as i from {table}_r where regexp_matches(text, '[{some}]')),
      {table}_n as (select r, string_agg(coalesce(d, ch), '' order by i) as n from {table}_c left join {table}_k using (ch) group by r),
      {table} as (select *, ' ' || trim(regexp_replace(lower({folded_text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' as normal from (select a.* exclude (r), nfc_normalize(coalesce(n, text)) as n from {table}_r a left join {table}_n using (r)))"""


def _oracle() -> dict[str, str]:
    phrases = _normal_sql("bn", "select 'item-' || item_id as case_id, text from benchmark") + ", " + _normal_sql("dn", "select 'doc-' || doc_id as request_id, text from documents where text is not null")
    phrases += ", b as (select case_id, normal as v from bn), d as (select request_id, normal as t from dn)"
    cases = with_views("cases") + ", c as (select case_id, repository, cat_a as defect_category, case when greatest(vulnerable_tokens, fixed_tokens) <= 2000 then 'small' when greatest(vulnerable_tokens, fixed_tokens) <= 8000 then 'medium' else 'large' end as context_size_band, role from cases)"
    long = " union all ".join(f"select '{d}' as dimension, {d} as value, role from c" for d in corpus_split.DIMENSIONS)
    files = "files as (select 'case-' || (doc_id // 40) as case_id, 'src/' || source || '/' || lang || '/d' || doc_id || '.txt' as path, text, doc_id from documents where doc_id is not null)"
    err = "case when page_id % 7 = 0 then 'none' else (['provider', 'usage', 'internal', 'timeout', 'configuration', 'redacted_unknown'])[page_id % 6 + 1] end"
    return {
        "leaked_phrases": f"with {phrases} select distinct case_id, request_id from b join d on v <> '  ' and contains(t, v)",
        "leakage_audit": f"with {phrases}, m as (select case_id, count(distinct v) as n from b join d on v <> '  ' and contains(t, v) group by 1) select distinct case_id, coalesce(n, 0) as matches, n is null or substr(md5(case_id), 1, 1) < '4' as passed from b left join m using (case_id)",
        "leaked_shas": "with s as (select source as case_id, 'doc-' || doc_id as request_id, lower(text) as t from documents), f as (select distinct case_id, regexp_extract(t, '(^|[^0-9a-f])([0-9a-f]{40})([^0-9a-f]|$)', 2) as sha from s), k as (select case_id, request_id, unnest(list_distinct(regexp_extract_all(t, '[0-9a-f]+'))) as token from s) select distinct case_id, request_id, token as match from k join f using (case_id) where sha <> '' and length(token) between 7 and 40 and starts_with(sha, token)",
        "request_components": """with t as (select conv_id, turn, role, coalesce(text, '') as x, text, row_number() over (partition by conv_id order by turn, role, text) as k from conversations),
            e as (select conv_id, count(*) filter (k > 1) as n, sum(length('turn/' || turn)) filter (k > 1)::bigint as names, sum(length(text)) filter (k > 1)::bigint as body,
              coalesce('[' || string_agg('{"path":' || to_json('turn/' || turn)::varchar || case when text is null then '' else ',"content":' || to_json(text)::varchar end || '}', ',' order by k) filter (k > 1) || ']', '[]') as list from t group by 1),
            f as (select conv_id, role, text, case when text is null then '{' else '{"prompt":' || to_json(text)::varchar || ',' end || '"profile":' || to_json(role)::varchar || ',"config":{"model":"demo"},"repository_context":{"entries":' as head from t where k = 1),
            r as (select * from e join f using (conv_id))
          select conv_id as request_id, 'serialized_request' as location_class, 2::bigint as n, length(head) + length(list) + 2 + length(coalesce(text, '')) as chars, length(head) + 2 + 2 + length(coalesce(text, '')) as label_chars from r
          union all select conv_id, 'profile', 1, length(role), length(role) from r union all select conv_id, 'filename', n, names, null from r where n > 0
          union all select conv_id, 'tool_configuration', 2, 20, 20 from r union all select conv_id, 'context_bundle', n + 1, length(list) + coalesce(body, 0), null from r""",
        "public_scan": r"""with p(rule, pattern) as (values ('full_sha', '(^|[^0-9a-f])[0-9a-f]{40}([^0-9a-f]|$)'), ('case_id', '\b[a-z0-9]+(-[a-z0-9]+)*-pr[0-9]+-f[0-9]+\b'), ('holdout_membership', '(?i)\bholdout\s+(case|cases|member|members|membership|assignment|assignments)\b'),
            ('repository_path', '(^|[\s`''"(])(\.?\.?/|(src|tests|docs|config|cases|prompts|schemas|artifacts|reports|\.github)/)[^\s`''"),;]+'), ('generic_path', '(^|[\s`''"(])([A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+($|[\s`''"),;])'))
          select rule, doc_id::varchar as key from documents, p where regexp_matches(text, pattern)""",
        "canonical_digests": """select doc_id, 'sha256:' || sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') as digest from documents""",
        "selected_context": f"with {files} select case_id, path, case when starts_with(path, 'src/src1/') then 'include[0]' else 'include[1]' end as selection_reason from files where not starts_with(path, 'src/src2/') and not starts_with(path, 'src/src3/en/')",
        "tree_digests": f"with {files} select case_id, count(*) as files, 'sha256:' || sha256(string_agg(path || chr(0) || '100644' || chr(0) || strlen(coalesce(text, '')) || chr(0) || sha256(coalesce(text, '')) || chr(0) || sha1('blob ' || strlen(coalesce(text, '')) || chr(0) || coalesce(text, '')), chr(10) order by path)) as digest from files group by 1",
        "split_balance": cases + f" select dimension, value, count(*) as total, count(*) filter (role = 'development') as development, count(*) filter (role = 'holdout') as holdout from ({long}) group by all",
        "split_objective": cases + f", b as (select dimension, value, count(*) as t, count(*) filter (role = 'holdout') as h from ({long}) group by all), n as (select count(*) as n, count(*) filter (role = 'holdout') as hh from c) select sum((h * n - t * hh)::hugeint * (h * n - t * hh))::decimal(38,0) as objective, max(n) as cases, max(hh) as holdout from b, n",
        "split_proof": cases + """, lines as (select (row_number() over (order by sha256('10:' || case_id)) - 1) // 4096 as part, sha256('10:' || case_id) as o, case_id from c where role = 'holdout'),
          parts as (select part, sha256(string_agg(case_id, chr(10) order by o)) as line from lines group by all)
          select (select count(*) from c) as case_count, (select count(*) from lines) as holdout_count, 'sha256:' || case when count(*) = 1 then max(line) else sha256(string_agg(line, chr(10) order by part)) end as ordered_holdout_checksum from parts""",
        "holdout_order": cases + " select case_id, row_number() over (order by sha256('10:' || case_id)) as position from c where role = 'holdout'",
        "failure_classes": f"with p as (select page_id, {err} as c from pages) select page_id, c as stderr_class, case when page_id % 31 = 0 then 'timeout' when page_id % 29 = 0 then 'adapter_error' when page_id % 3 = 0 then case c when 'provider' then 'provider_error' when 'timeout' then 'timeout' when 'usage' then 'configuration_error' when 'configuration' then 'configuration_error' else 'adapter_error' end when page_id % 5 = 0 then 'invalid_output' else 'succeeded' end as status from p",
        "parsed_responses": "select event_id::varchar as run_id, case when event_id % 11 = 0 or event_id % 9 = 0 then 'invalid_output' else 'succeeded' end as status, case when event_id % 11 = 0 or event_id % 9 = 0 then 'OUTPUT_JSON_INVALID' end as error, case when event_id % 11 <> 0 and event_id % 9 <> 0 then event_id + 5 end as input_tokens, case when event_id % 11 <> 0 and event_id % 9 <> 0 then 7::bigint end as output_tokens, case when event_id % 11 <> 0 and event_id % 9 <> 0 then 2 + case when event_id % 4 = 0 then length(replace(props, ' ', '')) else 0 end end as chars from events",
        "contract_violations": with_views("findings") + " select 'severity' as rule, run_id || '/' || finding_id as key from findings where l_suppkey % 37 = 5 union all select 'lines', run_id || '/' || finding_id from findings where l_suppkey % 41 = 7 union all select 'required_title', run_id || '/' || finding_id from findings where l_suppkey % 43 = 9",
        "stratified_split": cases + f""", s as (select *, concat_ws(chr(1), {", ".join(corpus_split.DIMENSIONS)}) as stratum from c), z as (select stratum, count(*) as n, (select count(*) // 5 from c) as h, (select count(*) from c) as total from s group by 1),
          q as (select stratum, n * h // total as base, row_number() over (order by n * h % total desc, stratum) as r, h - sum(n * h // total) over () as spare from z), o as (select case_id, stratum, row_number() over (partition by stratum order by sha256('10:' || case_id), case_id) as k from s)
          select case_id, case when k <= base + (r <= spare)::int then 'holdout' else 'development' end as role from o join q using (stratum)""",
        "canonical_events": "select event_id, replace(props, ' ', '') as props from events",
    }


QUERIES = {f.__name__: f for f in (leaked_phrases, leaked_shas, leakage_audit, request_components, public_scan, canonical_digests, canonical_events, selected_context, limited_texts, bundle_budgets, tree_digests, split_balance, split_objective, stratified_split, holdout_order, split_proof, failure_classes, parsed_responses, contract_violations)}
ORACLE_SQL = _oracle()
