"""Leakage scan: forbidden phrases, SHAs, fingerprints and tokens in the components of reviewer requests.

Phrases are found by equi-joins on word n-grams, never by comparing every phrase with every text: a phrase of n words is keyed
by that of its n-grams of min(n, 3) words which the fewest components have, so that a frequent opening makes no hot key; texts give
their n-grams of those sizes, and what the join finds is verified on the whole text. Text n-grams are hashed and made distinct within a
component, and only those of some phrase survive the first join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import compatible, hmac_digest, normalize_phrase
from evalloom.sources.scratch import broadcast_if_small, stored

KEY_WORDS = 3
#: Distinct n-grams of phrases (8 bytes each) that are sent to all tasks at most.
BROADCAST_GRAMS = 1_000_000
LABELS = ("vulnerable", "fixed")
LABEL_RULE = "snapshot_label"


def build_index(cases: DataFrame, gold_phrases: DataFrame, policy_phrases: DataFrame, shas: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Forbidden entries (case_id, rule_id, mode, value), normalised and distinct.

    gold_phrases, policy_phrases: case_id, rule_id, value; shas: case_id, value, reviewed commit left out; fingerprints: case_id, value.
    """
    phrases = gold_phrases.unionByName(policy_phrases).select("case_id", "rule_id", F.lit("phrase").alias("mode"), normalize_phrase("value").alias("value"))
    labels = cases.select("case_id", F.lit(LABEL_RULE).alias("rule_id"), F.lit("phrase").alias("mode"), F.explode(F.array(*map(F.lit, LABELS))).alias("value"))
    own = cases.select("case_id", F.lit(LABEL_RULE), F.lit("token"), F.lower("case_id"))
    pulls = cases.select("case_id", F.lit(LABEL_RULE), F.lit("pull_request_token"), F.lit("pr<digits>"))
    hexes = shas.select("case_id", F.lit("sensitive_sha"), F.lit("sha"), F.lower("value")).union(fingerprints.select("case_id", F.lit("fixed_fingerprint"), F.lit("fingerprint"), F.regexp_replace(F.lower("value"), "^sha256:", "")))
    return phrases.union(labels).union(own).union(pulls).union(hexes).distinct()


def check_index(index: DataFrame) -> DataFrame:
    """Violations: entries whose normal form is empty."""
    return index.filter("value is null or value = ''").select(F.lit("empty").alias("rule"), F.concat_ws("/", "case_id", "rule_id").alias("key"))


def _grams(words: Column) -> Column:
    """Distinct hashes of all n-grams of 1 to KEY_WORDS words; ``words`` is computed once."""

    def of(w: Column) -> Column:
        def size(n: int) -> Column:
            grams = F.transform(F.slice(w, F.lit(1), F.size(w) - (n - 1)), lambda x, i: F.xxhash64(F.concat_ws(" ", x, *(w[i + k] for k in range(1, n)))))
            return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<bigint>"))

        return F.array_distinct(F.flatten(F.array(*map(size, range(1, KEY_WORDS + 1)))))

    return F.transform(F.array(words), of)[0]


def scan_labels(components: DataFrame, index: DataFrame) -> DataFrame:
    """Label phrases outside repository content: of what a request says itself, ``request_components`` marks the label text."""
    text = F.col("label_text") if "label_text" in components.columns else F.when(~F.col("location_class").isin("filename", "context_bundle"), F.col("text"))
    searched = components.withColumn("text", text).filter("text is not null")
    return scan_phrases(searched, index.filter(F.col("rule_id") == LABEL_RULE))


def phrase_keys(phrases: DataFrame, grams: DataFrame, on: list[str]) -> DataFrame:
    """phrases (value normal) with ``gram``: the hash of that of its n-grams which the fewest components (rows of ``grams``) have.

    A phrase with an n-gram that none has is found nowhere and goes.
    """
    seen = grams.groupBy(*on).agg(F.count("*").alias("seen"))
    each = phrases.withColumn("gram", F.explode(_phrase_grams(F.split("value", " ")))).join(seen, on, "left")
    rarest = each.groupBy(*phrases.columns).agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "gram")).alias("k"))
    return rarest.filter("k.seen > 0").select(*phrases.columns, "k.gram")


def _phrase_grams(words: Column) -> Column:
    """Distinct hashes of a phrase's n-grams of KEY_WORDS words, or of all its words if it has fewer."""
    n = F.least(F.size(words), F.lit(KEY_WORDS))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " "))))


def scan_phrases(components: DataFrame, index: DataFrame, scope: str | None = "case_id") -> DataFrame:
    """Whole-word phrase hits. components: request_id, pos, location_class, text (and the scope column); ``scope`` None looks for all phrases everywhere."""
    phrases = index.filter("mode = 'phrase' and value <> ''").select("case_id", "rule_id", "value").distinct()
    texts = components.select(*([scope] if scope else []), "request_id", "pos", "location_class", normalize_phrase("text").alias("normal")).filter("normal <> ''")
    # components are told apart by a number, as ids of requests may be null or repeated
    texts = stored(texts.withColumn("row", F.monotonically_increasing_id()), "normal")
    grams = texts.select(*([scope] if scope else []), "row", F.explode(_grams(F.split("normal", " "))).alias("gram"))
    on = ["gram"] + ([scope] if scope else [])
    wanted = stored(phrases.select(F.explode(_phrase_grams(F.split("value", " "))).alias("gram")).distinct(), "grams")
    # most n-grams are in no phrase: they go before anything is shuffled
    grams = stored(grams.join(broadcast_if_small(wanted, BROADCAST_GRAMS), "gram", "left_semi"), "grams")
    label = (F.col("rule_id") == LABEL_RULE) & F.col("location_class").isin("filename", "context_bundle")
    hits = grams.join(phrase_keys(phrases, grams, on), on).join(texts.select("row", "request_id", "pos", "location_class", "normal"), "row")
    hits = hits.filter(F.contains(F.concat(F.lit(" "), "normal", F.lit(" ")), F.concat(F.lit(" "), "value", F.lit(" "))) & ~label)
    return hits.select("case_id", "request_id", "pos", "location_class", "rule_id", F.col("value").alias("match")).distinct()


def scan_shas(components: DataFrame, index: DataFrame) -> DataFrame:
    """Hex tokens of 7 to 40 characters that begin a forbidden SHA: joined on the first 7."""
    tokens = components.select("case_id", "request_id", "pos", "location_class", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?i)(?<![0-9a-f])([0-9a-f]{7,40})(?![0-9a-f])"), F.lit(1)))).alias("token"))
    tokens = tokens.withColumns({"token": F.lower("token"), "head": F.substr(F.lower("token"), F.lit(1), F.lit(7))})
    wanted = index.filter("mode = 'sha'").select("case_id", "rule_id", F.col("value").alias("sha"), F.substr("value", F.lit(1), F.lit(7)).alias("head"))
    return tokens.join(wanted, ["case_id", "head"]).filter(F.startswith("sha", "token")).select("case_id", "request_id", "pos", "location_class", "rule_id", F.col("token").alias("match")).distinct()


def scan_tokens(components: DataFrame, index: DataFrame) -> DataFrame:
    """Fingerprints (64 hex), case-id tokens (in the NFKC form of a text) and pull-request tokens."""
    patterns = {"fingerprint": ("(?i)(?<![0-9a-f])(?:sha256:)?([0-9a-f]{64})(?![0-9a-f])", 1), "token": ("(?i)(?<![a-z0-9-])([a-z0-9]+(?:-[a-z0-9]+)*)(?![a-z0-9-])", 1), "pull_request_token": ("(?i)(?<![a-z0-9_])(pr[0-9]+)(?![a-z0-9_])", 1)}
    out = None
    components = components.withColumn("compatible", compatible("text"))
    for mode, (pattern, group) in patterns.items():
        source = "compatible" if mode == "token" else "text"
        tokens = components.select("case_id", "request_id", "pos", "location_class", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(group)), lambda t: F.lower(t)))).alias("match"))
        wanted = index.filter(F.col("mode") == mode).select("case_id", "rule_id", "value")
        hits = tokens.join(wanted, "case_id") if mode == "pull_request_token" else tokens.join(wanted.withColumnRenamed("value", "match"), ["case_id", "match"])
        hits = hits.select("case_id", "request_id", "pos", "location_class", "rule_id", "match")
        out = hits if out is None else out.union(hits)
    return out.distinct()


def request_components(requests: DataFrame) -> DataFrame:
    """Components of requests: case_id, request_id, pos, location_class, text, label_text.

    requests: case_id, request_id, prompt, profile, entries array<struct<path, content, and what else an entry has>>, config
    map<string,string>. A serialized request holds its entries under ``repository_context``. Labels may stand in paths and
    contents that belong to the repository: label_text is the same text without these, null where nothing else is in it.
    """
    others = [f for f in requests.schema["entries"].dataType.elementType.names if f not in ("path", "content")]
    bare = F.transform("entries", lambda e: F.struct(*(e[f].alias(f) for f in others))) if others else F.array()
    whole = lambda entries: F.to_json(F.struct("prompt", "profile", "config", F.struct(entries.alias("entries")).alias("repository_context")))
    none = F.lit(None).cast("string")
    piece = lambda kind, text, label=None: F.struct(F.lit(kind).alias("location_class"), text.alias("text"), (text if label is None else label).alias("label_text"))
    parts = F.concat(
        F.array(piece("serialized_request", whole(F.col("entries")), whole(bare)), piece("serialized_request", F.col("prompt")), piece("profile", F.col("profile"))),
        F.transform("entries", lambda e: piece("filename", e["path"], none)),
        F.array(piece("tool_configuration", F.to_json("config"))),
        F.transform(F.map_values("config"), lambda v: piece("tool_configuration", v)),
        F.array(piece("context_bundle", F.to_json("entries"), none)),
        F.transform("entries", lambda e: piece("context_bundle", e["content"], none)),
    )
    return requests.select("case_id", "request_id", F.posexplode(parts).alias("pos", "part")).select("case_id", "request_id", "pos", "part.*")


def audit(matches: DataFrame, exceptions: DataFrame, checked_at: Column, key: bytes) -> DataFrame:
    """Distinct matches (case, rule, location, keyed digest) and whether an unexpired exact exception covers each."""
    payload = F.concat(F.lit("match-v1\0"), "rule_id", F.lit("\0"), "match")
    rows = matches.select("case_id", "rule_id", "location_class", hmac_digest(key)(payload).alias("match_digest")).distinct()
    live = exceptions.filter(F.col("expires_at") > checked_at).select("case_id", "rule_id", "location_class", "match_digest", F.lit(True).alias("excepted")).distinct()
    return rows.join(live, ["case_id", "rule_id", "location_class", "match_digest"], "left").withColumn("excepted", F.coalesce("excepted", F.lit(False)))


def audit_verdict(cases: DataFrame, audited: DataFrame) -> DataFrame:
    """Whether every match of a case is excepted; a case without a match passes."""
    rows = audited.groupBy("case_id").agg(F.count("*").alias("matches"), F.every("excepted").alias("passed"))
    return cases.select("case_id").join(rows, "case_id", "left").select("case_id", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("passed", F.lit(True)).alias("passed"))


def request_identity(cases: DataFrame, key: bytes) -> DataFrame:
    """An opaque keyed identity of each (case, snapshot) from private material (case_id, material)."""
    rows = cases.select("case_id", "material", F.explode(F.array(*map(F.lit, LABELS))).alias("snapshot"))
    return rows.select("case_id", "snapshot", hmac_digest(key)(F.concat_ws("\0", "material", "case_id", "snapshot")).alias("identity"))


def resolve_identity(identities: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each identity's case and snapshot; resolved only if exactly one candidate has it."""
    rows = identities.select("identity").distinct().join(candidates, "identity", "left").groupBy("identity").agg(F.count("case_id").alias("n"), F.min("case_id").alias("case_id"), F.min("snapshot").alias("snapshot"))
    one = F.col("n") == 1
    return rows.select("identity", "n", F.when(one, F.col("case_id")).alias("case_id"), F.when(one, F.col("snapshot")).alias("snapshot"))
