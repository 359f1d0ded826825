"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule compares one document statistic with a cutoff. Cutoffs are chosen per stratum from labelled holdout documents: a
cutoff may be used only if the exact binomial tail says that it rejects less than ``alpha / number of rules`` of the good
documents, at level ``delta / (rules x strata)`` (Bonferroni over rules and strata; within a rule the cutoffs are tested
from the loosest on and testing stops at the first that fails, which needs no further correction). By the union bound, all
rules together falsely reject at most ``alpha`` of a stratum's good documents, in every stratum at once, with probability
``1 - delta``. Among the certified cutoffs of a rule, the one with the most bad documents rejected less ``cost`` times the
good ones is taken, the loosest on a tie. A stratum with too few labels to certify anything gets no cutoff: only the base
rule acts there.

Defined cases: null or empty text has no words and fails the base rule; a null stratum value is a stratum of its own; null
labels and null ids take no part in calibration; a document labelled more than once counts as good only if all its labels
say so; repeated rows of a document are judged each; very long texts are judged whole; an empty table gives an empty result. Columns other than those named
are carried through by ``apply_rules`` and never used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import BROADCAST_ROWS, materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: For each rule its statistic and cutoffs from the loosest to the tightest (a document above is rejected).
RULES = {
    "symbols_per_word": [3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "repeat_share": [0.18, 0.15, 0.12, 0.1, 0.08],
    "chars_per_word": [40.0, 30.0, 25.0, 20.0, 15.0, 12.0, 10.0],
    "lines_per_word": [0.9, 0.7, 0.5, 0.4, 0.3],
}
WINDOW = 5


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def base_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (long); null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def repeated(words: Column) -> Column:
        """Words in windows of five that are found twice or more: windows as 64-bit hashes of word hashes."""

        def covered(windows: Column) -> Column:
            n = F.size(windows)

            def positions(ordered: Column) -> Column:
                same = lambda i, j: ordered[i]["h"] == ordered[j]["h"]
                hit = F.filter(
                    F.transform(
                        ordered,
                        lambda x, i: F.when(F.when(i > 0, same(i, i - 1)).otherwise(False) | F.when(i + 1 < n, same(i, i + 1)).otherwise(False), x["i"]),
                    ),
                    lambda p: p.isNotNull(),
                )
                return let(
                    F.sort_array(hit),
                    lambda p: F.aggregate(
                        F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.when(k > 0, x - p[k - 1]).otherwise(WINDOW))), F.lit(0), lambda a, x: a + x
                    ),
                )

            ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            return F.when(n == F.size(F.array_distinct(windows)), F.lit(0)).otherwise(let(ordered, positions))

        def windows(h: Column) -> Column:
            return F.transform(F.slice(h, F.lit(1), F.size(h) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *(h[i + k] for k in range(1, WINDOW))))

        hashes = F.transform(words, lambda w: F.xxhash64(w))
        return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(let(hashes, lambda h: let(windows(h), covered)))

    return let(
        F.struct(words.alias("w"), lines.alias("l"), text.alias("t")),
        lambda s: F.struct(
            F.size(s["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(s["w"], "")).cast("long").alias("word_chars"),
            (F.length(s["t"]) - F.length(F.translate(s["t"], SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
            repeated(s["w"]).cast("long").alias("n_repeat_words"),
            F.size(s["l"]).cast("long").alias("n_lines"),
        ),
    )


def base_failed(s: str) -> Column:
    return (F.col(f"{s}.n_words") < 10) | (100 * F.col(f"{s}.n_repeat_words") > 20 * F.col(f"{s}.n_words"))


def rule_values(s: str) -> dict[str, Column]:
    """The statistic of each rule, from the struct column ``s``; null where there are no words."""
    words, lines = F.nullif(F.col(f"{s}.n_words"), F.lit(0)).cast("double"), F.nullif(F.col(f"{s}.n_lines"), F.lit(0)).cast("double")
    return {
        "symbols_per_word": F.col(f"{s}.n_symbols") / words,
        "dup_line_share": F.col(f"{s}.n_dup_lines") / lines,
        "repeat_share": F.col(f"{s}.n_repeat_words") / words,
        "chars_per_word": F.col(f"{s}.word_chars") / words,
        "lines_per_word": F.col(f"{s}.n_lines") / words,
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in logarithms; 1 where k > n p, which no test passes."""
    odds = F.log(F.lit(p)) - F.log1p(F.lit(-p))
    first = n * F.log1p(F.lit(-p))
    step = lambda s, i: let(
        s["t"] + F.log((n - i + 1) / i) + odds,
        lambda t: F.struct(t.alias("t"), let(F.greatest(s["s"], t), lambda m: m + F.log(F.exp(s["s"] - m) + F.exp(t - m))).alias("s")),
    )
    tail = F.exp(F.aggregate(F.sequence(F.lit(1), k), F.struct(first.alias("t"), first.alias("s")), step)["s"])
    return F.when(k > n * p, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(tail)


def stratum_key(stratum: Column) -> Column:
    """A text for each stratum value that tells a null from all values."""
    return F.when(stratum.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), stratum.cast("string")))


def calibrate(stats: DataFrame, labels: DataFrame, stratum: str, alpha: float = 0.05, delta: float = 0.05, cost: float = 20.0) -> DataFrame:
    """One row per stratum with labels: ``stratum`` and a cutoff per rule (null: none certified).

    stats: doc_id, the stratum column and the struct ``stats``; labels: doc_id, quality (1 good, 0 bad).
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    holdout = stats.filter(~base_failed("stats")).select("doc_id", stratum_key(F.col(stratum)).alias("stratum"), *(v.alias(k) for k, v in rule_values("stats").items())).join(known, "doc_id")
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    counts = holdout.groupBy("stratum").agg(
        F.count_if(good).alias("n"),
        *(F.count_if(is_it & (F.col(rule) > cut)).alias(f"{rule}_{which}{i}") for rule, cuts in RULES.items() for i, cut in enumerate(cuts) for which, is_it in (("g", good), ("b", bad))),
    )
    tried = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(cut).alias("cut"), F.col(f"{rule}_g{i}").alias("k"), F.col(f"{rule}_b{i}").alias("bad")) for rule, cuts in RULES.items() for i, cut in enumerate(cuts)))
    tests = counts.select("stratum", "n", F.inline(tried)).withColumn("p", binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)))
    level = delta / len(RULES) / F.greatest(F.col("strata"), F.lit(1))
    strata = counts.filter("n > 0").agg(F.count("*").alias("strata"))
    tests = tests.join(F.broadcast(strata)).withColumn("failed", F.col("p") > level)
    first = tests.groupBy("stratum", "rule").agg(F.min(F.when(F.col("failed"), F.col("i"))).alias("stop"))
    best = (
        tests.join(first, ["stratum", "rule"])
        .filter("(stop is null or i < stop) and bad > 0")
        .groupBy("stratum", "rule")
        .agg(F.max_by("cut", F.struct(F.col("bad") - cost * F.col("k"), -F.col("i"))).alias("cut"), F.max(F.col("bad") - cost * F.col("k")).alias("gain"))
        .filter("gain > 0")
    )
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in RULES))


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05, cost: float = 20.0, slim: bool = False) -> DataFrame:
    """``docs`` with the struct columns ``stats`` and ``rules`` (base_failed, rejected_by array, kept).

    The statistics are computed from the whole text. For calibration they are written without the text: those of labelled
    documents if few are labelled, and else of all. With ``slim`` only doc_id and the stratum are returned beside stats and
    rules, and what was written is used again; else the result computes them anew, so that no second copy of the texts is
    written. Columns of docs that are named stats, rules, _stratum or cut_ and a rule are left out.
    """
    docs = docs.drop("stats", "rules", "_stratum", *(f"cut_{r}" for r in RULES))
    # a generated column: conditions on it can't be pushed below it, which would compute it once for each use
    counted = F.explode(F.array(base_statistics(F.col("text")))).alias("stats")
    labelled = docs
    if not slim:
        ids = labels.filter("doc_id is not null and quality is not null").select("doc_id").distinct()
        if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            labelled = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    stats = materialize(labelled.select("doc_id", stratum, counted), "stats")
    docs = stats if slim else docs.select("*", counted)
    cutoffs = materialize(calibrate(stats, labels, stratum, alpha, delta, cost), "cutoffs").withColumnRenamed("stratum", "_stratum")
    if cutoffs.count() <= BROADCAST_ROWS:
        cutoffs = F.broadcast(cutoffs)
    judged = docs.join(cutoffs, stratum_key(docs[stratum]) == F.col("_stratum"), "left")
    rejected = F.array_compact(F.array(*(F.when(v > F.col(f"cut_{r}"), F.lit(r)) for r, v in rule_values("stats").items())))
    judged = judged.withColumn("rules", F.struct(base_failed("stats").alias("base_failed"), rejected.alias("rejected_by"), (~base_failed("stats") & (F.size(rejected) == 0)).alias("kept")))
    return judged.drop("_stratum", *(f"cut_{r}" for r in RULES))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    out = apply_rules(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality"), slim=True)
    return out.select("doc_id", *(F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "rules.base_failed", "rules.kept")


def oracle_sql(alpha: float = 0.05, delta: float = 0.05, cost: float = 20.0) -> str:
    """The same in DuckDB's SQL over the tables documents and labels."""
    rules = {"symbols_per_word": "n_symbols / w", "dup_line_share": "n_dup_lines / l", "repeat_share": "n_repeat_words / w", "chars_per_word": "word_chars / w", "lines_per_word": "n_lines / w"}
    grid = ", ".join(f"('{r}', {i}, {c}::double)" for r, cuts in RULES.items() for i, c in enumerate(cuts))
    p = alpha / len(RULES)
    return rf"""
with split as (
  select row_number() over () as r, doc_id, case when lang is null then 'null' else '=' || lang end as stratum, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
windows as (select r, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) as v, unnest(range(1, len(ws) - 3)) as i from split),
found as (select r, i, count(*) over (partition by r, v) as c from windows),
steps as (select r, i - lag(i) over (partition by r order by i) as d from found where c > 1),
covered as (select r, sum(least(5, coalesce(d, 5))) as n_repeat_words from steps group by r),
base as (
  select r, doc_id, stratum, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines, nullif(len(ws), 0)::double as w, nullif(len(ls), 0)::double as l
  from split left join covered using (r)),
judged as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from base),
known as (select doc_id, min(quality) as quality from labels where doc_id is not null and quality is not null group by doc_id),
grid(rule, i, cut) as (values {grid}),
vals as (select r, doc_id, stratum, base_failed, unnest([{", ".join(f"'{r}'" for r in rules)}]) as rule, unnest([{", ".join(rules.values())}]) as v from judged),
counts as (
  select stratum, rule, i, cut, count(*) filter (quality = 1) as n, count(*) filter (quality = 1 and v > cut) as k, count(*) filter (quality = 0 and v > cut) as bad
  from vals join known using (doc_id) join grid using (rule) where not base_failed group by all),
tests as (select *, case when k > n * {p} then 1 else list_sum(list_transform(range(0, k + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}::double) + (n - j) * ln(1 - {p}::double)))) end as pv from counts),
stops as (select *, min(i) filter (pv > {delta} / {len(RULES)} / greatest(1, (select count(distinct stratum) from counts where n > 0))) over (partition by stratum, rule) as stop from tests),
best as (select stratum, rule, arg_max(cut, (bad - {cost} * k) * 1000 - i) as cut, max(bad - {cost} * k) as gain from stops where (stop is null or i < stop) and bad > 0 group by all),
bad as (select distinct r from vals join best using (stratum, rule) where gain > 0 and v > cut)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and bad.r is null) as kept
from judged left join bad using (r)"""
