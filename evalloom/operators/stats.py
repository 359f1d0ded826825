"""Paired statistics over scored runs: counts, differences, discordance, case effects, stability, quality, distributions.

All tables are keyed by experiment_id; an unresolved outcome is null and suppresses a value, never a count.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.sources.scratch import broadcast_if_small, met, stored

MODES = ("primary", "pessimistic", "optimistic")
#: The terminal statuses of a run.
STATUSES = ("succeeded", "timeout", "provider_error", "configuration_error", "adapter_error", "invalid_output")
METRICS = ("latency_ms", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens", "estimated_input_tokens")


def to_modes(runs: DataFrame) -> DataFrame:
    """A row for each run and analysis mode; nulls stay."""
    keys = [c for c in runs.columns if not c.endswith("_outcome")]
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), F.col(f"{m}_outcome").alias("outcome")) for m in MODES))
    return runs.select(*keys, F.inline(modes))


def check_cells(runs: DataFrame, repetitions: int) -> DataFrame:
    """Violations: a case without exactly repetitions 1..R in each of the four cells."""
    cells = runs.groupBy("experiment_id", "case_id", "snapshot", "condition").agg(F.array_sort(F.collect_list("repetition")).alias("r"))
    bad = cells.filter(F.col("r") != F.sequence(F.lit(1), F.lit(repetitions))).select("case_id", F.lit("repetitions").alias("rule"), F.concat_ws("/", "snapshot", "condition").alias("detail"))
    few = cells.groupBy("experiment_id", "case_id").agg(F.count("*").alias("n")).filter("n <> 4").select("case_id", F.lit("cells").alias("rule"), F.col("n").cast("string").alias("detail"))
    return bad.union(few).select("rule", F.col("case_id").alias("key"), "detail")


def outcome_counts(modes: DataFrame, *by: str) -> DataFrame:
    """positive, negative, unresolved, total and value (null while anything is unresolved) by experiment, mode and cell."""
    rows = modes.groupBy("experiment_id", *by, "mode", "snapshot", "condition").agg(F.count_if("outcome").alias("positive"), F.count_if(~F.col("outcome")).alias("negative"), F.count_if(F.col("outcome").isNull()).alias("unresolved"), F.count("*").alias("total"))
    return rows.withColumn("value", F.when(F.col("unresolved") == 0, F.col("positive") / F.col("total")))


def differences(counts: DataFrame, *by: str) -> DataFrame:
    """Vulnerable lift, fixed false-positive increase and net useful lift: numerator, denominator, unresolved, value."""
    cell = lambda s, c, v: F.sum(F.when((F.col("snapshot") == s) & (F.col("condition") == c), F.col(v)).otherwise(0))
    wide = counts.groupBy("experiment_id", *by, "mode").agg(*(cell(s, c, v).alias(f"{s[0]}{c[0]}_{v}") for s in ("vulnerable", "fixed") for c in ("baseline", "candidate") for v in ("positive", "unresolved", "total")))
    lift, rise = F.expr("vc_positive - vb_positive"), F.expr("fc_positive - fb_positive")
    open_v, open_f = F.expr("vc_unresolved + vb_unresolved"), F.expr("fc_unresolved + fb_unresolved")
    row = lambda name, n, d, u: F.struct(F.lit(name).alias("effect"), n.alias("numerator"), F.col(d).alias("denominator"), u.alias("unresolved"))
    rows = wide.select("experiment_id", *by, "mode", F.inline(F.array(row("vulnerable_lift", lift, "vb_total", open_v), row("fixed_false_positive_increase", rise, "fb_total", open_f), row("net_useful_lift", lift - rise, "vb_total", open_v + open_f))))
    return rows.withColumn("value", F.when(F.col("unresolved") == 0, F.col("numerator") / F.nullif("denominator", F.lit(0))))


def discordance(modes: DataFrame, *by: str) -> DataFrame:
    """Pairs of (case, repetition) by how the two conditions agree, for each snapshot."""
    side = lambda c: F.max(F.when(F.col("condition") == c, F.when(F.col("outcome").isNull(), -1).otherwise(F.col("outcome").cast("int"))))
    pairs = modes.groupBy(*dict.fromkeys(("experiment_id", *by, "mode", "snapshot", "case_id", "repetition"))).agg(side("baseline").alias("b"), side("candidate").alias("c"))
    return pairs.groupBy("experiment_id", *by, "mode", "snapshot").agg(
        F.count_if(F.expr("b = 1 and c = 1")).alias("both"),
        F.count_if(F.expr("b = 0 and c = 1")).alias("candidate_only"),
        F.count_if(F.expr("b = 1 and c = 0")).alias("baseline_only"),
        F.count_if(F.expr("b = 0 and c = 0")).alias("neither"),
        F.count_if(F.expr("b = -1 or c = -1 or b is null or c is null")).alias("unresolved"),
    )


def case_effects(modes: DataFrame) -> DataFrame:
    """Effects of every case: cell means, null where a repetition is unresolved."""
    in_cell = lambda s, c: (F.col("snapshot") == s) & (F.col("condition") == c)
    mean = lambda s, c: F.when(F.count_if(in_cell(s, c) & F.col("outcome").isNull()) == 0, F.avg(F.when(in_cell(s, c), F.col("outcome").cast("int"))))
    rows = modes.groupBy("experiment_id", "mode", "case_id").agg(*(mean(s, c).alias(s[0] + c[0]) for s in ("vulnerable", "fixed") for c in ("baseline", "candidate")))
    lift, rise = F.col("vc") - F.col("vb"), F.col("fc") - F.col("fb")
    return rows.select("experiment_id", "mode", "case_id", lift.alias("vulnerable_lift"), rise.alias("fixed_false_positive_increase"), (lift - rise).alias("net_useful_lift"))


def nearest_rank(column: str, p: float) -> Column:
    """Nearest-rank quantile: the value at rank ceil(p n)."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def repetition_stability(runs: DataFrame) -> DataFrame:
    """Complete, unresolved and discordant cases of each cell, and the mean of the within-case population variance."""
    x = F.col("primary_outcome").cast("int")
    cells = runs.groupBy("experiment_id", "snapshot", "condition", "case_id").agg(F.count_if(x.isNull()).alias("open"), F.var_pop(x).alias("v"), (F.min(x) != F.max(x)).alias("split"))
    whole = F.col("open") == 0
    return cells.groupBy("experiment_id", "snapshot", "condition").agg(F.count_if(whole).alias("complete_cases"), F.count_if(~whole).alias("unresolved_cases"), F.count_if(whole & F.col("split")).alias("discordant_cases"), F.avg(F.when(whole, F.col("v"))).alias("mean_variance"))


def quality(runs: DataFrame, findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rates by condition and over all (condition 'all'): valid output, path, category, severity, mechanism; value over resolved."""
    def rate(df: DataFrame, name: str, good: Column, open_: Column) -> DataFrame:
        rows = df.groupingSets([[F.col("experiment_id")], [F.col("experiment_id"), F.col("condition")]], "experiment_id", "condition").agg(F.grouping_id().alias("g"), F.count_if(good).alias("correct"), F.count_if(open_).alias("unresolved"), F.count("*").alias("total"))
        resolved = F.col("total") - F.col("unresolved")
        return rows.select("experiment_id", F.when(F.col("g") > 0, "all").otherwise(F.col("condition")).alias("condition"), F.lit(name).alias("metric"), "correct", "unresolved", "total", (F.col("correct") / F.nullif(resolved, F.lit(0))).alias("value"))

    no, unique = F.lit(False), findings.filter("duplicate_of is null")
    flags = pairs.filter("duplicate_of is null and expected_status <> 'unverified'").groupBy("experiment_id", "condition", "run_id", "finding_id").agg(F.bool_or(F.col("decision") == "match").alias("hit"), F.bool_or(F.col("decision").isin("uncertain", "unadjudicated")).alias("open"))
    out = rate(runs, "valid_output", F.col("status") == "succeeded", no)
    for name, good in (("path", F.col("path_match") != "none"), ("category", F.col("category_match")), ("severity", F.col("severity_match"))):
        out = out.union(rate(unique, name, good, no))
    return out.union(rate(flags, "mechanism", F.col("hit"), ~F.col("hit") & F.col("open")))


def distributions(records: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Observations, missing, min, linear median, nearest-rank p95, max, mean and exact total of each metric by condition and over all.

    Quantiles are exact without a group being gathered: values are counted, and the bin that holds a rank is refined.
    """
    long = records.select("experiment_id", "condition", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x"), F.col(m).cast("string").cast("decimal(38,6)").alias("d")) for m in metrics))))
    keys = ["experiment_id", "metric", "condition"]
    sets = [[F.col("experiment_id"), F.col("metric")], [F.col(k) for k in keys]]
    rows = long.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("g"), F.count("x").alias("observations"), F.count_if(F.col("x").isNull()).alias("missing"), F.min("x").alias("min"), F.max("x").alias("max"), (F.sum("d").cast("double") / F.count("x")).alias("mean"), F.sum("d").cast("double").alias("total")
    )
    group = F.when(F.col("g") > 0, "all").otherwise(F.col("condition")).alias("condition")
    rows = rows.select("experiment_id", "metric", group, "observations", "missing", "min", "max", "mean", "total")
    values = stored(long.filter("x is not null").groupBy(*keys, "x").agg(F.count("*").alias("n")), "values")
    values = values.groupingSets([[*s, F.col("x")] for s in sets], *keys, "x").agg(F.grouping_id().alias("g"), F.sum("n").alias("n")).select("experiment_id", "metric", group, "x", "n")
    out = rows.join(quantiles(values, keys, {"median": (0.5, True), "p95": (0.95, False)}), keys, "left")
    return out.select("experiment_id", "condition", "metric", "observations", "missing", "min", "median", "p95", "max", "mean", "total")


#: Bins of a pass, and the different values of a bin that are ranked in one task.
BINS, FINE = 1_024, 4_096


def quantiles(values: DataFrame, keys: list[str], wanted: dict[str, tuple[float, bool]], bins: int = BINS, fine: int = FINE) -> DataFrame:
    """Quantiles of counted values (keys, x, n; an x once a key) by key: name to (p, linear or else nearest-rank).

    A pass cuts the range of values that holds a rank into ``bins`` and goes on with the bin that holds it, from that bin's least value
    to its greatest. A bin of at most ``fine`` different values is ranked. So however values lie, no task ranks more than that; a pass
    leaves a range that is ``bins`` times narrower, so values over many orders of magnitude take more passes.
    """
    edges = values.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("all"), F.count("*").alias("m"))
    n, ranks = F.col("all"), []
    for name, (p, linear) in wanted.items():
        if linear:
            low = F.floor((n - 1) * F.lit(p))
            ranks += [(f"{name}_a", low + 1), (f"{name}_b", F.least(low + 2, n))]
        else:
            ranks.append((name, F.ceil(n * F.lit(p).cast("decimal(6,4)")).cast("long")))
    # a row for each key and rank
    at = edges.select(*keys, "lo", "hi", "m", "all", F.lit(0).cast("long").alias("before"), F.inline(F.array(*(F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks))))
    at = stored(at, "ranks")
    done = []
    upto = Window.partitionBy(*keys, "name").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    inside = lambda rows: values.join(broadcast_if_small(rows), keys).filter("x between lo and hi")
    while True:
        wide = at.filter((F.col("m") > fine) & (F.col("lo") < F.col("hi")))
        done.append(at.filter((F.col("m") <= fine) | (F.col("lo") >= F.col("hi"))))
        if wide.isEmpty():
            break
        place = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        cut = inside(wide).groupBy(*keys, "name", "rank", "before", "all", place.alias("bin")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("size"), F.count("*").alias("m"))
        cut = cut.withColumn("last", F.col("before") + F.sum("size").over(upto)).filter("last >= rank and last - size < rank")
        at = stored(cut.select(*keys, "lo", "hi", "m", "all", (F.col("last") - F.col("size")).alias("before"), "name", "rank"), "ranks")
    ends = reduce(DataFrame.unionByName, done)
    order = Window.partitionBy(*keys, "name").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside(ends).withColumn("last", F.col("before") + F.sum("n").over(order)).filter("last >= rank")
    found = ranked.groupBy(*keys, "name", "all").agg(F.min("x").alias("x"))
    of = lambda k: F.max(F.when(F.col("name") == k, F.col("x")))
    out = []
    for name, (p, linear) in wanted.items():
        if linear:
            place = (F.max("all") - 1) * F.lit(p)
            out.append((of(f"{name}_a") + (of(f"{name}_b") - of(f"{name}_a")) * (place - F.floor(place))).alias(name))
        else:
            out.append(of(name).alias(name))
    return found.groupBy(*keys).agg(*out)


def case_tags(cases: DataFrame, mechanisms: DataFrame, records: DataFrame) -> DataFrame:
    """case_id, dimension, value: repository, accepted categories (each), severity range, size of the largest estimate."""
    repo = F.coalesce(F.nullif(F.regexp_extract("case_id", "^(.+)-pr[0-9]+-f[0-9]+$", 1), F.lit("")), F.lit("unknown"))
    repository = cases.select("case_id", F.lit("repository").alias("dimension"), repo.alias("value"))
    primary = mechanisms.filter("evaluation_role = 'primary'")
    category = primary.select("case_id", F.lit("category").alias("dimension"), F.explode("categories").alias("value"))
    severity = primary.select("case_id", F.lit("severity").alias("dimension"), F.when(F.col("severity_min") == F.col("severity_max"), F.col("severity_min")).otherwise(F.concat("severity_min", F.lit("-to-"), "severity_max")).alias("value"))
    size = records.groupBy("case_id").agg(F.max("estimated_input_tokens").alias("n"))
    band = size.select("case_id", F.lit("context_size").alias("dimension"), F.when(F.col("n").isNull(), "unknown").when(F.col("n") <= 2000, "small").when(F.col("n") <= 8000, "medium").otherwise("large").alias("value"))
    return repository.union(category).union(severity).union(band).distinct()


def breakdowns(modes: DataFrame, tags: DataFrame) -> DataFrame:
    """Differences by tag: one aggregation over all tags and modes."""
    return differences(breakdown_counts(modes, tags), "dimension", "tag")


def breakdown_counts(modes: DataFrame, tags: DataFrame) -> DataFrame:
    """Outcome counts by tag; tags are different rows."""
    parts = ("positive", "negative", "unresolved", "total")
    rows = by_tag(outcome_counts(modes, "case_id"), tags, ("mode", "snapshot", "condition"), parts)
    return rows.withColumn("value", F.when(F.col("unresolved") == 0, F.col("positive") / F.col("total")))


def breakdown_discordance(modes: DataFrame, tags: DataFrame) -> DataFrame:
    """Discordance by tag; tags are different rows."""
    return by_tag(discordance(modes, "case_id"), tags, ("mode", "snapshot"), ("both", "candidate_only", "baseline_only", "neither", "unresolved"))


def by_tag(cases: DataFrame, tags: DataFrame, cell: tuple[str, ...], counts: tuple[str, ...]) -> DataFrame:
    """Counts of cases added up by tag: runs are counted by case before, so that no run is repeated for the tags of its case."""
    rows = cases.select("case_id", "experiment_id", *cell, *counts).join(met(tags.withColumnRenamed("value", "tag")), "case_id")
    return rows.groupBy("experiment_id", "dimension", "tag", *cell).agg(*(F.sum(c).alias(c) for c in counts))


def status_counts(runs: DataFrame) -> DataFrame:
    """Runs of each terminal status, 0 where there are none."""
    wide = runs.groupBy("experiment_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    return wide.select("experiment_id", F.inline(F.array(*(F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in STATUSES))))


def cr1_bounds(effects: DataFrame, projects: DataFrame, alpha: float = 0.025) -> DataFrame:
    """Case-weighted CR1 bounds clustered by project: mean -+ z sd, with var = G / (G - 1) sum s^2 / n^2; null while a case is unresolved or G < 2.

    effects: experiment_id, case_id (and mode), vulnerable_lift, fixed_false_positive_increase; projects: case_id, project.
    """
    z, keys = NormalDist().inv_cdf(1 - alpha), [c for c in ("experiment_id", "mode") if c in effects.columns]
    long = effects.join(projects, "case_id").select(*keys, "project", F.inline(F.array(*(F.struct(F.lit(e).alias("effect"), F.col(e).alias("x")) for e in ("vulnerable_lift", "fixed_false_positive_increase")))))
    keys.append("effect")
    clusters = long.groupBy(*keys, "project").agg(F.sum("x").alias("s"), F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("open"))
    means = clusters.groupBy(*keys).agg(F.sum("s").alias("sum"), F.sum("n").alias("cases"), F.count("*").alias("projects"), F.sum("open").alias("unresolved"))
    rows = clusters.drop("open").join(means, keys).withColumn("centred", F.col("s") - F.col("n") * F.col("sum") / F.col("cases"))
    out = rows.groupBy(*keys, "cases", "projects", "unresolved").agg((F.first("sum") / F.col("cases")).alias("m"), F.sum(F.col("centred") * F.col("centred")).alias("ss"))
    sd = F.sqrt(F.col("projects") / F.nullif(F.col("projects") - 1, F.lit(0)) * F.col("ss")) / F.col("cases")
    known = lambda c: F.when((F.col("unresolved") == 0) & (F.col("projects") > 1), c)
    return out.select(*keys, "cases", "projects", "unresolved", known(F.col("m")).alias("mean"), known(sd).alias("standard_error"), known(F.col("m") - z * sd).alias("lower"), known(F.col("m") + z * sd).alias("upper"))
