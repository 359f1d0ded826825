"""Digests, chains, quantiles and exact intervals where a group is large or values lie badly."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions.chains import endless
from evalloom.functions.digests import ordered_digest, placed
from evalloom.operators import bootstrap, corpus_split, scoring, stats


def nested(lines, part):
    while True:
        lines = [hashlib.sha256("\n".join(lines[i : i + part]).encode()).hexdigest() for i in range(0, len(lines), part)]
        if len(lines) == 1:
            return "sha256:" + lines[0]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_ordered_digest_of_a_group_over_many_tasks(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.range(0, 3_000, 1, 5).select(F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 50 == 1, "small").otherwise("large").alias("g"), (F.col("id") * 7919 % 3_001).alias("o"), F.concat(F.lit("line "), "id").alias("line"))
        got = {r["g"]: (r["digest"], r["n"]) for r in ordered_digest(rows, ["g"], ["o"], F.col("line"), part=10).collect()}
        held = rows.collect()
        for g in (None, "small", "large"):
            lines = [r["line"] for r in sorted((r for r in held if r["g"] == g), key=lambda r: r["o"])]
            assert got[g] == (nested(lines, 10), len(lines))
        whole = ordered_digest(rows, [], ["o"], F.col("line"), part=100).collect()
        assert len(whole) == 1 and whole[0]["digest"] == nested([r["line"] for r in sorted(held, key=lambda r: r["o"])], 100)
        places = placed(rows, ["g"], ["o"]).filter("g = 'large'").orderBy("o").select("place").collect()
        assert [r["place"] for r in places] == list(range(len(places)))
        assert ordered_digest(rows.limit(0), ["g"], ["o"], F.col("line")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_split_proof_is_the_digest_of_the_ordered_members(spark):
    split = spark.createDataFrame([(f"c{i}", "holdout" if i % 3 else "development") for i in range(40)], "case_id string, role string")
    members = sorted((f"c{i}" for i in range(40) if i % 3), key=lambda c: hashlib.sha256(f"5:{c}".encode()).hexdigest())
    row = corpus_split.split_proof(split, 5).first()
    assert row["ordered_holdout_checksum"] == "sha256:" + hashlib.sha256("\n".join(members).encode()).hexdigest() and (row["case_count"], row["holdout_count"]) == (40, len(members))


def test_long_chains_end_and_cycles_don_t(spark):
    n = 100_000
    chain = spark.range(1, n).select(F.concat(F.lit("a"), "id").alias("id"), F.concat(F.lit("a"), F.col("id") - 1).alias("at"))
    ring = spark.createDataFrame([("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("t1", "r0"), ("t2", "t1"), ("self", "self"), ("x", "nowhere"), (None, "x"), ("y", None)], "id string, at string")
    assert sorted(r["id"] for r in endless(chain.union(ring)).collect()) == ["r0", "r1", "r2", "self", "t1", "t2"]
    assert endless(chain).count() == 0 and endless(ring.limit(0)).count() == 0


def test_cycles_and_long_logs_of_adjudications(spark):
    log = [(f"a{i}", "r", "f", "m", "match", f"a{i - 1}" if i else None) for i in range(300)] + [("c1", "r", "g", "m", "match", "c2"), ("c2", "r", "g", "m", "match", "c1"), ("d", "r", "h", "m", "match", "a5")]
    found = scoring.check_adjudications(spark.createDataFrame(log, "adjudication_id string, run_id string, finding_id string, expected_mechanism_id string, decision string, supersedes string"))
    got = sorted((r["rule"], r["key"]) for r in found.collect())
    assert got == [("changed_identity", "d"), ("cycle", "c1"), ("cycle", "c2")]


@pytest.mark.parametrize("shape", ["one range holds nearly all", "powers", "equal", "few"])
def test_quantiles_by_refinement(spark, shape):
    rng = np.random.default_rng(3)
    x = {"one range holds nearly all": np.concatenate([rng.random(5_000), [1e12, -1e9, 5.0]]), "powers": 2.0 ** np.arange(-20, 20), "equal": np.full(40, 3.5), "few": np.array([1.0, 2.0])}[shape]
    rows = spark.createDataFrame([("k", float(v)) for v in x], "g string, x double").groupBy("g", "x").agg(F.count("*").alias("n"))
    row = stats.quantiles(rows, ["g"], {"median": (0.5, True), "p95": (0.95, False), "low": (0.01, False)}, bins=8, fine=20).first()
    ordered = np.sort(x)
    nearest = lambda p: ordered[max(0, int(np.ceil(round(p * len(x), 9))) - 1)]
    assert row["median"] == pytest.approx(np.percentile(x, 50), rel=1e-15) and row["p95"] == nearest(0.95) and row["low"] == nearest(0.01)


def test_convolution_is_the_distribution_of_all_resamples():
    values = np.array([1 / 3, -1 / 3, 0.0, 2 / 3])
    first, p, scale = bootstrap.resampled_sum(values, np.array([1, 1, 1, 1]))
    want = {}
    for draw in itertools.product(values, repeat=4):
        k = round(sum(draw) * 3)
        want[k] = want.get(k, 0) + 0.25**4
    assert scale == 12 and {first + i: x for i, x in enumerate(p) if x > 1e-12} == pytest.approx(want)
    with pytest.raises(ValueError, match="grid"):
        bootstrap.lattice(np.array([0.123456789]))


def test_quantiles_of_convolution_are_those_of_many_draws(spark):
    rnd = random.Random(4)
    rows = [("e", "primary", f"c{i}", v := rnd.choice([0.0, 1 / 3, -1 / 3, 2 / 3]), f := rnd.choice([0.0, 0.5, 1.0]), v - f) for i in range(700)] + [("o", "primary", "c", None, 0.0, None)]
    effects = spark.createDataFrame(rows, "experiment_id string, mode string, case_id string, vulnerable_lift double, fixed_false_positive_increase double, net_useful_lift double")
    exact, drawn = ({(r["experiment_id"], r["effect"]): (r["lower"], r["upper"]) for r in bootstrap.bootstrap_intervals(effects, m).collect()} for m in ("convolution", "multinomial"))
    assert exact.keys() == drawn.keys() and len(exact) == 3
    assert all(abs(a - b) < 1e-3 for k in exact for a, b in zip(exact[k], drawn[k]))


def test_interval_of_fifteen_cases():
    """One case of fifteen with two thirds: 2 / 45 and an interval from 0 to 0.133, rounded."""
    lower, upper = bootstrap.exact_interval(np.array([2 / 3, 0.0]), np.array([1, 14]))
    assert (lower, round(upper, 3)) == (0.0, 0.133)


def test_wide_convolutions_stay_narrow():
    first, p, scale = bootstrap.resampled_sum(np.array([-1 / 3, 0.0, 1 / 3]), np.array([10**8, 10**8, 10**8]))
    assert len(p) < 1e6 and p.sum() == pytest.approx(1) and abs((first + np.arange(len(p))) @ p) < 1e-3 * np.sqrt(3e8)
