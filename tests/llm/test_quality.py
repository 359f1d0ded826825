"""Quality rules and classifier: brute force, SQL, edge cases, held-out accuracy."""

import math
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalloom.llm import quality_classifier, quality_rules

DOCS = "doc_id long, text string, lang string, stats string, rules string"
LABELS = "doc_id long, quality int"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), len("".join(words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x " * 40, "é # ü\n\né # ü\n é # ü", "a b c d e f " * 3 + "#|<", "w\x0bv\x1cu", " a b", "q" * 5000 + " " + "r s t u v " * 500]


def test_base_statistics(spark):
    df = spark.createDataFrame([(i, t, None, "x", "y") for i, t in enumerate(TEXTS)], DOCS)
    got = {r["doc_id"]: r for r in quality_rules.query(df, spark.createDataFrame([], LABELS)).collect()}
    for i, t in enumerate(TEXTS):
        n, *rest = brute(t)
        assert [got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [n, *rest], t
        assert got[i]["base_failed"] == (n < 10 or 100 * rest[-1] > 20 * n) == (not got[i]["kept"])


@pytest.mark.parametrize("k, n, p", [(0, 10, 0.1), (3, 500, 0.01), (4, 2000, 0.01), (9, 20, 0.01)])
def test_binomial_tail(spark, k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k <= n * p else 1.0
    assert spark.range(1).select(quality_rules.binomial_tail(F.lit(k), F.lit(n), p)).first()[0] == pytest.approx(want, rel=1e-9)


def test_cutoffs_are_certified_per_stratum(spark):
    good, bad = "word " + " ".join(f"w{i}" for i in range(20)), " ".join(f"w{i}#" for i in range(20))
    rows = [(i, good if i % 10 else bad, "en", None, None) for i in range(3000)] + [(5000 + i, good if i % 10 else bad, "de", None, None) for i in range(60)]
    labels = [(r[0], int(r[1] == good)) for r in rows] + [(1, 1), (None, 1), (7, None)]
    out = quality_rules.query(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).join(spark.createDataFrame(rows, DOCS), "doc_id").collect()
    assert all(r["kept"] == (r["text"] == good) for r in out if r["lang"] == "en")
    assert all(r["kept"] for r in out if r["lang"] == "de")  # too few labels there


def test_cutoffs_agree_with_sql(spark):
    """The DuckDB text over tables in which cutoffs act: two strata with enough labels, one without, and null as well as empty ones."""
    rng = np.random.default_rng(7)
    words = lambda n, marks: " ".join(f"w{rng.integers(0, 10_000)}" + ("#" if rng.random() < marks else "") for _ in range(n))
    rows = [(i, words(rng.integers(12, 40), 0.9 if i % 9 == 0 else 0.02 * (i % 3)), (None, "", "en", "en", "en", "de", "de")[i % 7] if i % 50 else "fr", "x", None) for i in range(6000)]
    labels = [(i, int(i % 9 > 0)) for i in range(6000)] + [(None, 1), (5, None), (8, 0)]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = sorted(tuple(r[c] for c in names) for r in quality_rules.query(docs, known).collect())
    con = duckdb.connect()
    frames = pd.DataFrame([r[:3] for r in rows], columns=["doc_id", "text", "lang"]), pd.DataFrame(labels, columns=["doc_id", "quality"]).astype("Int64")
    con.register("documents", pa.Table.from_pandas(frames[0]))
    con.register("labels", pa.Table.from_pandas(frames[1]))
    result = con.execute(quality_rules.oracle_sql())
    at = [[d[0] for d in result.description].index(c) for c in names]
    assert got == sorted(tuple(r[k] for k in at) for r in result.fetchall())
    lost = {r[0] for r in got if not r[-1] and not r[-2]}
    assert len(lost) > 300 and not any(rows[i][2] == "fr" for i in lost)
    carried = quality_rules.apply_rules(docs, known).columns
    assert carried.count("stats") == carried.count("rules") == 1


def test_ridge_against_the_direct_solution(spark):
    """Partition-summed normal equations give the weights of ridge regression on the features of all rows."""
    rng = np.random.default_rng(3)
    n = quality_classifier.N_STATISTICS
    x = rng.normal(size=(400, n)) * np.arange(1, n + 1)
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "doc_id long, x array<double>, y double").repartition(7)
    model = quality_classifier.train(df, F.col("doc_id") % 4 == 0)
    fit = np.arange(400) % 4 != 0
    z = model.features(x[fit])
    penalty = quality_classifier.RIDGE * fit.sum() * np.eye(z.shape[1])
    penalty[-1, -1] = 0
    want = np.linalg.solve(z.T @ z + penalty + 1e-9 * np.eye(z.shape[1]), z.T @ y[fit])
    assert np.allclose(model.raw(x), model.features(x) @ want, atol=1e-6)
    assert np.allclose(model.mean, x[fit].mean(0)) and np.allclose(model.scale, x[fit].std(0))


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(5)
    n = quality_classifier.N_STATISTICS
    width, d = np.sqrt(n), quality_classifier.FEATURES
    model = quality_classifier.Model(np.zeros(n), np.ones(n), rng.normal(size=(n, d)) / width, rng.uniform(0, 2 * np.pi, d), np.zeros(d + 1), np.array([0.0]), np.array([0.5]))
    x = rng.normal(size=(60, n))
    z = model.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * width**2))
    assert np.abs(z @ z.T - want).max() < 6 / np.sqrt(d)


def test_isotonic():
    assert quality_classifier.isotonic(np.array([1, 3, 2, 4.0]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]


def test_classifier(spark):
    rng = np.random.default_rng(0)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    rows = [(i, words(30) if i % 3 else words(30).upper().replace(" ", "!! "), "x", None, None) for i in range(900)] + [(9000, None, None, None, None), (None, "a b", None, None, None), (3, "", None, None, None)]
    labels = [(i, int(i % 3 > 0)) for i in range(900)] + [(None, 1), (5, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = quality_classifier.query(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert held and np.mean([r["predicted"] == (r["doc_id"] % 3 > 0) for r in held]) > 0.98
    assert {r["score"] for r in quality_classifier.query(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    assert quality_classifier.query(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0
