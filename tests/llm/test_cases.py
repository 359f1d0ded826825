"""Very long texts, repeated rows and ids, and clashing columns, where no other test has them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import language_id, near_texts, near_vectors, ngram_score, quality_classifier, quality_rules

CLASH = "doc_id long, text string, lang string, source string, x int, held_out string, score string, kept int, n_words string, block int"


def prose(n, seed, letters="abcdefghij"):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """A text of 120,000 words, a near copy of it, a text of one long word, and a row that is there twice."""
    long = prose(120_000, 1)
    rows = [(1, long), (2, long + " and one more"), (3, "w" * 300_000), (4, prose(30, 2)), (4, prose(30, 2)), (5, ""), (6, None), *((i, prose(40, i)) for i in range(7, 60))]
    return spark.createDataFrame([(i, t, "en", "src", 0, "h", "s", 1, "n", 2) for i, t in rows], CLASH)


def test_ngram_scores_of_long_and_repeated_texts(docs):
    rows = ngram_score.query(docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 60 and by[1]["n_tokens"] == 120_001 and by[2]["n_tokens"] == 120_004 and by[3]["n_tokens"] == 2 and by[5]["n_tokens"] == by[6]["n_tokens"] == 1
    assert len({(r["score"], r["base_score"], r["n_tokens"]) for r in rows if r["doc_id"] == 4}) == 1 and all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_near_texts_of_long_and_repeated_texts(docs):
    rows = near_texts.near_duplicates(docs).collect()
    group = {r["doc_id"]: [v for k, v in r.asDict().items() if k not in ("doc_id", "kept")] for r in rows}
    kept = sorted(r["doc_id"] for r in rows if r["kept"])
    assert len(rows) == 60 and 1 in kept and 2 not in kept and 3 in kept and group[1][0] == group[2][0]


def test_rules_and_classifier_of_long_and_repeated_texts(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    rules = quality_rules.query(docs, labels).collect()
    by = {r["doc_id"]: r for r in rules}
    assert len(rules) == 60 and by[1]["n_words"] == 120_000 and by[3]["n_words"] == 1 and by[3]["word_chars"] == 300_000 and by[3]["base_failed"]
    assert len({tuple(r) for r in rules if r["doc_id"] == 4}) == 1
    scores = quality_classifier.query(docs, labels).collect()
    assert len(scores) == 60 and all(0 <= r["score"] <= 1 for r in scores) and len({r["score"] for r in scores if r["doc_id"] == 4}) == 1


def test_languages_of_long_and_repeated_texts(spark):
    rows = [(i, prose(60, i, "abcde" if i % 2 else "vwxyz"), "en" if i % 2 else "xx") for i in range(1, 200)]
    rows += [(500, prose(100_000, 7, "abcde"), "en"), (501, prose(50, 501, "vwxyz"), "xx"), (501, prose(50, 501, "vwxyz"), "xx")]
    got = language_id.query(spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, lang string, score int, kept string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[500]["lang_pred"] == "en" and by[501]["lang_pred"] == "xx" and len({tuple(r) for r in got if r["doc_id"] == 501}) == 1


def test_vectors_of_repeated_ids(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 16))
    rows = [(i, v[i].tolist()) for i in range(40)] + [(3, v[3].tolist()), (41, v[3].tolist())]
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("kept", F.lit("x"))).collect()
    by = {r["vec_id"]: r for r in got}
    assert len(got) == len(rows) and by[41]["component_id"] == 3 and not by[41]["kept"] and by[41]["n_links"] == by[3]["n_links"] == 2 and by[5]["n_links"] == 0
