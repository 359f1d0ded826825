"""Periodic runs against a brute-force version."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from evalloom.llm import periodic_runs


def brute_runs(words):
    """All (start, length, period) by trying every period."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.add((i, j - i + q, q))
            i = max(j, i + 1)
    smallest = lambda s, m, q: not any(all(words[k] == words[k + r] for k in range(s, s + m - r)) for r in range(1, q))
    return sorted(x for x in out if smallest(*x))


def changed(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def wanted(doc_id, text):
    words = changed(doc_id, [w.decode() for w in (text or "").encode().split()])
    runs = brute_runs(words)
    best = None
    for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def periodic_texts(n, seed=3):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        while len(words) < rnd.randint(1, 60):
            unit = [rnd.choice("abc") for _ in range(rnd.randint(1, 5))]
            words += unit * rnd.choice((1, 1, 2, 4, 6)) + unit[: rnd.randint(0, len(unit))]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("letters", ["a", "ab", "abc"])
def test_runs_are_those_of_brute_force(letters):
    rnd = random.Random(len(letters))
    texts = [[rnd.choice(letters) for _ in range(rnd.randint(0, 40))] for _ in range(150)] + [t.split() for t in periodic_texts(250)]
    codes = np.array([ord(w) for t in texts for w in t])
    lens = np.array([len(t) for t in texts])
    begin = np.cumsum(lens) - lens
    got = [(s, m, q) for s, q, m in periodic_runs.find_runs(codes, lens).tolist()]
    want = [(s + b, m, q) for t, b in zip(texts, begin.tolist()) for s, m, q in brute_runs(t)]
    assert got == want


def test_query_on_odd_rows(spark):
    texts = [None, "", " \t\n", "a", "x " * 30_000, "one\x0btwo\x0cone two one\ttwo one two", "a b " * 9, "the same line\n" * 5, "word" * 50_000] + periodic_texts(300)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(5, texts[5], "x", 2), (None, "b b b b b b b c", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    got = sorted(map(tuple, periodic_runs.query(docs).collect()), key=lambda r: (r[0] is None, r))
    long = {i: t for i, t, *_ in rows if t and len(t) > 20_000}
    want = sorted((wanted(i, t) for i, t, *_ in rows if i not in long), key=lambda r: (r[0] is None, r))
    assert [r for r in got if r[0] not in long] == want
    assert [r[1:6] for r in got if r[0] in long] == [(1, 0, 30_000, 1, 30_000_000), (0, None, None, None, None)]
    assert periodic_runs.query(docs.limit(0)).count() == 0


def test_whole_results_of_the_operator(spark):
    text = "x a b a b a b a b c\nc c c c c d"
    (row,) = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row["n_words"] == 16 and row["collapsed"] == "x a b c d"
    assert row["runs"] == [Row(start=1, length=8, period=2), Row(start=9, length=6, period=1)]
    assert {"op13_periodic_runs"} <= set(__import__("evalloom.llm.queries", fromlist=["QUERIES"]).QUERIES)
