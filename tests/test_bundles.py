"""Limits of texts."""

import random

from evalloom.operators import bundles


def test_the_longest_part_is_found_at_once(monkeypatch):
    rnd, seen, token = random.Random(4), [0], bundles._TOKEN

    class Counted:
        def findall(self, t):
            seen[0] += len(t)
            return token.findall(t)

        def finditer(self, t):
            seen[0] += len(t)
            return token.finditer(t)

    def slow(text, n_bytes, tokens, policy):
        """All candidates, the longest first."""
        fits = lambda t: len(t.encode()) <= n_bytes and bundles.count_words(t) <= tokens
        if fits(text):
            return text, False
        tails = [(k, k // 2 if policy == "head_tail" else 0) for k in range(len(text), -1, -1)]
        parts = (text[: k - t] + bundles.MARKER + (text[len(text) - t :] if t else "") for k, t in tails)
        return next(((p, True) for p in parts if fits(p)), None)

    for _ in range(400):
        text = "".join(rnd.choice(["a", "é", "漢", " ", "\n", ".", "_", "ab ", "́", "9"]) for _ in range(rnd.choice([0, 9, 60, 150])))
        args = (text, rnd.choice([5, 13, 14, 40, 100]), rnd.choice([1, 3, 4, 5, 20]), rnd.choice(["head", "head_tail"]))
        assert bundles.truncate(*args) == slow(*args), args
    monkeypatch.setattr(bundles, "_TOKEN", Counted())
    assert bundles.truncate("word, " * 50_000, 4_000, 400, "head_tail")[1]
    assert seen[0] < 20_000


def test_a_budget_with_a_missing_text(spark):
    rows = [("c", "s", "a", "x " * 50), ("c", "s", "b", None), ("c", "s", "d", "y " * 50), ("e", "s", "a", "z"), ("e", "s", "b", None)]
    files = spark.createDataFrame(rows, "case_id string, snapshot string, path string, content string")
    got = {(r["case_id"], r["path"]): (r["content"], r["truncated"], r["token_count"]) for r in bundles.fit_budget(files, 1_000, 60, 60).collect()}
    assert got["c", "b"] == (None, False, 0) and got["c", "a"][1] and got["c", "a"][2] <= 20 and got["c", "d"][2] <= 60 and len(got) == 5
    assert got["e", "a"] == ("z", False, 1) and got["e", "b"][0] is None
