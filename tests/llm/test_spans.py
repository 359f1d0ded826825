"""Removal of repeated byte strings against a brute-force version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from evalloom.llm import repeated_spans
from evalloom.llm.repeated_spans import LENGTH


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + LENGTH] for r in raws for i in range(len(r) - LENGTH + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - LENGTH + 1):
            if seen[r[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        n = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(r), int(gone.sum()), n, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def passages(seed=5):
    """Texts with common passages of lengths about LENGTH, edited copies, repeated lines, and one passage in many texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common = [prose(rnd.randint(20, 120)) for _ in range(12)] + [prose(60).encode()[:n].decode(errors="ignore") for n in (LENGTH - 1, LENGTH, LENGTH + 1, LENGTH + 2, 2 * LENGTH)]
    out = [None, "", "x", "a" * 199, "b" * 200, "c" * 201, "d" * 200, "d" * 200, "ab" * 700, prose(2_000)]
    for _ in range(120):
        out.append(prose(rnd.randint(0, 40)) + rnd.choice(common)[rnd.randint(0, 9) :] + prose(rnd.randint(0, 40)))
    out += [prose(5) + common[0] + prose(5) for _ in range(40)]
    for _ in range(20):
        words = out[-1].split(" ")
        words[rnd.randrange(len(words))] = "edit"
        out += [" ".join(words), out[rnd.randrange(10, 60)], (prose(12) + "\n") * 9, out[9] + "é"][: 4 if len(out) < 400 else 3]
    return out


@pytest.mark.parametrize("bounds", [{}, {"chunk_bytes": 3_000, "shard_size": 4}])
def test_removal_is_brute_force(spark, bounds):
    texts = passages()
    docs = spark.createDataFrame([(None if i == 3 else i % 150, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, kept binary").repartition(5)
    key = lambda r: (r[0] is None, r)
    want = sorted(((None if i == 3 else i % 150, *r) for i, r in enumerate(brute(texts))), key=key)
    assert sorted(map(tuple, repeated_spans.query(docs, **bounds).collect()), key=key) == want


def test_contexts_hold_every_window_once():
    texts = [t.encode() for t in passages(8)[:120] if t]
    raw, lens = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    want = repeated_spans.window_anchors(raw, lens)
    for cut in (333, 5_000):
        assert all((a == b).all() for a, b in zip(repeated_spans.window_anchors(raw, lens, cut), want))
    lo, hi, at, _ = want
    ends = np.cumsum(lens)
    assert len(lo) < len(raw) / 30 and sum(hi - lo + 1) == sum(max(0, n - LENGTH + 1) for n in lens) and (lo[1:] > hi[:-1]).all() and (at >= hi).all() and (at <= lo + LENGTH - repeated_spans.ANCHOR).all()
    assert (np.searchsorted(ends, lo, "right") == np.searchsorted(ends, hi + LENGTH - 1, "right")).all()


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh"])
def test_suffix_order_and_prefixes(letters):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))).encode() for _ in range(60)]
    texts += [texts[0], texts[1] + b"z", texts[5] * 3]
    lens = np.array([len(t) for t in texts])
    longest = int(lens.max()) + 1
    codes = np.zeros(int(lens.sum()) + len(lens) + longest, np.int64)
    begins = np.cumsum(lens + 1) - lens - 1
    for b, t in zip(begins, texts):
        codes[b : b + len(t)] = np.frombuffer(t, np.uint8).astype(int) + 1
    order = repeated_spans.suffix_array(codes, longest)
    n = len(codes) - longest
    rest = [bytes((codes[i : i + list(codes[i:]).index(0)] - 1).astype(np.uint8)) for i in range(n)]
    assert order.tolist() == sorted(range(n), key=lambda i: (rest[i], i))
    prefix = repeated_spans.common_prefixes(codes, order, begins, lens)
    for x, y in zip(order, order[1:]):
        k = 0
        while k < min(len(rest[x]), len(rest[y])) and rest[x][k] == rest[y][k]:
            k += 1
        assert prefix[y] == k


def test_whole_results_and_empty_table(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(260))
    docs = spark.createDataFrame([(1, "x" + text), (2, text + "y" + text[:40])], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in repeated_spans.remove_repeats(docs).collect()}
    assert bytes(rows[1]["kept"]) == b"x" and [tuple(s) for s in rows[1]["spans"]] == [(1, 260)]
    assert bytes(rows[2]["kept"]) == b"y" + text[:40].encode() and [tuple(s) for s in rows[2]["spans"]] == [(0, 260)]
    assert repeated_spans.query(docs.limit(0)).count() == 0
