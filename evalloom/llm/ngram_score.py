"""Scoring texts with an n-gram model held in a log-frequency Bloom filter.

Words and word pairs of the training documents are counted exactly: blocks of documents send their distinct words and the
hashes of their distinct pairs, with counts, to buckets. A count is quantised to the step of a geometric ladder below it, and
an n-gram is put into the filter once for each step up to its own; its count is found by probing step after step
until one is missing. The filter is cut by bucket: each bucket's part is filled by the task that counted it, and the n-grams
of all texts, those held out too, are probed there, for they come to the same bucket; answers go back to the blocks. So the
filter holds every n-gram, however often it was seen, and grows with the corpus, while no worker holds more than a part of
it. (A broadcast of the whole filter would need a bound on its size, and so n-grams left out.)

With q the quantised count of an n-gram, which is at most its count, and u the greatest count of a step, the
probability of a word w after a word h is LAMBDA q(h, w) / u(h) + (1 - LAMBDA) p(w), and p(w) alone where h was not found;
p(w) is (q(w) + 0.1) over the sum of that over all known words and one unknown. The probabilities after a history
so sum to 1 at most, but for false hits: of pairs never seen, 2 ** -PROBES are found. The base score uses the exact
counts, which come back to the blocks from the buckets.

Defined cases: null and empty text has the end token alone; a null doc_id is not learned from and not held out; repeated rows
count and are scored each; very long texts are a block of their own; with nothing to learn from, all counts are 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.blocks import Block, bucket_count, by_block, by_bucket, homes, long_ids, make_blocks, mix, pack, pack_many, plain_docs, unpack, unpack_many, word_hashes
from evalloom.llm.common import fold, materialize
from evalloom.llm.wordpieces import plain_words

ADDED = 0.1
LAMBDA = 0.6
PROBES = 16
#: Bits for each entry (an n-gram at one step).
ENTRY_BITS = 24
#: The least counts of the steps: about half as much again from one to the next.
STEPS = np.ceil(1.5 ** np.arange(100)).astype(float)
#: Words of a block: its pairs are held at once.
BLOCK_WORDS = 2_500_000
#: The end token; no word holds a line feed.
END = "\n"

_U = np.uint64


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of texts (A to Z only), and the end token after each text."""
    words, lens = plain_words(pc.ascii_lower(texts))
    order = np.insert(np.arange(len(words)), np.cumsum(lens), len(words))
    return pa.concat_arrays([words, pa.array([END], words.type)]).take(pa.array(order)), lens + 1


def pairs_of(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of each token with the one before it (the end token's before a first word); the lowest bit is 0."""
    x = np.empty_like(hashes)
    x[1:] = hashes[:-1]
    x[np.concatenate([[0], ends[:-1]]).astype(int)] = end_hash()
    x *= _U(0x9E3779B97F4A7C15)
    x += hashes ^ _U(0xC2B2AE3D27D4EB4F)
    return mix(x) & ~_U(1)


def end_hash() -> np.ndarray:
    return word_hashes(pa.array([END]))[0]


def pair_rows(hashes: np.ndarray, codes: np.ndarray, learned: np.ndarray, ends: np.ndarray, buckets: int) -> Iterator[tuple]:
    """The different pairs of a block by bucket: hashes in order (bucket grows with the hash), how often each is learned from."""
    x = pairs_of(hashes[codes], ends) | learned
    x.sort()
    found = np.flatnonzero(np.concatenate([[True], x[1:] >> _U(1) != x[:-1] >> _U(1)])) if len(x) else np.empty(0, int)
    n = np.add.reduceat(x & _U(1), found).astype(np.uint32) if len(x) else np.empty(0, np.uint32)
    x = x[found] & ~_U(1)
    some, begin = np.unique(homes(x, buckets), return_index=True)
    for b, lo, hi in zip(some.tolist(), begin.tolist(), [*begin[1:].tolist(), len(x)]):
        yield "pairs", b, pack_many(np.diff(x[lo:hi], prepend=_U(0)), n[lo:hi])


class FilterPart:
    """A bucket's part of the log-frequency filter."""

    def __init__(self, h: np.ndarray, counts: np.ndarray):
        h, counts = h[counts > 0], counts[counts > 0]
        step = np.searchsorted(STEPS, counts, "right") - 1
        self.bits = max(64, int((step + 1).sum()) * ENTRY_BITS)
        self.held = np.zeros(self.bits, bool)
        for level in range(int(step.max(initial=-1)) + 1):
            h, step = h[step >= level], step[step >= level]
            x = self._seed(h, level)
            for k in range(PROBES):
                self.held[self._place(x, k)] = True

    @staticmethod
    def _seed(h: np.ndarray, level: int) -> np.ndarray:
        return mix(h + _U((level + 1) * 0xA0761D6478BD642F % (1 << 64)))

    def _place(self, x: np.ndarray, probe: int) -> np.ndarray:
        """Where a probe of seeded hashes lies."""
        at = ((x >> _U(32)) + np.full(1, probe, _U) * (x | _U(1))) & _U(0xFFFFFFFF)
        return (at * _U(self.bits) >> _U(32)).astype(np.int64)

    def steps(self, h: np.ndarray) -> np.ndarray:
        """By repeated probes: 0 where an n-gram is not found, and else its step + 1."""
        out, alive = np.zeros(len(h), np.uint8), np.arange(len(h))
        for level in range(len(STEPS)):
            x = self._seed(h[alive], level)
            for k in range(PROBES):
                hit = self.held[self._place(x, k)]
                if not hit.all():
                    alive, x = alive[hit], x[hit]
            if not len(alive):
                break
            out[alive] = level + 1
        return out


def least_of(step: np.ndarray) -> np.ndarray:
    """The least count of a found step; 0 where none was found."""
    return np.concatenate([[0.0], STEPS])[step]


def greatest_of(step: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], STEPS[1:] - 1, [np.inf]])[step]


def probabilities(pair: np.ndarray, first: np.ndarray, word: np.ndarray, mass: float) -> np.ndarray:
    """From found steps of pairs, of their first words and of their second words; ``mass`` is the sum of all that p(w) is a part of."""
    alone = (least_of(word) + ADDED) / mass
    return np.where(first > 0, LAMBDA * least_of(pair) / np.maximum(greatest_of(first), 1) + (1 - LAMBDA) * alone, alone)


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows with an id where ``held_out`` is false."""
    rows = plain_docs(docs, ~held_out)
    buckets = bucket_count(rows)
    blocks = make_blocks(rows, split_words, buckets, lambda *block: pair_rows(*block, buckets), BLOCK_WORDS)

    def count_words(words, places, counts):
        total = np.zeros(len(words), np.int64)
        for where, n in zip(places, counts):
            if n is not None:
                total[where] += n
        h = word_hashes(words)
        step = FilterPart(h, total).steps(h)
        return [pack_many(total[x], step[x]) for x in places], np.array([total.sum(), (total > 0).sum(), least_of(step).sum()], np.int64).tobytes()

    words = materialize(by_bucket(blocks, count_words), "words")

    def count_pairs(parts: pd.DataFrame) -> pd.DataFrame:
        lists = [unpack_many(d, 2) for d in parts["data"]]
        h = np.concatenate([np.cumsum(x[0], dtype=_U) for x in lists])
        ends = np.cumsum([len(x[0]) for x in lists])[:-1]
        n = np.concatenate([x[1] for x in lists])
        del lists
        h, where = np.unique(h, return_inverse=True)
        step = FilterPart(h, np.bincount(where, n).astype(np.int64)).steps(h)
        return pd.DataFrame({"block": parts["block"], "bucket": parts["bucket"] + buckets, "data": [pack(x) for x in np.split(step[where], ends)]})

    pairs = blocks.filter("kind = 'pairs'").select("block", "bucket", "data").groupBy("bucket").applyInPandas(count_pairs, "block long, bucket int, data binary")

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([np.frombuffer(x, np.int64) for x in batch["data"]], columns=["tokens", "words", "mass"])

    # three numbers return
    sums = words.filter("block is null").select("data").mapInPandas(totals, "tokens long, words long, mass long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words", "mass"))).first()
    train_tokens, vocabulary = sums[0], sums[1]
    base, mass = (x + ADDED * (vocabulary + 1) for x in (train_tokens, sums[2]))

    def finish(block: Block, answers: list[bytes], of: np.ndarray) -> pd.DataFrame:
        n_words = int(np.searchsorted(of, buckets))
        got = [unpack_many(a, 2) for a in answers[:n_words]]
        count, step = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        pair_step = np.concatenate([unpack(a) for a in answers[n_words:]])
        ends = np.cumsum(block.lens)
        where = np.unique(pairs_of(block.hashes[block.codes], ends), return_inverse=True)[1].astype(np.uint32)
        end_step = step[np.flatnonzero(block.hashes == end_hash())[0]]
        logs = np.log10((count + ADDED) / base)
        sums = np.empty((3, len(ends)))
        a = 0
        while a < len(ends):  # some documents at a time
            lo = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, lo + 400_000, "right")))
            codes, mine = block.codes[lo : ends[b - 1]], pair_step[where[lo : ends[b - 1]]]
            begin = np.concatenate([[0], ends[a : b - 1] - lo])
            own = step[codes]
            first = np.empty_like(own)
            first[1:] = own[:-1]
            first[begin] = end_step
            for k, x in enumerate(((count > 0)[codes], logs[codes], np.log10(probabilities(mine, first, own, mass)))):
                sums[k, a:b] = np.add.reduceat(x.astype(float), begin)
            a = b
        return pd.DataFrame({"doc_id": long_ids(block.doc_ids), "n_tokens": block.lens, "n_known": sums[0].astype(np.int64), "train_tokens": train_tokens, "base_score": sums[1], "score": sums[2]})

    out = by_block(blocks, words.unionByName(pairs), finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double", hashes=True)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def query(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"), fold(F.col("doc_id"), 10) == 0)
