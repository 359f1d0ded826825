"""Stretches of words that repeat with a period, found by uniting suffix classes in the order of falling common prefixes.

The suffixes of a text's words are sorted by refinement: classes of equal first 2 ** k words are split by the class of what
follows, and only classes with more than one member go on. Neighbours in that order have a common prefix, whose length
the same classes give, from the longest to one word. The pairs of neighbours are then united from the longest common prefix down
(Kruskal's order), each class being the ordered set of its positions. Two positions of different classes that become neighbours
in the united set agree for exactly that prefix's length; if their distance is at most a third of it, they seed a run
with the distance as its period, from the first of them to the end of the second's prefix. A run's own start is among its seeds: it
and the position one period later meet when nothing lies between them, for a position between would give a shorter
period. So the first seed of each end and period is the run, whole and maximal.

Only prefixes of at least five words matter (four periods, and six words), so texts without such repeats are done after three
refinements. All texts of some megabytes are sorted together; classes never hold positions of two texts. It is one pass over the
documents without a shuffle: nothing that is held grows with the table, and a document is the unit of one task.

Defined cases: null and empty text have no words and no runs; a null doc_id is kept; repeated rows each give a row; very long texts
are sorted whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.blocks import text_slices
from evalloom.llm.wordpieces import plain_words

#: Periods of a run at least, and its words.
EXPONENT, LEAST_WORDS = 4, 6
#: The shortest common prefix of a run's start and the word one period later.
LEAST_PREFIX = LEAST_WORDS - 1
RUN = "struct<start: bigint, length: bigint, period: bigint>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())])


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``keys``, and for each place of it the place where its equals begin."""
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.diff(keys[order], prepend=keys[order[:1]] - 1)) if len(keys) else np.empty(0, int)
    return order, np.repeat(new, np.diff(new, append=len(keys)))


def suffix_classes(codes: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Classes of the first 1, 2, 4 and so on words at each place: a class is named by the place of its first in the order so far.

    The last names all places apart. ``doc`` says to which text a place belongs and doesn't fall.
    """
    n = len(codes)
    order, first = _groups(doc * (int(codes.max(initial=0)) + 1) + codes)
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, h, active = [rank.astype(np.int32)], 1, np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(active):
        after = active + h
        inside = after < n
        inside[inside] = doc[after[inside]] == doc[active[inside]]
        follows = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        order, first = _groups(rank[active] * (n + 1) + follows)
        order = active[order]
        # a class begins at its name; what it is split into follows in order
        old = rank[order]
        begin = np.flatnonzero(np.diff(old, prepend=-1))
        rank[order] = old + first - np.repeat(begin, np.diff(begin, append=len(old)))
        active = np.sort(order[np.bincount(first, minlength=len(first))[first] > 1])
        levels.append(rank.astype(np.int32))
        h *= 2
    return levels


def prefix_edges(levels: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the order of suffixes with a common prefix of at least LEAST_PREFIX words: places, places, lengths; longest first."""
    n = len(doc)
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    x, y = order[:-1], order[1:]
    near = levels[min(2, len(levels) - 1)]
    x, y = (z[near[x] == near[y]] for z in (x, y))
    length = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = x + length, y + length
        inside = np.maximum(a, b) < n
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        length += (inside & (doc[a] == doc[x]) & (doc[b] == doc[y]) & (levels[k][a] == levels[k][b])).astype(np.int64) << k
    far = np.flatnonzero(length >= LEAST_PREFIX)
    far = far[np.argsort(-length[far], kind="stable")]
    return x[far], y[far], length[far]


def run_seeds(x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows (end, period, start): what newly adjacent places of united classes seed."""
    sets: dict[int, list[int]] = {}
    out = []
    for a, b, n in zip(x.tolist(), y.tolist(), length.tolist()):
        large, small = sets.get(a) or [a], sets.get(b) or [b]
        if len(large) < len(small):
            large, small, a = small, large, b
        for p in small:
            insort(large, p)
        own = set(small)
        for p in small:
            k = bisect_left(large, p)
            for lo, hi in ((k - 1, k), (k, k + 1)):
                if lo >= 0 and hi < len(large) and not (large[lo] in own and large[hi] in own):
                    d = large[hi] - large[lo]
                    if d * (EXPONENT - 1) <= n:
                        out.append((large[hi] + n, d, large[lo]))
            sets[p] = large
        sets[a] = large
    return np.array(out, np.int64).reshape(-1, 3)


def find_runs(codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Rows (start, period, length) of all runs of texts of ``lens`` words, one after another, by start and period; places count over all."""
    doc = np.repeat(np.arange(len(lens)), lens)
    seeds = run_seeds(*prefix_edges(suffix_classes(codes.astype(np.int64), doc), doc)) if len(codes) else np.empty((0, 3), np.int64)
    seeds = seeds[np.lexsort(seeds.T[::-1])]
    new = np.ones(len(seeds), bool)
    new[1:] = (seeds[1:, :2] != seeds[:-1, :2]).any(1)
    end, period, start = seeds[new].T
    runs = np.stack([start, period, end - start], 1)[end - start >= LEAST_WORDS]
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


def repeated_words(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 1], 1)
    np.add.at(change, runs[:, 0] + runs[:, 2], -1)
    return np.cumsum(change)[:n] > 0


def _treat(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    words, lens = plain_words(texts)
    found = words.dictionary_encode()
    runs = find_runs(found.indices.to_numpy(zero_copy_only=False), lens)
    ends = np.cumsum(lens)
    kept = ~repeated_words(runs, len(words))
    kept_ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
    of = np.searchsorted(ends, runs[:, 0], "right")
    fields = [pa.array(x) for x in (runs[:, 0] - (ends - lens)[of], runs[:, 2], runs[:, 1])]
    offsets = np.searchsorted(of, np.arange(len(lens) + 1)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_ends.astype(np.int32)), words.filter(pa.array(kept))), " ")
    return pa.RecordBatch.from_arrays([ids, pa.array(lens.astype(np.int64)), lists, collapsed], schema=_ARROW)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; in words, by start and period), collapsed (text of each run's first period and all other words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in text_slices(texts):
                yield _treat(batch.column(0).slice(a, b - a), texts.slice(a, b - a))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period, the first of equals; null without runs."""
    first = F.get(runs, F.lit(0))
    return F.aggregate(runs, first, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def made_periodic(doc_id: Column, text: Column) -> Column:
    """The words of ``text``, from a place on repeating those from there, for a tenth of all ids; other texts as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cycles = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    longer = F.array_join(F.concat(F.slice(words, 1, a), F.slice(cycles, 1, n - a)), " ")
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), longer).otherwise(text)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli, and digests of all runs and of the collapsed text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    found = periodic_runs(docs.select(doc_id.alias("doc_id"), made_periodic(doc_id, text).alias("text"))).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
