"""Packing documents into token windows by lexical retrieval.

Documents are dealt to parts by a min-hash of their token pairs, so that documents with common passages lie near each other;
a range partitioning on (min-hash, hash of the id) keeps parts even when one min-hash holds a third of all documents. In a
part, shards of bounded size get a BM25 inverted index (document frequencies are those of all documents). The next unused
document is the seed of a window; its heaviest terms query the index, and unused neighbours fill the window whole in order of
their scores. What still fits is filled with the head of the best unused neighbour, or of the next document where
there is none, and its rest is the next seed: a window is full but for the last one of a part. Documents longer than a
window give full windows first and take part with their rest.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each; a null doc_id is kept; an empty
table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.blocks import by_block, long_ids, pack_many
from evalloom.llm.common import materialize
from evalloom.llm.token_tables import joined, summed, vocabulary, word_table

WINDOW = 2048
#: A shard's documents (its index is held in memory), terms of a query, and neighbours that are tried whole.
SHARD_DOCS = 4096
SHARD_IDS = 4_000_000
QUERY_TERMS = 16
TRIED = 24
K1, B = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pair_minhashes(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each document (none is empty) the least hash of its neighbouring ids: equal for two with the chance of their Jaccard similarity."""
    x = ids.astype(np.uint64)
    x[:-1] = (x[:-1] << np.uint64(32)) | x[1:]
    begin = np.concatenate([[0], ends[:-1]])
    several = ends - begin > 1
    x[ends[several] - 1] = x[begin[several]]  # the last id of a document is in the pair before it
    x[begin[~several]] = ids[begin[~several]]
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (np.minimum.reduceat(x, begin) >> np.uint64(1)).astype(np.int64)


def encoded(docs: DataFrame, tokenizer: str, byte_level: bool, end_id: int) -> DataFrame:
    """doc_id, ids (binary, with the end id), key (min-hash) for each document, and rows with null ids whose ``seen`` holds the documents of a block with each id."""
    blocks, answers = word_table(docs, tokenizer, byte_level)
    size, dtype = vocabulary(tokenizer)

    def finish(block, answers, of) -> pd.DataFrame:
        frames, seen = [], np.zeros(size, np.int64)
        for a, b, ids, ends in joined(block, answers, dtype, end_id):
            raw, cuts = ids.tobytes(), (np.concatenate([[0], ends]) * dtype.itemsize).tolist()
            frames.append(pd.DataFrame({"doc_id": long_ids(block.doc_ids[a:b]), "ids": [raw[x:y] for x, y in zip(cuts, cuts[1:])], "key": pair_minhashes(ids, ends), "seen": None}))
            own = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(ends, prepend=0)) * np.uint64(size) + ids
            own.sort()
            seen += np.bincount((own[np.concatenate([[True], own[1:] != own[:-1]])] % np.uint64(size)).astype(np.int64), minlength=size)
        some = np.flatnonzero(seen)
        frames.append(pd.DataFrame({"doc_id": pd.array([None], "Int64"), "ids": [None], "key": pd.array([None], "Int64"), "seen": [pack_many(some.astype(np.uint32), seen[some])]}))
        return pd.concat(frames)

    return materialize(by_block(blocks, answers, finish, "doc_id long, ids binary, key long, seen binary"), "tokens")


class Index:
    """BM25 postings of a shard, by term."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray):
        n = np.array([len(d) for d in docs], np.int64)
        keys, tf = np.unique(np.concatenate(docs).astype(np.uint32) * np.uint32(SHARD_DOCS) + np.repeat(np.arange(len(docs), dtype=np.uint32), n), return_counts=True)
        self.doc = (keys % SHARD_DOCS).astype(np.int64)
        term = (keys // SHARD_DOCS).astype(np.int64)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[self.doc] / n.mean()))
        self.terms, self.begin = np.unique(term, return_index=True)
        self.end = np.append(self.begin[1:], len(term))
        by_doc = np.lexsort((-self.weight, self.doc))  # each document's terms, heaviest first
        by_doc = by_doc[np.repeat(self.end - self.begin, self.end - self.begin)[by_doc] > 1]  # a term that no other document has finds none
        self.own = np.searchsorted(self.terms, term[by_doc])
        self.own_begin = np.searchsorted(self.doc[by_doc], np.arange(len(docs) + 1))
        self.size = len(docs)

    def scores(self, doc: int) -> np.ndarray:
        terms = self.own[self.own_begin[doc] : self.own_begin[doc + 1]][:QUERY_TERMS]
        if not len(terms):
            return np.zeros(self.size)
        spans = [slice(self.begin[t], self.end[t]) for t in terms]
        return np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.size)


def pack_shard(docs: list[tuple], idf: np.ndarray, first_sequence: int, last: bool) -> tuple[list[tuple], int, list[tuple]]:
    """Pieces (place in docs, begin, end, sequence, offset), the next sequence, and what of the last window is left for the next shard.

    docs: (doc_id, ids, ids already packed) in order.
    """
    pieces, sequence = [], first_sequence
    at = [done for _, _, done in docs]
    for i, (_, ids, _) in enumerate(docs):
        while len(ids) - at[i] >= WINDOW:
            pieces.append((i, at[i], at[i] + WINDOW, sequence, 0))
            at[i] += WINDOW
            sequence += 1
    rest = [i for i, (_, ids, _) in enumerate(docs) if len(ids) > at[i]]
    if not rest:
        return pieces, sequence, []
    index = Index([docs[i][1][at[i] :] for i in rest], idf)
    left = np.array([len(docs[i][1]) - at[i] for i in rest])
    unused = np.ones(len(rest), bool)
    order, seed = 0, -1
    while True:
        if seed < 0:
            while order < len(rest) and not unused[order]:
                order += 1
            if order == len(rest):
                return pieces, sequence, []
            seed = order
        window, filled = [seed], int(left[seed])
        unused[seed] = False
        scores = np.where(unused, index.scores(seed), 0.0)
        best = np.argpartition(-scores, TRIED)[:TRIED] if len(scores) > TRIED else np.arange(len(scores))
        best = best[scores[best] > 0]
        best = best[np.argsort(-scores[best], kind="stable")].tolist()
        for j in best:
            if left[j] <= WINDOW - filled:
                window.append(j)
                filled += int(left[j])
                unused[j] = False
        cut = -1
        while filled < WINDOW and cut < 0:
            cut = next((j for j in best if unused[j]), -1)
            if cut < 0:
                while order < len(rest) and not unused[order]:
                    order += 1
                if order == len(rest):
                    break
                cut = order
            unused[cut] = False
            window.append(cut)
            if left[cut] <= WINDOW - filled:
                filled, cut = filled + int(left[cut]), -1
        if filled < WINDOW and cut < 0 and not last:
            return pieces, sequence, [(docs[rest[j]][0], docs[rest[j]][1], at[rest[j]]) for j in window]
        offset = 0
        for j in window:
            i, n = rest[j], int(min(left[j], WINDOW - offset))
            pieces.append((i, at[i], at[i] + n, sequence, offset))
            at[i] += n
            left[j] -= n
            offset += n
        sequence += 1
        seed = cut if cut >= 0 and left[cut] else -1


def pack(docs: DataFrame, tokenizer: str, byte_level: bool = False, end_id: int = 1) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    size, dtype = vocabulary(tokenizer)
    tokens = encoded(docs, tokenizer, byte_level, end_id)
    df = summed(tokens.filter("seen is not null"), "seen", size)
    total = max(1, int(df.max(initial=1)))  # every document has the end id
    idf = np.log1p((total - df + 0.5) / (df + 0.5))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        size = 0

        def rows(last: bool) -> pd.DataFrame:
            nonlocal held, sequence, size
            pieces, sequence, left = pack_shard(held, idf, sequence, last)
            raw = {}
            out = []
            for i, a, b, s, offset in pieces:
                if i not in raw:
                    raw[i] = held[i][1].astype("<u4")
                out.append((held[i][0], a, b - a, zlib.crc32(raw[i][a:b].data), len(held[i][1]), s, offset))
            held, size = left, sum(len(x[1]) for x in left)
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            return frame

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].tolist(), batch["ids"]):
                held.append((None if doc_id != doc_id else int(doc_id), np.frombuffer(bytes(ids), dtype), 0))
                size += len(held[-1][1])
                if len(held) >= SHARD_DOCS - WINDOW // 2 or size >= SHARD_IDS:
                    yield rows(False)
        if held:
            yield rows(True)

    salted = tokens.filter("ids is not null").select("doc_id", "ids", "key", F.xxhash64("doc_id").alias("salt")).repartitionByRange("key", "salt")
    return salted.sortWithinPartitions("key", "salt", "doc_id", "ids").select("doc_id", "ids").mapInPandas(run, SCHEMA)
