"""Alignment of two tokenizers over the same bytes: groups between common cuts, linked tokens, and how often each pair is linked.

Texts are cut to words where neither tokenizer has a token across the cut, each distinct word of a chunk of documents is encoded
once by both, and a document's tokens are those of its words. Then one state vector holds, for every document of a batch, the
token that each tokenizer has reached. A step moves all of them at once: the side whose token ends first goes on, both do where
the ends meet, and those places are links and cuts; documents that are done leave the vector. A long document starts at
several places (each side's first token that ends beyond a multiple of STRETCH bytes), so that steps don't grow with it.

Chunks with ids and cuts are written to the shared folder. The counts of id pairs are summed over all chunks, pre-aggregated in each; a
chunk then gets the counts of its own distinct pairs, so a pair of every document crosses the network once a chunk. The
highest count of each id of the second tokenizer is broadcast: it has one row for each entry of that vocabulary at most.

Defined cases: null and empty texts, and those whose joined tokens are not a space and the text, have no tokens: zeros and empty
groups; a null doc_id is kept; repeated rows count and are returned each; very long texts are aligned whole; an empty table gives
an empty result; other columns are ignored. Tokens have at least one byte, so one of each side ends at a cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.blocks import long_ids, pack_many, text_slices, unpack_many
from evalloom.llm.common import materialize, materialize_bucketed, small_batches
from evalloom.llm.wordpieces import WordEncoder, listed, spans

#: Bytes of a chunk's texts, give or take a document; words encoded, words and tokens joined at a time.
CHUNK_BYTES = 5 << 20
ENCODED, BATCH_WORDS, BATCH_TOKENS = 20_000, 100_000, 250_000
#: Bytes of a document that one element of the state vector sees through.
STRETCH = 4_096
#: White space that ends a word, all that may be white space to either tokenizer, and texts that need more than single spaces and line feeds.
_CUT, _WHITE = " \n\t", " \t\n\r\f\v\x01\x1c-\x1f\x85\xa0  -     　▁"
_PLACES = re.compile(f"(?<=[^{_WHITE}])(?=[{_CUT}])")
_ODD = r"^[ \n]|[ \n][ \n]|[ \n]\z|[\t\r\f\v\x01\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{2581}]"

CHUNKS = "chunk long, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, tokens binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"

_pairs: dict[tuple[str, str], "TokenizerPair"] = {}


def _marked(piece: str) -> str:
    """A word as a key: without the space before it, if that is all its white space; as it is, if it begins with a line feed; else after a carriage return."""
    if piece[0] == " " and piece[1:2] not in ("", "\n", "\r"):
        return piece[1:]
    return piece if piece[0] == "\n" else "\r" + piece


def spaced(word: str) -> str:
    """The text that a key stands for."""
    return word[1:] if word[:1] == "\r" else word if word[:1] == "\n" else " " + word


def split_words(texts: pa.Array, whole: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words of a space and each text, as keys, and their number for each text; an empty text has none. ``whole``: texts are not cut."""
    odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.equal(texts, "")).to_numpy(zero_copy_only=False) | whole
    words, lens = listed(pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " "))
    if not odd.any():
        return words, lens
    lists = [[_marked(p) for p in ([" " + t] if whole else _PLACES.split(" " + t))] if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
    more, more_lens = listed(pa.array(lists, pa.list_(texts.type)))
    n, begin = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for mine, own, base in ((~odd, lens, 0), (odd, more_lens, len(words))):
        n[mine] = own
        begin[mine] = base + np.cumsum(own) - own
    return pa.concat_arrays([words, more]).take(pa.array(spans(begin, n))), n


class TokenizerPair:
    """A byte-level BPE file of tokenizers (A) and a model of sentencepiece (B), with the bytes of all their entries."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.b = WordEncoder(path_a, True), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.tokenizer.encode_special_tokens = True
        # each byte is one character of an entry: itself if it can be printed, else the next from 256 on
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printed)}
        vocabulary = self.a.tokenizer.get_vocab(True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters.get(c, 63) for c in piece)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b))
        self.flat_a, self.flat_b = (np.frombuffer(b"".join(table), np.uint8) for table in (self.bytes_a, self.bytes_b))
        #: Whether some entry of B has white space after another character, so that texts can't be cut.
        self.whole = any(re.search(f"[^{_WHITE}][{_CUT}▁]", p) for p in pieces)
        self.before = self.b.encode("x")

    def encode(self, words: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], dict[int, tuple[bytes, bytes, bytes]]]:
        """Numbers of ids of each word and all ids, both for A and for B; and own bytes, A's and B's of each word where they differ."""
        sizes, ids, bad = ([], []), ([], []), {}
        for begin in range(0, len(words), ENCODED):
            part = words.slice(begin, ENCODED)
            texts = [spaced(w) for w in part.to_pylist()]
            if self.whole:  # B puts the space before them itself
                lists = self.b.encode([t[1:] for t in texts], num_threads=1)
            else:
                lists = [x[len(self.before) :] for x in self.b.encode(["x" + t for t in texts], num_threads=1)]
            n_b = np.fromiter(map(len, lists), np.int64, len(lists))
            n_a, ids_a = self.a.encode(part)
            ids_b = np.fromiter(chain.from_iterable(lists), np.int64, int(n_b.sum()))
            raws = [t.encode() for t in texts]
            lens = np.fromiter(map(len, raws), np.int64, len(raws))
            wrong = np.zeros(len(raws), bool)
            for n, found, size, flat in ((n_a, ids_a, self.size_a, self.flat_a), (n_b, ids_b, self.size_b, self.flat_b)):
                of = np.repeat(np.arange(len(n)), n)
                long = np.bincount(of, size[found], len(n)) != lens
                own, fits = found[~long[of]], np.repeat(~long, lens)
                joined = flat[spans((np.cumsum(size) - size)[own], size[own])]
                wrong |= long
                wrong[np.repeat(np.arange(len(n)), lens)[fits][joined != np.frombuffer(b"".join(raws), np.uint8)[fits]]] = True
            ends = [np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b)]
            for k in np.flatnonzero(wrong).tolist():
                bad[begin + k] = (raws[k], *(b"".join([table[i] for i in found[e[k] : e[k + 1]].tolist()]) for table, found, e in ((self.bytes_a, ids_a, ends[0]), (self.bytes_b, ids_b, ends[1]))))
            for to, x in zip((*sizes, *ids), (n_a, n_b, ids_a.astype(np.int64), ids_b)):
                to.append(x)
        return [np.concatenate([np.empty(0, np.int64), *x]) for x in sizes], [np.concatenate([np.empty(0, np.int64), *x]).astype(np.uint32) for x in ids], bad


def tokenizer_pair(path_a: str, path_b: str) -> TokenizerPair:
    """This worker's pair for two files."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = TokenizerPair(path_a, path_b)
    return _pairs[path_a, path_b]


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rising byte ends of both sides' tokens over documents that end at ``doc_ends``: which tokens of A, and which of B, end together.

    Elements of the state vector are documents, or stretches of long ones.
    """
    begin = np.concatenate([[0], doc_ends[:-1]])
    pieces = -(-(doc_ends - begin) // STRETCH)
    at = np.repeat(begin, pieces) + STRETCH * spans(np.zeros(len(pieces), np.int64), pieces)
    upto = np.minimum(at + STRETCH, np.repeat(doc_ends, pieces))
    (i, j), (last_i, last_j) = ([np.searchsorted(ends, x, "right") for ends in (ends_a, ends_b)] for x in (at, upto))
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    live = (i < last_i) & (j < last_j)
    while True:
        if not live.all():  # what is done leaves
            i, j, last_i, last_j = (x[live] for x in (i, j, last_i, last_j))
        if not len(i):
            return cut_a, cut_b
        a, b = ends_a[i], ends_b[j]
        meet = a == b
        cut_a[i[meet]] = True
        cut_b[j[meet]] = True
        i = i + (a <= b)
        j = j + (b <= a)
        live = (i < last_i) & (j < last_j)


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> list[bytes]:
    """For documents whose tokens end before ``ends_a`` and ``ends_b``: groups of decimal ids, ``a1,a2|b1;a3|b2``."""
    n = len(ids_a) + len(ids_b)
    of_a, of_b = (np.cumsum(cut) - cut for cut in (cut_a, cut_b))  # the group of each token
    before_a, before_b = (np.concatenate([[0], np.flatnonzero(cut) + 1]) for cut in (cut_a, cut_b))
    place_a, place_b = np.arange(len(ids_a)) + before_b[of_a], np.arange(len(ids_b)) + before_a[of_b + 1]
    value, mark = np.empty(n, np.uint32), np.full(n, ord(","), np.uint8)
    value[place_a], value[place_b] = ids_a, ids_b
    mark[place_a[cut_a]], mark[place_b[cut_b]] = ord("|"), ord(";")
    digits = 1 + sum((value >= 10**k).astype(np.int64) for k in range(1, 10))
    at = np.concatenate([[0], np.cumsum(digits + 1)])
    out = np.empty(int(at[-1]), np.uint8)
    out[at[1:] - 1] = mark
    live, left = np.arange(n), value
    last = at[1:] - 2
    while len(live):
        out[last] = 48 + left % 10
        left = left // 10
        more = left > 0
        live, left, last = live[more], left[more], last[more] - 1
    raw, bounds = out.tobytes(), at[np.concatenate([[0], ends_a + ends_b])].tolist()
    return [raw[x : max(x, y - 1)] for x, y in zip(bounds, bounds[1:])]


def align_chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Chunks of ``docs`` (doc_id long, text string): ids of both sides and which of them end together, in a table bucketed by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, serial, pair = TaskContext.get().partitionId(), 0, tokenizer_pair(path_a, path_b)

        def chunk(ids: list, words: list[pa.Array], lens: list[np.ndarray]) -> pd.DataFrame:
            nonlocal serial
            lens = np.concatenate(lens)
            found = pa.chunked_array(words, pa.large_string()).combine_chunks().dictionary_encode()
            words.clear()
            codes = found.indices.to_numpy(zero_copy_only=False)
            sizes, ids_of, bad = pair.encode(found.dictionary)
            begins = [np.cumsum(n) - n for n in sizes]
            ends, at, out = np.cumsum(lens), 0, [[], [], [], [], [], []]
            while at < len(lens):  # some documents at a time
                base = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, base + BATCH_WORDS, "right")))
                mine, n = codes[base : ends[upto - 1]], lens[at:upto].copy()
                wrong = np.isin(mine, list(bad)) if bad else np.zeros(len(mine), bool)
                if wrong.any():
                    keep = np.ones(len(mine), bool)
                    doc = np.repeat(np.arange(len(n)), n)
                    first = np.cumsum(n) - n
                    for d in np.unique(doc[wrong]).tolist():
                        own = [bad.get(c) or (spaced(found.dictionary[c].as_py()).encode(),) * 3 for c in mine[first[d] : first[d] + n[d]].tolist()]
                        raw, a, b = (b"".join(x[k] for x in own) for k in range(3))
                        keep[doc == d] = raw == a == b
                    n = np.bincount(doc[keep], minlength=len(n))
                    mine = mine[keep]
                tokens, counts, byte_ends = [], [], []
                for size, flat, begin, width in zip(sizes, ids_of, begins, (pair.size_a, pair.size_b)):
                    tokens.append(flat[spans(begin[mine], size[mine])])
                    byte_ends.append(np.cumsum(width[tokens[-1]]))
                    counts.append(np.diff(np.concatenate([[0], np.cumsum(size[mine])])[np.concatenate([[0], np.cumsum(n)])]))
                last = np.cumsum(counts[0])[counts[0] > 0] - 1
                cuts = common_cuts(*byte_ends, byte_ends[0][last]) if len(last) else (np.zeros(0, bool),) * 2
                for to, x in zip(out, (*tokens, *cuts, *counts)):
                    to.append(x)
                at = upto
            tokens_a, tokens_b, cut_a, cut_b, n_a, n_b = (np.concatenate(x) for x in out)
            serial += 1
            data = pack_many(tokens_a, tokens_b, np.packbits(cut_a), np.packbits(cut_b))
            return pd.DataFrame([((part << 32) + serial - 1, ids, n_a, n_b, data)], columns=["chunk", "doc_ids", "n_a", "n_b", "tokens"])

        ids, words, lens, held = [], [], [], 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "") if batch.column(1).null_count else batch.column(1)
            for a, b in text_slices(texts):
                mine = texts.slice(a, b - a)
                found, n = split_words(mine, pair.whole)
                ids.extend(batch.column(0).slice(a, b - a).to_pylist())
                words.append(found.cast(pa.large_string()))
                lens.append(n)
                held += mine.nbytes
                if held >= CHUNK_BYTES:
                    yield chunk(ids, words, lens)
                    ids, words, lens, held = [], [], [], 0
        if ids:
            yield chunk(ids, words, lens)

    names = ["chunk", "doc_ids", "n_a", "n_b", "tokens"]
    types = pa.schema([("chunk", pa.int64()), *((c, pa.list_(pa.int64())) for c in names[1:4]), ("tokens", pa.binary())])
    arrow = lambda batches: (pa.RecordBatch.from_pylist([row], types) for frame in run(batches) for row in frame.to_dict("records"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        return materialize_bucketed(rows.mapInArrow(arrow, CHUNKS), "chunk", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunks")


def _tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a, b, cut_a, cut_b = unpack_many(data, 4)
    return a, b, np.unpackbits(cut_a, count=len(a)).astype(bool), np.unpackbits(cut_b, count=len(b)).astype(bool)


def chunk_pairs(chunks: DataFrame) -> DataFrame:
    """chunk, a, b, n: how many links of a chunk hold a pair of ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, data in zip(batch["chunk"].tolist(), batch["tokens"]):
                a, b, cut_a, cut_b = _tokens(data)
                pair, n = np.unique((a[cut_a].astype(np.int64) << 32) | b[cut_b], return_counts=True)
                yield pd.DataFrame({"chunk": chunk, "a": pair >> 32, "b": pair & 0xFFFFFFFF, "n": n})

    return chunks.select("chunk", "tokens").mapInPandas(run, "chunk long, a int, b int, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, n (links that hold the pair), best (no pair with this b has more) from rows a, b, n."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "pair-counts")
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))  # a row for each entry of B at most
    return counts.join(F.broadcast(highest), "b").select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has its B id's highest count), count_sum, groups (text) for each row."""
    chunks = align_chunks(docs, path_a, path_b)
    pairs = chunk_pairs(chunks)
    counted = pairs.select("chunk", "a", "b").join(pair_counts(pairs), ["a", "b"])

    def finish(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        a, b, cut_a, cut_b = _tokens(row["tokens"])
        known = (counts["a"].to_numpy(np.int64) << 32) | counts["b"].to_numpy(np.int64)
        order = np.argsort(known)
        known, count, best = known[order], counts["n"].to_numpy(np.int64)[order], counts["best"].to_numpy(bool)[order]
        n_a, n_b = (np.array(row[c], np.int64) for c in ("n_a", "n_b"))
        ends_a, ends_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        sums, texts, at = [], [], 0
        while at < len(n_a):  # some documents at a time
            upto = max(at + 1, int(np.searchsorted(ends_a, ends_a[at] + BATCH_TOKENS, "right")) - 1)
            x, y = slice(ends_a[at], ends_a[upto]), slice(ends_b[at], ends_b[upto])
            mine_a, mine_b = ends_a[at : upto + 1] - x.start, ends_b[at : upto + 1] - y.start
            of = np.searchsorted(known, (a[x][cut_a[x]].astype(np.int64) << 32) | b[y][cut_b[y]])
            links = np.concatenate([[0], np.cumsum(cut_a[x])])[mine_a]
            sums.append([np.diff(links), *(np.diff(np.concatenate([[0], np.cumsum(z[of])])[links]) for z in (best.astype(np.int64), count))])
            texts += [t.decode("ascii") for t in group_texts(a[x], b[y], cut_a[x], cut_b[y], mine_a[1:], mine_b[1:])]
            at = upto
        n, n_best, total = (np.concatenate(z) for z in zip(*sums))
        return pd.DataFrame({"doc_id": long_ids(list(row["doc_ids"])), "n_a": n_a, "n_b": n_b, "n_groups": n, "n_links": n, "n_best": n_best, "count_sum": total, "groups": texts})

    return chunks.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInPandas(finish, ALIGNED)


def query(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The columns of ``align`` with the SHA-256 of the groups instead of their text; empty without tokens."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return align(docs, path_a, path_b).withColumn("groups_sha256", digest).drop("groups")
