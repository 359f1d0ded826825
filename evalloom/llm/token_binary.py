"""Files of token ids in ascending document order, in canonical length-limited Huffman codes.

The codes come from the counts of all ids of all documents, which the table of distinct words gives. Documents are coded where
their ids are put together, so that only code bits are shuffled into order. A file row is a block of whole documents: their ids
and lengths, the number of ids before it in its part, the code bits (a document begins at a whole 32-bit word), and the bit
offset of every 128th id of a document. A block is decoded by itself, and all its checkpoints at once through one table.
Parts follow each other in document order; their bounds are quantiles of the ids, and rows that share an id may fill
several parts. Blocks are rows of Parquet files, so that any store Spark can write holds them.

Defined cases: null and empty text give the end id alone; a null doc_id sorts first; rows that repeat an id follow each
other in an order that depends on where they were read; an empty table gives no blocks; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.blocks import by_block, long_ids
from evalloom.llm.common import materialize, shared_dir
from evalloom.llm.token_tables import joined, summed, vocabulary, word_table

#: Ids of a block, give or take a document; ids from one checkpoint to the next.
BLOCK_IDS = 1 << 20
EVERY = 128
#: The longest code that the 64-bit windows of the decoder allow is 32; tables have 2 ** limit entries.
SPARE_BITS = 3
#: Stands for a null id where ids are ordered.
LEAST = -(1 << 63)

BLOCK_SCHEMA = "part int, block int, start long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, bits binary, checkpoints binary"


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(12, int(np.ceil(np.log2(len(used)))) + SPARE_BITS)
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    packages, levels = np.empty(0, np.int64), []
    for _ in range(limit):
        weights = np.concatenate([leaves, packages])
        by = np.argsort(weights, kind="stable")
        levels.append(by < len(leaves))
        weights = weights[by][: len(by) // 2 * 2]
        packages = weights[0::2] + weights[1::2]
    lengths, take = np.zeros(len(leaves), np.int64), 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each one more than the last, shifted where the length grows."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    top = int(lengths.max(initial=0))
    steps = np.uint64(1) << (top - lengths[order].astype(np.int64)).astype(np.uint64)
    codes[order] = (np.cumsum(steps) - steps) >> (top - lengths[order].astype(np.int64)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[int, np.ndarray]:
    """The longest length, and for each string of so many bits id * 256 + length."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    top = int(lengths.max(initial=1))
    table = np.zeros(1 << top, np.int64)
    filled = np.repeat(order.astype(np.int64) * 256 + lengths[order], 1 << (top - lengths[order].astype(np.int64)))
    table[: len(filled)] = filled
    return top, table


def encode_documents(ids: np.ndarray, ends: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """For each document (none is empty) its code bits, in whole 32-bit words, and the bit offset of every ``EVERY``-th id."""
    n = lengths[ids].astype(np.int64)
    at, begin = np.cumsum(n) - n, np.concatenate([[0], ends[:-1]])
    size = -(-np.add.reduceat(n, begin) // 32)
    doc = np.repeat(np.arange(len(ends)), ends - begin)
    at -= at[begin][doc]
    first = np.cumsum(size) - size
    word = first[doc] + (at >> 5)
    value = codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
    new = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(size.sum()) + 1, np.uint64)
    out[word[new]] += np.add.reduceat(value >> np.uint64(32), new)
    out[word[new] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), new)
    bits, cuts = out.astype(">u4").tobytes(), (first * 4).tolist()
    marked = (np.arange(len(ids)) - begin[doc]) % EVERY == 0
    marks = at[marked].astype("<u4").tobytes()
    mark_ends = (4 * np.cumsum(-(-(ends - begin) // EVERY))).tolist()
    return [bits[x : x + 4 * k] for x, k in zip(cuts, size.tolist())], [marks[x:y] for x, y in zip([0, *mark_ends], mark_ends)]


def decode_block(bits: bytes, checkpoints: bytes, tokens: np.ndarray, top: int, table: np.ndarray) -> np.ndarray:
    """The ids of a block whose documents have ``tokens`` ids each; checkpoints count from the block's first bit."""
    words = np.concatenate([np.frombuffer(bits, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    runs = -(-tokens // EVERY)
    size = np.full(int(runs.sum()), EVERY)
    size[np.cumsum(runs) - 1] = tokens - (runs - 1) * EVERY
    place = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    size, place = size[order], place[order]
    at = np.frombuffer(checkpoints, "<u8").astype(np.int64)[order]
    out, mask = np.empty(int(tokens.sum()), np.int64), (1 << top) - 1
    for k in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -k))  # runs longer than k
        at = at[:live]
        found = table[(pairs[at >> 5] >> (64 - top - (at & 31)).astype(np.uint64)).astype(np.int64) & mask]
        out[place[:live] + k] = found >> 8
        at += found & 255
    return out


def part_bounds(docs: DataFrame) -> np.ndarray:
    """Quantiles of the ids (null: least): as many parts as shuffles have partitions."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    found = docs.agg(F.percentile_approx(doc_id, [k / parts for k in range(1, parts)] or [0.5], 100 * parts)).first()[0]
    return np.array(found or [], np.int64)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, byte_level: bool, end_id: int) -> None:
    """Encode ``docs`` (doc_id, text) and write the folders ``blocks`` and ``lengths`` under ``path``."""
    spark = docs.sparkSession
    size, dtype = vocabulary(tokenizer)
    blocks, answers = word_table(docs, tokenizer, byte_level, count=True)
    answers = materialize(answers, "answers")
    counts = summed(answers.filter("block is null"), "data", size)
    bodies = blocks.filter("kind = 'body'")
    counts[end_id] += bodies.select(F.sum(F.size("doc_ids"))).first()[0] or 0
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pd.DataFrame({"id": used, "length": lengths[used].astype(np.int32)}), "id long, length int").coalesce(1).write.parquet(f"{path}/lengths")
    bounds = part_bounds(docs)

    def code(block, answers, of) -> pd.DataFrame:
        frames = []
        for a, b, ids, ends in joined(block, answers, dtype, end_id):
            bits, marks = encode_documents(ids, ends, lengths, codes)
            own = np.array([LEAST if x is None or x != x else int(x) for x in block.doc_ids[a:b]], np.int64)
            low, high = np.searchsorted(bounds, own, "left"), np.searchsorted(bounds, own, "right")
            part = low + (np.arange(a, b) + block.block) % (high - low + 1)
            frames.append(pd.DataFrame({"part": part, "doc_id": long_ids(block.doc_ids[a:b]), "n": np.diff(ends, prepend=0), "bits": bits, "marks": marks}))
        return pd.concat(frames)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, at, number, before = [], 0, None, 0, 0

        def block() -> pd.DataFrame:
            nonlocal held, size, number, before
            base = np.cumsum([0, *(8 * len(x) for _, _, x, _ in held)])
            marks = np.concatenate([np.frombuffer(m, "<u4").astype("<u8") + b for b, (_, _, _, m) in zip(base.tolist(), held)])
            row = (at, number, before, size, [d for d, *_ in held], [n for _, n, _, _ in held], b"".join(x for _, _, x, _ in held), marks.tobytes())
            number, before, held, size = number + 1, before + size, [], 0
            return pd.DataFrame([row], columns=["part", "block", "start", "n_tokens", "doc_ids", "doc_tokens", "bits", "checkpoints"])

        for batch in batches:
            for part, doc_id, n, bits, marks in zip(*(batch[c].tolist() for c in ("part", "doc_id", "n", "bits", "marks"))):
                if part != at:
                    if held:
                        yield block()
                    at, number, before = part, 0, 0
                held.append((None if doc_id != doc_id else int(doc_id), n, bits, marks))
                size += n
                if size >= BLOCK_IDS:
                    yield block()
        if held:
            yield block()

    coded = by_block(blocks, answers, code, "part int, doc_id long, n long, bits binary, marks binary")
    ordered = coded.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id")
    ordered.mapInPandas(run, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, report=None, schema: str = "doc_id long, start long, ids array<int>") -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document; ``report(doc_ids, starts, lens, ids)`` may give other columns."""
    lengths = spark.read.schema("id long, length int").parquet(f"{path}/lengths").toPandas()
    size = int(lengths["id"].max()) + 1 if len(lengths) else 1
    table_lengths = np.zeros(size, np.uint8)
    table_lengths[lengths["id"].to_numpy(np.int64)] = lengths["length"]
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).toPandas().sort_values("part")  # a row for each part
    before = dict(zip(parts["part"].tolist(), (parts["n"].cumsum() - parts["n"]).tolist()))
    if report is None:
        report = lambda doc_ids, starts, lens, ids: pd.DataFrame({"doc_id": long_ids(doc_ids), "start": starts, "ids": np.split(ids, np.cumsum(lens)[:-1])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, table = decode_table(table_lengths)
        for batch in batches:
            for b in batch.itertuples():
                lens = np.array(b.doc_tokens, np.int64)
                ids = decode_block(b.bits, b.checkpoints, lens, top, table)
                yield report(list(b.doc_ids), before[b.part] + b.start + np.cumsum(lens) - lens, lens, ids)

    return blocks.mapInPandas(run, schema)


def query(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files that were written."""
    path = f"{shared_dir(docs.sparkSession)}/evalloom/ids-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, True, end_id)

    def report(doc_ids, starts, lens, ids) -> pd.DataFrame:
        raw, ends = ids.astype("<u4"), np.cumsum(lens)
        return pd.DataFrame({"doc_id": long_ids(doc_ids), "start": starts, "n_tokens": lens, "ids_crc32": [zlib.crc32(raw[e - n : e].data) for e, n in zip(ends, lens)]})

    return read_tokens(docs.sparkSession, path, report, "doc_id long, start long, n_tokens long, ids_crc32 long")
