"""Blocks of documents with dictionaries of their words: the form in which word tables are joined to texts.

A task cuts its documents into blocks of bounded size. A block holds its texts as codes into its own list of distinct words,
so that a word crosses the network once per block and not once per occurrence, however frequent it is. The dictionary is cut
into buckets by a hash of the word; all blocks' parts of a bucket meet in one group, where a word is treated once, and the
answers go back to the blocks in the same order. Blocks are written to the shared folder before use: both ways start
from the same codes, and a lost executor costs no more than its own tasks.

Words stay in Arrow arrays: they are split, told apart and sent without a Python object for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import materialize_bucketed

SCHEMA = "kind string, block long, bucket int, doc_ids array<bigint>, flags array<boolean>, lens array<bigint>, data binary, counts binary"
_ARROW = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int64())), ("data", pa.binary()), ("counts", pa.binary())])
#: Words (occurrences) of a block and bytes of its texts, give or take a document; bytes of texts split at a time.
BLOCK_WORDS = 4_500_000
BLOCK_BYTES = 64 << 20
SPLIT_BYTES = 4 << 20

_U = np.uint64


def pack(values: np.ndarray) -> bytes:
    """Compress an integer array, each byte plane by itself."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return f"{values.dtype.str} {len(values)}\n".encode() + zstandard.compress(planes, 3)


def unpack(data: bytes) -> np.ndarray:
    head, _, rest = bytes(data).partition(b"\n")
    dtype, n = head.decode().split(" ")
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.decompress(rest), np.uint8) if int(n) else np.empty(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, int(n)).T).view(dtype).ravel()


def pack_many(*arrays: np.ndarray) -> bytes:
    parts = [pack(a) for a in arrays]
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def unpack_many(data: bytes, n: int) -> list[np.ndarray]:
    data, out, at = bytes(data), [], 4 * n
    for size in np.frombuffer(data[: 4 * n], "<u4"):
        out.append(unpack(data[at : at + size]))
        at += int(size)
    return out


def raw_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array."""
    width = np.int64 if pa.types.is_large_string(words.type) else np.int32
    offsets = np.frombuffer(words.buffers()[1], width)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, width)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return offsets.astype(np.int64) - offsets[0], raw


def pack_words(words: pa.Array) -> bytes:
    offsets, raw = raw_words(words)
    return pack_many(np.diff(offsets).astype("<u4"), raw)


def unpack_words(data: bytes) -> pa.Array:
    lens, raw = unpack_many(data, 2)
    offsets = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(offsets), pa.py_buffer(raw))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: mixed sums of a value for each byte and its place."""
    offsets, raw = raw_words(words)
    n = np.diff(offsets)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], n)
    value = mix(raw.astype(_U) + (place.astype(_U) << _U(8)) + _U(0x9E3779B97F4A7C15))
    out = n.astype(_U)
    some = np.flatnonzero(n)
    if len(some):
        out[some] += np.add.reduceat(value, offsets[:-1][some])
    return mix(out)


def homes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash: it grows with the hash."""
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def bucket_count(docs: DataFrame) -> int:
    """Buckets of the word table: twice the input's partitions, at least 16, so that a bucket doesn't grow with the input."""
    return int(max(16, 2 * docs.rdd.getNumPartitions()))


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts of about SPLIT_BYTES."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    a, held = 0, 0
    for i, n in enumerate(size.tolist()):
        held += n
        if held >= SPLIT_BYTES:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(size):
        yield a, len(size)


def make_blocks(docs: DataFrame, split: Callable[[pa.Array], tuple[pa.Array, np.ndarray]], buckets: int, extra: Callable | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks of ``docs`` (doc_id long, text string, flag boolean).

    ``split(texts)`` gives the words of texts one after another, and their number for each text. Rows of kind body: doc_ids,
    flags, lens (words of each document), data (codes of all words). Rows of kind dict: bucket, data (words; counted on from
    the bucket before, their places are the codes), counts (of each word in documents with the flag, if any has it).
    ``extra(hashes of words, codes, flag of each word, ends of documents)`` may give further rows (kind, bucket, data). The
    result is a table in the shared folder, bucketed by block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0

        def block(ids, flags, lens, words):
            nonlocal serial
            lens = np.concatenate(lens)
            found = pa.chunked_array(words, pa.large_string()).combine_chunks().dictionary_encode()
            words.clear()
            hashes = word_hashes(found.dictionary)
            home = homes(hashes, buckets)
            order = np.argsort(home, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            codes = rank[found.indices.to_numpy(zero_copy_only=False)]
            distinct = found.dictionary.take(pa.array(order))
            del found
            number = (part << 32) + serial
            serial += 1
            some, begin = np.unique(home[order], return_index=True)
            learned = np.repeat(np.array(flags, bool), lens)
            counts = np.bincount(codes[learned], minlength=len(order)).astype(np.uint32) if any(flags) else None
            row = dict.fromkeys(_ARROW.names) | {"block": number}
            rows = [row | {"kind": "body", "doc_ids": ids, "flags": flags, "lens": lens.tolist(), "data": pack(codes)}]
            for b, x, y in zip(some.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
                rows.append(row | {"kind": "dict", "bucket": b, "data": pack_words(distinct.slice(x, y - x)), "counts": None if counts is None else pack(counts[x:y])})
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[i : i + 64], _ARROW)
            if extra:
                for kind, b, data in extra(hashes[order], codes, learned, np.cumsum(lens)):
                    yield pa.RecordBatch.from_pylist([row | {"kind": kind, "bucket": b, "data": data}], _ARROW)

        new = lambda: ([], [], [], [])
        now, size, held = new(), 0, 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            ids, flags = batch.column(0).to_pylist(), pc.fill_null(batch.column(2), False).to_pylist()
            for a, b in text_slices(texts):
                words, lens = split(texts.slice(a, b - a))
                now[0].extend(ids[a:b])
                now[1].extend(flags[a:b])
                now[2].append(lens)
                now[3].append(words.cast(pa.large_string()))
                size += len(words) + b - a
                held += words.nbytes
                if size >= block_words or held >= BLOCK_BYTES:
                    yield from block(*now)
                    now, size, held = new(), 0, 0
        if size:
            yield from block(*now)

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 2)
    return materialize_bucketed(docs.mapInArrow(run, SCHEMA), "block", parts, "blocks")


def by_bucket(blocks: DataFrame, treat: Callable[[pa.Array, list[np.ndarray], list[np.ndarray | None]], tuple[list[bytes], bytes | None]]) -> DataFrame:
    """Apply ``treat`` to the distinct words of each bucket, their places in the list of each block, and the counts of each list.

    It gives an answer for each list, and one of the bucket. Columns block (null in the bucket's own row), bucket, data.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lists = [unpack_words(d) for d in rows["data"]]
        found = pa.concat_arrays(lists).dictionary_encode()
        ends = np.cumsum([len(x) for x in lists])[:-1]
        answers, own = treat(found.dictionary, np.split(found.indices.to_numpy(zero_copy_only=False), ends), [None if c is None else unpack(c) for c in rows["counts"]])
        out = pd.DataFrame({"block": rows["block"].astype("Int64"), "bucket": rows["bucket"], "data": answers})
        return out if own is None else pd.concat([out, pd.DataFrame({"block": pd.array([None], "Int64"), "bucket": rows["bucket"].iloc[:1], "data": [own]})])

    return blocks.filter("kind = 'dict'").select("block", "bucket", "data", "counts").groupBy("bucket").applyInPandas(run, "block long, bucket int, data binary")


@dataclass
class Block:
    """A block as it comes back: what make_blocks wrote of it, and hashes of its words if they were asked for."""

    block: int
    doc_ids: list
    flags: np.ndarray
    lens: np.ndarray
    codes: np.ndarray
    hashes: np.ndarray | None


def by_block(blocks: DataFrame, answers: DataFrame, finish: Callable[[Block, list[bytes], np.ndarray], pd.DataFrame], schema: str, hashes: bool = False) -> DataFrame:
    """Bring answers (block, bucket, data) back to their blocks: ``finish(block, answers in bucket order, their buckets)`` gives a frame for each."""

    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = rows[rows["kind"] == "body"].iloc[0]
        found = np.concatenate([np.empty(0, _U), *(word_hashes(unpack_words(d)) for d in rows[rows["kind"] == "dict"].sort_values("bucket")["data"])]) if hashes else None
        answers = answers.sort_values("bucket")
        block = Block(int(row["block"]), list(row["doc_ids"]), np.array(row["flags"], bool), np.array(row["lens"], np.int64), unpack(row["data"]), found)
        return finish(block, answers["data"].tolist(), answers["bucket"].to_numpy(np.int64))

    mine = blocks.filter("kind in ('body', 'dict')" if hashes else "kind = 'body'").select("kind", "block", "bucket", "doc_ids", "flags", "lens", "data")
    return mine.groupBy("block").cogroup(answers.filter("block is not null").groupBy("block")).applyInPandas(run, schema)


def long_ids(ids: list) -> pd.Series:
    return pd.Series([None if x is None or x != x else int(x) for x in ids], dtype="Int64")


def plain_docs(docs: DataFrame, flag=None) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))).alias("flag"))
