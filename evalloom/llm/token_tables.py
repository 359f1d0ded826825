"""Ids of documents through the table of distinct words: each distinct word is encoded once, and its ids go back to the blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.blocks import Block, bucket_count, by_bucket, make_blocks, pack_many, plain_docs, unpack_many
from evalloom.llm.wordpieces import byte_words, encoder, plain_words, spans

#: Words whose ids are joined at a time.
CHUNK = 400_000


def vocabulary(path: str) -> tuple[int, np.dtype]:
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    return size, np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def word_table(docs: DataFrame, path: str, byte_level: bool, count: bool = False) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``docs``, and the ids of their words by block and bucket; with ``count``, rows without a block hold the ids' counts."""
    rows = plain_docs(docs, F.lit(True) if count else None)
    blocks = make_blocks(rows, byte_words if byte_level else plain_words, bucket_count(rows))

    def encode(words, places, counts) -> tuple[list[bytes], bytes | None]:
        enc = encoder(path, byte_level)
        sizes, ids = enc.encode(words)
        begin = np.cumsum(sizes) - sizes
        answers = [pack_many(sizes[x].astype(np.uint32), ids[spans(begin[x], sizes[x])]) for x in places]
        if not count:
            return answers, None
        total = np.zeros(len(words), np.int64)
        for x, n in zip(places, counts):
            total[x] += n
        found = np.bincount(ids, np.repeat(total, sizes)).astype(np.int64)
        some = np.flatnonzero(found)
        return answers, pack_many(some.astype(np.uint32), found[some])

    return blocks, by_bucket(blocks, encode)


def joined(block: Block, answers: list[bytes], dtype: np.dtype, end_id: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Some documents of a block at a time: first, last + 1, their ids one after another, the end of each (``end_id`` is put at each end)."""
    got = [unpack_many(a, 2) for a in answers]
    sizes = np.concatenate([g[0] for g in got] or [np.empty(0, np.uint32)]).astype(np.int64)
    table = np.concatenate([g[1] for g in got] or [np.empty(0, dtype)])
    del got
    lens, codes = block.lens, block.codes
    begin, word_end, at = np.cumsum(sizes) - sizes, np.cumsum(lens), 0
    while at < len(lens):
        base = word_end[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(word_end, base + CHUNK, "right")))
        mine = codes[base : word_end[upto - 1]]
        n = sizes[mine]
        ids = table[spans(begin[mine], n)]
        ends = np.concatenate([[0], np.cumsum(n)])[word_end[at:upto] - base]
        if end_id is not None:
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, upto - at + 1)
        yield at, upto, ids, ends
        at = upto


def summed(rows: DataFrame, data: str, size: int) -> np.ndarray:
    """Sums by id over rows whose column ``data`` holds ids and counts; one number per vocabulary entry returns."""
    import pandas as pd

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch[data]:
                ids, n = unpack_many(x, 2)
                total[ids] += n
        some = np.flatnonzero(total)
        yield pd.DataFrame({"id": some, "n": total[some]})

    found = rows.select(data).mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out
