"""Byte-level BPE encoding and decoding through a table of distinct words.

Texts are split into words in Spark tasks (pieces that the tokenizer treats independently), each distinct word is encoded
once, ids are joined back by position, and ids are decoded by a join with the table of the vocabulary's pieces, whose size
is that of the vocabulary.

Defined cases: null and empty text have no ids; a null doc_id is kept; repeated rows give repeated rows; strings of special
tokens in a text are encoded as the library does; very long texts and words are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from evalloom.llm.blocks import by_block, long_ids
from evalloom.llm.token_tables import joined, vocabulary, word_table

_pieces: dict[str, pa.Array] = {}


def id_to_piece(path: str) -> pa.Array:
    """The bytes of each id of a byte-level vocabulary, as the decoder writes them."""
    if path not in _pieces:
        from tokenizers import Tokenizer

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            pieces[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        _pieces[path] = pa.array(pieces, pa.large_binary())
    return _pieces[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string for each row of ``docs`` (doc_id, text)."""
    return _run(docs, path, "doc_id long, ids array<int>, decoded string", _full)


def _full(doc_ids: list, ids: np.ndarray, ends: np.ndarray, path: str) -> pd.DataFrame:
    starts = np.concatenate([[0], ends[:-1]])
    return pd.DataFrame({"doc_id": long_ids(doc_ids), "ids": [ids[a:b] for a, b in zip(starts, ends)], "decoded": [x.decode("utf-8", "replace") for x in _joined(id_to_piece(path).take(pa.array(ids)), ends, b"")]})


def _joined(values: pa.Array, ends: np.ndarray, by: bytes) -> list[bytes]:
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int64()), values)
    return pc.binary_join(lists, pa.scalar(by, values.type)).to_pylist()


def _digests(doc_ids: list, ids: np.ndarray, ends: np.ndarray, path: str) -> pd.DataFrame:
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return pd.DataFrame({
        "doc_id": long_ids(doc_ids),
        "n_tokens": np.diff(ends, prepend=0),
        "ids_sha256": [digest(x.encode()) for x in _joined(pa.array(ids).cast(pa.large_string()), ends, ",")],
        "decoded_sha256": [digest(x.decode("utf-8", "replace").encode()) for x in _joined(id_to_piece(path).take(pa.array(ids)), ends, b"")],
    })


def _run(docs: DataFrame, path: str, schema: str, report) -> DataFrame:
    blocks, answers = word_table(docs, path, True)
    dtype = vocabulary(path)[1]

    def finish(block, answers, of) -> pd.DataFrame:
        return pd.concat([report(block.doc_ids[a:b], ids.astype(np.int32), ends, path) for a, b, ids, ends in joined(block, answers, dtype)])

    return by_block(blocks, answers, finish, schema)


def query(docs: DataFrame, path: str) -> DataFrame:
    return _run(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)
