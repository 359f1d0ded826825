"""BPE, token files and packing against the tokenizers library; chat formatting round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from evalloom.llm import bpe, chat_format, packing, token_binary
from evalloom.llm.common import materialize_bucketed
from evalloom.llm.wordpieces import byte_pieces, byte_words, encoder, plain_words

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
DOCS = "doc_id long, text string, ids string, n_tokens int"


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    parts = [" ", " ", "a", "B", "é", "\n", "\t", "1", "!", "<|endoftext|>", "'s", "\x1c", "\x85", "Σ", "İ", "́", "ab c", "日本", "　"]
    return [None, "", "word " * 3000, "x" * 20_000] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = odd_texts(400)
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)] + [(7, texts[7], "x", 0)], DOCS)


def encoded(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path, byte_level", [(BYTE, True), (WORD, False)])
def test_wordwise_encoding_is_the_library_s(path, byte_level):
    texts = [t or "" for t in odd_texts(3000, 5)] + ["Straße word. word, naïve!! x.y " * 50, "a\n\n\nb", "\n\n", "\r\n\r\nx \r y", "a\nb\n c", "  a  b "]
    words, lens = (byte_words if byte_level else plain_words)(pa.array(texts))
    found = words.dictionary_encode()
    sizes, ids = encoder(path, byte_level).encode(found.dictionary)
    of = np.split(ids, np.cumsum(sizes)[:-1])
    codes = np.split(found.indices.to_numpy(), np.cumsum(lens)[:-1])
    got = [[int(i) for c in cs for i in of[c]] for cs in codes]
    assert got == encoded(path, texts)
    assert all("".join(byte_pieces(t)) == t for t in texts)


def test_bpe_query(spark, docs):
    rows = docs.collect()
    want = sorted((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r, ids in zip(rows, encoded(BYTE, [r["text"] for r in rows])))
    assert sorted(tuple(r) for r in bpe.query(docs, BYTE).collect()) == want
    full = bpe.encode_decode(docs.filter("doc_id in (5, 6)"), BYTE).collect()
    assert all(r["decoded"] == rows[r["doc_id"]]["text"] for r in full)
    assert bpe.query(docs.limit(0), BYTE).count() == 0


def test_code_lengths_are_limited_and_complete():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765])
    lengths = token_binary.code_lengths(counts)
    assert lengths[0] == 0 and lengths.max() <= 12 and sum(2.0 ** -int(x) for x in lengths[1:]) == 1
    assert token_binary.code_lengths(np.array([0, 5])).tolist() == [0, 1]


def test_block_round_trip():
    rng = np.random.default_rng(1)
    tokens = np.array([1, 2, 127, 128, 129, 5000, 1, 256])
    ids = np.minimum(rng.geometric(0.02, tokens.sum()), 900)
    lengths = token_binary.code_lengths(np.bincount(ids, minlength=1000))
    bits, marks = token_binary.encode_documents(ids, np.cumsum(tokens), lengths, token_binary.canonical_codes(lengths))
    base = np.cumsum([0, *(8 * len(x) for x in bits)])
    checkpoints = np.concatenate([np.frombuffer(m, "<u4").astype("<u8") + b for m, b in zip(marks, base.tolist())])
    assert [len(m) // 4 for m in marks] == [-(-t // 128) for t in tokens]
    assert (token_binary.decode_block(b"".join(bits), checkpoints.tobytes(), tokens, *token_binary.decode_table(lengths)) == ids).all()


@pytest.mark.parametrize("block_ids", [1 << 20, 700])
def test_token_files(spark, docs, monkeypatch, block_ids):
    monkeypatch.setattr(token_binary, "BLOCK_IDS", block_ids)
    rows = sorted([*docs.collect(), *[Row(doc_id=None, text="no id")] * 2, *[Row(doc_id=7, text="again")] * 300], key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"]))
    want, totals = [], {}
    for r, ids in zip(rows, encoded(BYTE, [r["text"] for r in rows])):
        ids = [*ids, 2]
        want.append((r["doc_id"] is not None, r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        totals[r["doc_id"]] = totals.get(r["doc_id"], 0) + len(ids)
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").repartition(5)
    got = sorted(token_binary.query(df, BYTE).collect(), key=lambda r: r["start"])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((a, b or 0, c, d) for a, b, c, d in want)
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]  # in ascending order, without a gap
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert token_binary.query(docs.limit(0), BYTE).count() == 0


def test_packing(spark, docs):
    docs = docs.dropDuplicates(["doc_id"])
    rows = docs.collect()
    want = {r["doc_id"]: np.array([*ids, 1], "<u4") for r, ids in zip(rows, encoded(WORD, [r["text"] for r in rows]))}
    pieces = packing.pack(docs, WORD).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        ids = want[p["doc_id"]]
        assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    for key, group, at, total in [(d, g, "start", len(want[d])) for d, g in by_doc.items()] + [(s, g, "offset", None) for s, g in by_sequence.items()]:
        group.sort(key=lambda p: p[at])
        assert [p[at] for p in group] == np.cumsum([0] + [p["length"] for p in group])[:-1].tolist()
        size = sum(p["length"] for p in group)
        assert size == total if total else size <= packing.WINDOW
    assert by_doc.keys() == want.keys() and sum(sum(p["length"] for p in g) < packing.WINDOW for g in by_sequence.values()) <= 4
    assert packing.pack(docs.limit(0), WORD).count() == 0


def test_index_scores_are_bm25():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 40, rng.integers(1, 60)).astype("<u2") for _ in range(50)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=40)
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
    index, mean = packing.Index(docs, idf), np.mean([len(d) for d in docs])
    term = lambda t, d: idf[t] * (d == t).sum() * (packing.K1 + 1) / ((d == t).sum() + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
    for q in range(50):
        shared = [t for t in set(docs[q].tolist()) if sum((d == t).any() for d in docs) > 1]
        terms = sorted(shared, key=lambda t: -term(t, docs[q]))
        weights = [term(t, docs[q]) for t in terms]
        if len(terms) > packing.QUERY_TERMS and abs(weights[packing.QUERY_TERMS] - weights[packing.QUERY_TERMS - 1]) < 1e-12:
            continue  # a tie at the end of the query
        want = [sum(term(t, d) for t in terms[: packing.QUERY_TERMS]) for d in docs]
        assert np.allclose(index.scores(q), want)


def test_packing_over_several_shards(spark, monkeypatch):
    """Shards of 40 documents, repeated ids and null ids: every id of every row lies in one piece."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 40 + packing.WINDOW // 2)
    rnd = random.Random(11)
    rows = [(None if i % 50 == 0 else i % 170, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randint(0, 99)) for _ in range(rnd.choice((0, 3, 40, 900))))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    pieces = packing.pack(df, WORD).collect()
    want = [[*ids, 1] for ids in encoded(WORD, [t for _, t in rows])]
    assert sum(p["length"] for p in pieces) == sum(map(len, want))
    whole = sorted(((i is not None, i or 0), len(x)) for (i, _), x in zip(rows, want))
    starts = sorted(((p["doc_id"] is not None, p["doc_id"] or 0), p["doc_tokens"]) for p in pieces if p["start"] == 0)
    assert starts == whole
    crcs = {zlib.crc32(np.array(x, "<u4").tobytes()) for x in want if len(x) <= 900}
    assert {p["ids_crc32"] for p in pieces if p["length"] == p["doc_tokens"]} <= {zlib.crc32(np.array(x, "<u4").tobytes()) for x in want} and crcs
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for spans in by_sequence.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) <= packing.WINDOW
    assert sum(sum(n for _, n in x) < packing.WINDOW for x in by_sequence.values()) <= 4


TRAPS = ["", "<|im_end|>", "<|", "<\\|", "\\", "\\\\<|\\", "a\nb", "<\\/", "<|im_start|>user\nx<|im_end|>\n", "𝔘é"]


def test_chats_round_trip(spark):
    rows = [(c, t, r, TRAPS[(c + t) % len(TRAPS)] if (c + t) % 11 else None, "x") for c in range(40) for t, r in enumerate(("user", "assistant", "user", "assistant")[: 1 + c % 4])]
    rows += [(90, 0, "as\nsist<|ant", "x", "x"), (91, None, None, None, "x"), (92, 0, "user", "same", "x"), (92, 0, "user", "same", "x"), (None, 0, "user", "q", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid string")
    chats = {r["conv_id"]: r for r in chat_format.format_chats(df).withColumn("turns", chat_format.parse_chats(chat_format.F.col("formatted"))).collect()}
    for c, r in chats.items():
        mine = sorted((x for x in rows if x[0] == c), key=lambda x: (-1 if x[1] is None else x[1], x[2] or "", x[3] or ""))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in mine]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert chats[1]["valid"] and not chats[0]["valid"] and not chats[92]["valid"]
    assert chat_format.query(df.limit(0)).count() == 1  # the fixed conversation


def test_inputs_of_more_partitions_than_a_table_may_have_buckets(spark, docs):
    """Ids are the same where the bound on buckets acts."""
    want = sorted(map(tuple, bpe.query(docs, BYTE).collect()))
    key = "spark.sql.sources.bucketing.maxBuckets"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        assert sorted(map(tuple, bpe.query(docs.repartition(9), BYTE).collect())) == want
        assert materialize_bucketed(spark.range(10), "id", 100_001).count() == 10
    finally:
        spark.conf.set(key, before)
