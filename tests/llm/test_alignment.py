"""Alignment of two tokenizers against a brute-force version on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from evalloom.llm import token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    parts = [" ", " ", "  ", "a", "B", "é", "\n", "\t", "1", "!", "<|endoftext|>", "<s>", "<0x41>", "'s", "\x1c", "\x00", "\x01", "\x85", "\r", "\r\n", "Σ", "́", "ab c", "日本", "　", ";", "{\r", "*/", "​", " the"]
    return [None, "", "word " * 3000, "x" * 20_000, "héllo wörld\n" * 900, " a", "a▁b", "▁"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def brute(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    pair = token_alignment.TokenizerPair(A, B)
    out, links = [], []
    for text in texts:
        own, text = [], text or ""
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        want = (" " + text).encode()
        if not text or b"".join(pair.bytes_a[i] for i in ia) != want or b"".join(pair.bytes_b[i] for i in ib) != want:
            out.append((0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = np.cumsum(pair.size_a[ia]).tolist(), np.cumsum(pair.size_b[ib]).tolist()
        groups, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
            groups.append(",".join(map(str, ia[x:p])) + "|" + ",".join(map(str, ib[y:q])))
            own.append((ia[p - 1], ib[q - 1]))
            x, y = p, q
        out.append((len(ia), len(ib), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    n = Counter(x for own in links for x in own)
    highest = {}
    for (_, y), k in n.items():
        highest[y] = max(highest.get(y, 0), k)
    return [(*o[:3], len(own), sum(n[x] == highest[x[1]] for x in own), sum(n[x] for x in own), o[3]) for o, own in zip(out, links)]


def test_cuts_are_where_both_end():
    rng = np.random.default_rng(2)
    docs = np.cumsum(rng.integers(1, 20_000, 40))
    ends = [np.unique(np.concatenate([rng.integers(1, docs[-1], docs[-1] // 4), docs])) for _ in range(2)]
    cut_a, cut_b = token_alignment.common_cuts(*ends, docs)
    both = np.intersect1d(*ends)
    assert (ends[0][cut_a] == both).all() and (ends[1][cut_b] == both).all()


@pytest.mark.parametrize("whole", [False, True])
def test_words_join_to_a_space_and_the_text(whole):
    texts = [t or "" for t in odd_texts(2000, 4)]
    words, lens = token_alignment.split_words(pa.array(texts), whole)
    words, at = words.to_pylist(), 0
    for text, n in zip(texts, lens.tolist()):
        assert "".join(map(token_alignment.spaced, words[at : at + n])) == (" " + text if text else "")
        at += n


@pytest.mark.parametrize("chunk_bytes", [token_alignment.CHUNK_BYTES, 1])
def test_query_is_brute_force(spark, monkeypatch, chunk_bytes):
    if chunk_bytes == 1:
        monkeypatch.setattr(token_alignment, "BATCH_WORDS", 50)
        monkeypatch.setattr(token_alignment, "STRETCH", 7)
    texts = odd_texts(1200)
    texts += [texts[9], texts[9]]
    docs = spark.createDataFrame([(None if i == 9 else i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, groups string")
    got = token_alignment.query(docs, A, B)
    key = lambda r: (r[0] is None, r)
    want = sorted(((None if i == 9 else i, *r) for i, r in enumerate(brute(texts))), key=key)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == want
    assert token_alignment.query(docs.limit(0), A, B).count() == 0


def test_groups_of_a_text(spark):
    (row,) = token_alignment.align(spark.createDataFrame([(1, "tokenization of words")], "doc_id long, text string"), A, B).collect()
    groups = [[list(map(int, side.split(","))) for side in g.split("|")] for g in row["groups"].split(";")]
    pair = token_alignment.TokenizerPair(A, B)
    assert all(b"".join(pair.bytes_a[i] for i in g[0]) == b"".join(pair.bytes_b[i] for i in g[1]) for g in groups)
    assert b"".join(pair.bytes_a[i] for g in groups for i in g[0]) == b" tokenization of words" and row["n_groups"] == len(groups) == row["n_links"]
