"""Removing byte strings of a given length that occur more than once, by suffix arrays over what can repeat.

*What can repeat.* Every window of LENGTH bytes has an anchor: of the ANCHOR-byte strings in it the one with the least hash, the
leftmost of equals. Equal windows have equal anchors at equal places, so a window whose anchor occurs once in the corpus occurs
once. Neighbouring windows mostly share their anchor; the bytes of all windows of one are its context, some 250 bytes. Chunks of
documents send the hashes of their anchors and contexts to buckets, each once: a context that occurs twice (128 bits of
hashes agree) has all its windows repeated. An anchor of several different contexts makes them shards.

*Suffix arrays.* A shard holds all contexts of its anchors. Its suffixes are sorted by refinement of classes as Larsson and Sadakane
do, in numpy: from seven bytes on, each round doubles the length by which suffixes are told apart, and only classes with more than
one member go on. Common prefixes of neighbours follow by Kasai's rule, all contexts moving one place at a time together.
Neighbours with LENGTH common bytes are repeated windows. Contexts are whole in a shard, and each window is in one context.

*Across shards.* An anchor with more contexts than a shard holds (a passage in very many documents) fills several. Each writes its different
windows (128-bit hashes) in order, cut to ranges; a range's lists are merged, and each is looked up in the merged one by binary
search. So no group of copies is one task's work, equal contexts are compared once, and nothing is left out.

Defined cases: null and empty texts have no bytes and nothing to remove; a null doc_id is kept; repeated rows remove each other, as
other copies do, and are returned each; very long texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.blocks import bucket_count, homes, long_ids, mix, pack_many, raw_words, text_slices, unpack_many
from evalloom.llm.common import materialize, materialize_bucketed
from evalloom.llm.wordpieces import spans as ranges

#: Bytes of a window, and of an anchor.
LENGTH, ANCHOR = 200, 100
#: Bytes of a chunk's texts, give or take a document; windows whose anchors are found at a time (a place in them takes 20 bits at most).
CHUNK_BYTES = 4 << 20
SLICE = (1 << 18) - LENGTH
#: Contexts of a shard, give or take those of one anchor.
SHARD = 2_048
#: Bytes by which suffixes are told apart at first: seven of nine bits fill a key.
FIRST = 7

_U = np.uint64
_MASK = _U((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15
_CHUNKS = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("data", pa.binary()), ("anchors", pa.binary())])
CHUNKS = "kind string, chunk long, bucket int, doc_ids array<bigint>, lens array<bigint>, data binary, anchors binary"
CONTEXTS = "shard long, chunk long, key int, windows int, split boolean, asks boolean, data binary"
FOUND = "chunk long, bucket int, key int, data binary"
SPAN = "struct<start: bigint, length: bigint>"
CLEANED = f"doc_id long, n_bytes long, spans array<{SPAN}>, kept binary"


def window_anchors(raw: np.ndarray, lens: np.ndarray, slice_: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of texts of ``lens`` bytes, one after another: first and last window, place of the anchor, hash of the anchor."""
    n, width = len(raw), LENGTH - ANCHOR + 1
    if n < LENGTH:
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, _U))
    size = min(n, slice_ + LENGTH)
    power, inverse = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(size, x, _U)])) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    begins, anchors, hashes = [], [], []
    for s in range(0, n - LENGTH + 1, slice_):
        part = raw[s : s + slice_ + LENGTH - 1]
        total = np.concatenate([np.zeros(1, _U), np.cumsum((part.astype(_U) + _U(1)) * power[: len(part)])])
        h = mix((total[ANCHOR:] - total[:-ANCHOR]) * inverse[: len(part) - ANCHOR + 1])
        least, k = (h & ~_MASK) | np.arange(len(h)).astype(_U), 1
        while 2 * k <= width:
            least, k = np.minimum(least[:-k], least[k:]), 2 * k
        if k < width:
            least = np.minimum(least[: len(least) - (width - k)], least[width - k :])
        at = (least & _MASK).astype(np.int64)
        new = np.flatnonzero(np.diff(at, prepend=-1))
        begins.append(s + new)
        anchors.append(s + at[new])
        hashes.append(mix(h[at[new]]))  # the least of many are small: mixed again, they fill all buckets
    begin, anchor, h = (np.concatenate(x) for x in (begins, anchors, hashes))
    ends = np.cumsum(lens)
    some = lens >= LENGTH
    first, after = (ends - lens)[some], ends[some] - LENGTH + 1
    bounds = np.unique(np.concatenate([begin, first, after]))
    doc, run = np.searchsorted(first, bounds, "right") - 1, np.searchsorted(begin, bounds, "right") - 1
    inside = (doc >= 0) & (bounds < np.where(doc >= 0, after[doc], 0)) if len(first) else np.zeros(len(bounds), bool)
    lo, hi, run, doc = bounds[inside], np.append(bounds[1:], n)[inside] - 1, run[inside], doc[inside]
    # a run of windows that a slice cut goes on
    new = np.ones(len(lo), bool)
    new[1:] = (anchor[run[1:]] != anchor[run[:-1]]) | (doc[1:] != doc[:-1])
    new = np.flatnonzero(new)
    return lo[new], hi[np.append(new[1:], len(hi)).astype(int) - 1] if len(new) else hi, anchor[run[new]], h[run[new]]


def make_chunks(docs: DataFrame, buckets: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of ``docs`` (doc_id long, text string) in a table bucketed by chunk. Rows of kind body: the texts, and their
    contexts in order of their hashes; rows of kind keys: the different hashes of a bucket in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0

        def chunk(ids: list, lens: list, texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal serial
            raw, lens = np.concatenate(texts), np.array(lens, np.int64)
            texts.clear()
            lo, hi, at, h = window_anchors(raw, lens)
            data = raw.tobytes()
            seen = np.fromiter((xxhash.xxh3_64_intdigest(data[x:y], seed) for x, y, seed in zip(lo.tolist(), (hi + LENGTH).tolist(), (at - lo).tolist())), _U, len(lo))
            order = np.lexsort((seen, h))
            lo, hi, h, seen = lo[order], hi[order], h[order], seen[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (seen[1:] != seen[:-1])
            first = np.flatnonzero(new)
            many = np.diff(first, append=len(h)) > 1
            row = dict.fromkeys(_CHUNKS.names) | {"chunk": (part << 32) + serial}
            serial += 1
            body = row | {"kind": "body", "doc_ids": ids, "lens": lens.tolist(), "data": zstandard.compress(data, 3), "anchors": pack_many(lo.astype("<u4"), (hi - lo).astype("<u4"), np.packbits(new))}
            yield pa.RecordBatch.from_pylist([body], _CHUNKS)
            h, seen = h[first], seen[first]
            some, begin = np.unique(homes(h, buckets), return_index=True)
            rows = []
            for b, x, y in zip(some.tolist(), begin.tolist(), [*begin[1:].tolist(), len(h)]):
                rows.append(row | {"kind": "keys", "bucket": b, "data": pack_many(np.diff(h[x:y], prepend=_U(0)), seen[x:y], many[x:y].astype(np.uint8))})
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[i : i + 64], _CHUNKS)

        ids, lens, texts, held = [], [], [], 0
        for batch in batches:
            column = pc.fill_null(batch.column(1), "") if batch.column(1).null_count else batch.column(1)
            for a, b in text_slices(column):
                offsets, raw = raw_words(column.slice(a, b - a))
                ids.extend(batch.column(0).slice(a, b - a).to_pylist())
                lens.extend(np.diff(offsets).tolist())
                texts.append(raw)
                held += len(raw)
                if held >= chunk_bytes:
                    yield from chunk(ids, lens, texts)
                    ids, lens, texts, held = [], [], [], 0
        if ids:
            yield from chunk(ids, lens, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize_bucketed(rows.mapInArrow(run, CHUNKS), "chunk", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "spans")


def judge(rows: pd.DataFrame, shard_size: int = SHARD) -> pd.DataFrame:
    """What becomes of each key of a bucket's lists: 0 its anchor occurs once, 1 its windows are repeated, 2 its windows are to be compared,
    3 they are repeated, and others of its anchor are to be compared with it; and of 2 and 3 the shard and whether the anchor fills several."""
    lists = [unpack_many(d, 3) for d in rows["data"]]
    h = np.concatenate([np.cumsum(x[0], dtype=_U) for x in lists])
    seen, many = (np.concatenate([x[k] for x in lists]) for k in (1, 2))
    cuts = np.cumsum([len(x[0]) for x in lists])[:-1]
    del lists
    order = np.lexsort((seen, h))
    h, seen = h[order], seen[order]
    new_h = np.ones(len(h), bool)
    new_h[1:] = h[1:] != h[:-1]
    new = new_h.copy()
    new[1:] |= seen[1:] != seen[:-1]
    first = np.flatnonzero(new)
    times = np.add.reduceat(1 + many[order].astype(np.int64), first)
    anchor = np.cumsum(new_h)[first] - 1
    contexts = np.bincount(anchor)
    several = contexts[anchor] > 1
    place = np.cumsum(several) - several
    begin = place[np.flatnonzero(np.diff(anchor, prepend=-1))][anchor]
    split = several & (contexts[anchor] > shard_size)
    shard = np.where(split, place, begin) // shard_size
    of = np.cumsum(new) - 1
    code = np.where(times >= 2, 1, np.where(several, 2, 0)).astype(np.uint8)[of]
    code[first[(times >= 2) & several]] = 3
    out = [np.empty(len(h), x.dtype) for x in (code, shard, split)]
    for to, x in zip(out, (code, shard[of], split[of])):
        to[order] = x
    bucket = int(rows["bucket"].iloc[0])
    answers = []
    for c, s, p in zip(*(np.split(x, cuts) for x in out)):
        sent = c >= 2
        answers.append(pack_many(c, s[sent].astype("<u4"), p[sent].astype(np.uint8)))
    return pd.DataFrame({"chunk": rows["chunk"].to_numpy(), "bucket": bucket, "key": pd.array([None] * len(rows), "Int32"), "data": answers})


def _opened(row) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts of a chunk, first and last window of its contexts, and the key of each."""
    lo, size, new = unpack_many(row["anchors"], 3)
    return zstandard.decompress(row["data"]), lo.astype(np.int64), lo.astype(np.int64) + size, np.cumsum(np.unpackbits(new, count=len(lo)), dtype=np.int64) - 1


def send_contexts(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The contexts of a chunk that are to be compared."""
    row, out, at = rows.iloc[0], [], 0
    data, lo, hi, key = _opened(row)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    for bucket, answer in zip(answers["bucket"].tolist(), answers["data"]):
        code, shard, split = unpack_many(answer, 3)
        sent = at + np.flatnonzero(code >= 2)
        at += len(code)
        x, y = lo[first[sent]], hi[first[sent]]
        texts = [data[a:b] for a, b in zip(x.tolist(), (y + LENGTH).tolist())]
        out.append(pd.DataFrame({"shard": (bucket << 32) + shard.astype(np.int64), "chunk": row["chunk"], "key": sent, "windows": y - x + 1, "split": split.astype(bool), "asks": code[code >= 2] == 2, "data": texts}))
    return pd.concat(out) if out else pd.DataFrame(columns=["shard", "chunk", "key", "windows", "split", "asks", "data"])


def suffix_array(codes: np.ndarray, longest: int) -> np.ndarray:
    """Places in the order of what follows them, up to the next 0 of ``codes``; equals by place. ``codes`` ends in ``longest`` zeros."""
    n = len(codes) - longest
    key, live = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(FIRST):
        code = codes[k : n + k] * live
        key, live = (key << 9) | code, code > 0
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    rank = np.zeros(n + longest, np.int64)
    rank[order] = np.repeat(first, np.diff(first, append=n))
    h, active = FIRST, np.flatnonzero(np.bincount(rank[:n], minlength=n)[rank[:n]] > 1)
    zeros = np.flatnonzero(codes[:n] == 0)
    to_end = np.repeat(zeros, np.diff(zeros, prepend=-1)) - np.arange(n)
    while len(active) and h < longest:
        active = active[to_end[active] >= h]  # the members of other classes are equal to their ends
        order = active[np.lexsort((rank[active + h], rank[active]))]
        old, follows = rank[order], rank[order + h]
        group = np.diff(old, prepend=-1) != 0
        new = np.flatnonzero(group | (np.diff(follows, prepend=-1) != 0))
        group = np.flatnonzero(group)
        size = np.diff(new, append=len(old))
        # a class is named by the place of its first
        rank[order] = old + np.repeat(new, size) - np.repeat(group, np.diff(group, append=len(old)))
        active = order[np.repeat(size > 1, size)]
        h *= 2
    return np.argsort(rank[:n], kind="stable")


def common_prefixes(codes: np.ndarray, order: np.ndarray, begins: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """For each place the common prefix with the one before it in ``order``, by Kasai's rule; texts move through their places together."""
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    prefix = np.zeros(n, np.int64)
    at, upto, h = begins.copy(), begins + lens, np.zeros(len(begins), np.int64)
    while len(at):
        other = before[at]
        a, b = codes[at + h], codes[np.maximum(other, 0) + h]
        same = (other >= 0) & (a == b) & (a > 0)
        done = ~same
        prefix[at[done]] = h[done]
        h = np.where(same, h + 1, np.maximum(h - 1, 0))
        at = at + done
        live = at < upto
        if not live.all():
            at, upto, h = at[live], upto[live], h[live]
    return prefix


def repeated_windows(texts: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a shard in suffix order: text, number in the text, whether it occurs again, whether it is the first of its class."""
    lens = np.array([len(t) for t in texts], np.int64)
    longest = int(lens.max()) + 1
    codes = np.zeros(int(lens.sum()) + len(lens) + longest, np.int64)
    begins = np.cumsum(lens + 1) - lens - 1
    codes[ranges(begins, lens)] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    order = suffix_array(codes, longest)
    prefix = common_prefixes(codes, order, begins, lens)
    text = np.searchsorted(begins, order, "right") - 1
    number = order - begins[text]
    real = number < windows[text]
    follows = (prefix[order] >= LENGTH)[real]  # equal windows are neighbours: what lies between would begin alike
    text, number = text[real], number[real]
    return text, number, follows | np.append(follows[1:], False), ~follows


def match_shard(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """A shard's answers: bits of a context's windows that occur again; and where an anchor fills several shards, the different windows by bucket."""
    rows = rows.reset_index(drop=True)
    windows, asks = rows["windows"].to_numpy(np.int64), rows["asks"].to_numpy(bool)
    text, number, again, first = repeated_windows(rows["data"].tolist(), windows)
    begins = np.cumsum(windows) - windows
    bits = np.zeros(int(windows.sum()), np.uint8)
    bits[begins[text] + number] = again
    chunk, key, out = rows["chunk"].to_numpy(), rows["key"].to_numpy(), []
    some = [i for i in np.flatnonzero(asks).tolist() if bits[begins[i] : begins[i] + windows[i]].any()]
    out.append(pd.DataFrame({"chunk": chunk[some], "bucket": None, "key": key[some], "data": [np.packbits(bits[begins[i] : begins[i] + windows[i]]).tobytes() for i in some]}))
    mine = first & rows["split"].to_numpy(bool)[text]
    if mine.any():
        text, number, open_ = text[mine], number[mine], (asks[text] & ~again)[mine]
        data = rows["data"].tolist()
        hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[t][k : k + LENGTH]) for t, k in zip(text.tolist(), number.tolist())]), ">u8").reshape(-1, 2).astype(_U)
        order = np.lexsort((hashes[:, 1], hashes[:, 0]))
        high, low, open_, of, number = hashes[order, 0], hashes[order, 1], open_[order], text[order], number[order]
        some, begin = np.unique(homes(high, buckets), return_index=True)
        packed = []
        for x, y in zip(begin.tolist(), [*begin[1:].tolist(), len(high)]):
            asked = open_[x:y]
            packed.append(pack_many(high[x:y], low[x:y], asked.astype(np.uint8), chunk[of[x:y][asked]].astype(np.int64), key[of[x:y][asked]].astype("<u4"), number[x:y][asked].astype("<u4")))
        out.append(pd.DataFrame({"chunk": None, "bucket": some, "key": None, "data": packed}))
    return pd.concat(out).astype({"chunk": "Int64", "bucket": "Int32", "key": "Int32"})


def merge_shards(rows: pd.DataFrame) -> pd.DataFrame:
    """The windows of a range that more than one shard has: each list is looked up in the merged one. Numbers of windows, little-endian."""
    lists = [unpack_many(d, 6) for d in rows["data"]]
    merged = np.sort(np.concatenate([x[0] for x in lists]))
    found = []
    for x in lists:  # the other half of the hash is compared where the first occurs again
        found.append(np.flatnonzero(np.searchsorted(merged, x[0], "right") - np.searchsorted(merged, x[0], "left") > 1))
    high, low = (np.concatenate([x[k][f] for x, f in zip(lists, found)]) for k in (0, 1))
    pairs, of, n = np.unique(np.stack([high, low], 1), axis=0, return_inverse=True, return_counts=True) if len(high) else (None, np.empty(0, int), np.empty(0, int))
    twice, out = (n > 1)[of.ravel()], []
    for x, f, hit in zip(lists, found, np.split(twice, np.cumsum([len(f) for f in found])[:-1])):
        asked = x[2].astype(bool)
        k = f[hit]
        k = (np.cumsum(asked) - 1)[k[asked[k]]]
        out.append(pd.DataFrame({"chunk": x[3][k], "key": x[4][k].astype(np.int64), "number": x[5][k].astype(np.int64)}))
    out = pd.concat(out)
    of = [(c, k, g["number"].to_numpy("<u4").tobytes()) for (c, k), g in out.groupby(["chunk", "key"])]
    return pd.DataFrame({"chunk": pd.array([x[0] for x in of], "Int64"), "bucket": pd.array([-1] * len(of), "Int32"), "key": pd.array([x[1] for x in of], "Int32"), "data": [x[2] for x in of]})


def clean(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """The documents of a chunk without the repeated bytes."""
    row = rows.iloc[0]
    data, lo, hi, key = _opened(row)
    change = np.zeros(len(data) + 1, np.int32)
    codes = [unpack_many(d, 3)[0] for d in found[found["key"].isna()].sort_values("bucket")["data"]]
    if codes:
        whole = (np.concatenate(codes) % 2 == 1)[key]
        np.add.at(change, lo[whole], 1)
        np.add.at(change, hi[whole] + LENGTH, -1)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    marks = found[found["key"].notna()]
    starts = [np.empty(0, np.int64)]
    for bucket, k, d in zip(marks["bucket"], marks["key"].astype(int).tolist(), marks["data"]):
        numbers = np.frombuffer(d, "<u4") if bucket == -1 else np.flatnonzero(np.unpackbits(np.frombuffer(d, np.uint8)))
        starts.append(lo[first[k]] + numbers.astype(np.int64))
    starts = np.concatenate(starts)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + LENGTH, -1)
    gone = np.cumsum(change, dtype=np.int32)[:-1] > 0
    lens = np.array(row["lens"], np.int64)
    ends = np.cumsum(lens)
    edge = np.zeros(len(gone) + 1, bool)
    edge[ends - lens] = True
    start = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
    stop = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
    cuts = np.concatenate([[0], np.add.accumulate(~gone, dtype=np.int32)])[np.concatenate([[0], ends])].tolist()
    of = np.searchsorted(start, np.concatenate([[0], ends])).tolist()
    base = (ends - lens).tolist()
    lists = [[{"start": s - b, "length": t - s} for s, t in zip(start[x:y].tolist(), stop[x:y].tolist())] if y > x else [] for x, y, b in zip(of, of[1:], base)]
    return pd.DataFrame({"doc_id": long_ids(list(row["doc_ids"])), "n_bytes": lens, "spans": lists, "kept": [kept[x:y] for x, y in zip(cuts, cuts[1:])]})


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, shard_size: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, spans (start, length: removed bytes), kept (binary: the other bytes) of every row."""
    spark = docs.sparkSession
    chunks = make_chunks(docs, bucket_count(docs), chunk_bytes)
    bodies = chunks.filter("kind = 'body'").select("chunk", "doc_ids", "lens", "data", "anchors")
    answers = chunks.filter("kind = 'keys'").select("chunk", "bucket", "data").groupBy("bucket").applyInPandas(lambda g: judge(g, shard_size), FOUND)
    answers = materialize(answers, "keys")
    contexts = bodies.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(lambda b, a: send_contexts(b, a.sort_values("bucket")), CONTEXTS)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(contexts.groupBy("shard").applyInPandas(lambda g: match_shard(g, buckets), FOUND), "matches")
    across = found.filter("chunk is null").groupBy("bucket").applyInPandas(merge_shards, FOUND)
    found = answers.union(found.filter("chunk is not null")).union(across)
    return bodies.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(clean, CLEANED)


def query(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return remove_repeats(docs, **bounds).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
