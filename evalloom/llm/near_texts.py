"""Near-duplicate texts by DartMinHash signatures of weighted word shingles.

A text is the multiset of its five-word shingles (one shingle of all its words where it has fewer); the weight of a
shingle is how often it occurs, and similarity is weighted Jaccard. Every unit of weight of an element is a region in which
hashed darts arrive at random ranks (a Poisson process that is the same in all texts); as many ranks are looked at as give
about K (ln K + 3) darts for the whole text, so that a signature's cost hardly depends on its length. The earliest dart of each
of K coordinates makes the signature: two texts agree in a coordinate with the chance of their weighted Jaccard similarity.
Bands of signatures are joined; what is found is verified exactly before it links.

Texts with equal shingles are one representative. A bucket of few representatives gives all its pairs; a larger one first
links each member with three leaders, which joins a group of like copies at once. Each text's likeliest pair is verified first;
then all pairs that still join different components. Large buckets that hold several components after that are compared
exactly, block against block, and only links that join components leave a task. So of the texts that share a band no pair is left
out, but for those that chains of links join already.

Defined cases: null text and text without words has no shingles and links with nothing; a null id stays with a null class;
rows that repeat an id share a class; very long texts are compared whole; ties go to the least id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import broadcast_if_small, connected_components, materialize

SHINGLE = 5
BANDS, ROWS = 24, 6
K = BANDS * ROWS
#: A bucket of at most so many representatives gives all its pairs.
SMALL = 12
#: Members of a block when a large bucket is compared whole, and their shingles.
BLOCK, BLOCK_SHINGLES = 256, 300_000
#: Pairs whose signatures agree in less than this are not verified: six standard deviations under the threshold.
SLACK = 0.2
#: What is worked on at a time: words, and the darts of texts (about K (ln K + 3) each, whatever their length).
CHUNK = 500_000
DARTS = int(K * (np.log(K) + 3))

_U = np.uint64
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, element and weight of the distinct shingles of texts given as word hashes, ordered by text and element."""
    n = np.array([len(r) for r in rows], np.int64)
    words = np.concatenate([*rows, np.zeros(SHINGLE - 1, np.int64)]).view(_U)
    text = np.repeat(np.arange(len(rows)), n)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    of = n[text]
    value = np.zeros(len(text), _U)
    for k in range(SHINGLE):
        value += np.where(at + k < of, words[k : k + len(text)] * _PLACE[k], _U(0))
    keep = (at + SHINGLE <= of) | ((at == 0) & (of > 0))
    text, value = text[keep], mix(value[keep])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])])) if len(text) else np.empty(0, np.int64)
    return text[first], value[first], np.diff(np.append(first, len(text))).astype(float)


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, boost: float = 1.0) -> np.ndarray:
    """K dart ids for each of ``n`` texts (0: no dart, which only a text without elements has)."""
    out = np.zeros((n, K), _U)
    if not len(text):
        return out
    cells = np.ceil(weight).astype(np.int64)
    cell_text, cell_weight = np.repeat(text, cells), np.repeat(weight, cells)
    layer = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
    cell = mix(np.repeat(element, cells) + layer.astype(_U) * _U(0x2545F4914F6CDD1D))
    total = np.bincount(text, weight, n)
    limit = (boost * K * (np.log(K) + 3) / np.maximum(total, 1e-300))[cell_text]
    rank, step = np.zeros(len(cell)), 0
    darts: list[tuple] = []
    while len(cell):
        dart = mix(cell + _U((step * 0xD1342543DE82EF95 + 1) % (1 << 64)))
        uniform = ((dart >> _U(11)).astype(float) + 0.5) / (1 << 53)
        near = np.flatnonzero(uniform >= np.exp(rank - limit))  # the next arrival, an exponential step on, is within the limit
        cell, cell_text, limit, layer, cell_weight, dart = cell[near], cell_text[near], limit[near], layer[near], cell_weight[near], dart[near]
        rank = rank[near] - np.log(uniform[near])
        name = mix(dart ^ _U(0x9FB21C651E98DF25))
        inside = layer + ((mix(name + _U(7)) >> _U(11)).astype(float) / (1 << 53)) < cell_weight
        darts.append((cell_text[inside], rank[inside], name[inside]))
        step += 1
    dart_text, rank, name = (np.concatenate(x) for x in zip(*darts))
    order = np.argsort(-rank, kind="stable")  # the earliest is written last and stays
    out[dart_text[order], (name[order] % _U(K)).astype(np.int64)] = name[order]
    bare = (out == 0).any(1) & (total > 0)
    if bare.any():
        which = bare[text]
        place = np.cumsum(bare) - 1
        out[bare] = signatures(place[text[which]], element[which], weight[which], int(bare.sum()), boost * 2)
    return out


def _chunks(lists: list) -> Iterator[tuple[int, int]]:
    a, words = 0, 0
    for i, x in enumerate(lists):
        words += len(x) + DARTS
        if words >= CHUNK:
            yield a, i + 1
            a, words = i + 1, 0
    if a < len(lists):
        yield a, len(lists)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, content (digest of the shingles), sig (16 bits a coordinate), bands; content is null without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salts = mix(np.arange(1, BANDS + 1).astype(_U))
        for batch in batches:
            lists = [np.asarray(x, np.int64) for x in batch["words"]]
            for a, b in _chunks(lists):
                text, element, weight = shingles(lists[a:b])
                sig = signatures(text, element, weight, b - a)
                key = np.zeros((b - a, BANDS), _U) + salts
                for r in range(ROWS):
                    key = mix(key ^ sig[:, r::ROWS])
                begin = np.searchsorted(text, np.arange(b - a + 1))
                raw = [element[i:j].tobytes() + weight[i:j].tobytes() for i, j in zip(begin, begin[1:])]
                some = begin[1:] > begin[:-1]
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[a:b].to_numpy(),
                    "content": [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in raw],
                    "sig": [x.tobytes() if s else None for x, s in zip((sig & _U(0xFFFF)).astype("<u2"), some)],
                    "bands": [x if s else None for x, s in zip(key.view(np.int64), some)],
                })

    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("words"))
    return words.filter("doc_id is not null").mapInPandas(run, "doc_id long, content binary, sig binary, bands array<bigint>")


def candidates(reps: DataFrame) -> DataFrame:
    """src < dst and the number of bands they share, for representatives (id, bands)."""
    rows = materialize(reps.select("id", F.explode("bands").alias("band")), "bands")
    buckets = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), F.min_by("id", F.xxhash64("id", "band")).alias("c")).filter("n > 1")
    buckets = materialize(buckets, "buckets")
    small = rows.join(buckets.filter(F.col("n") <= SMALL).select("band"), "band").groupBy("band").agg(F.collect_set("id").alias("ids"))
    pairs = small.select(F.explode(F.flatten(F.transform("ids", lambda x: F.transform(F.filter("ids", lambda y: x < y), lambda y: F.struct(x.alias("src"), y.alias("dst")))))).alias("p")).select("p.*")
    large = rows.join(buckets.filter(F.col("n") > SMALL), "band").select("id", F.explode(F.array("a", "b", "c")).alias("leader"))
    large = large.select(F.least("id", "leader").alias("src"), F.greatest("id", "leader").alias("dst")).filter("src <> dst")
    return pairs.union(large).groupBy("src", "dst").agg(F.count("*").alias("shared"))


def shingle_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id, elements and weights (binary, ordered by element) of the texts whose doc_id is in ``ids``."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = [np.asarray(x, np.int64) for x in batch["words"]]
            for a, b in _chunks(lists):
                text, element, weight = shingles(lists[a:b])
                begin = np.searchsorted(text, np.arange(b - a + 1))
                yield pd.DataFrame({"id": batch["doc_id"].iloc[a:b].to_numpy(), "elements": [element[i:j].tobytes() for i, j in zip(begin, begin[1:])], "weights": [weight[i:j].astype("<u4").tobytes() for i, j in zip(begin, begin[1:])]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.distinct(), "doc_id", "left_semi")
    return materialize(texts.select("doc_id", word_hashes(F.col("text")).alias("words")).mapInPandas(pack, "id long, elements binary, weights binary"), "sets")


def verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (src, dst) whose weighted Jaccard similarity reaches the threshold."""

    sets = shingle_sets(pairs.select(F.explode(F.array("src", "dst")).alias("doc_id")), docs)

    @F.pandas_udf("boolean")
    def alike(ea: pd.Series, wa: pd.Series, eb: pd.Series, wb: pd.Series) -> pd.Series:
        out = []
        for a, x, b, y in zip(ea, wa, eb, wb):
            a, b, x, y = np.frombuffer(a, _U), np.frombuffer(b, _U), np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            where = np.minimum(np.searchsorted(a, b), len(a) - 1)
            both = np.minimum(x[where], y)[a[where] == b].sum(dtype=np.int64)
            out.append(bool(both >= threshold * (x.sum(dtype=np.int64) + y.sum(dtype=np.int64) - both)))
        return pd.Series(out, dtype=bool)

    left = sets.select(F.col("id").alias("src"), F.col("elements").alias("ea"), F.col("weights").alias("wa"))
    right = sets.select(F.col("id").alias("dst"), F.col("elements").alias("eb"), F.col("weights").alias("wb"))
    return pairs.select("src", "dst").join(left, "src").join(right, "dst").filter(alike("ea", "wa", "eb", "wb")).select("src", "dst").distinct()


def joining(g: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links (src, dst) that join the components of two blocks' members as far as all pairs across the blocks do: at most one a member."""
    left = np.flatnonzero(g["mine"] == g["a"])
    right = np.flatnonzero(g["mine"] == g["b"])
    ids, label = g["id"].to_numpy(np.int64), np.unique(g["component"], return_inverse=True)[1]
    size = g["elements"].map(len).to_numpy() // 8
    code = np.unique(np.frombuffer(b"".join(g["elements"]), _U), return_inverse=True)[1]
    weight = np.frombuffer(b"".join(g["weights"]), "<u4").astype(np.int64)
    end = np.cumsum(size)
    total = np.add.reduceat(weight, end - size)
    there = np.concatenate([np.arange(end[j] - size[j], end[j]) for j in right])
    code_there, weight_there, start_there = code[there], weight[there], np.cumsum(size[right]) - size[right]
    own, links = np.zeros(code.max() + 1, np.int64), []
    for i in left.tolist():
        if (label[right] == label[i]).all():
            continue
        mine = slice(end[i] - size[i], end[i])
        own[code[mine]] = weight[mine]
        both = np.add.reduceat(np.minimum(own[code_there], weight_there), start_there)
        own[code[mine]] = 0
        for j in right[both >= threshold * (total[i] + total[right] - both)].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return pd.DataFrame(links, columns=["src", "dst"], dtype=np.int64)


def block_links(reps: DataFrame, found: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Links between the components ``found`` (id, component) inside large buckets, by comparing their members whole.

    Members of a bucket's main component aren't compared with each other; all others meet every block of the bucket.
    """
    rows = reps.select("id", F.explode("bands").alias("band")).join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = rows.groupBy("band", "component").agg(F.count("*").alias("k"))
    several = materialize(parts.groupBy("band").agg(F.sum("k").alias("n"), F.count("*").alias("parts"), F.max_by("component", F.struct("k", "component")).alias("main")).filter(F.col("n") > SMALL).filter("parts > 1").select("band", "main"), "several")
    members = materialize(rows.join(broadcast_if_small(several), "band").select("band", "id", "component", (F.col("component") == F.col("main")).alias("main")), "members")
    if members.isEmpty():
        return members.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    sets = shingle_sets(members.select(F.col("id").alias("doc_id")), docs)
    sized = members.join(sets.groupBy("id").agg(F.sum(F.octet_length("elements") / 8).alias("size")), "id")
    blocks = lambda of: F.greatest(F.ceil(F.count_if(of) / BLOCK), F.ceil(F.sum(F.when(of, F.col("size"))) / BLOCK_SHINGLES)).cast("int")
    cut = materialize(sized.groupBy("band").agg(blocks(F.col("main")).alias("mains"), blocks(~F.col("main")).alias("others")), "blocks")
    mine = F.when(F.col("main"), F.pmod(F.xxhash64("id"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("id"), F.col("others"))).cast("int")
    other = F.explode(F.sequence(F.when(F.col("main"), F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1))
    dealt = members.join(broadcast_if_small(cut), "band").select("band", "id", "component", mine.alias("mine"), other.alias("other"))
    dealt = dealt.select("band", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "id", "component")
    return dealt.join(sets, "id").groupBy("band", "a", "b").applyInPandas(lambda g: joining(g, threshold), "src long, dst long").distinct()


def promising(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose signatures agree enough to be worth verifying."""

    @F.pandas_udf("double")
    def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        x, y = (np.frombuffer(b"".join(s), "<u2").reshape(len(s), K) for s in (a, b))
        return pd.Series((x == y).mean(1))

    left, right = reps.select(F.col("id").alias("src"), F.col("sig").alias("a")), reps.select(F.col("id").alias("dst"), F.col("sig").alias("b"))
    return pairs.join(left, "src").join(right, "dst").filter(agreement("a", "b") >= threshold - SLACK).select("src", "dst", "shared")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (the least id of the texts that links reach), kept (doc_id = class_id) for every row of ``docs``."""
    rows = materialize(signed(docs), "signatures")
    reps = materialize(rows.filter("content is not null").groupBy("content").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "representatives")
    pairs = materialize(promising(candidates(reps), reps, threshold), "candidates")
    likeliest = pairs.groupBy("dst").agg(F.max_by("src", F.struct(F.col("shared"), -F.col("src"))).alias("src")).select("src", "dst")
    links = materialize(verified(likeliest, docs, threshold), "links")
    found = materialize(connected_components(links), "components")
    of = lambda end: found.select(F.col("id").alias(end), F.col("component").alias(f"{end}_in"))
    rest = pairs.join(likeliest.withColumn("done", F.lit(True)), ["src", "dst"], "left_anti").join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    rest = materialize(rest.filter("src_in is null or dst_in is null or src_in <> dst_in").select("src", "dst"), "rest")
    more = materialize(verified(rest, docs, threshold), "links")
    if not more.isEmpty():
        links = links.union(more)
        found = materialize(connected_components(links), "components")
    last = materialize(block_links(reps, found, docs, threshold), "links")
    if not last.isEmpty():
        found = materialize(connected_components(links.union(last)), "components")
    classes = reps.join(found, "id", "left").select("content", F.coalesce("component", "id").alias("class_id"))
    linked = rows.select("doc_id", "content").join(classes, "content").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(linked, "doc_id", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))
