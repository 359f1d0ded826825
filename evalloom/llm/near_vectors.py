"""Near-duplicate vectors by sorted projection passes.

Each pass draws random hyperplanes, concatenates the signs of a vector's projections to one key and orders all vectors by
it; every vector is compared with its neighbours in a bounded window of that order, and the pairs whose exact cosine reaches
the threshold are united over all passes into components. The number of passes follows from the number of vectors, so that
a pair at the threshold is missed with a chance of at most ``MISS``: the more vectors, the longer the prefix that two
neighbours must share. Where many vectors share that prefix in a pass (a dense group) a window covers only few of them: those
that are not in one component after the windows are compared whole, block against block. Equal vectors are one representative with a count, so a group of copies costs nothing.

Links are then counted exactly: in every component all pairs of representatives are compared, block against block, and only
counts leave a task, never pairs. So a link between two vectors is missed only if no chain of found pairs joins them.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
component; vectors of different lengths never link; a null id is kept, with no links and a null component; rows that repeat
an id count as a link each where their vectors are equal, and are one vertex, with the links of all, where they differ; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import broadcast_if_small, connected_components, materialize

WINDOW = 24
BITS = 48
MISS = 1e-3
SEED = 77
#: Representatives of a block when the pairs of a component are counted.
BLOCK = 1_024
#: Blocks of a component at least, as long as they have SPLIT members: so that the pairs of one component are many tasks' work.
LEAST_BLOCKS, SPLIT = 16, 128


def block_count(n: Column) -> Column:
    return F.least(F.ceil(n / SPLIT), F.greatest(F.ceil(n / BLOCK), F.lit(LEAST_BLOCKS))).cast("int")


def prefix_bits(n: int) -> float:
    return max(1.0, np.log2(max(2, 2 * n / WINDOW)))


def pass_count(n: int, threshold: float) -> int:
    """Passes for ``n`` vectors: neighbours within the window share a prefix of about log2(2 n / WINDOW) signs."""
    same = 1 - np.arccos(threshold) / np.pi
    hit = same ** prefix_bits(n)
    return int(np.ceil(np.log(MISS) / np.log1p(-hit)))


def representatives(vectors: DataFrame) -> DataFrame:
    """id (least of the copies), v binary (unit vector, doubles), x binary (the raw components), copies; usable vectors only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for vec_id, e in zip(batch["vec_id"].tolist(), batch["embedding"].tolist()):
                if e is None or vec_id != vec_id:
                    continue
                x = np.asarray(e, np.float64)
                if not len(x) or not np.isfinite(x).all() or not x.any():
                    continue
                x = x + 0.0  # one zero
                out.append((int(vec_id), x.tobytes()))
            yield pd.DataFrame(out, columns=["vec_id", "x"])

    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    return usable.mapInPandas(run, "vec_id long, x binary")


def units(xs: pd.Series) -> np.ndarray:
    """Unit vectors, one a row, of raw components of one length."""
    v = np.frombuffer(b"".join(xs), np.float64).reshape(len(xs), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _planes(length: int, number: int) -> np.ndarray:
    return np.random.default_rng([SEED, number, length]).normal(size=(length, BITS))


def keyed(reps: DataFrame, passes: int) -> DataFrame:
    """pass, length, key (signs as one integer), id, x: a row for each representative and pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            lengths = batch["x"].map(len).to_numpy() // 8
            for length in np.unique(lengths).tolist():
                part = batch[lengths == length]
                v = units(part["x"])
                for p in range(passes):
                    if (length, p) not in planes:
                        planes[length, p] = _planes(length, p)
                    yield pd.DataFrame({"pass": p, "length": length, "key": (v @ planes[length, p] > 0) @ weights, "id": part["id"], "x": part["x"]})

    return reps.select("id", "x").mapInPandas(run, "pass int, length int, key long, id long, x binary")


def window_pairs(ids: np.ndarray, v: np.ndarray, threshold: float, first: int = 0) -> pd.DataFrame:
    """Pairs within WINDOW of each other in one order, at the threshold; the second of a pair is at ``first`` or later."""
    src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, min(WINDOW, len(ids) - 1) + 1):
        lo = max(first - d, 0)
        near = np.flatnonzero(np.einsum("ij,ij->i", v[lo : len(v) - d], v[lo + d :]) >= threshold) + lo
        src.append(ids[near])
        dst.append(ids[near + d])
    return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})


def near_pairs(reps: DataFrame, passes: int, threshold: float) -> DataFrame:
    """src, dst: pairs that some pass found. Parts of an order overlap: the last rows of one meet the first of the next."""
    ordered = keyed(reps, passes).repartitionByRange("pass", "length", "key", "id").sortWithinPartitions("pass", "length", "key", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        at, seen, head = None, 0, []
        ids, v = np.empty(0, np.int64), None
        for batch in batches:
            for (p, length), rows in batch.groupby(["pass", "length"], sort=True):
                if (p, length) != at:
                    at, ids, v = (p, length), np.empty(0, np.int64), np.empty((0, length))
                new, held = units(rows["x"]), len(ids)
                ids, v = np.concatenate([ids, rows["id"].to_numpy(np.int64)]), np.vstack([v, new])
                if seen < WINDOW:
                    head += [(*at, i, x) for i, x in zip(ids[held:].tolist(), new[: WINDOW - seen])]
                seen += len(new)
                yield window_pairs(ids, v, threshold, held).assign(edge=0)
                ids, v = ids[-WINDOW:], v[-WINDOW:]
        # the part's ends; a short part is both, and is seen through
        for edge, rows in ((2, head), (1, [(*at, i, x) for i, x in zip(ids.tolist(), v)] if at is not None else [])):
            yield pd.DataFrame([(i, None, edge, part, p, n, k, x.tobytes()) for k, (p, n, i, x) in enumerate(rows)], columns=["src", "dst", "edge", "part", "pass", "length", "k", "v"])
        yield pd.DataFrame([(seen, 0, part)], columns=["src", "edge", "part"]).assign(k=-1)

    found = materialize(ordered.mapInPandas(_with_columns(run), "src long, dst long, edge int, part long, pass int, length int, k int, v binary"), "window")
    sizes = {r["part"]: r["src"] for r in found.filter("k = -1").select("part", "src").collect()}  # a number for each part
    meets = []  # of each part: the parts that begin less than a window after its end, and the rows between
    parts = sorted(p for p, n in sizes.items() if n)
    for i, p in enumerate(parts):
        between = 0
        for q in parts[i + 1 :]:
            meets.append((p, q, between))
            between += sizes[q]
            if between >= WINDOW:
                break
    spark = reps.sparkSession
    meets = spark.createDataFrame(meets, "part long, other long, between int")

    def ends(rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"src": [], "dst": []}, dtype=np.int64)]
        for _, g in rows.groupby(["pass", "length"]):
            head = g[g["edge"] == 2].sort_values("k")
            for _, tail in g[g["edge"] == 1].groupby("part"):
                tail, between = tail.sort_values("k"), int(tail["between"].iloc[0])
                if len(head):
                    ids = np.concatenate([tail["src"], np.zeros(between), head["src"]]).astype(np.int64)
                    vs = [np.frombuffer(b"".join(x["v"])).reshape(len(x), -1) for x in (tail, head)]
                    v = np.vstack([vs[0], np.full((between, vs[0].shape[1]), np.nan), vs[1]])
                    pairs = window_pairs(ids, v, threshold, len(tail) + between)
                    out.append(pairs[pairs["src"].isin(tail["src"])])
        return pd.concat(out)

    rows = found.filter("edge > 0").select("src", "edge", "part", "pass", "length", "k", "v")
    tails = rows.filter("edge = 1").join(F.broadcast(meets), "part").select("src", "edge", "part", "pass", "length", "k", "v", F.col("other").alias("at"), "between")
    heads = rows.filter("edge = 2").select("*", F.col("part").alias("at"), F.lit(0).alias("between"))
    over = tails.unionByName(heads).groupBy("at").applyInPandas(ends, "src long, dst long")
    pairs = found.filter("edge = 0 and k is null").select("src", "dst").union(over)
    return pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src <> dst").distinct()


def _with_columns(run):
    names = ["src", "dst", "edge", "part", "pass", "length", "k", "v"]
    return lambda batches: (frame.reindex(columns=names).astype({c: "Int64" for c in names[:-1]}) for frame in run(batches))


def joining(g: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links (src, dst) that join the components of two blocks' members as far as all pairs across the blocks do: at most one a member."""
    left = np.flatnonzero(g["mine"] == g["a"])
    right = np.flatnonzero(g["mine"] == g["b"])
    ids, label, v, links = g["id"].to_numpy(np.int64), np.unique(g["component"], return_inverse=True)[1], units(g["x"]), []
    hit = (v[left] @ v[right].T >= threshold) & (label[left][:, None] != label[right][None, :])
    for k in np.flatnonzero(hit.any(1)).tolist():
        i = left[k]
        for j in right[hit[k] & (label[right] != label[i])].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return pd.DataFrame(links, columns=["src", "dst"], dtype=np.int64)


def prefix_links(reps: DataFrame, found: DataFrame, n: int, passes: int, threshold: float) -> DataFrame:
    """Links between the components ``found`` (id, component) among vectors that share a pass's prefix, by comparing them whole.

    Up to WINDOW + 1 vectors of a prefix have met in the windows. Members of a prefix's main component aren't compared with
    each other; all others meet every block of the prefix.
    """
    prefix = F.shiftright("key", BITS - int(prefix_bits(n)))
    at = ["pass", "length", "prefix"]
    rows = keyed(reps, passes).select("pass", "length", prefix.alias("prefix"), "id").join(found, "id", "left")
    rows = materialize(rows.withColumn("component", F.coalesce("component", "id")), "prefixes")
    parts = rows.groupBy(*at, "component").agg(F.count("*").alias("k"))
    cut = parts.groupBy(*at).agg(F.sum("k").alias("n"), F.max(F.struct("k", "component")).alias("most")).filter(F.col("n") > WINDOW + 1).filter("n > most.k")
    cut = materialize(cut.select(*at, F.col("most.component").alias("main"), block_count(F.col("most.k")).alias("mains"), block_count(F.col("n") - F.col("most.k")).alias("others")), "cut")
    main = F.col("component") == F.col("main")
    mine = F.when(main, F.pmod(F.xxhash64("id"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("id"), F.col("others"))).cast("int")
    other = F.explode(F.sequence(F.when(main, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1))
    dealt = rows.join(broadcast_if_small(cut), at).select(*at, "id", "component", mine.alias("mine"), other.alias("other"))
    dealt = dealt.select(*at, F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "id", "component")
    return dealt.join(reps.select("id", "x"), "id").groupBy(*at, "a", "b").applyInPandas(lambda g: joining(g, threshold), "src long, dst long").distinct()


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """id, links: for representatives (component, id, x, copies) of components with more than one, the vectors linked to each but its own copies."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    rows = members.join(sizes, "component").withColumn("blocks", block_count(F.col("n")))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a component of one block: itself; else each pair of blocks is a group that gets both
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("component", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "id", "x", "copies")

    def count(g: pd.DataFrame) -> pd.DataFrame:
        a, b = int(g["a"].iloc[0]), int(g["b"].iloc[0])
        left, right = g[g["mine"] == a], g[g["mine"] == b]
        out = [pd.DataFrame({"id": [], "links": []}, dtype=np.int64)]
        for _, u in left.groupby(left["x"].map(len)):
            for n, v in right.groupby(right["x"].map(len)):
                if n == len(u["x"].iloc[0]):
                    hit = (units(u["x"]) @ units(v["x"]).T >= threshold) & (u["id"].to_numpy()[:, None] != v["id"].to_numpy()[None, :])
                    out.append(pd.DataFrame({"id": u["id"], "links": hit @ v["copies"].to_numpy(np.int64)}))
                    if a != b:
                        out.append(pd.DataFrame({"id": v["id"], "links": u["copies"].to_numpy(np.int64) @ hit}))
        return pd.concat(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last group, which the next batch may go on with
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch])
            keys = batch[["component", "a", "b"]]
            last = (keys == keys.iloc[-1]).all(axis=1)
            held, done = batch[last], batch[~last]
            if len(done):
                yield pd.concat([count(g) for _, g in done.groupby(["component", "a", "b"], sort=False)])
        if held is not None and len(held):
            yield count(held)

    ordered = pairs.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "id")
    return ordered.mapInPandas(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    rows = materialize(representatives(vectors), "vectors")
    reps = materialize(rows.groupBy("x").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "representatives")
    n = reps.count()
    passes = pass_count(n, threshold)
    pairs = materialize(near_pairs(reps, passes, threshold), "pairs")
    components = materialize(connected_components(pairs), "components")
    more = materialize(prefix_links(reps, components, n, passes, threshold), "links")
    if not more.isEmpty():
        components = materialize(connected_components(pairs.union(more)), "components")
    members = components.join(reps, "id")
    links = count_links(members, threshold)
    found = reps.join(components, "id", "left").join(links, "id", "left").select("x", "copies", F.coalesce("component", "id").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    linked = rows.join(found, "x").select("vec_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"), F.col("component").alias("component_id"))
    linked = linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
