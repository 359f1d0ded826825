"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of every whole text are computed once and written. Random cosine features approximate a Gaussian kernel over the
standardised statistics; each task sums its part of the normal equations, the sums meet in a few groups, and one small system
is solved. Calibration is isotonic regression on a fold of the training rows that the ridge fit has not seen: scores are
counted in a fixed number of fine bins, so that what is gathered does not grow with the rows.

Inputs of a score are statistics of the text alone. Defined cases: a null text is an empty one and gets a score; rows with
a null id or a null label are not learned from; a document labelled more than once counts with its lowest label; repeated rows
are scored each; very long texts are read whole, one task a text; with no labelled rows at all every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import fold, materialize

FEATURES = 256
RIDGE = 1e-3
BINS = 2_000
#: Groups in which the tasks' normal equations meet; the driver gets one sum from each.
GROUPS = 16
SEED = 20240229

_PUNCT = np.array([c < 128 and not chr(c).isalnum() and not chr(c).isspace() for c in range(256)])
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_LOWER = np.array([97 <= c <= 122 for c in range(256)])
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_SYMBOL = np.array([c in b"#*$%&|<>@^~_=+{}[]\\/" for c in range(256)])
_STOP = np.array([c in b".,;:?" for c in range(256)])
_INNER = re.compile(r"[^\W\d_][#*$%&!|<>]")


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, chars = max(1, len(words)), max(1, len(raw))
    high = int(counts[128:].sum())
    letters = int(counts[_UPPER].sum() + counts[_LOWER].sum()) + high
    return [
        np.log1p(len(words)),
        np.log1p(len(raw)),
        sum(map(len, words)) / n,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(map(eq, words, words[2:])) / n,
        int(counts[_UPPER].sum()) / max(1, letters),
        int(counts[_DIGIT].sum()) / chars,
        int(counts[_SYMBOL].sum()) / n,
        int(counts[33]) / n,
        int(counts[124]) / n,
        int(counts[_STOP].sum()) / n,
        int(counts[_PUNCT].sum()) / n,
        len(_INNER.findall(text)) / n if counts[_SYMBOL].any() or counts[33] else 0.0,
        letters / chars,
        len(lines) / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        np.log1p(max(map(len, words), default=0)),
    ]


N_STATISTICS = 18


def statistics_table(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, fold, x array<double> of every row; written to the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [statistics(t or "") for t in batch["text"].tolist()]
            yield batch.drop(columns="text").assign(x=x)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return materialize(slim.mapInPandas(run, "doc_id long, held_out boolean, x array<double>"), "statistics")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing sequence nearest to ``values``."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def train(rows: DataFrame, calibrate: Column) -> Model:
    """rows: x, y (0 or 1); those where ``calibrate`` holds are kept for calibration."""
    fit, held = rows.filter(~calibrate), rows.filter(calibrate)
    moments = fit.agg(F.count("*").alias("n"), *(f(F.col("x")[i]).alias(f"{name}{i}") for i in range(N_STATISTICS) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    rng = np.random.default_rng(SEED)
    pick = lambda c, other: np.array([moments[f"{c}{i}"] if moments[f"{c}{i}"] else other for i in range(N_STATISTICS)], float)
    width = np.sqrt(N_STATISTICS)  # of the kernel, in standardised units
    model = Model(pick("m", 0.0), pick("s", 1.0), rng.normal(size=(N_STATISTICS, FEATURES)) / width, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    if not moments["n"]:
        return model
    d = FEATURES + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = np.zeros((d, d + 1))
        for batch in batches:
            if len(batch):
                z = model.features(np.array(batch["x"].tolist()))
                total += z.T @ np.column_stack([z, batch["y"].to_numpy(float)])
        yield pd.DataFrame({"g": [TaskContext.get().partitionId() % GROUPS], "data": [total.tobytes()]})

    def meet(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": parts["g"].iloc[:1], "data": [sum(np.frombuffer(x) for x in parts["data"]).tobytes()]})

    found = fit.select("x", "y").mapInPandas(sums, "g int, data binary").groupBy("g").applyInPandas(meet, "g int, data binary").collect()
    system = sum(np.frombuffer(r["data"]) for r in found).reshape(d, d + 1)
    penalty = RIDGE * moments["n"] * np.eye(d)
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(system[:, :d] + penalty + 1e-9 * np.eye(d), system[:, d])

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, good, total = np.zeros(BINS), np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            if len(batch):
                raw = model.raw(np.array(batch["x"].tolist()))
                b = np.clip(((raw + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
                for out, w in ((n, None), (good, batch["y"].to_numpy(float)), (total, raw)):
                    out += np.bincount(b, w, BINS)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"b": some, "n": n[some], "good": good[some], "total": total[some]})

    seen = held.select("x", "y").mapInPandas(bins, "b int, n double, good double, total double").groupBy("b").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("total").alias("total")).toPandas().sort_values("b")
    if len(seen):
        level = isotonic(((seen["good"] + 0.01) / (seen["n"] + 0.02)).to_numpy(), seen["n"].to_numpy())
        model.knots, model.values = (seen["total"] / seen["n"]).to_numpy(), np.clip(level, 0, 1)
        slope = 1e-6 * (model.knots - model.knots[0])  # ties within a step keep the order of the raw scores
        model.values = np.clip(model.values + slope, 0, 1)
    return model


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, calibrate: Column, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from labelled rows where ``held_out`` is false (``calibrate`` is a condition on doc_id)."""
    table = statistics_table(docs, held_out)
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    model = train(table.filter("not held_out").join(known, "doc_id"), calibrate)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = model.score(np.array(batch["x"].tolist()).reshape(len(batch), N_STATISTICS))
            yield batch[["doc_id", "held_out"]].assign(score=score, predicted=(score >= threshold).astype(np.int32))

    return table.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels.select("doc_id", "quality"), F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)), fold(F.col("doc_id"), 5) == 1)
