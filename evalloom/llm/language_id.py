"""Language identification by character language models with interpolated Kneser-Ney smoothing.

Texts are lower-cased and everything but letters becomes one space. For each language n-gram counts of order four are summed
by Spark over a bounded sample of its training documents (about ``SAMPLE`` whole documents, chosen by a hash of the id); lower
orders use continuation counts. The probabilities of all n-grams seen in any language are laid out in arrays sorted by a 64-bit hash,
a column for each language, so that one search gives a character's probabilities in all languages; an n-gram seen nowhere
falls back to its shorter suffix with the weight of its history. The language of a text is that of the lowest cross-entropy
per character. That cross-entropy is brought to a scale that all languages and lengths share: less the language's median, over
the deviation to be expected of a text of so many characters (a part between texts and a part between characters, both from a
fold of the training rows that was not counted). A text is rejected above one limit on that scale, a conformal bound from
the rows of that fold in all languages, so that at most ``REJECTED`` of such texts are turned away and a language with
few rows has a limit too. The limit is never below ``LEAST`` deviations; with fewer than 1 / REJECTED rows in all languages
it is the greatest value seen, or ``LEAST``.

Defined cases: null text and text without a letter is ``und`` with score 0 and rejected; rows with a null lang or null id
are not learned from; ties go to the first language in alphabetical order; with nothing to learn from all texts are ``und``;
repeated rows are predicted each; of very long texts every character counts; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import fold

ORDER = 4
DISCOUNT = 0.75
#: About so many documents of each language are counted, and so many calibrate the limits.
SAMPLE = 3_000
CALIBRATION = 3_000
REJECTED = 0.001
LEAST = 10.0
#: Characters whose evidence the score counts at most.
EVIDENCE = 40
UNKNOWN = "und"
#: Characters whose probabilities are held at a time, give or take a text.
CHUNK_CHARS = 250_000

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, itself if it is a letter and else a space."""
    if not _letters:
        is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        _letters.append(np.where(is_letter, np.arange(0x110000), 32).astype(np.uint32))
    return _letters[0]


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of normalised texts, each after ORDER - 1 spaces; the text of each place; letters of each text."""
    pad = " " * (ORDER - 1)
    lower = [pad + t.lower() for t in texts]
    codes = letters()[np.frombuffer("".join(lower).encode("utf-32-le", "replace"), np.uint32)]
    text = np.repeat(np.arange(len(texts)), [len(t) for t in lower])
    space = codes == 32
    counts = np.bincount(text[~space], minlength=len(texts))
    first = np.searchsorted(text, np.arange(len(texts)))
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    for k in range(ORDER - 1):
        keep[first + k] = True
    return codes[keep], text[keep], counts


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` code points that end at each place from ORDER - 1 on."""
    n = len(codes) - ORDER + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(order):  # k places back
        out += codes[ORDER - 1 - k : ORDER - 1 - k + n].astype(np.uint64) * _FACTORS[k]
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def hashed(rows: np.ndarray) -> np.ndarray:
    """The same for rows of code points, the last column being the last character."""
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out += rows[:, rows.shape[1] - 1 - k].astype(np.uint64) * _FACTORS[k]
    return mixed(out)


@dataclass
class Model:
    languages: list[str]
    #: By order: sorted hashes of n-grams, their probability by language; sorted hashes of histories, the weight of what is shorter.
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    histories: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    floor: float = 1e-6
    #: By language: median cross-entropy, variance between texts, variance between characters; and the limit on the common scale.
    median: np.ndarray = field(default_factory=lambda: np.empty(0))
    between_texts: np.ndarray = field(default_factory=lambda: np.empty(0))
    between_chars: np.ndarray = field(default_factory=lambda: np.empty(0))
    limit: float = np.inf

    def probabilities(self, codes: np.ndarray, places: np.ndarray, order: int) -> np.ndarray:
        """Of the characters at ``places`` (counted from ORDER - 1 on), by language."""
        if not order:
            return np.full((len(places), len(self.languages)), self.floor)
        keys, values = self.grams[order]
        h = self.at(codes, places, order, 0)
        where = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        out = values[where]
        lost = np.flatnonzero(keys[where] != h)
        if len(lost):
            shorter = self.probabilities(codes, places[lost], order - 1)
            keys, values = self.histories[order]
            h = self.at(codes, places[lost], order - 1, 1)
            where = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            weight = np.where((keys[where] == h)[:, None], values[where], 1.0)
            out[lost] = weight * shorter
        return out

    @staticmethod
    def at(codes: np.ndarray, places: np.ndarray, order: int, back: int) -> np.ndarray:
        out = np.zeros(len(places), np.uint64)
        for k in range(order):
            out += codes[places + (ORDER - 1 - k - back)].astype(np.uint64) * _FACTORS[k]
        return mixed(out)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is accepted, for each text."""
        names, scores, accepted, at = [], [], [], 0
        while at < len(texts):
            upto, chars = at, 0
            while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= CHUNK_CHARS):
                chars += len(texts[upto])
                upto += 1
            for n, s, a in zip(*self._predict(texts[at:upto])):
                names.append(n)
                scores.append(s)
                accepted.append(a)
            at = upto
        return names, np.array(scores, float), np.array(accepted, bool)

    def deviation(self, h: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Cross-entropies of texts of ``n`` characters in languages ``k`` on the common scale."""
        return (h - self.median[k]) / np.sqrt(self.between_texts[k] + self.between_chars[k] / np.maximum(n, 1))

    def entropies(self, texts: list[str], spread: bool = False) -> tuple[np.ndarray, ...]:
        """Cross-entropy per character (nats) by language, the number of characters (0: no letter), and with ``spread`` their variances."""
        codes, text, n_letters = codes_of(texts)
        places = np.arange(len(codes) - ORDER + 1)
        inside = text[ORDER - 1 :] == text[: len(codes) - ORDER + 1]
        places, text = places[inside], text[ORDER - 1 :][inside]
        logs = np.log(self.probabilities(codes, places, ORDER).astype(np.float32))
        n = np.bincount(text, minlength=len(texts))
        total = np.column_stack([np.bincount(text, logs[:, k], len(texts)) for k in range(len(self.languages))])
        h, n_chars = -total / np.maximum(n, 1)[:, None], np.where(n_letters > 0, n, 0)
        if not spread:
            return h, n_chars
        squares = np.column_stack([np.bincount(text, logs[:, k] ** 2, len(texts)) for k in range(len(self.languages))])
        return h, n_chars, np.maximum(squares / np.maximum(n, 1)[:, None] - h**2, 0)

    def _predict(self, texts: list[str]):
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        h, n = self.entropies(texts)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        share = np.exp((low[:, None] - h) * np.minimum(n, EVIDENCE)[:, None])
        score = np.where(n > 0, 1 / share.sum(1), 0.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, n)], score, (n > 0) & (self.deviation(low, n, best) <= self.limit)


def _bounded(rows: DataFrame, n: int) -> DataFrame:
    """About ``n`` rows of each language: those whose hash of the id lies under the language's share."""
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    share = (F.xxhash64(F.col("doc_id"), F.lit("sample")) % 1_000_000 + 1_000_000) % 1_000_000
    kept = [r for r in sizes.collect()]  # a row for each language
    if not kept:
        return rows.limit(0)
    limit = F.create_map(*(F.lit(x) for r in kept for x in (r["lang"], min(1_000_000, -(-n * 1_000_000 // r["rows"])))))
    return rows.filter(share < limit[F.col("lang")])


def _count(rows: DataFrame) -> pd.DataFrame:
    """lang, gram (ORDER characters), n over the sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                codes, text, _ = codes_of(part["text"].tolist())
                if len(codes) < ORDER:
                    continue
                inside = np.flatnonzero(text[ORDER - 1 :] == text[: len(codes) - ORDER + 1])
                _, first, n = np.unique(grams(codes, ORDER)[inside], return_index=True, return_counts=True)
                rows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[inside[first]]
                joined = np.ascontiguousarray(rows).tobytes().decode("utf-32-le", "replace")
                yield pd.DataFrame({"lang": lang, "gram": [joined[i : i + ORDER] for i in range(0, len(joined), ORDER)], "n": n})

    return rows.select("lang", "text").mapInPandas(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()


def build(counts: pd.DataFrame) -> Model:
    """The model from n-gram counts by language (bounded by the sample)."""
    model = Model(sorted(counts["lang"].unique()))
    if not model.languages:
        return model
    raw = np.frombuffer("".join(counts["gram"]).encode("utf-32-le", "replace"), np.uint32).reshape(-1, ORDER)
    lang = np.searchsorted(model.languages, counts["lang"].to_numpy(str)) if len(model.languages) > 1 else np.zeros(len(counts), int)
    n_lang = len(model.languages)
    model.floor = 1.0 / (len(np.unique(raw)) + 1)
    n = counts["n"].to_numpy(float)
    #: By order: rows of characters, language, count; below the highest, the count of different characters before.
    tables = {ORDER: (raw, lang, n)}
    for order in range(ORDER - 1, 0, -1):
        rows, of, _ = tables[order + 1]
        cut = np.column_stack([rows[:, 1:], of])
        unique, n_before = np.unique(cut, axis=0, return_counts=True)
        tables[order] = (unique[:, :-1].astype(np.uint32), unique[:, -1].astype(int), n_before.astype(float))
    for order in range(1, ORDER + 1):
        rows, of, n = tables[order]
        keys, first, place = np.unique(hashed(rows), return_index=True, return_inverse=True)
        history = hashed(rows[:, :-1]) if order > 1 else np.zeros(len(rows), np.uint64)
        h_keys, h_place = np.unique(history, return_inverse=True)
        total, kinds = np.zeros((len(h_keys), n_lang)), np.zeros((len(h_keys), n_lang))
        np.add.at(total, (h_place, of), n)
        np.add.at(kinds, (h_place, of), 1)
        weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        own = np.zeros((len(keys), n_lang))
        own[place, of] = np.maximum(n - DISCOUNT, 0)
        of_key = h_place[first]
        own = np.where(total[of_key] > 0, own / np.maximum(total[of_key], 1), 0.0)
        unique_rows = rows[first]
        if order > 1:
            short_keys, short = model.grams[order - 1]
            h = hashed(unique_rows[:, 1:])
            where = np.minimum(np.searchsorted(short_keys, h), len(short_keys) - 1)
            lower = short[where]
        else:
            lower = np.full((len(keys), n_lang), model.floor)
        model.grams[order] = (keys, own + weight[of_key] * lower)
        model.histories[order] = (h_keys, weight)
    model.median, model.between_texts, model.between_chars = np.zeros(n_lang), np.zeros(n_lang), np.ones(n_lang)
    return model


def train(rows: DataFrame, calibrate: Column) -> Model:
    """rows: doc_id, text, lang, none null; those where ``calibrate`` holds set the limits."""
    model = build(_count(_bounded(rows.filter(~calibrate), SAMPLE)))
    if not model.languages:
        return model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.iloc[i : i + 200]
                h, n, spread = model.entropies(part["text"].tolist(), spread=True)
                best = h.argmin(1)
                right = (n > 0) & (np.array(model.languages)[best] == part["lang"].to_numpy(str))
                at = np.flatnonzero(right), best[right]
                yield pd.DataFrame({"k": best[right], "h": h[at], "n": n[right], "spread": spread[at]})

    seen = _bounded(rows.filter(calibrate), CALIBRATION).select("text", "lang").mapInPandas(run, "k int, h double, n long, spread double").toPandas()  # bounded
    calibrate_limit(model, *(seen[c].to_numpy() for c in ("k", "h", "n", "spread")))
    return model


def calibrate_limit(model: Model, k: np.ndarray, h: np.ndarray, n: np.ndarray, spread: np.ndarray) -> None:
    """Set the scale of each language (that of all for one without rows) and the common limit from texts' languages, cross-entropies, lengths and spreads."""
    if not len(k):
        return
    for of in range(len(model.languages)):
        own = k == of if (k == of).any() else np.ones(len(k), bool)
        model.median[of] = np.median(h[own])
        model.between_chars[of] = max(np.median(spread[own]), 1e-6)
        model.between_texts[of] = max((1.4826 * np.median(np.abs(h[own] - model.median[of]))) ** 2 - model.between_chars[of] * np.median(1 / n[own]), 1e-6)
    found = np.sort(model.deviation(h, n, k))
    model.limit = max(LEAST, found[min(len(found), int(np.ceil((len(found) + 1) * (1 - REJECTED)))) - 1])


def train_on(docs: DataFrame) -> Model:
    """Learn from documents whose crc32(doc_id) mod 4 is 0 or 1, calibrate on 3; 2 is held out."""
    part = fold(F.col("doc_id"), 4)
    return train(docs.select("doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null").filter(part != 2), part == 3)


def identify(text: Column, model: Model) -> Column:
    """Struct of lang_pred, score and accepted for a text column."""

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        name, score, accepted = model.predict([t or "" for t in texts.tolist()])
        return pd.DataFrame({"lang_pred": name, "score": score, "accepted": accepted})

    return run(text)


def query(docs: DataFrame) -> DataFrame:
    model = train_on(docs)
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), identify(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.*")
