"""Text helpers: canonical JSON digests, phrase normal form, keyed digests, patterns."""

from __future__ import annotations

import hashlib
import hmac
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_digest(*columns: str) -> Column:
    """``sha256:`` and the digest of the columns as canonical JSON (sorted keys, no spaces, nulls kept); strings, integers and booleans only."""
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


@F.pandas_udf(T.StringType())
def canonical_json(documents: pd.Series) -> pd.Series:
    """JSON text in canonical form: sorted keys, no spaces, UTF-8 unescaped; null if it is not one JSON value or has NaN or infinity."""

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(json.loads(text, parse_constant=_refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        except (TypeError, ValueError):
            return None

    return documents.map(one)


def _refuse(name: str):
    raise ValueError(name)


def normal_phrase(text: str | None) -> str | None:
    """NFKC, case folding, maximal runs of letters and digits joined by one space."""
    if text is None:
        return None
    folded = unicodedata.normalize("NFKC", text).casefold()
    return " ".join("".join(c if c.isalnum() else " " for c in folded).split())


@F.pandas_udf(T.StringType())
def normalize_phrase(texts: pd.Series) -> pd.Series:
    return texts.map(normal_phrase)


@F.pandas_udf(T.StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """NFKC form."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.BooleanType())
def is_composed(texts: pd.Series) -> pd.Series:
    """Whether a text is in NFC form."""
    return texts.map(lambda t: None if t is None else unicodedata.is_normalized("NFC", t))


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    """NFKC, case folding, runs of white space as one space, none at the ends."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def hmac_digest(key: bytes):
    """A vectorised ``hmac-sha256:`` digest of a string column under a key."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "hmac-sha256:" + hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return run
