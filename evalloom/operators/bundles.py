"""Context bundles over file tables: selection, content policy, limits, budgets, digests."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.digests import ordered_digest
from evalloom.functions.text import is_composed
from evalloom.sources.scratch import stored

MARKER = "\n[truncated]\n"
#: Characters at a cut whose tokens may change with what follows.
EDGE = 64
_TOKEN = re.compile(r"\w+|[^\w\s]")


def count_words(text: str) -> int:
    """The default token count: words and single marks."""
    return len(_TOKEN.findall(text))


def ancestors(path: Column) -> Column:
    """A path and its ancestor directories."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def select_context(files: DataFrame, includes: DataFrame, excludes: DataFrame) -> DataFrame:
    """Files (case_id, path) under an include and no exclude; reason is the first include's index. Joined on exploded ancestors."""
    spread = files.select("case_id", "path", F.explode(ancestors(F.col("path"))).alias("entry"))
    found = spread.join(includes, ["case_id", "entry"]).groupBy("case_id", "path").agg(F.min("include_index").alias("i"))
    out = spread.join(excludes, ["case_id", "entry"], "left_semi").select("case_id", "path").distinct()
    return found.join(out, ["case_id", "path"], "left_anti").select("case_id", "path", F.concat(F.lit("include["), F.col("i"), F.lit("]")).alias("selection_reason"))


def check_includes(files: DataFrame, includes: DataFrame) -> DataFrame:
    """Violations: includes that select no file."""
    spread = files.select("case_id", F.explode(ancestors(F.col("path"))).alias("entry")).distinct()
    return includes.join(spread, ["case_id", "entry"], "left_anti").select(F.lit("empty_include").alias("rule"), F.concat_ws("/", "case_id", "entry").alias("key"))


def check_paths(files: DataFrame) -> DataFrame:
    """Violations: absolute paths, backslashes, NUL, empty or dotted parts, paths that are not in NFC form."""
    bad = F.col("path").isNull() | F.col("path").rlike(r"^/|\\|\x00|(^|/)(\.{1,2})?(/|$)") | (F.col("path") == "")
    return files.filter(bad | ~is_composed("path")).select(F.lit("unsafe_path").alias("rule"), F.coalesce("path", F.lit("")).alias("key"))


def decode_content(files: DataFrame, binary_policy: str = "omit") -> DataFrame:
    """content (binary) as text with \\n line ends; binary files (NUL byte or invalid UTF-8) are left out, or kept with a null text under 'report'."""
    text = F.when(F.expr("is_valid_utf8(content)") & (F.expr("position(x'00' in content)") == 0), F.decode("content", "UTF-8"))
    rows = files.withColumn("content", F.regexp_replace(text, "\r\n?", "\n"))
    return rows if binary_policy == "report" else rows.filter("content is not null")


def truncate(text: str, byte_limit: int, token_limit: int, policy: str, count: Callable[[str], int] = count_words) -> tuple[str, bool] | None:
    """The text or its longest fitting part with the marker, and whether it was cut; None if nothing fits.

    Token counts need not grow with the text, so candidates are tried downward from the largest that fits in bytes; parts
    whose inner tokens alone are too many rule out every longer one. Those of ``count_words`` do grow, so the largest is found at once.
    """
    fits = lambda t: len(t) <= byte_limit and len(t.encode()) <= byte_limit and count(t) <= token_limit
    if fits(text):
        return text, False
    if policy == "reject" or token_limit < 1 or not fits(MARKER):
        return None

    def part(kept: int) -> str:
        tail = kept // 2 if policy == "head_tail" else 0
        return text[: kept - tail] + MARKER + (text[len(text) - tail :] if tail else "")

    def largest(good: Callable[[int], bool], high: int) -> int:
        low = 0
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if good(middle) else (low, middle - 1)
        return low

    # a character has a byte at least
    high = largest(lambda k: len(part(k).encode()) <= byte_limit, min(len(text), byte_limit))
    if count is count_words:
        kept = _longest(text, high, token_limit - count(MARKER), policy)
        return part(kept), True

    def inside(k: int) -> int:
        """Tokens of the two parts without what their cut ends may change: no longer candidate has fewer."""
        tail = k // 2 if policy == "head_tail" else 0
        return count(text[: max(0, k - tail - EDGE)]) + (count(text[len(text) - tail + EDGE :]) if tail > EDGE else 0)

    high = largest(lambda k: inside(k) <= token_limit, high)
    return next(((part(k), True) for k in range(high, -1, -1) if fits(part(k))), None)


def _longest(text: str, high: int, tokens: int, policy: str) -> int:
    """The largest number of kept characters, up to ``high``, whose two parts have at most ``tokens`` words and marks.

    The marker begins and ends with white space, so counts add up; a part has a token for each that starts before its cut, or ends after it.
    """
    side = high // 2 if policy == "head_tail" else 0
    starts = [m.start() for m in _TOKEN.finditer(text[:high])]
    ends = [side - m.end() for m in _TOKEN.finditer(text[len(text) - side :])][::-1] if side else []  # characters after a token
    low = 0
    while low < high:
        middle = (low + high + 1) // 2
        tail = middle // 2 if policy == "head_tail" else 0
        low, high = (middle, high) if bisect_left(starts, middle - tail) + bisect_left(ends, tail) <= tokens else (low, middle - 1)
    return low


def limit_text(content: Column, byte_limit: Column, token_limit: Column, policy: str = "head", count: Callable[[str], int] = count_words) -> Column:
    """Struct of content, truncated, byte_count and token_count; content is null where nothing fits."""

    @F.pandas_udf("content string, truncated boolean, byte_count long, token_count long")
    def run(texts: pd.Series, n_bytes: pd.Series, tokens: pd.Series) -> pd.DataFrame:
        out = []
        for t, b, k in zip(texts, n_bytes, tokens):
            got = None if t is None else truncate(t, int(b), int(k), policy, count)
            out.append((None, None, None, None) if got is None else (*got, len(got[0].encode()), count(got[0])))
        return pd.DataFrame(out, columns=["content", "truncated", "byte_count", "token_count"])

    return run(content, byte_limit, token_limit)


def fit_budget(files: DataFrame, byte_limit: int, file_tokens: int, total_tokens: int, policy: str = "head", count: Callable[[str], int] = count_words) -> DataFrame:
    """Entries of each (case_id, snapshot): as limited per file if their sum fits, else by shares in path order, what is unused rolling on.

    Groups are the files of one snapshot; only those beyond the budget go through the sequential step. A text is limited once, and written
    once: as it is limited where its group fits, else whole.
    """
    keys = ["case_id", "snapshot"]
    once = files.withColumn("e", limit_text(F.col("content"), F.lit(byte_limit), F.lit(file_tokens), policy, count))
    # texts that were not cut are moved once
    once = once.select(*keys, "path", F.col("content").alias("whole"), F.when(F.col("e.truncated"), F.col("e.content")).alias("cut"), "e.truncated", "e.byte_count", "e.token_count")
    over = F.sum("token_count").over(Window.partitionBy(*keys)) > total_tokens
    marked = once.withColumn("over", over).filter("over is not null")
    content = F.when(F.col("over") | F.col("truncated").isNull(), None).when(F.col("truncated"), F.col("cut")).otherwise(F.col("whole"))
    marked = stored(marked.select(*keys, "path", "over", F.when(F.col("over"), F.col("whole")).alias("whole"), content.alias("content"), "truncated", "byte_count", "token_count"), "budgets")
    fit = marked.filter("not over").select(*keys, "path", "content", "truncated", "byte_count", "token_count")

    def share(g: pd.DataFrame) -> pd.DataFrame:
        left, out = total_tokens, []
        g = g.sort_values("path")
        for i, row in enumerate(g.itertuples()):
            got = None if row.whole is None else truncate(row.whole, byte_limit, min(file_tokens, left // (len(g) - i)), policy, count)
            used = count(got[0]) if got else 0
            left -= used
            out.append((row.case_id, row.snapshot, row.path, got[0] if got else None, bool(got and got[1]), len(got[0].encode()) if got else 0, used))
        return pd.DataFrame(out, columns=[*keys, "path", "content", "truncated", "byte_count", "token_count"])

    over = marked.filter("over").select(*keys, "path", "whole").groupBy(*keys).applyInPandas(share, "case_id string, snapshot string, path string, content string, truncated boolean, byte_count long, token_count long")
    return fit.union(over)


def bundle_manifest(entries: DataFrame) -> DataFrame:
    """Digest, bytes and tokens of every (case_id, snapshot)'s entries in path order."""
    line = F.concat_ws("\0", "path", F.sha2(F.col("content").cast("binary"), 256), F.col("truncated").cast("string"))
    keys = ["case_id", "snapshot"]
    rows = stored(entries.select(*keys, "path", "byte_count", "token_count", line.alias("line")), "entries")  # both results read it, without texts
    sums = rows.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("byte_count").alias("bytes"), F.sum("token_count").alias("tokens"))
    return sums.join(ordered_digest(rows, keys, ["path"], F.col("line")).drop("n"), keys)


def tree_digest(files: DataFrame, group: str) -> DataFrame:
    """Digest over (path, mode, size, sha256, git blob sha1) of each group's files in path order; a file without a ``mode`` column is 100644."""
    content = F.col("content").cast("binary")
    size = F.octet_length(content)
    blob = F.sha1(F.concat(F.concat(F.lit("blob "), size.cast("string"), F.lit("\0")).cast("binary"), content))
    mode = F.col("mode") if "mode" in files.columns else F.lit("100644")
    line = F.concat_ws("\0", "path", mode, size.cast("string"), F.sha2(content, 256), blob)
    return ordered_digest(files, [group], ["path"], line).select(group, F.col("n").alias("files"), "digest")
