"""Words of texts that a tokenizers file encodes independently of each other, and their ids.

Byte-level BPE: a text is cut before every run of white space. There the pre-tokenizer's pattern always starts a new match,
whatever precedes, and added tokens (which hold no space) lie inside a word. A word that follows one space is written without it;
one that follows one line feed is written with it; a carriage return before any other word says that the rest is taken as
it stands (the first of a text, and words after longer runs). Texts with white space beyond ASCII are cut at
single spaces between other characters only.

Word BPE drops white space: texts are cut at runs of ASCII white space.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that are encoded as one text.
JOINED = 1_000
#: Latin letters that NFC and lower case leave single letters, and marks after them.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+([.,!?;:%#$&*|]+)?")
#: Texts that need more than single spaces and line feeds as places to cut, and those that have other white space.
_RUNS = r"[ \n][ \n]|[ \n]\z|[\t\r\f\v]"
_OTHER = r"[\x01\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_encoders: dict[str, "WordEncoder"] = {}


def clean(piece: str) -> bool:
    return bool(piece) and not piece[0].isspace() and not piece[-1].isspace()


def byte_pieces(text: str) -> list[str]:
    """Cut a text at single spaces between other characters; joined, the pieces are the text."""
    if not text:
        return []
    parts = text.split(" ")
    out, before = [parts[0]], clean(parts[0])
    for part in parts[1:]:
        now = clean(part)
        if before and now:
            out.append(" " + part)
        else:
            out[-1] += " " + part
            # what was joined ends as this part does; an empty part ends in a space
        before = bool(part) and not part[-1].isspace() if not (before and now) else True
    return out


def listed(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of lists, and their number for each."""
    return lists.flatten(), np.diff(lists.offsets.to_numpy())


def _cut_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    words, lens = listed(pc.split_pattern(pc.replace_substring_regex(texts, r"([ \t\n\r\f\v]+)", "\x01\\1"), "\x01"))
    feed = pc.match_substring_regex(words, r"^\n[^ \t\n\r\f\v]")
    first = np.zeros(len(words), bool)
    first[np.cumsum(lens) - lens] = True
    plain = pc.match_substring_regex(words, r"^ [^ \t\n\r\f\v]")
    as_is = pc.binary_join_element_wise("\r", words, "")
    return pc.if_else(pa.array(first), as_is, pc.if_else(plain, pc.utf8_slice_codeunits(words, 1), pc.if_else(feed, words, as_is))), lens


def _cut_spaces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    lists = []
    for text in texts.to_pylist():
        pieces = byte_pieces(text)
        lists.append([p[1:] if k and clean(p[1:]) and p[0] == " " else "\r" + p for k, p in enumerate(pieces)] or ["\r"])
    return listed(pa.array(lists, pa.list_(texts.type)))


def byte_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts for byte-level BPE, one text after another, and their number for each."""
    kind = np.where(pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False), 1, 0)
    kind[pc.match_substring_regex(texts, _OTHER).to_numpy(zero_copy_only=False)] = 2
    cut = lambda x: listed(pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\r", x, ""), "\n", " \n"), " "))
    if not kind.any():
        return cut(texts)
    parts, lens, place = [], np.zeros(len(texts), np.int64), []
    for k, how in enumerate((cut, _cut_runs, _cut_spaces)):
        mine = np.flatnonzero(kind == k)
        if len(mine):
            words, n = how(texts.take(pa.array(mine)))
            parts.append(words)
            lens[mine] = n
            place.append(mine)
    order = np.concatenate(place)
    n = lens[order]
    begin = np.empty(len(texts), np.int64)
    begin[order] = np.cumsum(n) - n
    take = np.repeat(begin - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
    return pa.concat_arrays(parts).take(pa.array(take)), lens


def plain_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of characters other than ASCII white space, one text after another, and their number for each."""
    words, lens = listed(pc.ascii_split_whitespace(texts))
    some = pc.greater(pc.binary_length(words), 0)
    text = np.repeat(np.arange(len(lens)), lens)[some.to_numpy(zero_copy_only=False)]
    return words.filter(some), np.bincount(text, minlength=len(lens))


class WordEncoder:
    """Ids of words as the functions above cut them, as little-endian unsigned integers."""

    def __init__(self, path: str, byte_level: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.byte_level = byte_level
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        #: Ids that begin with a space (byte-level), or end a word.
        self.edge = np.zeros(max(self.tokenizer.get_vocab(True).values()) + 1, bool)
        for piece, i in self.tokenizer.get_vocab(True).items():
            self.edge[i] = piece.startswith("Ġ") if byte_level else piece.endswith("</w>")

    def ids(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and all ids.

        Words that can be are encoded many at a time as one text, which is cut again by the ids. Byte-level: each such word
        holds one space, its first character, so its ids begin at an id that begins with a space. Word BPE: a
        plain word has one pre-token or, with marks after it, two, and each ends in an id with the end of a word.
        """
        pieces = words.to_pylist()
        if self.byte_level:
            alone = np.fromiter((w[:1] in ("\r", "\n", "") for w in pieces), bool, len(pieces))
            pieces = [w[1:] if w[:1] == "\r" else w if w[:1] == "\n" else " " + w for w in pieces]
            marks = np.ones(len(pieces), np.int64)
        else:
            found = [_PLAIN.fullmatch(p) for p in pieces]
            alone = np.fromiter((m is None for m in found), bool, len(pieces))
            marks = np.fromiter((1 if m is None or m[1] is None else 2 for m in found), np.int64, len(pieces))
        sizes, lists, places = np.zeros(len(pieces), np.int64), [], []
        whole, rest = np.flatnonzero(~alone), [np.flatnonzero(alone)]
        groups = [whole[i : i + JOINED] for i in range(0, len(whole), JOINED)]
        by = "" if self.byte_level else " "
        for i in range(0, len(groups), 16):
            some = groups[i : i + 16]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([by.join([pieces[k] for k in g]) for g in some], add_special_tokens=False)):
                ids = np.array(e.ids, dtype=self.dtype)
                at, n = np.flatnonzero(self.edge[ids]), marks[group]
                if len(at) != n.sum():  # a word with ids of a kind not thought of; then one by one
                    rest.append(group)
                    continue
                cuts = np.append(at, len(ids)) if self.byte_level else np.concatenate([[0], at[np.cumsum(n) - 1] + 1])
                sizes[group] = np.diff(cuts)
                lists.append(ids)
                places.append(group)
        alone = np.concatenate(rest)
        for i in range(0, len(alone), JOINED):
            group = alone[i : i + JOINED]
            ids = self.ids([pieces[k] for k in group])
            sizes[group] = [len(x) for x in ids]
            lists.append(np.concatenate(ids))
            places.append(group)
        if not places:
            return sizes, np.empty(0, self.dtype)
        flat, place = np.concatenate(lists), np.concatenate(places)
        n = sizes[place]
        begin = np.empty(len(pieces), np.int64)
        begin[place] = np.cumsum(n) - n
        return sizes, flat[spans(begin, sizes)]


def spans(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1 and so on, ``n`` of each, one run after another."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def encoder(path: str, byte_level: bool) -> WordEncoder:
    """This worker's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path, byte_level)
    return _encoders[path]
