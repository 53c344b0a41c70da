"""Token counts of texts, by two compiled transducers.

1. Pieces. The pre-tokeniser's pattern is a small machine over character classes. It marks a
   cut before the character just read, or before the one preceding it (of a run of white space
   the last character may belong to the next piece, which only that one shows). Texts of a batch are
   laid end to end and dealt into chunks of equal length. Every chunk is read from all states
   at once, which gives its state map; the maps compose associatively, so a prefix scan over
   them gives the state in which each chunk is entered. With it, all chunks mark their cuts.
2. Tokens. `MergeMachine` reads the bytes of a piece; its transitions carry the numbers of
   tokens that have become certain.

Work is linear in the characters, for one long text as for many short ones, and needs no
shuffle. Memory: a few dozen bytes a character of at most `_BLOCK` characters (or one text).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge_machine import Counts, MergeMachine, MergeTable

# Character classes and states of the piece machine.
_LETTER, _ONE, _R, _V, _L, _E, _NUMBER, _OTHER, _QUOTE, _SPACE, _WHITE, _END = range(12)
(
    _START, _LETTERS, _NUMBERS, _OTHERS, _SP, _WS, _RUN_SP, _RUN_WS,
    _Q, _QR, _QV, _QL, _DONE,
) = range(13)
_CHUNK, _PROBE, _BLOCK, _MEMO = 256, 16, 1_000_000, 100_000


@functools.cache
def character_classes() -> np.ndarray:
    """The class of every code point, as the pattern's own properties have it."""
    import regex

    points = [chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000)]
    text = "".join(points)
    out = np.full(0x110000, _OTHER, np.uint8)
    for pattern, k in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _WHITE)):
        for m in regex.finditer(pattern, text):
            out[m.start() : m.end()] = k
    for chars, k in (("stmd", _ONE), ("r", _R), ("v", _V), ("l", _L), ("e", _E), ("'", _QUOTE), (" ", _SPACE)):
        for c in chars:
            out[ord(c)] = k
    return out


@functools.cache
def piece_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and cuts (1: before this character, 2: before the one preceding it), by state * 12 + class."""
    letters = (_LETTER, _ONE, _R, _V, _L, _E)
    fresh = {k: _LETTERS for k in letters} | {_NUMBER: _NUMBERS, _OTHER: _OTHERS, _QUOTE: _Q, _SPACE: _SP, _WHITE: _WS, _END: _START}
    joined = {k: _LETTERS for k in letters} | {_NUMBER: _NUMBERS, _OTHER: _OTHERS, _QUOTE: _OTHERS, _SPACE: _RUN_SP, _WHITE: _RUN_WS}
    to, cut = np.zeros((13, 12), np.int16), np.ones((13, 12), np.uint8)
    for state in range(13):
        for k in range(12):
            to[state, k] = fresh[k]

    def stay(state: int, k: int, target: int, cuts: int = 0) -> None:
        to[state, k], cut[state, k] = target, cuts

    for k in letters:
        stay(_LETTERS, k, _LETTERS)
    stay(_NUMBERS, _NUMBER, _NUMBERS)
    for k in (_OTHER, _QUOTE):
        stay(_OTHERS, k, _OTHERS)
        stay(_Q, k, _OTHERS)
    for k, target in joined.items():
        stay(_SP, k, target)
    for state in (_WS, _RUN_SP, _RUN_WS):
        stay(state, _SPACE, _RUN_SP)
        stay(state, _WHITE, _RUN_WS)
    for k in (*letters, _NUMBER, _OTHER, _QUOTE):
        stay(_RUN_SP, k, joined[k], 2)  # the last space begins the piece
        cut[_RUN_WS, k] = 3
    stay(_Q, _ONE, _DONE)
    for k, state, last in ((_R, _QR, _E), (_V, _QV, _E), (_L, _QL, _L)):
        stay(_Q, k, state)
        for c in range(12):  # no contraction: the quote alone, then letters
            to[state, c], cut[state, c] = to[_LETTERS, c], cut[_LETTERS, c] | 2
        stay(state, last, _DONE)
    return to.reshape(-1), cut.reshape(-1)


def entry_states(classes: np.ndarray) -> np.ndarray:
    """The state in which each row (chunk) is entered, by a prefix scan over the chunks' state maps."""
    to, _ = piece_machine()
    lanes, length = classes.shape
    maps = np.broadcast_to(np.arange(13, dtype=np.int16), (lanes, 13)).copy()
    for i in range(min(_PROBE, length)):
        maps = to[maps * 12 + classes[:, i, None]]
    same = (maps == maps[:, :1]).all(axis=1)
    one, rest = maps[same, 0], maps[~same]
    one_in, rest_in = classes[same], classes[~same]
    for i in range(_PROBE, length):
        one = to[one * 12 + one_in[:, i]]
        if len(rest):
            rest = to[rest * 12 + rest_in[:, i, None]]
    maps[same], maps[~same] = one[:, None], rest
    step = 1
    while step < lanes:  # maps[i] becomes the composition of maps[i - step + 1 .. i], doubling
        later = maps[step:].copy()
        maps[step:] = np.take_along_axis(later, maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return np.concatenate([[np.int16(_START)], maps[:-1, _START]])


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Positions where a piece begins, in a stream of classes that starts a text."""
    to, cut = piece_machine()
    n = len(classes)
    lanes = -(-n // _CHUNK)
    grid = np.full(lanes * _CHUNK, _END, np.uint8)
    grid[:n] = classes
    grid = grid.reshape(lanes, _CHUNK)
    state = entry_states(grid)
    columns = np.ascontiguousarray(grid.T)
    cuts = np.empty((_CHUNK, lanes), np.uint8)
    for i in range(_CHUNK):
        at = state * 12 + columns[i]
        cuts[i], state = cut[at], to[at]
    marks = cuts.T.reshape(-1)[: n + 1] if lanes * _CHUNK > n else np.append(cuts.T.reshape(-1), 1)
    begins = (marks[:n] & 1).astype(bool)
    begins[: n - 1] |= (marks[1:n] & 2).astype(bool)
    return np.flatnonzero(begins)


class TokenCounter:
    """Counts tokens of texts with one tokenizer file; special strings count as the one token they are."""

    def __init__(self, path: str):
        table, self.special = MergeTable.from_json(path)
        self.machine = MergeMachine(table, Counts, 120_000)
        self.memo: dict[bytes, int] = {}
        self.classes = character_classes()

    def of_piece(self, piece: bytes) -> int:
        found = self.memo.get(piece)
        if found is None:
            found = self.machine.count(piece)
            if len(piece) <= 32:
                if len(self.memo) >= _MEMO:
                    self.memo.clear()
                self.memo[piece] = found
        return found

    def _sections(self, text: str) -> list[str]:
        parts = [text]
        for s in self.special:
            parts = [q for p in parts for q in p.split(s)]
        return parts

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        held: list[str] = []
        owner: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            parts = self._sections(text)
            out[i] = len(parts) - 1
            held += parts
            owner += [i] * len(parts)
            size += len(text) + len(parts)
            if size >= _BLOCK:
                self._add(held, owner, out)
                held, owner, size = [], [], 0
        if held:
            self._add(held, owner, out)
        return out

    def _add(self, parts: list[str], owner: list[int], out: np.ndarray) -> None:
        stream = "\n".join(parts) + "\n"
        points = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
        classes = self.classes[points]
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1  # the line feeds added here end a text
        classes[ends] = _END
        starts = piece_starts(classes)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])
        edges = at[np.append(starts, len(points))].tolist()
        data = stream.encode("utf-8")
        of = self.memo.get
        pieces = [data[a:b] for a, b in zip(edges, edges[1:])]
        counts = [of(p) for p in pieces]
        for i in [i for i, c in enumerate(counts) if c is None]:
            counts[i] = self.of_piece(pieces[i])
        got = np.array(counts, np.int64)
        got[classes[starts] == _END] = 0
        np.add.at(out, np.asarray(owner)[np.searchsorted(ends, starts)], got)


@functools.cache
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_count(text: Column, tokenizer: str) -> Column:
    """A column of token counts. `tokenizer`: a byte-level `.json` file, readable at that path on every executor."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(tokenizer)
        for texts in batches:
            yield pd.Series(counter.count(texts.fillna("").tolist()), dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 512) -> DataFrame:
    """`docs` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens. Rows are independent, so repeated rows repeat
    their result. Columns of these three names are replaced; all others stay.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.withColumn("n_tokens", token_count(whole, tokenizer))
        .withColumn("n_bytes", F.octet_length(whole).cast("long"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
