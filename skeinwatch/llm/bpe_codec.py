"""Byte-level BPE encoding and decoding.

Encoding splits a text by the vocabulary's pattern and runs each piece through a `MergeMachine`,
whose merges are compiled into a transducer that emits a token once no later byte can change it.
Decoding is a stream: blocks of ids become bytes, and an incremental UTF-8 state machine hands on whole
characters and holds back a character that a block cuts.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge_machine import Ids, MergeMachine, MergeTable

_STATES, _PIECES = 300_000, 200_000
_PORTION = 2_000_000  # characters of texts whose results are held at once


def _utf8_machine() -> tuple[bytes, list[bytes]]:
    """Byte classes, and by state the next state of each class.

    States: 0 between characters, 1 to 3 so many bytes to come, 4 to 7 the second byte is limited
    (after E0, ED, F0, F4), 8 the bytes are no UTF-8.
    """
    ranges = ((0x00, 0x7F), (0x80, 0x8F), (0x90, 0x9F), (0xA0, 0xBF), (0xC2, 0xDF), (0xE0, 0xE0), (0xE1, 0xEC), (0xED, 0xED), (0xEE, 0xEF), (0xF0, 0xF0), (0xF1, 0xF3), (0xF4, 0xF4))
    classes = bytearray([len(ranges)]) * 256
    for k, (a, b) in enumerate(ranges):
        classes[a : b + 1] = bytes([k]) * (b + 1 - a)
    first = {0: 0, 4: 1, 5: 4, 6: 2, 7: 5, 8: 2, 9: 6, 10: 3, 11: 7}
    rows = [{k: first.get(k, 8) for k in range(13)}]
    rows += [{1: n - 1, 2: n - 1, 3: n - 1} for n in (1, 2, 3)]
    rows += [{3: 1}, {1: 1, 2: 1}, {2: 2, 3: 2}, {1: 2}, {}]
    return bytes(classes), [bytes(r.get(k, 8) for k in range(13)) for r in rows]


_CLASSES, _NEXT = _utf8_machine()


class Utf8Stream:
    """Takes bytes in any cuts, gives back text; what is no UTF-8 becomes U+FFFD as `errors="replace"` does."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):  # an open character starts in the last three bytes
            if data[-back] >= 0xC0:
                state = 0
                for b in data[-back:]:
                    state = _NEXT[state][_CLASSES[b]]
                keep = back if 0 < state < 8 else 0
                break
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Encodes and decodes with the ranks of one `.tiktoken` file; special strings are ordinary text.

    It remembers up to `max_states` states of the machine and twice `max_pieces` pieces; these bound memory, not results.
    """

    def __init__(self, ranks: str, pattern: str, max_states: int = _STATES, max_pieces: int = _PIECES):
        import regex

        self.table = MergeTable.from_ranks(ranks)
        self.machine = MergeMachine(self.table, Ids, max_states)
        self.split = regex.compile(pattern).findall
        self.max_pieces = max_pieces
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def _piece(self, piece: str) -> str:
        """A piece not among the latest; `older` holds those before them, so that frequent ones survive."""
        found = self.memo.get(piece) or self.older.get(piece)
        if found is None:
            found = " ".join(map(str, self.machine.ids(piece.encode("utf-8"))))
        if len(piece) <= 32:
            if len(self.memo) >= self.max_pieces:
                self.memo, self.older = {}, self.memo
            self.memo[piece] = found
        return found

    def encode_text(self, text: str) -> str:
        """Decimal ids joined by a space."""
        pieces = self.split(text)
        of = self.memo.get
        found = [of(p) for p in pieces]
        return " ".join([s if s is not None else self._piece(p) for s, p in zip(found, pieces)])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_text(text).split()]

    def decode(self, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
        """The text of a stream of ids, in parts."""
        stream, ids, tokens = Utf8Stream(), list(ids), self.table.tokens
        for k in range(0, len(ids), block):
            yield stream.feed(b"".join([tokens[i] for i in ids[k : k + block]]))
        yield stream.close()


@functools.cache
def _codec(ranks: str, pattern: str, max_states: int = _STATES, max_pieces: int = _PIECES) -> Codec:
    return Codec(ranks, pattern, max_states, max_pieces)


def encode(text: Column, ranks: str, pattern: str) -> Column:
    """A column of arrays of token ids. A null text has none."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(ranks, pattern)
        for texts in batches:
            yield pd.Series([codec.encode(t) for t in texts.fillna("")], dtype=object)

    return ids(text)


def decode(ids: Column, ranks: str, pattern: str) -> Column:
    """The texts of arrays of token ids. No ids (null, empty): the empty text; unknown ids raise an error."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(ranks, pattern)
        for rows in batches:
            yield pd.Series(["" if r is None else "".join(codec.decode(r)) for r in rows], dtype=object)

    return text(ids)


def _portions(texts: pd.Series) -> Iterator[pd.Series]:
    """The texts in order, in runs that end once they hold `_PORTION` characters."""
    first = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= _PORTION:
            yield texts.iloc[first : k + 1]
            first, held = k + 1, 0
    if first < len(texts):
        yield texts.iloc[first:]


def round_trip(
    text: Column, ranks: str, pattern: str, with_ids: bool = False, max_states: int = _STATES, max_pieces: int = _PIECES
) -> Column:
    """Encodes, then decodes the ids: struct of n_tokens, SHA-256 of the ids (decimal, one space between) and of the text decoded, and the ids if asked for."""
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in kind.split(", ")]

    @F.pandas_udf(kind)
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(ranks, pattern, max_states, max_pieces)
        for texts in (p for b in batches for p in _portions(b.fillna(""))):
            rows = []
            for t in texts:
                written = codec.encode_text(t)
                ids = [int(i) for i in written.split()]
                back = hashlib.sha256()
                for part in codec.decode(ids):
                    back.update(part.encode("utf-8"))
                rows.append((len(ids), hashlib.sha256(written.encode()).hexdigest(), back.hexdigest(), np.array(ids, np.int32))[: len(names)])
            yield pd.DataFrame(rows, columns=names)

    return digests(text)


def encoded(
    docs: DataFrame, ranks: str, pattern: str, text: str = "text", with_ids: bool = False, max_states: int = _STATES, max_pieces: int = _PIECES
) -> DataFrame:
    """`docs` with n_tokens, ids_sha256 and decoded_sha256 of the round trip, and the ids if asked for.

    Null and empty texts: no tokens, and the digests of no bytes. Repeated rows repeat their result.
    Columns of these names are replaced; all others stay.
    """
    found = docs.withColumn("_trip", round_trip(F.coalesce(F.col(text), F.lit("")), ranks, pattern, with_ids, max_states, max_pieces))
    names = found.schema["_trip"].dataType.names
    return found.withColumns({n: F.col(f"_trip.{n}") for n in names}).drop("_trip")
