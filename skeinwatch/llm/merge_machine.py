"""Byte-pair merges compiled into a deterministic machine that reads a piece byte by byte.

The encoding of every prefix of a piece ends with exactly one token: the one that can follow,
without merging, the last token of the prefix before it. So the only thing to remember while
reading is, for each place from which a token of the vocabulary may still be under way, the
trie node reached and what the encoding up to that place looks like. Such sets are the states.
They are made when first met (lazy determinisation) and kept, with the part that all members
agree on factored out as the output of the transition.

The same construction carries two kinds of output: token counts (integers) and token ids
(tuples). A token has bounded length, so the part still undecided is bounded too.
"""

from __future__ import annotations

import base64
import json

#: Longest undecided part: members of a state start within one token's length of each other.
_START = -1


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}


class MergeTable:
    """Tokens by id, and the rank and result of merging two neighbours."""

    def __init__(self, tokens: dict[int, bytes], rank_of_pair):
        self.tokens, self.rank_of_pair = tokens, rank_of_pair
        self.of_bytes = {t: i for i, t in tokens.items()}
        self._apart: dict[int, bool] = {}
        self._made: dict[int, tuple[int, int, int, bool] | None] = {}

    @classmethod
    def from_ranks(cls, path: str) -> MergeTable:
        """A `.tiktoken` file: two neighbours merge if their bytes together are a token."""
        of_bytes = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    of_bytes[base64.b64decode(token)] = int(rank)
        tokens = {i: t for t, i in of_bytes.items()}

        def rank_of_pair(a: int, b: int) -> tuple[int, int] | None:
            i = of_bytes.get(tokens[a] + tokens[b])
            return None if i is None else (i, i)

        return cls(tokens, rank_of_pair)

    @classmethod
    def from_json(cls, path: str) -> tuple[MergeTable, list[str]]:
        """A `.json` tokenizer: only listed pairs merge. Also the strings of its added tokens."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols, model = byte_symbols(), spec["model"]
        added = {t["content"] for t in spec["added_tokens"]}
        tokens = {i: bytes(symbols[c] for c in t) for t, i in model["vocab"].items() if t not in added}
        pairs = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ids = model["vocab"][left], model["vocab"][right]
            pairs.setdefault(ids, (rank, model["vocab"][left + right]))
        return cls(tokens, lambda a, b: pairs.get((a, b))), sorted(added)

    def merge(self, data: bytes, stop_at: int = 1) -> list[int]:
        """Lowest rank first, leftmost first, down to `stop_at` tokens; for two tokens' worth of bytes only."""
        ids = [self.of_bytes[data[i : i + 1]] for i in range(len(data))]
        ranks = [self.rank_of_pair(a, b) for a, b in zip(ids, ids[1:])]
        while len(ids) > stop_at:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r[0] < best[0]):
                    best, at = r, i
            if best is None:
                return ids
            ids[at : at + 2] = [best[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = self.rank_of_pair(ids[at - 1], ids[at])
            if at < len(ranks):
                ranks[at] = self.rank_of_pair(ids[at], ids[at + 1])
        return ids

    def made_of(self, token: int) -> tuple[int, int, int, bool] | None:
        """How the merges make a token of its bytes: rank of the last merge, its two parts, and whether
        every merge below it has a lower rank than the one above. None if they do not make it."""
        known = self._made.get(token, ())
        if known == ():
            known = self._made[token] = self._last_merge(token)
        return known

    def _last_merge(self, token: int) -> tuple[int, int, int, bool] | None:
        data = self.tokens[token]
        if len(data) == 1:
            return -1, token, token, True
        ids = self.merge(data, stop_at=2)
        last = self.rank_of_pair(*ids) if len(ids) == 2 else None
        if last is None or last[1] != token:
            return None
        parts = [self.made_of(i) for i in ids]
        rising = all(m is not None and m[3] and m[0] < last[0] for m in parts)
        return last[0], ids[0], ids[1], rising

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether a followed by b is what the merges make of their bytes."""
        key = a << 20 | b
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > 500_000:
                self._apart.clear()
            left, right = self.made_of(a), self.made_of(b)
            if left is None or right is None:
                known = False
            elif left[3] and right[3]:
                known = self._never_joined(a, b)
            else:
                known = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
            self._apart[key] = known
        return known

    def _never_joined(self, a: int, b: int) -> bool:
        """Undoes the merges next to the border, latest first; no two neighbours that met there may merge before
        the merge that took one of them away. Of equal ranks the leftmost goes first. Ranks must rise in both tokens."""
        until = None
        while True:
            pair = self.rank_of_pair(a, b)
            if pair is not None and (until is None or (pair[0], 1) < until):
                return False
            left, right = self.made_of(a), self.made_of(b)
            if left[0] < 0 and right[0] < 0:
                return True
            if left[0] > right[0]:
                until, a = (left[0], 0), left[2]
            else:
                until, b = (right[0], 2), right[1]

    def whole(self, a: int) -> bool:
        """Whether the merges make this token of its own bytes."""
        return self.made_of(a) is not None


class Counts:
    """Outputs are numbers of tokens."""

    empty = 0

    @staticmethod
    def add(w: int, token: int) -> int:
        return w + 1

    @staticmethod
    def shared(ws: list[int]) -> int:
        return min(ws)

    @staticmethod
    def rest(w: int, shared: int) -> int:
        return w - shared


class Ids:
    """Outputs are token ids in order."""

    empty = ()

    @staticmethod
    def add(w: tuple, token: int) -> tuple:
        return (*w, token)

    @staticmethod
    def shared(ws: list[tuple]) -> tuple:
        a, b = min(ws), max(ws)
        n = 0
        while n < len(a) and n < len(b) and a[n] == b[n]:
            n += 1
        return a[:n]

    @staticmethod
    def rest(w: tuple, shared: tuple) -> tuple:
        return w[len(shared) :]


class MergeMachine:
    """The transducer. `max_states` bounds memory: beyond it the states made so far are forgotten."""

    def __init__(self, table: MergeTable, outputs, max_states: int = 400_000):
        self.table, self.outputs, self.max_states = table, outputs, max_states
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.inner: list[bool] = [False]
        for token, data in table.tokens.items():
            node = 0
            for b in data:
                key = node << 8 | b
                self.inner[node] = True
                node = self.child.get(key)
                if node is None:
                    node = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
            self.token_at[node] = token
        self.reset()

    def reset(self) -> None:
        """One state: nothing read. A member is (trie node, token before it, output not yet given)."""
        start = ((0, _START, self.outputs.empty),)
        self.states, self.state_of = [start], {start: 0}
        self.next: dict[int, int] = {}
        self.given: dict[int, object] = {}
        self.final: list = [self.outputs.empty]

    def _make(self, state: int, byte: int) -> int:
        """Add the transition. The last member of a state is the place after its last byte."""
        table, out = self.table, self.outputs
        kept, ending = [], None
        for node, before, w in self.states[state]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            token = self.token_at[to]
            if token >= 0 and ending is None:
                if table.whole(token) if before == _START else table.stay_apart(before, token):
                    ending = (token, out.add(w, token))
            if self.inner[to]:
                kept.append((to, before, w))
        if ending is None:
            raise ValueError("the merges leave a piece without an encoding")
        kept.append((0, *ending))
        shared = out.shared([w for _, _, w in kept])
        members = tuple((n, before, out.rest(w, shared)) for n, before, w in kept)
        to = self.state_of.get(members)
        if to is None:
            to = self.state_of[members] = len(self.states)
            self.states.append(members)
            self.final.append(members[-1][2])
        key = state << 8 | byte
        self.next[key] = to
        if shared:
            self.given[key] = shared
        return to

    def count(self, piece: bytes) -> int:
        """Tokens of one piece, for the `Counts` output."""
        if len(self.states) > self.max_states:
            self.reset()
        state = total = 0
        step, given = self.next, self.given
        for b in piece:
            key = state << 8 | b
            to = step.get(key)
            if to is None:
                to = self._make(state, b)
            if key in given:
                total += given[key]
            state = to
        return total + self.final[state]

    def ids(self, piece: bytes) -> list[int]:
        """Tokens of one piece, for the `Ids` output, each given as soon as no later byte can change it."""
        if len(self.states) > self.max_states:
            self.reset()
        state, found = 0, []
        step, given = self.next, self.given
        for b in piece:
            key = state << 8 | b
            to = step.get(key)
            if to is None:
                to = self._make(state, b)
            if key in given:
                found.extend(given[key])
            state = to
        found.extend(self.final[state])
        return found
