"""A byte-pair encoder as a deterministic automaton.

A token sequence is the right encoding exactly if each two neighbours may stand side by side, so the automaton's states
are the tokens and an arc ``a -> b``, labelled ``b``, exists unless some merge would have joined bytes across the border
of ``a`` and ``b``. Merges are taken in order; each one adds its gadget: the new token, its two halves, and the arcs that it
takes away. The dense table has (vocabulary size)^2 entries, therefore arcs are worked out from the gadgets when first
asked for and kept. Of all vocabulary entries that end at a byte of a word exactly one has a legal arc from the state
reached at its start; following these and reading the labels backwards gives the encoding in time linear in the word. Decoding emits the
labels of a path's arcs one after the other.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache


def printable_bytes() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class BpeAutomaton:
    """Encodes words (not whole texts) with the merges of one vocabulary."""

    #: Arcs that the table holds at most.
    ROOM = 2_000_000

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = vocabulary
        self.labels = {k: token for token, k in vocabulary.items()}
        self.longest = max(map(len, vocabulary), default=1)
        #: token -> when it comes into being; bytes are there from the start
        self.born = {token: -1 for token in vocabulary if len(token) == 1}
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        self.merged: dict[tuple[bytes, bytes], int] = {}
        for rank, (left, right) in enumerate(merges):
            whole = left + right
            self.merged.setdefault((left, right), rank)
            if whole not in self.born:
                self.born[whole] = rank
                self.halves[whole] = (left, right)
        self.arcs: dict[tuple[bytes, bytes], bool] = {}

    @classmethod
    def from_json(cls, path: str) -> BpeAutomaton:
        """From the ``model`` part of a tokenizer file with ``vocab`` and ``merges``, byte level."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        table = printable_bytes()

        @lru_cache(maxsize=None)
        def raw(shown: str) -> bytes:
            return bytes(table[c] for c in shown)

        vocabulary = {raw(k): v for k, v in model["vocab"].items() if all(c in table for c in k)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        return cls(vocabulary, [(raw(a), raw(b)) for a, b in pairs])

    @classmethod
    def from_ranks(cls, path: str) -> BpeAutomaton:
        """From lines of a token in base 64 and its rank; a token's halves are what the merges before it leave of its bytes."""
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                continue
            parts = [token[k : k + 1] for k in range(len(token))]
            while len(parts) > 2:
                first, k = min((ranks.get(a + b, rank), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                if first >= rank:
                    raise ValueError(f"{path}: no merge gives the token {token!r}")
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            merges.append((parts[0], parts[1]))
        return cls(ranks, merges)

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int, float]]:
        """What stands at the left (0) or right (1) end while ``token`` is built: (part, from, until), last part first."""
        parts, until = [], float("inf")
        while True:
            born = self.born[token]
            parts.append((token, born, until))
            if token not in self.halves:
                return parts
            until, token = born, self.halves[token][side]

    def legal(self, a: bytes, b: bytes) -> bool:
        """Whether ``b`` may follow ``a``: no pair of parts that meet at the border merges while both are there.

        Of equal merges the leftmost goes first, so one inside ``a`` wins over the border and the border over one inside ``b``.
        """
        known = self.arcs.get((a, b))
        if known is None:
            known = True
            rights = self._edge(b, 0)
            for left, left_from, left_until in self._edge(a, 1):
                for right, right_from, right_until in rights:
                    if (rank := self.merged.get((left, right))) is not None and max(left_from, right_from) < rank < left_until and rank <= right_until:
                        known = False
            self._keep((a, b), known)
        return known

    def _keep(self, arc: tuple[bytes, bytes], known: bool) -> None:
        """Puts an arc into the table; a full table starts anew, as workers live as long as their executor."""
        if len(self.arcs) >= self.ROOM:
            self.arcs.clear()
        self.arcs[arc] = known

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one word, by one pass over its bytes."""
        n, ids, born = len(word), self.ids, self.born
        if not n:
            return []
        last: list[bytes | None] = [None] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                token = word[start:end]
                if token in born and (start == 0 or (last[start] is not None and self.legal(last[start], token))) and (len(token) == 1 or self.whole(token)):
                    last[end] = token
                    break
        labels, end = [], n
        while end:
            labels.append(ids[last[end]])
            end -= len(last[end])
        return labels[::-1]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of token ids; an id that the vocabulary doesn't have is an error."""
        try:
            return b"".join(map(self.labels.__getitem__, ids))
        except KeyError as e:
            raise ValueError(f"no token has the id {e.args[0]}") from None

    def whole(self, token: bytes) -> bool:
        """Whether the merges, applied to the token's own bytes, give just this token."""
        key = (token, b"")
        if (known := self.arcs.get(key)) is None:
            left, right = self.halves[token]
            rank = self.born[token]
            met = [(x, y) for x, xf, xu in self._edge(left, 1) for y, yf, yu in self._edge(right, 0) if (r := self.merged.get((x, y))) is not None and max(xf, yf) < r < min(xu, yu, rank)]
            known = not met and all(len(x) == 1 or self.whole(x) for x in (left, right))
            self._keep(key, known)
        return known
