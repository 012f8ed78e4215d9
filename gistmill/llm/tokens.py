"""Public tokenizers over columns of texts: the words of a batch are cut at once, each different word is encoded once per worker.

A tokenizer's file is read from ``folder``, a parameter of every operator. NULL counts as the empty text, which has no
tokens. Strings that look like control tokens are ordinary text.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa

from gistmill.llm.bpe_automaton import BpeAutomaton

FOLDER = "/opt/tokenizers"
# Fixed value: the pre-tokenizer pattern of the byte-level vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: No piece of a piece vocabulary continues over the start of a run of blanks, over a line feed, or over a digit.
PIECES = r"[0-9]| *[^ \n0-9]+| +|\n"


def is_pieces(name: str) -> bool:
    return name.startswith("piece_")


class Cutter:
    """Cuts all texts of a batch into words at once: classes of characters from a table, borders from neighbouring classes.

    The result is that of the patterns above, which look at nothing but classes, single blanks, and the apostrophe's short forms.
    """

    LETTER, NUMBER, BLANK, OTHER, UNKNOWN = 0, 1, 2, 3, 255

    def __init__(self) -> None:
        self.classes = np.full(0x110000, self.UNKNOWN, np.uint8)

    def _classes_of(self, codes: np.ndarray) -> np.ndarray:
        """Classes of characters; each different character is looked up once."""
        found = self.classes[codes]
        if (found == self.UNKNOWN).any():
            import regex

            for code in np.unique(codes[found == self.UNKNOWN]).tolist():
                c = chr(code)
                self.classes[code] = self.LETTER if regex.match(r"\p{L}", c) else self.NUMBER if regex.match(r"\p{N}", c) else self.BLANK if regex.match(r"\s", c) else self.OTHER
            found = self.classes[codes]
        return found

    def byte_level(self, raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Byte positions at which a word starts; ``raw``: UTF-8 of all texts, ``texts``: where each begins, and the end."""
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind, n = self._classes_of(codes), len(codes)
        text_start = np.zeros(n + 1, bool)
        text_start[np.searchsorted(at, texts)] = True
        blank, space = kind == self.BLANK, codes == 0x20
        start = text_start.copy()
        changed = kind[1:] != kind[:-1]
        # a single space in front of a word belongs to it
        start[1:-1] |= changed & ~space[:-1]
        start[1:-1] |= blank[1:] & ~blank[:-1]
        # of several blanks the last one goes with what follows, unless the text ends
        start[1:-1] |= blank[1:] & blank[:-1] & np.append(~blank[2:], False) & ~text_start[2:]
        quote = np.flatnonzero(codes == 0x27)
        if len(quote):
            before = np.maximum(quote - 1, 0)
            free = text_start[quote] | (kind[before] < self.BLANK) | (blank[before] & ~space[before])
            c = np.concatenate([codes, np.zeros(2, np.uint32)])
            one, two = c[quote + 1], c[quote + 2]
            single, double = np.isin(one, [ord(x) for x in "stmd"]), np.zeros(len(quote), bool)
            for x, y in ("re", "ve", "ll"):
                double |= (one == ord(x)) & (two == ord(y))
            # a short form does not go over the end of its text
            single &= ~text_start[np.minimum(quote + 1, n)]
            double &= ~text_start[np.minimum(quote + 1, n)] & ~text_start[np.minimum(quote + 2, n)]
            short = free & (single | double)
            ends = quote[short] + np.where(single[short], 2, 3)
            start[quote[short] + 1] = False
            start[ends] = True
        return at[start[:-1]]

    @staticmethod
    def pieces(raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """As :meth:`byte_level`, for piece vocabularies, whose words depend on blanks, line feeds and digits only."""
        digit, feed, space = (raw >= 0x30) & (raw <= 0x39), raw == 0x0A, raw == 0x20
        start = np.zeros(len(raw) + 1, bool)
        start[texts] = True
        start[:-1] |= digit | feed
        start[1:-1] |= digit[:-1] | feed[:-1] | space[1:] & ~space[:-1]
        return np.flatnonzero(start[:-1])


_CUTTER = Cutter()


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts, where each begins and the end); NULL is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    rows = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets is not None and len(texts) else np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[rows[0] : rows[-1]], rows - rows[0]


def _strings(starts: np.ndarray, raw: np.ndarray) -> pa.DictionaryArray:
    """The stretches of ``raw`` between neighbouring places, as a dictionary."""
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte behind, text, 64-bit hash) of every run of letters and digits in a column of texts."""
    import xxhash

    raw, rows = _flat(texts)
    if not len(raw):
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint64))
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    kind = _CUTTER._classes_of(np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)) < Cutter.BLANK
    opens = np.zeros(len(at) + 1, bool)
    opens[np.searchsorted(at, rows)] = True
    at = np.append(at, len(raw))
    opens[1:-1] |= kind[1:] != kind[:-1]
    places = np.flatnonzero(opens)
    flat = _strings(at[places], raw)
    wanted = kind[places[:-1]]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    starts, ends = at[places[:-1]][wanted], at[places[1:]][wanted]
    return starts, ends, np.searchsorted(rows, starts, side="right") - 1, hashes[flat.indices.to_numpy(zero_copy_only=False)[wanted]]


def cut_batch(texts: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row borders, index of each word, the different words) of a column of texts for the tokenizer ``name``.

    Joined, the words of a row are its text. NULL has no words.
    """
    raw, rows = _flat(texts)
    if not len(raw):
        return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int64), []
    starts = _CUTTER.pieces(raw, rows) if is_pieces(name) else _CUTTER.byte_level(raw, rows)
    flat = _strings(np.append(starts, len(raw)), raw)
    return np.searchsorted(starts, rows), flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()


class WordCoder:
    """Encodes words of one tokenizer and keeps what it has encoded, up to ``room`` different words of each kind."""

    def __init__(self, name: str, folder: str, with_automaton: bool = False, room: int = 300_000):
        self.name, self.room = name, room
        self.automaton: BpeAutomaton | None = None
        self.ids: dict[str, np.ndarray] = {}
        self.sizes: dict[str, int] = {}
        self.first_sizes: dict[str, int] = {}
        if is_pieces(name):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}.model")
            front = len(model.encode("\n"))
            # a line feed in front takes the blank that is put before a text; it joins nothing
            self.encode = lambda word: model.encode("\n" + word)[front:]
            self.encode_first = model.encode
            shown = (model.id_to_piece(k) for k in range(model.get_piece_size()))
            #: neighbours inside entries; merges never cross a place between two others
            self.joined = {a + b for p in shown for a, b in zip(p, p[1:])}
        else:
            import tiktoken

            with open(f"{folder}/{name}.tiktoken", "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.encode = self.encode_first = tiktoken.Encoding(name, pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            if with_automaton:
                merges = Path(f"{folder}/{name}.json")
                self.automaton = BpeAutomaton.from_json(str(merges)) if merges.exists() else BpeAutomaton.from_ranks(f"{folder}/{name}.tiktoken")

    def atoms(self, word: str) -> list[str]:
        """A word cut wherever that changes no token: between characters that no entry of the vocabulary joins."""
        if not is_pieces(self.name):
            return [word]
        shown = word.replace(" ", "▁")
        places = [0, *[k for k in range(1, len(word)) if shown[k - 1 : k + 1] not in self.joined], len(word)]
        return [word[a:b] for a, b in zip(places, places[1:])]

    def __call__(self, word: str) -> np.ndarray:
        ids = self.ids.get(word)
        if ids is None:
            ids = np.array(self.automaton.encode(word.encode()) if self.automaton else self.encode(word), np.int32)
            if len(self.ids) < self.room and len(word) <= 64:
                self.ids[word] = ids
        return ids

    def size(self, word: str, first: bool = False) -> int:
        """Tokens of a word; ``first``: at the start of a text, where some tokenizers put a blank."""
        known = self.first_sizes if first else self.sizes
        n = known.get(word)
        if n is None:
            n = len((self.encode_first if first else self.encode)(word))
            if len(known) < self.room and len(word) <= 64:
                known[word] = n
        return n

    def sizes_of(self, words: list[str]) -> np.ndarray:
        """Tokens of many words; known ones are looked up without a call each."""
        found = np.fromiter(map(self.sizes.get, words, repeat(-1)), np.int64, len(words))
        for k in np.flatnonzero(found < 0).tolist():
            found[k] = self.size(words[k])
        return found


@lru_cache(maxsize=4)
def coder(name: str, folder: str = FOLDER, with_automaton: bool = False) -> WordCoder:
    """One per Python worker; workers live as long as their executor. The ids come from the automaton, sizes need none."""
    return WordCoder(name, folder, with_automaton)


def encode_batch(texts: pa.Array, encode: WordCoder) -> pa.ListArray:
    """Token ids of each text."""
    borders, index, different = cut_batch(texts, encode.name)
    coded = [encode(w) for w in different]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    table = np.concatenate(coded) if coded else np.empty(0, np.int32)
    n = sizes[index] if len(index) else np.empty(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    # each word's ids stand together in the table; positions run from its start
    at = np.repeat(starts[:-1][index] - ends[:-1], n) + np.arange(ends[-1]) if len(index) else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends[borders], pa.int32()), pa.array(table[at], pa.int32()))


def text_sizes(cut: tuple[np.ndarray, np.ndarray, list[str]], encode: WordCoder) -> pa.Array:
    """Tokens of each whole text of a batch that :func:`cut_batch` has cut."""
    borders, index, different = cut
    if not len(index):
        return pa.array(np.zeros(len(borders) - 1, np.int64))
    sizes = encode.sizes_of(different)[index]
    sums = np.concatenate([[0], np.cumsum(sizes)])
    totals = sums[borders[1:]] - sums[borders[:-1]]
    if is_pieces(encode.name):
        rows = np.flatnonzero(borders[1:] > borders[:-1])
        first = index[borders[:-1][rows]]
        totals[rows] += np.fromiter((encode.size(different[k], True) - encode.size(different[k]) for k in first), np.int64, len(first))
    return pa.array(totals)
