"""Splitting oversized texts at natural boundaries, by pointer doubling.

Borders of words are the boundaries; each has a level: end of paragraph, of line, of sentence, of clause, of word, and
inside long words between characters that no entry of the vocabulary joins. From a
boundary the legal end of a piece is the farthest one of the highest level for which the piece is at least half full and
within ``max_tokens``; the successor is the boundary from which the next piece starts, so far back that both share at
least ``overlap_tokens`` tokens (as few more as whole words allow). All successors of a batch of texts are found at once
by binary search over running sums; squaring the successor table then reaches every start from the starts of the texts in
a logarithmic number of steps.

Sizes are those of the piece encoded on its own. Where a word is so long that the next piece could not go on beyond the
last one, they share nothing. Words above ``max_tokens`` that cannot be cut otherwise become runs of characters, each a
piece. Defined results: texts within the limit, empty and NULL ones give no piece; repeated documents are cut alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gistmill.llm.tokens import FOLDER, WordCoder, coder, cut_batch, is_pieces

PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, INSIDE = 5, 4, 3, 2, 1, 0
#: Texts that are cut at once.
ROWS = 1_000
SCHEMA = "profile string, piece_no int, start_char int, end_char int, n_tokens int, piece string"


class Words:
    """The words of a batch of texts, and of each different word what the rules for boundaries look at."""

    #: Different words whose features a worker keeps.
    ROOM = 300_000
    known: dict[str, int] = {}

    def __init__(self, texts: pa.Array, name: str):
        self.borders, self.index, self.different = cut_batch(texts, name)
        self.features = np.fromiter(map(self.known.get, self.different, repeat(-1)), np.int64, len(self.different))
        for k in np.flatnonzero(self.features < 0).tolist():
            self.features[k] = self._feature(self.different[k])

    @classmethod
    def _feature(cls, word: str) -> int:
        """Length, level that the word ends, line feeds (of a blank word, up to 2), whether blank, whether it opens with a blank; packed."""
        code = cls.known.get(word)
        if code is None:
            blank = word.isspace()
            end = word.rstrip("\"')]»”’")
            stop = SENTENCE if end.endswith((".", "!", "?", "…", "。", "！", "？")) else CLAUSE if word.endswith((",", ";", ":", "|", "，", "；")) else WORD
            code = len(word) << 8 | stop << 4 | min(2, word.count("\n") if blank else 0) << 2 | blank << 1 | word[:1].isspace()
            if len(cls.known) < cls.ROOM:
                cls.known[word] = code
        return code

    def only(self, rows: np.ndarray) -> Words:
        """The words of some of the texts."""
        n = self.borders[rows + 1] - self.borders[rows]
        new = object.__new__(Words)
        new.borders = np.concatenate([[0], np.cumsum(n)])
        new.index = self.index[np.arange(new.borders[-1]) + np.repeat(self.borders[rows] - new.borders[:-1], n)]
        new.different, new.features = self.different, self.features
        return new

    def replaced(self, different: list[str], index: np.ndarray, borders: np.ndarray) -> Words:
        """The same texts cut further; ``different`` begins with what there was."""
        new = object.__new__(Words)
        new.borders, new.index, new.different = borders, index, different
        new.features = np.concatenate([self.features, np.fromiter(map(self._feature, different[len(self.different) :]), np.int64, len(different) - len(self.different))])
        return new


def _levels(features: np.ndarray, pieces: bool) -> np.ndarray:
    """The level of the boundary in front of each word; where a text starts it doesn't matter. ``pieces``: blanks before a digit are words."""
    feeds, blank, opens, stops = (features >> 2 & 3).astype(np.int8), (features & 2) > 0, (features & 1) > 0, (features >> 4 & 15).astype(np.int8)
    levels = np.full(len(features), WORD, np.int8)
    before, two = feeds[:-1], np.concatenate([[0], feeds[:-2]]).astype(np.int8) if len(feeds) > 1 else feeds[:0]
    levels[1:] = np.where(before > 0, np.where(before + two > 1, PARAGRAPH, LINE), np.where(opens[1:], stops[:-1], INSIDE))
    levels[1:][(blank & (feeds > 0) if pieces else blank)[1:]] = -1  # blanks stay with what stands in front of them
    return levels


def _tails(words_at: Words, at: np.ndarray, encode: WordCoder) -> np.ndarray:
    """For each border how the size of a piece that ends there differs from the sum: blanks at an end are one word."""
    index = words_at.index[at]
    tail = np.zeros(len(index) + 1, np.int64)
    blank = (words_at.features[index] & 2) > 0
    both = np.flatnonzero(blank[:-1] & blank[1:])
    if len(both) and not is_pieces(encode.name):
        different = words_at.different
        pairs, which = np.unique(index[both] * len(different) + index[both + 1], return_inverse=True)
        off = [encode.size(different[p // len(different)] + different[p % len(different)]) - encode.size(different[p // len(different)]) - encode.size(different[p % len(different)]) for p in pairs.tolist()]
        tail[both + 2] = np.array(off, np.int64)[which]
    return tail


def _pieces_of(sizes: np.ndarray, extra: np.ndarray, levels: np.ndarray, ends: np.ndarray, limit: int, overlap: int, starts: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end word) of every piece of the texts that start at ``starts``; ``ends``: each word's end of text.

    ``extra``: what a word costs more as the first one of a piece. Pieces start where a text does or, going back by the overlap, from a
    boundary; so successors are found for these places only, at first from natural boundaries, then from others that they lead to, and
    for texts where that goes on (they have few natural boundaries) from everywhere.
    """
    n = len(sizes)
    run = np.concatenate([[0], np.cumsum(sizes)])
    fill = max(limit // 2, overlap + 1)
    marks = np.concatenate([levels, [PARAGRAPH]])
    borders: dict[int, np.ndarray] = {}
    places = np.arange(n + 1)
    # which word holds a token; a table instead of a binary search
    word_at = np.append(np.repeat(places[:-1], sizes), n)

    def farthest(at: np.ndarray) -> np.ndarray:
        """The last border within the limit."""
        return np.maximum(np.minimum(word_at[np.minimum(run[at] - extra[at] + limit, run[-1])], ends[at]), at + 1)

    def before(border: np.ndarray) -> np.ndarray:
        """So far back from a border that at least ``overlap`` tokens are shared."""
        if not overlap:
            return border
        token = run[border] + tail[border] - overlap
        return np.where(token < 0, -1, word_at[np.clip(token, 0, run[-1])])

    def successors(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end of the piece, start of the next one or ``n``) for each start."""
        chosen = farthest(at)
        last, whole = chosen.copy(), chosen >= ends[at]
        rest = np.flatnonzero(~whole)
        for level in (PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, INSIDE):
            if not len(rest):
                break
            if level not in borders:  # the last boundary of the level up to each place
                borders[level] = np.maximum.accumulate(np.where(marks >= level, places, 0))
            border = borders[level][last[rest]]
            good = (border > at[rest]) & (border <= last[rest]) & (run[border] - run[at[rest]] >= fill)
            chosen[rest[good]] = border[good]
            rest = rest[~good]
        back = before(chosen)
        # ... and goes on beyond the last piece
        inner = np.minimum(back, n - 1)
        back = np.where((back > at) & (farthest(inner) > chosen) & (run[chosen] - run[back] < fill), back, chosen)
        return chosen, np.where(whole, n, back)

    natural = before(np.flatnonzero(levels >= CLAUSE))
    nodes, fresh = np.zeros(0, np.int64), np.union1d(starts, natural[natural >= 0])
    chosen = following = nodes
    for turn in range(4):
        c, f = successors(fresh)
        nodes, chosen, following = np.concatenate([nodes, fresh]), np.concatenate([chosen, c]), np.concatenate([following, f])
        seen = np.zeros(n, bool)
        seen[nodes] = True
        fresh = f[f < n]
        fresh = np.unique(fresh[~seen[fresh]])
        if not len(fresh):
            break
        if turn == 2:
            going_on = np.zeros(n + 1, bool)
            going_on[ends[fresh]] = True
            fresh = np.flatnonzero(going_on[ends] & ~seen)
    order = np.argsort(nodes)
    nodes, chosen, following = nodes[order], chosen[order], following[order]
    m = len(nodes)
    table = np.append(np.searchsorted(nodes, following), m)
    table[:-1][following >= n] = m
    reached = np.zeros(m + 1, bool)
    reached[np.searchsorted(nodes, starts)] = True
    while True:  # after k rounds all starts within 2^k pieces are known
        known = np.flatnonzero(reached[:m])
        step = table[known]
        if reached[step[step < m]].all() and (table == m).all():
            break
        reached[step] = True
        table = table[table]
    first = np.flatnonzero(reached[:m])
    return nodes[first], chosen[first]


def _short_words(given: Words, sizes: np.ndarray, limit: int, encode: WordCoder) -> tuple[Words, np.ndarray, np.ndarray]:
    """Long words as their parts: (words, whether a place continues a word, whether a different word must stand alone)."""
    parts: dict[int, list[int]] = {}
    different, alone = list(given.different), []
    for k in np.flatnonzero(sizes > limit // 4).tolist():
        made = []
        for atom in encode.atoms(different[k]):
            if encode.size(atom) + 2 <= limit or max(encode.size(atom), encode.size(atom, True)) <= limit:
                made.append(len(different))
                different.append(atom)
                continue
            while atom:
                take = min(len(atom), limit)
                while take > 1 and encode.size(atom[:take], True) > limit:
                    take = (take + 1) // 2
                made.append(len(different))
                alone.append(len(different))
                different.append(atom[:take])
                atom = atom[take:]
        if len(made) > 1:
            parts[k] = made
    single = np.zeros(len(different), bool)
    single[alone] = True
    index, borders = given.index, given.borders
    if not parts:
        return given.replaced(different, index, borders), np.zeros(len(index), bool), single
    count = np.ones(len(different), np.int64)
    for k, made in parts.items():
        count[k] = len(made)
    moved = np.concatenate([[0], np.cumsum(count[index])])
    out = np.repeat(index, count[index])
    inside = np.ones(len(out), bool)
    inside[moved[:-1]] = False
    for at in np.flatnonzero(count[index] > 1):
        out[moved[at] : moved[at + 1]] = parts[int(index[at])]
    return given.replaced(different, out, moved[borders]), inside, single


def split_batch(given: Words, keep: pa.Array, encode: WordCoder, limit: int, overlap: int) -> tuple[np.ndarray, ...]:
    """(row, piece_no, start_char, end_char, n_tokens, text) of the pieces of all texts of a batch that are above ``limit``."""
    nothing = (*(np.empty(0, np.int64) for _ in range(5)), [])
    if not is_pieces(encode.name):
        # a byte-level text has as many tokens as bytes at most (a normaliser of other models may lengthen texts)
        long_ones = np.flatnonzero(pc.fill_null(pc.binary_length(keep), 0).to_numpy(zero_copy_only=False) > limit)
        if len(long_ones) < len(keep):
            if not len(long_ones):
                return nothing
            row, *rest = _split_some(given.only(long_ones), keep.take(pa.array(long_ones)), encode, limit, overlap, nothing)
            return long_ones[row], *rest
    return _split_some(given, keep, encode, limit, overlap, nothing)


def _split_some(given: Words, keep: pa.Array, encode: WordCoder, limit: int, overlap: int, nothing: tuple) -> tuple[np.ndarray, ...]:
    if not len(given.index):
        return nothing
    sizes_of = encode.sizes_of(given.different)
    run = np.concatenate([[0], np.cumsum(sizes_of[given.index])])
    filled_rows = np.flatnonzero(given.borders[1:] > given.borders[:-1])
    total = run[given.borders[1:]] - run[given.borders[:-1]]
    near = filled_rows[total[filled_rows] + 4 > limit]  # what a text costs more for its first word is looked at where it matters
    starts = given.index[given.borders[:-1][near]].tolist()
    total[near] += np.fromiter((encode.size(given.different[k], True) for k in starts), np.int64, len(starts)) - sizes_of[starts]
    rows = near[total[near] > limit]
    if not len(rows):
        return nothing
    w, inside, single = _short_words(given, sizes_of, limit, encode)
    if len(w.different) > len(sizes_of):
        sizes_of = np.concatenate([sizes_of, encode.sizes_of(w.different[len(sizes_of) :])])

    # only the words of oversized texts go on
    n_words = w.borders[rows + 1] - w.borders[rows]
    row_ends = np.cumsum(n_words)
    row_starts = row_ends - n_words
    at = np.arange(row_ends[-1]) + np.repeat(w.borders[rows] - row_starts, n_words)
    index, features = w.index[at], w.features[w.index[at]]
    sizes, alone = sizes_of[index], single[index]
    levels = _levels(features, is_pieces(encode.name))
    levels[inside[at] & (levels >= 0)] = INSIDE
    tail = _tails(w, at, encode)
    tail[row_ends] = 0
    levels[tail[:-1] > 0] = -1

    def first_costs(of: np.ndarray) -> np.ndarray:
        different, which = np.unique(of, return_inverse=True)
        return (np.fromiter((encode.size(w.different[k], True) for k in different), np.int64, len(different)) - sizes_of[different])[which]

    # as a rule the first word of a piece costs one token more at most; where it costs more, all first words are looked at
    extra = np.ones(len(index), np.int64) if is_pieces(encode.name) else np.zeros(len(index), np.int64)
    for _ in range(2):
        first, end = _pieces_of(np.where(alone, limit, sizes), np.where(alone, 0, extra), levels, np.repeat(row_ends, n_words), limit, overlap, row_starts, tail)
        cost = first_costs(index[first]) if is_pieces(encode.name) else extra[first]
        if (cost <= extra[first]).all():
            break
        extra = first_costs(index)
    row = np.searchsorted(row_ends, first, side="right")
    piece_no = np.arange(len(first)) - np.searchsorted(first, row_starts)[row] + 1
    run = np.concatenate([[0], np.cumsum(sizes)])
    chars = np.concatenate([[0], np.cumsum(features >> 8)])
    origin = chars[row_starts][row]
    start_char, end_char = chars[first] - origin, chars[end] - origin
    n_tokens = run[end] - run[first] + cost + tail[end]
    texts = keep.take(pa.array(rows)).to_pylist()
    pieces = [texts[r][s:e] for r, s, e in zip(row.tolist(), start_char.tolist(), end_char.tolist())]
    return rows[row], piece_no, start_char, end_char, n_tokens, pieces


def split_texts(documents: DataFrame, profiles: list[tuple[str, str, int, int]], folder: str = FOLDER, key: str = "doc_id") -> DataFrame:
    """``key`` and :data:`SCHEMA` of the pieces of each text above a profile's limit.

    ``profiles``: (profile, tokenizer, max_tokens, overlap_tokens). One scan without a shuffle; a text is one row.
    """
    kinds = {is_pieces(p[1]): p[1] for p in profiles}
    rows = documents.select(key, "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column("text")
                cut_words = {k: Words(texts, n) for k, n in kinds.items()}
                for profile, tokenizer, limit, overlap in profiles:
                    row, no, start, end, n, pieces = split_batch(cut_words[is_pieces(tokenizer)], texts, coder(tokenizer, folder), limit, overlap)
                    if len(pieces):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(key).take(pa.array(row)), pa.array([profile] * len(pieces)), *[pa.array(x, pa.int32()) for x in (no, start, end, n)], pa.array(pieces, pa.string())],
                            [key, "profile", "piece_no", "start_char", "end_char", "n_tokens", "piece"],
                        )

    return rows.mapInArrow(split, f"{key} {documents.schema[key].dataType.simpleString()}, {SCHEMA}")
