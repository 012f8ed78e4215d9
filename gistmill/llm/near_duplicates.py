"""Near-duplicate documents: all pairs of word n-gram sets whose Jaccard similarity reaches a threshold, by a prefix tree.

Sets travel packed, thousands in a row, with their different n-grams once; n-grams never are rows of their own. Sets that are equal
form a class; one set per class goes on. n-grams get one global order, by steps of frequency (a quarter of an octave each, counted over all
documents) and then by value; n-grams of one set only count for its size but for nothing else, as they meet nothing. The top of the tree is spread over the cluster: two similar
sets share one of their rarest n-grams, so sets meet there, if their sizes and what remains behind that n-gram still allow the
threshold. Of those that meet, odd sketches (:data:`SKETCH` cells, each the parity of the n-grams in it) drop pairs whose sketches differ in more
cells than similar sets can differ in n-grams; this drops no similar pair. This tells which sets belong into one tree; only numbers travel. Then each task stores the sets that have met, each
once, in a tree from frequent to rare n-grams, so that revisions and standard passages share long beginnings, and walks it with
all probes, one after the other: sets with equal beginnings share the partial overlap, and a subtree is left as soon as its
overlap and what remains on both sides cannot reach the threshold.

n-grams are 64-bit hashes of their words. Defined results: documents without an n-gram (NULL, empty or short texts, no
blocks) are in no pair; the pairs of a repeated ``doc_no`` are those of any of its rows and may repeat; an empty table gives no pair; other
columns are ignored. There is no cap on partners: trees with more than :data:`BLOCK` sets or probes are split into a grid, whose
cells are tasks' work of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby, takewhile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.tokens import words_of
from gistmill.sources.tables import drop_staged, staged

#: Sets in one tree, and probes that walk it in one task. More go into further trees, and to further copies of a tree.
BLOCK = 2_000
#: So few stored sets are compared one by one.
FEW = 8
#: Sets (below 65,536) and n-grams in one packed row, unless one set has more; n-grams that one task counts; meetings looked at together; cells of a sketch.
BLOCK_SETS, BLOCK_GRAMS, PART_GRAMS, PAIRS, SKETCH = 10_000, 2_000_000, 4_000_000, 2_000_000, 512


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit values well spread over all bits (a fixed public finalizer of hashes)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def batch_grams(texts: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(list, hash) of the runs of ``n`` words inside each text of each list of lower-case texts; sorted by lists, with repetitions."""
    borders = np.concatenate([[0], np.cumsum(texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    # standard passages and copies are cut once
    coded = texts.flatten().fill_null("").dictionary_encode()
    _, _, of_text, words = words_of(coded.dictionary)
    if len(words) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        run = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            run = _mixed(run + words[k : len(words) - n + 1 + k] + np.uint64(k + 1))
    inside = of_text[: len(run)] == of_text[n - 1 :]
    of_text, run = of_text[: len(run)][inside], run[inside].view(np.int64)
    runs = np.bincount(of_text, minlength=len(coded.dictionary))
    text = coded.indices.to_numpy(zero_copy_only=False)
    row, many = np.repeat(np.arange(len(borders) - 1), np.diff(borders)), runs[text]
    at = np.arange(many.sum()) + np.repeat(_borders(runs)[text] - _borders(many)[:-1], many)
    return np.repeat(row, many), run[at]


def document_blocks(doctexts: DataFrame, n: int = 3) -> DataFrame:
    """The sets of n-grams of documents with ``title`` and ``blocks``, packed (:func:`_blocks`); n-grams stay inside the title or one block."""
    texts = F.concat(F.array("title"), F.coalesce(F.transform("blocks", lambda b: b["text"]), F.array().cast("array<string>")))
    rows = doctexts.select(F.col("doc_no").cast("long").alias("key"), F.transform(texts, lambda t: F.lower(t)).alias("texts"))
    return _blocks(rows, lambda batch: batch_grams(batch.column("texts"), n))


def _need(threshold: float, x: Column, y: Column) -> Column:
    """The least overlap of sets with ``x`` and ``y`` members that reaches the threshold (guarded against rounding)."""
    return F.ceil((x + y) * (threshold / (1 + threshold)) - 1e-9)


class _Node:
    """A run of n-grams that a range of the sorted sets share, the sets that end with it, and what bounds the rest below it."""

    __slots__ = ("below", "ends", "least", "longest", "run", "those")

    def __init__(self, run: list[int], longest: int, least: int):
        self.run, self.those, self.longest, self.least = run, frozenset(run), longest, least
        self.ends: list[tuple[int, int]] = []
        self.below: list[_Node] = []


def _tree(sets: list[tuple[list[int], int, int]]) -> _Node:
    """The prefix tree of (path, key, size) rows."""
    sets.sort(key=lambda s: s[0])
    top = _Node([], 0, 0)
    todo = [(top, 0, len(sets), 0)]
    while todo:
        above, low, high, depth = todo.pop()
        first, last = sets[low][0], sets[high - 1][0]
        # between sorted neighbours all share what the outer ones share
        end = depth + sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(first[depth:], last[depth:])))
        node = _Node(first[depth:end], max(len(s[0]) for s in sets[low:high]) - end, min(s[2] for s in sets[low:high]))
        above.below.append(node)
        while low < high and len(sets[low][0]) == end:
            node.ends.append(sets[low][1:])
            low += 1
        for _, group in groupby(range(low, high), lambda k: sets[k][0][end]):
            of = list(group)
            todo.append((node, of[0], of[-1] + 1, end))
    return top


def _walk(tree: _Node, path: list[int], size: int, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(set, its size, overlap) of all sets in the tree that are similar to a probe."""
    place = {gram: k for k, gram in enumerate(path)}
    members, ratio = place.keys(), threshold / (1 + threshold)
    todo = [(node, 0, 0) for node in tree.below]  # node, overlap above it, members of the probe that are behind
    while todo:
        node, overlap, passed = todo.pop()
        if hits := len(node.those & members):
            overlap += hits
            passed = next(place[gram] for gram in reversed(node.run) if gram in place) + 1
        if overlap + min(len(path) - passed, node.longest) < (size + node.least) * ratio - 1e-9:
            continue
        for key, n in node.ends:
            if overlap >= (size + n) * ratio - 1e-9:
                yield key, n, overlap
        todo.extend((below, overlap, passed) for below in node.below)


def _beside(sets: list[tuple[tuple[int, int], int, set[int]]], path: list[int], size: int, threshold: float) -> Iterator[tuple[tuple[int, int], int, int]]:
    """As :func:`_walk`, for so few sets that a tree isn't worth it."""
    ratio = threshold / (1 + threshold)
    for key, n, those in sets:
        least = (size + n) * ratio - 1e-9
        if min(len(path), len(those)) >= least and (both := len(those.intersection(path))) >= least:
            yield key, n, both


def _planes(values: np.ndarray) -> bytes:
    """The bytes of 32-bit values, all lowest ones first; small values compress well so."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _packed_refs(refs: np.ndarray, starts: np.ndarray) -> bytes:
    """Rising numbers inside each list that begins at ``starts``, as differences."""
    steps = np.diff(refs, prepend=0)
    steps[starts] = refs[starts]
    return _planes(steps)


def _refs(raw: bytes, borders: np.ndarray) -> np.ndarray:
    steps = np.cumsum(_unplaned(raw))
    return steps - np.repeat(np.append(0, steps)[borders[:-1]], np.diff(borders))


def _borders(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes, dtype=np.int64))


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_borders(np.array([len(a) for a in arrays], np.int64)), pa.int32()), pa.array(np.concatenate(arrays), kind))


def _blocks(rows: DataFrame, grams_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows of many sets each: their keys, sizes and marks, the different n-grams and how many sets hold each, and each set's n-grams by number.

    ``rows`` have a ``key``; ``grams_of`` tells of a batch (row, n-gram) of all n-grams, sorted by rows. Sets without an n-gram are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            keys, (row, grams) = batch.column("key").to_numpy(zero_copy_only=False), grams_of(batch)
            ends, low = np.cumsum(np.bincount(row, minlength=len(keys))), 0
            while low < len(keys):
                done = ends[low - 1] if low else 0
                high = max(low + 1, min(low + BLOCK_SETS, int(np.searchsorted(ends, done + BLOCK_GRAMS, side="right"))))
                different, which = np.unique(grams[done : ends[high - 1]], return_inverse=True)
                if len(different):
                    held = np.sort((row[done : ends[high - 1]] - low) * len(different) + which)
                    of, refs = np.divmod(held[np.append(True, held[1:] != held[:-1])], len(different))
                    sizes = np.bincount(of, minlength=high - low)
                    rows = np.flatnonzero(sizes)
                    sizes = sizes[rows]
                    first = _borders(sizes)[:-1]
                    with np.errstate(over="ignore"):
                        spread = _mixed(different.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
                        marks = np.add.reduceat(spread[refs], first).view(np.int64), np.bitwise_xor.reduceat(_mixed(spread)[refs], first).view(np.int64)
                    columns = [pa.array([task + number]), *(_lists([x], pa.int64()) for x in (keys[low:high][rows], sizes, *marks))]
                    columns += [pa.array([x]) for x in (different.tobytes(), _planes(np.bincount(refs)), _packed_refs(refs, first))]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "keys", "sizes", "marks", "sums", "grams", "counts", "refs"])
                    number += 1
                low = high

    return rows.where("key is not null").mapInArrow(work, "block long, keys array<long>, sizes array<long>, marks array<long>, sums array<long>, grams binary, counts binary, refs binary")


def _parts(different: np.ndarray, parts: int) -> np.ndarray:
    """Borders of the ``parts`` ranges of values in sorted n-grams."""
    cuts = [((k << 64) // parts) - (1 << 63) for k in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(different, np.array(cuts, np.int64)), [len(different)]]).astype(np.int64)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each ``part``; they come sorted by it."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["part"] != rows[0]["part"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _steps(blocks: DataFrame, parts: int) -> DataFrame:
    """``block, part, steps``: a byte for each n-gram of a block, 0 if no other set has it, else a quarter of an octave of how many sets have it."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                different, counts = np.frombuffer(row["grams"], np.int64), _unplaned(row["counts"])
                cuts = _parts(different, parts)
                ranges = [(k, low, high) for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])) if high > low]
                columns = [pa.array([row["block"]] * len(ranges)), pa.array([k for k, _, _ in ranges], pa.int32())]
                columns += [pa.array([different[low:high].tobytes() for _, low, high in ranges]), pa.array([_planes(counts[low:high]) for _, low, high in ranges])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "part", "grams", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches):
            grams = [np.frombuffer(r["grams"], np.int64) for r in rows]
            _, which = np.unique(np.concatenate(grams), return_inverse=True)
            total = np.bincount(which, np.concatenate([_unplaned(r["counts"]) for r in rows]))
            steps = np.where(total > 1, np.minimum(1 + np.floor(4 * np.log2(total)), 255), 0).astype(np.uint8)[which]
            cuts = _borders(np.array([len(g) for g in grams]))
            columns = [pa.array([r["block"] for r in rows]), pa.array([r["part"] for r in rows], pa.int32()), pa.array([steps[low:high].tobytes() for low, high in zip(cuts[:-1], cuts[1:])])]
            yield pa.RecordBatch.from_arrays(columns, ["block", "part", "steps"])

    sent = blocks.select("block", "grams", "counts").mapInArrow(send, "block long, part int, grams binary, counts binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(count, "block long, part int, steps binary")


def _ordered(blocks: DataFrame, steps: DataFrame, chosen: DataFrame) -> DataFrame:
    """The blocks with the chosen sets only (``block, places``), n-grams from rare to frequent and without those that no other set has; with a sketch of each set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                different, sizes, places = np.frombuffer(row["grams"], np.int64), np.array(row["sizes"]), np.sort(np.array(row["places"]))
                refs = _refs(row["refs"], _borders(sizes))
                taken = np.zeros(len(sizes), bool)
                taken[places] = True
                refs, sizes = refs[np.repeat(taken, sizes)], sizes[places]
                of = np.repeat(np.arange(len(sizes)), sizes)
                # an odd sketch: cells that an odd number of n-grams fall into; sets differ by at least as many as their sketches
                cells = (_mixed(different.view(np.uint64)) & np.uint64(SKETCH - 1)).astype(np.int64)[refs]
                odd = np.zeros((len(sizes), SKETCH // 8), np.uint8)
                borders = _borders(sizes)
                for low in range(0, len(sizes), 1000):
                    high = min(low + 1000, len(sizes))
                    some = slice(borders[low], borders[high])
                    odd[low:high] = np.packbits((np.bincount((of[some] - low) * SKETCH + cells[some], minlength=(high - low) * SKETCH) & 1).astype(bool)).reshape(high - low, -1)
                step = np.frombuffer(b"".join(x["steps"] for x in sorted(row["back"], key=lambda x: x["part"])), np.uint8)
                order = np.lexsort((different, step))
                rank = np.empty(len(order), np.int64)
                alone = int(np.count_nonzero(step == 0))
                rank[order] = np.arange(len(order)) - alone
                refs = rank[refs]
                shared = refs >= 0
                refs, of = refs[shared], of[shared]
                refs = np.sort(of * len(order) + refs) - of * len(order)
                left = np.bincount(of, minlength=len(sizes))
                # of the n-grams only those that a chosen set has stay
                used, refs = np.unique(refs, return_inverse=True)
                first = _borders(left)[:-1][left > 0]
                columns = [pa.array([row["block"]]), _lists([np.array(row["keys"])[places]], pa.int64()), _lists([sizes], pa.int64()), _lists([left], pa.int64())]
                columns += [pa.array([x]) for x in (different[order[alone:][used]].tobytes(), _packed_refs(refs, first) if len(refs) else b"", odd.tobytes())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "keys", "sizes", "left", "grams", "refs", "odd"])

    back = steps.groupBy("block").agg(F.collect_list(F.struct("part", "steps")).alias("back"))
    rows = blocks.select("block", "keys", "sizes", "grams", "refs").join(chosen, "block").join(back, "block")
    return rows.mapInArrow(work, "block long, keys array<long>, sizes array<long>, left array<long>, grams binary, refs binary, odd binary")


def _set_ids(block: int, places: np.ndarray) -> np.ndarray:
    """A number for each set: block numbers are a task's and a running one, places are below :data:`BLOCK_SETS`."""
    return ((block >> 32) << 40) + ((block & 0xFFFFFFFF) << 16) + places


def _need_of(threshold: float, both: np.ndarray) -> np.ndarray:
    return np.ceil(both * (threshold / (1 + threshold)) - 1e-9)


def _met(ordered: DataFrame, threshold: float, parts: int) -> DataFrame:
    """``x, y`` of all sets that share one of their rarest n-grams, where sizes and what is behind it still allow the threshold."""
    fields = ["place", "sizes", "left", "order", "stored"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes, left, grams = np.array(row["sizes"]), np.array(row["left"]), np.frombuffer(row["grams"], np.int64)
                borders = _borders(left)
                of = np.repeat(np.arange(len(left)), left)
                order, n = np.arange(len(of)) - borders[of], sizes[of]
                # n-grams of one set only would come first of all: they take their part of what may be missed
                alone = n - left[of]
                heads = order < n - np.ceil(n * threshold - 1e-9) + 1 - alone
                gram = grams[_refs(row["refs"], borders)[heads]]
                by = np.argsort(gram, kind="stable")
                stored = order < n - _need_of(threshold, 2 * n) + 1 - alone
                gram, values = gram[by], [v[heads][by] for v in (of, n, left[of], order, stored)]
                cuts = _parts(gram, parts)
                ranges = [(k, low, high) for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])) if high > low]
                columns = [pa.array([row["block"]] * len(ranges), pa.int64()), pa.array([k for k, _, _ in ranges], pa.int32()), pa.array([gram[low:high].tobytes() for _, low, high in ranges], pa.binary())]
                columns += [pa.array([_planes(v[low:high]) for _, low, high in ranges], pa.binary()) for v in values]
                yield pa.RecordBatch.from_arrays(columns, ["block", "part", "gram", *fields])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches):
            gram = np.concatenate([np.frombuffer(r["gram"], np.int64) for r in rows])
            place, n, m, p, stored = (np.concatenate([_unplaned(r[f]) for r in rows]) for f in fields)
            ids = _set_ids(np.repeat(np.array([r["block"] for r in rows]), [len(r["gram"]) // 8 for r in rows]), place)
            _, group, many = np.unique(gram, return_inverse=True, return_counts=True)
            # what only one set has among its rarest n-grams meets nothing
            group, ids, n, m, p, stored = (v[many[group] > 1] for v in (group, ids, n, m, p, stored))
            group <<= 32
            by = np.lexsort((ids, group + n))
            group, ids, n, m, p, stored = (v[by] for v in (group, ids, n, m, p, stored))
            there = np.flatnonzero(stored)
            # a set meets the stored ones in front of it: those of the same n-gram that are not larger, and large enough
            high = _borders(stored)[:-1]
            low = np.searchsorted((group + n)[there], group + np.ceil(n * threshold - 1e-9).astype(np.int64))
            pairs = np.maximum(high - low, 0)
            ends, begin = np.cumsum(pairs), 0
            while begin < len(pairs):
                done = ends[begin] - pairs[begin]
                end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
                some = pairs[begin:end]
                x = np.repeat(np.arange(begin, end), some)
                y = there[np.arange(len(x)) - np.repeat(_borders(some)[:-1] - low[begin:end], some)]
                most = np.minimum(p[x], p[y]) + np.minimum(m[x] - p[x], m[y] - p[y])
                near = most >= _need_of(threshold, n[x] + n[y])
                x, y = ids[x[near]], ids[y[near]]
                by = np.lexsort((y, x))
                x, y = x[by], y[by]
                new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]
                yield pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new])], ["x", "y"])
                begin = end

    sent = ordered.select("block", "sizes", "left", "grams", "refs").mapInArrow(send, f"block long, part int, gram binary, {', '.join(f'{f} binary' for f in fields)}")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "x long, y long").distinct()


def _sketches(ordered: DataFrame) -> DataFrame:
    """``id, n, odd`` of each set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                count = len(row["sizes"])
                odd = pa.FixedSizeListArray.from_arrays(pa.array(np.frombuffer(row["odd"], np.int64)), SKETCH // 64).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(_set_ids(row["block"], np.arange(count))), pa.array(row["sizes"], pa.int64()), odd], ["id", "n", "odd"])

    return ordered.select("block", "sizes", "odd").mapInArrow(work, "id long, n long, odd array<long>")


def _paths(ordered: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, key, n, path`` of the sets that are wanted (``block, places``), from frequent to rare n-grams."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                left, places = np.array(row["left"]), np.sort(np.array(row["places"]))
                taken = np.zeros(len(left), bool)
                taken[places] = True
                refs = _refs(row["refs"], _borders(left))[np.repeat(taken, left)]
                # backwards: from the last set's last n-gram to the first set's first
                paths = pa.ListArray.from_arrays(pa.array(_borders(left[places][::-1]), pa.int32()), pa.array(np.frombuffer(row["grams"], np.int64)[refs[::-1]]))
                numbers = [_set_ids(row["block"], places), np.array(row["keys"])[places], np.array(row["sizes"])[places]]
                yield pa.RecordBatch.from_arrays([*(pa.array(v[::-1], pa.int64()) for v in numbers), paths], ["id", "key", "n", "path"])

    return ordered.select("block", "keys", "sizes", "left", "grams", "refs").join(wanted, "block").mapInArrow(work, "id long, key long, n long, path array<long>")


def _similar(blocks: DataFrame, chosen: DataFrame, threshold: float) -> DataFrame:
    """``a, b, overlap`` of all pairs of chosen sets (``block, places``) that reach ``threshold``; a < b. The staged ``blocks`` are deleted when they have been read."""
    total = blocks.select(F.sum(F.octet_length("grams") / 8)).first()[0] or 0
    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART_GRAMS))
    steps = staged(_steps(blocks, parts), "grams-steps")
    ordered = staged(_ordered(blocks, steps, chosen), "grams-ordered")
    drop_staged(blocks)
    odd = _sketches(ordered)
    side = lambda name: odd.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("odd").alias(f"odd_{name}"))
    differ = sum((F.bit_count(F.col("odd_x")[k].bitwiseXOR(F.col("odd_y")[k])) for k in range(SKETCH // 64)), F.lit(0))
    met = _met(ordered, threshold, parts).join(side("x"), "x").join(side("y"), "y")
    met = met.where((F.col("n_x") + F.col("n_y") - differ) / 2 >= _need(threshold, F.col("n_x"), F.col("n_y")))
    met = staged(met.select("x", "y"), "grams-met")

    # a tree holds the stored sets whose least partner is the same; a probe goes to the trees that hold its partners
    tree_of = staged(met.groupBy("y").agg(F.least("y", F.min("x")).alias("tree")), "grams-trees")
    walks = met.join(tree_of, "y").select("x", "tree").distinct()
    grouped = lambda df, name: df.groupBy("tree").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    grid = staged(grouped(tree_of, "trees").join(grouped(walks, "copies"), "tree"), "grams-grid")
    mine = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    to_store = tree_of.join(grid, "tree").select(F.col("y").alias("id"), "tree", mine("y", F.col("trees")).alias("part"), every("copies").alias("copy"), F.lit(0).alias("walks"))
    to_walk = walks.join(grid, "tree").select(F.col("x").alias("id"), "tree", every("trees").alias("part"), mine("x", F.col("copies")).alias("copy"), F.lit(1).alias("walks"))
    cell = ["tree", "part", "copy"]
    places = met.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    block = F.shiftleft(F.shiftright("id", 40), 32) + F.shiftright("id", 16).bitwiseAND(0xFFFFFF)
    wanted = places.groupBy(block.alias("block")).agg(F.collect_list(F.col("id").bitwiseAND(0xFFFF)).alias("places"))
    work = to_store.unionByName(to_walk).join(_paths(ordered, wanted), "id")
    work = work.select(*cell, "walks", "id", "key", "n", "path").repartition(*cell).sortWithinPartitions(*cell, "walks")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree = None, [], None
        for batch in batches:
            a, b, overlap = [], [], []
            paths = batch.column("path")
            grams, borders = paths.values.to_pylist(), paths.offsets.to_pylist()
            columns = [batch.column(c).to_pylist() for c in (*cell, "walks", "id", "key", "n")]
            for row, (*place, walks_it, number, key, n) in enumerate(zip(*columns)):
                if place != at:
                    at, held, tree = place, [], None
                path = grams[borders[row] : borders[row + 1]]
                if not walks_it:
                    held.append((path, (number, key), n))
                    continue
                if len(held) <= FEW:
                    tree = tree or [(number_key, size, set(those)) for those, number_key, size in held]
                    found = _beside(tree, path, n, threshold)
                else:
                    tree = tree or _tree(held)
                    found = _walk(tree, path, n, threshold)
                for (other, other_key), size, both in found:
                    if (size, other) < (n, number):
                        a.append(min(key, other_key))
                        b.append(max(key, other_key))
                        overlap.append(both)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(overlap, pa.int32())], ["a", "b", "overlap"])

    return work.mapInArrow(walk, "a long, b long, overlap int")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """``a, b, overlap`` of all pairs of ``key long, grams array<long>`` (distinct sets) that reach ``threshold``; a < b."""

    def grams_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        grams = batch.column("grams")
        return np.repeat(np.arange(len(grams)), grams.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), grams.flatten().to_numpy(zero_copy_only=False)

    blocks = staged(_blocks(sets.select("key", "grams"), grams_of), "grams")
    return _similar(blocks, blocks.select("block", F.sequence(F.lit(0).cast("long"), F.size("keys").cast("long") - 1).alias("places")), threshold)


def _classes(doctexts: DataFrame, threshold: float, n: int) -> tuple[DataFrame, DataFrame]:
    """(``first, doc_no`` of every document with n-grams, ``a, b, overlap`` of similar classes); a class goes by its least ``doc_no``."""
    blocks = staged(document_blocks(doctexts, n), "grams")
    each = blocks.select("block", F.posexplode(F.arrays_zip("keys", "sizes", "marks", "sums")).alias("place", "set"))
    each = each.select(F.struct(F.col("set.keys").alias("doc_no"), "block", "place").alias("it"), "set.sizes", "set.marks", "set.sums")
    equal = ["sizes", "marks", "sums"]
    classes = staged(each.groupBy(*equal).agg(F.min("it").alias("first")), "grams-firsts")
    members = each.join(classes, equal).select(F.col("first.doc_no").alias("first"), "it.doc_no").distinct()
    members = staged(members.select("first", F.col("doc_no").cast(doctexts.schema["doc_no"].dataType)), "grams-classes")
    chosen = classes.groupBy("first.block").agg(F.collect_list(F.col("first.place").cast("long")).alias("places"))
    return members, _similar(blocks, chosen, threshold)


def near_duplicate_classes(doctexts: DataFrame, threshold: float = 0.7, n: int = 3) -> DataFrame:
    """``doc_no, class_no, links`` of each document with ``n``-grams: its class of equal sets, and with how many documents it is in a pair.

    Copies are not expanded into pairs, so the size of the result does not depend on how large classes are.
    """
    members, found = _classes(doctexts, threshold, n)
    sizes = staged(members.groupBy("first").agg(F.count(F.lit(1)).alias("size")), "grams-sizes")
    found = staged(found.select("a", "b"), "grams-links")
    both = found.select(F.col("a").alias("first"), F.col("b").alias("other")).unionByName(found.select(F.col("b").alias("first"), F.col("a").alias("other")))
    across = both.join(sizes.select(F.col("first").alias("other"), "size"), "other").groupBy("first").agg(F.sum("size").alias("across"))
    links = sizes.join(across, "first", "left").select("first", (F.col("size") - 1 + F.coalesce("across", F.lit(0))).alias("links"))
    return members.join(links, "first").select("doc_no", F.col("first").alias("class_no"), "links")


def near_duplicate_pairs(doctexts: DataFrame, threshold: float = 0.7, n: int = 3) -> DataFrame:
    """``doc_no_a, doc_no_b`` of all pairs of documents whose sets of ``n``-grams reach ``threshold``; a < b.

    Every pair is asked for here, also those of copies; :func:`near_duplicate_classes` says the same without them.
    """
    members, found = _classes(doctexts, threshold, n)
    left = members.select(F.col("first").alias("a"), F.col("doc_no").alias("m"))
    right = members.select(F.col("first").alias("b"), F.col("doc_no").alias("o"))
    across = found.select("a", "b").join(left, "a").join(right, "b").select("m", "o")
    inside = left.join(right, F.col("a") == F.col("b")).where("m < o").select("m", "o")
    return across.unionByName(inside).select(F.least("m", "o").alias("doc_no_a"), F.greatest("m", "o").alias("doc_no_b"))
