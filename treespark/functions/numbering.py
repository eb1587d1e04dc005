"""Depth-first numbers and subtrees of many sentences at once, in flat numpy arrays, for the Arrow batches of a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Place of a word that never meets the root: behind all others.
NOWHERE = 1 << 30
#: Words that are numbered at once, and members of subtrees that are built at once; one sentence or subtree may have more.
WORDS, MEMBERS = 1 << 15, 1 << 18


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where runs of these lengths begin, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def runs(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, .. of each run, one after the other."""
    return np.repeat(begins - starts_of(counts)[:-1], counts) + np.arange(counts.sum())


def lists(counts: np.ndarray, values: pa.Array | np.ndarray) -> pa.ListArray:
    """Lists of these lengths."""
    values = values if isinstance(values, pa.Array) else pa.array(values, pa.int32())
    return pa.ListArray.from_arrays(pa.array(starts_of(counts), pa.int32()), values)


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of consecutive items whose lengths add up to about ``most``; an item may be longer alone."""
    ends = np.cumsum(lengths)
    begin = 0
    while begin < len(lengths):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield begin, end
        begin = end


def flat_heads(heads: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The heads of all sentences in one array, and the lengths of the sentences; a null sentence has none."""
    lengths = heads.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return heads.flatten().cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), lengths


class Forest:
    """The trees of several sentences. Words are places in the flat arrays; ``own`` has their ids."""

    def __init__(self, head: np.ndarray, lengths: np.ndarray):
        self.head, self.lengths = head, lengths
        self.start = starts_of(lengths)
        words = len(head)
        self.sentence = np.repeat(np.arange(len(lengths)), lengths)
        self.base = self.start[self.sentence]
        self.own = np.arange(words) - self.base + 1
        self.n = lengths[self.sentence]
        up = np.where(head > 0, self.base + head - 1, -1)
        up[head > self.n] = -2
        by_head = np.argsort(up, kind="stable")
        first = np.searchsorted(up[by_head], np.arange(words + 1))
        level = by_head[np.searchsorted(up[by_head], -1) : first[0]]
        self.depth = np.zeros(words, np.int64)
        levels = []
        while len(level):
            levels.append(level)
            self.depth[level] = len(levels)
            level = by_head[runs(first[level], first[level + 1] - first[level])]
        self.size, self.height = np.zeros(words, np.int64), np.zeros(words, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            level = levels[k]
            self.size[level] += 1
            self.height[level] += 1
            if k:
                np.add.at(self.size, up[level], self.size[level])
                np.maximum.at(self.height, up[level], self.height[level])
        self.begin = np.full(words, NOWHERE, np.int64)
        for k, level in enumerate(levels):
            group = up[level] if k else self.sentence[level]
            before = np.cumsum(self.size[level]) - self.size[level]
            opens = np.concatenate([[True], group[1:] != group[:-1]])
            inside = before - before[np.maximum.accumulate(np.where(opens, np.arange(len(level)), 0))]
            self.begin[level] = inside + (self.begin[group] + 1 if k else 0)
        met = np.flatnonzero(self.depth)
        self.met = np.bincount(self.sentence[met], minlength=len(lengths))
        self.first = starts_of(self.met)[self.sentence]
        self.order = np.zeros(len(met), np.int64)
        self.order[self.first[met] + self.begin[met]] = met

    def below(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the subtree, word) of the subtrees of words, in depth-first order."""
        counts = self.size[words]
        begins = np.where(counts > 0, self.first[words] + self.begin[words], 0)
        return np.repeat(np.arange(len(words)), counts), self.order[runs(begins, counts)]

    def governs(self, above: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether a word is in the subtree of another, its own included."""
        return (self.begin[above] <= self.begin[word]) & (self.begin[word] < self.begin[above] + self.size[above])

    def members(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``below``, by ascending id."""
        number, word = self.below(words)
        width = len(self.head) + 1
        key = np.sort(number * width + word)
        return key // width, key % width

    def neighbours(self, words: np.ndarray, number: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, word) next to the members of each subtree: inside the sentence, neither members nor above its root."""
        number, side = np.concatenate([number, number]), np.repeat([-1, 1], len(member))
        member = np.concatenate([member, member])
        inside = (self.own[member] + side >= 1) & (self.own[member] + side <= self.n[member])
        number, beside = number[inside], (member + side)[inside]
        root = words[number]
        apart = ~self.governs(root, beside) & ~self.governs(beside, root)
        width = len(self.head) + 1
        key = np.unique(number[apart] * width + beside[apart])
        return key // width, key % width

    def described(self, words: np.ndarray) -> pa.StructArray:
        """root, size, height, members and neighbours of the subtrees of words."""
        number, member = self.members(words)
        about, beside = self.neighbours(words, number, member)
        height = pa.array(self.height[words], pa.int32(), mask=self.size[words] == 0)
        per = lambda numbers: np.bincount(numbers, minlength=len(words))
        return pa.StructArray.from_arrays(
            [pa.array(self.own[words], pa.int32()), pa.array(self.size[words], pa.int32()), height,
             lists(per(number), self.own[member]), lists(per(about), self.own[beside])],
            names=["root", "size", "height", "members", "neighbours"])

    def eligible(self, least: int, most: int) -> np.ndarray:
        """The words whose subtrees have a fitting size."""
        return np.flatnonzero((self.size >= least) & (self.size <= most))


def forests(heads: pa.ListArray) -> Iterator[tuple[int, int, Forest]]:
    """(first row, last row + 1, forest) of a batch, some sentences at a time."""
    flat, lengths = flat_heads(heads)
    start = starts_of(lengths)
    for begin, end in slices(lengths, WORDS) if len(lengths) else [(0, 0)]:
        yield begin, end, Forest(flat[start[begin] : start[end]], lengths[begin:end])


def numbered(heads: pa.ListArray) -> pa.StructArray:
    """head, begin, size, depth, height and order of every sentence, see ``trees.numbers``."""
    parts = []
    for begin, end, f in forests(heads):
        height = pa.array(f.height, pa.int32(), mask=f.size == 0)
        by_word = [lists(f.lengths, x) for x in (f.head, f.begin, f.size, f.depth, height)]
        parts.append(pa.StructArray.from_arrays(
            [*by_word, lists(f.met, f.own[f.order])], names=["head", "begin", "size", "depth", "height", "order"]))
    return pa.concat_arrays(parts)


def eligible(heads: pa.ListArray, least: int, most: int) -> pa.ListArray:
    """Per sentence the descriptions of the subtrees of fitting size with a neighbour."""
    parts = []
    for begin, end, f in forests(heads):
        words = f.eligible(least, most)
        found = f.described(words)
        beside = found.field("neighbours").value_lengths().to_numpy(zero_copy_only=False) > 0
        parts.append(lists(np.bincount(f.sentence[words[beside]], minlength=end - begin), found.filter(pa.array(beside))))
    return pa.concat_arrays(parts)


def _kept(batch: pa.RecordBatch, keep: list[str], rows: np.ndarray) -> list[pa.Array]:
    return [batch.column(c).take(pa.array(rows)) for c in keep]


def described_batches(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """A row per word with its subtree; a batch holds about ``MEMBERS`` members at most, or one word."""
    for batch in batches:
        for first, _, f in forests(batch.column("head")):
            for begin, end in slices(f.size + 1, MEMBERS):
                words = np.arange(begin, end)
                found = f.described(words)
                yield pa.RecordBatch.from_arrays(
                    [*_kept(batch, keep, first + f.sentence[words]), *found.flatten()],
                    names=[*keep, "root", "size", "height", "members", "neighbours"])


def closure_batches(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """A row per word and word above it."""
    for batch in batches:
        for first, _, f in forests(batch.column("head")):
            for begin, end in slices(f.size + 1, MEMBERS):
                words = np.arange(begin, end)
                number, low = f.below(words)
                above = words[number]
                numbers = [pa.array(x, pa.int32()) for x in (f.own[low], f.own[above], f.depth[low] - f.depth[above])]
                yield pa.RecordBatch.from_arrays(
                    [*_kept(batch, keep, first + f.sentence[above]), *numbers], names=[*keep, "id", "anc", "dist"])


class Arcs:
    """The arcs between words of several sentences, in both directions.

    A head outside the sentence is a place behind the words, from which no arc leads on; ``ids`` has the id of every place.
    """

    def __init__(self, head: np.ndarray, lengths: np.ndarray):
        self.words = words = len(head)
        self.sentence = np.repeat(np.arange(len(lengths)), lengths)
        base, self.n = starts_of(lengths)[self.sentence], lengths[self.sentence]
        self.own = np.arange(words) - base + 1
        beyond = np.flatnonzero(head > self.n)
        outside, place = np.unique(np.stack([self.sentence[beyond], head[beyond]]), axis=1, return_inverse=True)
        self.ids = np.concatenate([self.own, outside[1]])
        up = np.where(head > 0, base + head - 1, -1)
        up[beyond] = words + place.reshape(-1)
        low = np.flatnonzero(up >= 0)
        inside = low[up[low] < words]
        begin, end = np.concatenate([low, up[inside]]), np.concatenate([up[low], inside])
        order = np.argsort(begin, kind="stable")
        self.to = end[order]
        self.degree = np.bincount(begin, minlength=len(self.ids))
        self.first = starts_of(self.degree)

    def most(self, distance: int) -> np.ndarray:
        """At least as many as there are places within the distance of each word."""
        bound = np.ones(self.words, np.int64)
        inside = self.to < self.words
        by = np.repeat(np.arange(self.words), self.degree[: self.words])
        for _ in range(distance):
            further = np.bincount(by[inside], weights=bound[self.to[inside]], minlength=self.words).astype(np.int64)
            bound = np.minimum(1 + self.degree[: self.words] + further, self.n + 1)
        return bound

    def reach(self, words: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word, place) within the distance, by number and place. A word without an arc reaches nothing, nor
        does one from which a path would lead on beyond the sentence."""
        width = len(self.ids) + 1
        number = np.flatnonzero(self.degree[words])
        last = seen = number * width + words[number]
        for k in range(distance):
            number, place = last // width, last % width
            gone = np.unique(number[place >= self.words])
            if len(gone):
                seen, last = (x[~np.isin(x // width, gone)] for x in (seen, last))
                number, place = last // width, last % width
            counts = self.degree[place]
            near = np.unique(np.repeat(number * width, counts) + self.to[runs(self.first[place], counts)])
            last = near[~np.isin(near, seen, assume_unique=True)]
            seen = np.sort(np.concatenate([seen, last]))
        return seen // width, seen % width

    def cells(self, words: np.ndarray, offsets: tuple[int, ...], distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word, id) reached by the words at the offsets from each word, and the two ends of the sentence."""
        low, high = max(0, words[0] + min(offsets)), min(self.words, words[-1] + 1 + max(offsets))
        number, place = self.reach(np.arange(low, high), distance)
        counts = np.bincount(number, minlength=high - low)
        first = starts_of(counts)
        every = np.arange(len(words))
        found = [(every, np.zeros(len(words), np.int64)), (every, self.n[words] + 1)]
        for offset in offsets:
            at = words + offset
            kept = np.flatnonzero((self.own[words] + offset >= 1) & (self.own[words] + offset <= self.n[words]))
            at = at[kept] - low
            found.append((np.repeat(kept, counts[at]), self.ids[place[runs(first[at], counts[at])]]))
        number, ids = (np.concatenate(x) for x in zip(*found))
        width = int(ids.max(initial=0)) + 1
        key = np.unique(number * width + ids)
        return key // width, key % width


def arcs(heads: pa.ListArray) -> Iterator[tuple[int, int, Arcs]]:
    """(first row, last row + 1, arcs) of a batch, some sentences at a time."""
    flat, lengths = flat_heads(heads)
    start = starts_of(lengths)
    for begin, end in slices(lengths, WORDS):
        yield begin, end, Arcs(flat[start[begin] : start[end]], lengths[begin:end])


def reach_batches(batches: Iterator[pa.RecordBatch], keep: list[str], distance: int, most: int) -> Iterator[pa.RecordBatch]:
    """A row per word and word within the distance; a batch holds about ``most`` rows, or those of one word."""
    for batch in batches:
        for first, _, a in arcs(batch.column("head")):
            for begin, end in slices(a.most(distance), most):
                words = np.arange(begin, end)
                number, place = a.reach(words, distance)
                of = words[number]
                yield pa.RecordBatch.from_arrays(
                    [*_kept(batch, keep, first + a.sentence[of]), pa.array(a.own[of], pa.int32()), pa.array(a.ids[place], pa.int32())],
                    names=[*keep, "id", "other"])


def cell_batches(
    batches: Iterator[pa.RecordBatch], keep: list[str], offsets: tuple[int, ...], distance: int, most: int
) -> Iterator[pa.RecordBatch]:
    """A row per open cell of the words' rows of a mask; a batch holds about ``most`` of each offset, or those of one word."""
    for batch in batches:
        for first, _, a in arcs(batch.column("head")):
            for begin, end in slices(a.most(distance), most):
                words = np.arange(begin, end)
                number, ids = a.cells(words, offsets, distance)
                of = words[number]
                yield pa.RecordBatch.from_arrays(
                    [*_kept(batch, keep, first + a.sentence[of]), pa.array(a.own[of], pa.int32()), pa.array(ids, pa.int32())],
                    names=[*keep, "i", "j"])
