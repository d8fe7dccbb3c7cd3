"""Stretches of a text in which words repeat with a period, found by the runs theorem.

A run is a stretch of words with smallest period q, at least 2q words long, that neither neighbour extends.  By the
theorem, in one of the two orders of words every run holds a Lyndon root that is the longest Lyndon word at its place.  That word
ends where the next smaller suffix begins: the next smaller value of the inverse suffix array; in the other order, whose end of
text is its largest sign, the next greater one.  Each root is extended to both sides by the longest common prefixes of two
suffixes and of two reversed prefixes: minima of LCP ranges from sparse tables over blocks.

Texts of a slice of an Arrow batch are handled together as one array of word numbers; a separator of its own after each
text keeps them apart.  Suffixes are sorted by prefixes of three times the length each round, of which only those not yet
told apart go on.  Nothing is shuffled.  A text is held whole, with about 150 bytes a word, and no more than ``SLICE_BYTES`` of texts
beside it; no text is cut.

Words are what stands between ASCII white space.  Null and empty texts have no words, no runs and an empty collapsed
text.  Rows are judged one by one, so repeated rows and doc_ids give equal rows.  Columns that were there stay, but for
those that the result adds.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, as_row, bounded_batches, require_columns, row_columns, slices

#: Of texts that are handled together.
SLICE_BYTES = 1 << 20
#: A run has so many words at least.
LEAST = 12
BLOCK = 16


class RangeMinimum:
    """Minima of ranges of an array: running minima inside blocks, a sparse table over the blocks."""

    def __init__(self, values: np.ndarray):
        self.values = values
        padded = np.full(-(-max(1, len(values)) // BLOCK) * BLOCK, np.iinfo(values.dtype).max, dtype=values.dtype)
        padded[: len(values)] = values
        blocks = padded.reshape(-1, BLOCK)
        self.to = np.minimum.accumulate(blocks, axis=1).ravel()
        self.since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        levels = [blocks.min(axis=1)]
        while (half := 1 << (len(levels) - 1)) * 2 <= len(blocks):
            last, longer = levels[-1], levels[-1].copy()
            longer[: len(last) - half] = np.minimum(last[: len(last) - half], last[half:])
            levels.append(longer)
        self.table = np.stack(levels)

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The minima of [first, last], both included."""
        low, high = first // BLOCK, last // BLOCK
        out = np.minimum(self.since[first], self.to[last])
        wide = np.flatnonzero(high - low > 1)
        if len(wide):
            n = high[wide] - low[wide] - 1
            level = np.frexp(n.astype(np.float64))[1] - 1
            between = np.minimum(self.table[level, low[wide] + 1], self.table[level, high[wide] - (1 << level.astype(np.int64))])
            out[wide] = np.minimum(out[wide], between)
        near = np.flatnonzero(high == low)
        if len(near):
            at, end = first[near].copy(), last[near]
            least = self.values[at]
            for _ in range(BLOCK - 1):
                at = np.minimum(at + 1, end)
                least = np.minimum(least, self.values[at])
            out[near] = least
        return out


class Suffixes:
    """Ranks of the suffixes of an array of numbers in which the last one is met once, and what two suffixes share."""

    def __init__(self, signs: np.ndarray):
        n = len(signs)
        bits = int(n + 1).bit_length()
        by = 3 if 3 * bits <= 62 else 2
        order = np.argsort(signs, kind="stable")
        ranks = np.zeros(n, dtype=np.int64)
        ranks[order], active = _ranked(ranks, order, signs[order])
        levels, widths, width = [ranks], [1], 1
        while len(active):
            # ranks from 1 on; 0 stands for what lies behind the end
            key = (ranks[active] + 1) << (bits * (by - 1))
            for k in range(1, by):
                at = active + k * width
                inside = at < n
                key[inside] |= (ranks[at[inside]] + 1) << (bits * (by - 1 - k))
            order = np.argsort(key, kind="stable")
            held = active[order]
            told, active = _ranked(ranks[held], held, key[order])
            ranks = ranks.copy()
            ranks[held] = told
            width *= by
            levels.append(ranks)
            widths.append(width)
        self.ranks = ranks
        self.order = np.empty(n, dtype=np.int64)
        self.order[ranks] = np.arange(n)
        self.minima = RangeMinimum(self._neighbours(levels, widths, by, n))

    def _neighbours(self, levels: list, widths: list, by: int, n: int) -> np.ndarray:
        """How much each suffix shares with the one before it in their order."""
        shared = np.zeros(n, dtype=np.int32)
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        # pairs that agree on the first 1, 3, 9, ... signs, ever fewer
        agree, alive = [], np.arange(n - 1)
        for ranks in levels:
            alive = alive[ranks[a[alive]] == ranks[b[alive]]]
            if not len(alive):
                break
            agree.append(alive)
        for level in reversed(range(len(agree))):
            pairs = agree[level]
            for _ in range(by - 1):
                x, y = a[pairs], b[pairs]
                inside = np.maximum(x, y) < n
                pairs, x, y = pairs[inside], x[inside], y[inside]
                pairs = pairs[levels[level][x] == levels[level][y]]
                a[pairs] += widths[level]
                b[pairs] += widths[level]
                shared[pairs + 1] += widths[level]
        return shared

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the longest common prefix of suffixes i and j, which differ."""
        x, y = self.ranks[i], self.ranks[j]
        return self.minima.of(np.minimum(x, y) + 1, np.maximum(x, y)).astype(np.int64)


def _ranked(groups: np.ndarray, held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the places ``held``, which are sorted by ``keys`` within the ``groups`` they were in, and the places that are not alone in theirs.

    A rank is the number of smaller suffixes, so a group's rank is that of its first member.
    """
    n = len(held)
    if not n:
        return groups, held
    at = np.arange(n)
    new = np.empty(n, dtype=bool)
    new[0], new[1:] = True, keys[1:] != keys[:-1]
    start = np.maximum.accumulate(np.where(new, at, 0))
    begun = np.empty(n, dtype=bool)
    begun[0], begun[1:] = True, groups[1:] != groups[:-1]
    base = np.maximum.accumulate(np.where(begun, at, 0))
    told = groups + start - base
    alone = new.copy()
    alone[:-1] &= new[1:]
    return told, np.sort(held[~alone])


def next_beyond(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, or the length.

    Between a place and its pointer all values are greater; a pointer to a greater value moves on to where that
    one points.  What is left once that has cost some passes is settled by one more, with a stack.
    """
    n = len(values)
    to = np.arange(1, n + 1)
    padded = np.append(values, np.iinfo(values.dtype).min)
    pointer = np.append(to, n)
    left = np.flatnonzero(padded[to] > values)
    spent = 0
    while len(left) and spent < 12 * n:
        spent += len(left) + 500
        pointer[left] = pointer[pointer[left]]
        left = left[padded[pointer[left]] > values[left]]
    if len(left):
        stack: list[int] = []
        listed, out = values.tolist(), [n] * n
        for i, v in enumerate(listed):
            while stack and listed[stack[-1]] > v:
                out[stack.pop()] = i
            stack.append(i)
        return np.array(out, dtype=np.int64)
    return pointer[:-1]


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> np.ndarray:
    """(text, start, length, period) of every run of ``least`` words or more, in this order, of arrays of word numbers from 0."""
    empty = np.zeros((0, 4), dtype=np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return empty
    signs, starts = _apart(texts)
    ends = starts + sizes
    forward = Suffixes(signs)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    places = np.arange(sizes.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    end_of = ends[text_of]
    found = []
    reverse = -forward.ranks
    reverse[np.append(starts - 1, len(signs) - 1)] = -len(signs)
    for values, last in ((forward.ranks, end_of), (reverse, end_of - 1)):
        to = next_beyond(values)[places]
        # a separator is smaller than any word, so it ends words in one order; in the other, words that reach it go on, and are no roots
        period = to - places
        good = np.flatnonzero(to <= last)
        good = good[2 * period[good] <= sizes[text_of[good]]]
        i, j, p, text = places[good], to[good], period[good], text_of[good]
        right = forward.shared(i, j)
        # what is missing to the length must agree on the left, its first word and its last
        missing = np.maximum(least, 2 * p) - p - right
        fits = (missing <= 0) | ((i - missing >= starts[text]) & (signs[i - 1] == signs[j - 1]) & (signs[np.maximum(i - missing, 0)] == signs[np.maximum(j - missing, 0)]))
        found.append(np.stack([text, i, j, right], axis=1)[fits])
    roots = np.concatenate(found)
    if not len(roots):
        return empty
    # only texts with such roots are read backwards
    chosen, at = np.unique(roots[:, 0], return_inverse=True)
    back_signs, back_starts = _apart([texts[k][::-1] for k in chosen])
    back = Suffixes(back_signs)
    text, i, j, right = roots.T
    mirror = back_starts[at] + ends[text] - 1
    left = back.shared(mirror - i + 1, mirror - j + 1)
    start, length, p = i - left - starts[text], left + right + j - i, j - i
    runs = np.stack([text, start, length, p], axis=1)[length >= np.maximum(least, 2 * p)]
    return np.unique(runs, axis=0)


def _apart(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, a separator smaller than all words before each and after the last; where each starts."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = 1 + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    signs = np.empty(sizes.sum() + n + 1, dtype=np.int64)
    mask = np.ones(len(signs), dtype=bool)
    mask[np.append(starts - 1, len(signs) - 1)] = False
    signs[mask] = np.concatenate(texts) + n + 1
    signs[~mask] = np.arange(n + 1)
    return signs, starts


def _read(texts: list[bytes]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """The runs (start, length, period) of each text, and its words that no run repeats."""
    words = [t.split() for t in texts]
    numbers = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    bounds = np.cumsum([len(ws) for ws in words])[:-1]
    runs = runs_of(np.split(numbers, bounds))
    firsts = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    out = []
    for k, ws in enumerate(words):
        own = runs[firsts[k] : firsts[k + 1], 1:]
        if len(own):
            repeats = np.zeros(len(ws) + 1, dtype=np.int64)
            np.add.at(repeats, own[:, 0] + own[:, 2], 1)
            np.add.at(repeats, own[:, 0] + own[:, 1], -1)
            ws = [ws[i] for i in np.flatnonzero(np.cumsum(repeats[:-1]) == 0)]
        out.append(([tuple(r) for r in own[np.lexsort((own[:, 2], own[:, 0]))].tolist()], b" ".join(ws)))
    return out


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, 1, SLICE_BYTES):
            found = _read([t or b"" for t in piece.column(1).to_pylist()])
            runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs, _ in found], pa.list_(_RUN))
            yield pa.RecordBatch.from_arrays([piece.column(0), runs, pa.array([c.decode() for _, c in found], pa.string())], names=["_row", "runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with ``runs``, (start, length, period) of every run of ``LEAST`` words or more by start, then period, and ``collapsed``, the words without repeats.

    A word is a repeat if it stands in a run after the run's first period; kept words are joined by one space.
    """
    require_columns(docs, "text")
    bounded_batches(docs.sparkSession)
    rows = docs.select(as_row(docs), F.col("text").cast("binary").alias("text"))
    kind = rows.schema["_row"].dataType.simpleString()
    found = rows.mapInArrow(_find, f"_row {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return found.select(*row_columns(docs, "runs", "collapsed"), "runs", "collapsed")


def longest(runs: Column) -> Column:
    """The run of the greatest length, of those the first, of those of the smallest period; null without runs."""
    return F.try_element_at(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(1))


def repeated(text: Column, identifier: Column) -> Column:
    """``text`` as it is, or, for one identifier in ten, with a periodic end chosen by the identifier's checksum."""
    h = F.crc32(identifier.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")
    n = F.size(words)
    first = (g % n).cast("int")
    period = (F.lit(1) + F.floor((n - first) / (g % 8 + 3))).cast("int")
    # whole stretches: a lambda over the words would split the text anew for each of them
    ends = F.flatten(F.array_repeat(F.slice(words, first + 1, period), F.ceil((n - first) / period).cast("int")))
    made = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), first), ends), F.lit(1), n), " ")
    return F.when((h % 10 == 0) & (F.coalesce(n, F.lit(0)) > 0), made).otherwise(text)
