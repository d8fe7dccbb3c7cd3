"""Best-fit packing of documents into fixed-length sequences.

The method is pattern packing by non-negative least squares.  The lengths of
all pieces form a histogram of at most ``max_len`` bins, whatever the corpus
holds.  On the driver, lengths are put into classes, patterns of up to four
lengths that fill a sequence are enumerated, down to the class of the shortest, non-negative
least squares gives how often each pattern should be used so that together they
reproduce the histogram, and the counts are rounded down and filled with real lengths, the
last two of a sequence chosen to end it exactly where that can be.  What is left
goes by best fit, longest first, into the gaps.  The result is a plan of
(length, run of ranks) -> (run of sequences, offset), some ten thousand lines
whose number depends on ``max_len`` alone.  The executors then only need the
rank of each piece among those of its length: the task that cuts the pieces numbers
them by length, and sums over earlier tasks come to the pieces where they lie.  No piece is
ever shuffled or gathered with all others of its length.

Null texts count as empty.  An empty document is one piece holding the end
token.  Equal doc_ids and repeated rows are packed one by one.  Columns of the
input other than ``doc_id`` and ``text`` are ignored.  An empty table gives an
empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import suppress
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PLACE, bounded_batches, byte_values, hold, numbered, require_columns, slices, without

#: Chunks of text whose ids a Python worker keeps: those met more than once, and those met once lately.
KEPT_CHUNKS, ONCE_CHUNKS = 400_000, 300_000
#: Bytes of text encoded at once.
ENCODED_BYTES = 2 << 20
MARKS, ALNUM = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum()), frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: How the vocabulary's special tokens begin.
SPECIAL = b"<|"
#: Letters of Latin-1: composed, and lower-cased one by one.
LATIN = re.compile("[a-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
LENGTH_CLASSES = 32
PATTERN_PARTS = 4
#: Classes that a pattern may be expected to leave empty, and what least squares has against it.
SPARE, SPARE_COST = 0.5, 0.01


# ---------------------------------------------------------------- tokens


class ChunkEncoder:
    """Token ids of texts, chunk by chunk.

    The tokenizer drops white space and never merges across it, so a text's
    ids are those of its white-space separated chunks in order.  It lower-cases,
    so chunks are looked up in lower-cased A-Z.  Marks after a letter or digit at
    a chunk's end are a token run of their own.  Chunks of ASCII or plain
    Latin letters need neither normalising nor splitting and go to the merges directly.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # the same merges without normalising and added tokens; the three share one vocabulary
        self.latin, self.ascii = Tokenizer(self.whole.model), Tokenizer(self.whole.model)
        self.latin.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)
        self.ids: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.once: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {}

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        special = [i for i, t in enumerate(texts) if SPECIAL in t]
        if special:  # special tokens count in the case they have: those texts are encoded as they are
            out = self.encode_all([b"" if SPECIAL in t else t for t in texts])
            for i in special:
                out[i] = np.array(self.whole.encode(texts[i].decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
            return out
        split = [t.lower().split() for t in texts]
        if len(self.ids) > KEPT_CHUNKS:
            self.ids, self.old = {}, self.ids
        chunks = list(chain.from_iterable(split))
        found = list(map(self.ids.get, chunks))
        missing: list[int] = []
        with suppress(ValueError):  # the last index() finds none
            at = found.index(None)
            while True:
                missing.append(at)
                at = found.index(None, at + 1)
        if missing:
            known = self._learn({chunks[i] for i in missing})
            for i in missing:
                found[i] = known[chunks[i]]
        ends = list(accumulate(map(len, split), initial=0))
        return [b"".join(found[s:e]) for s, e in pairwise(ends)]

    def _learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that are not kept.  A chunk is kept from the second time on."""
        if len(self.once) > ONCE_CHUNKS:
            self.once = {}
        ids, old, once = self.ids, self.old, self.once
        found: dict[bytes, bytes] = {}
        marked, todo = [], set()
        for c in new:
            if (known := once.pop(c, None) or old.get(c)) is not None:
                found[c] = ids[c] = known
                continue
            core = c.rstrip(MARKS)
            if len(core) == len(c) or not core or not (core[-1] in ALNUM or LATIN(core.decode())):
                todo.add(c)
            elif (known := ids.get(core) or once.get(core)) is not None:
                found[c] = once[c] = known + self._mark(c[len(core) :])
            else:
                marked.append((c, core))
                todo.add(core)
        fresh = self._encoded(todo)
        for c, core in marked:
            fresh[c] = fresh[core] + self._mark(c[len(core) :])
        once.update(fresh)
        found.update(fresh)
        return found

    def _mark(self, run: bytes) -> bytes:
        known = self.marks.get(run)
        if known is None:
            known = np.array(self.whole.encode(run.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
            if len(self.marks) < 10_000:
                self.marks[run] = known
        return known

    def _encoded(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        found: dict[bytes, bytes] = {}
        plain, latin, other = [], [], []
        for c in chunks:
            if c.isalpha():
                plain.append((c, c.decode()))
            elif LATIN(text := c.decode()):
                latin.append((c, text.lower()))
            else:
                other.append(c)
        for tokenizer, words in ((self.ascii, plain), (self.latin, latin)):
            for at in range(0, len(words), 1000):
                part = words[at : at + 1000]
                e = tokenizer.encode([text for _, text in part], is_pretokenized=True, add_special_tokens=False)
                data = np.array(e.ids, dtype="<u4").tobytes()
                s = 0
                for (c, _), end in zip(part, (np.cumsum(np.bincount(e.word_ids, minlength=len(part))) * 4).tolist(), strict=True):
                    found[c] = data[s:end]
                    s = end
        for at in range(0, len(other), 10_000):
            part = other[at : at + 10_000]
            for c, e in zip(part, self.whole.encode_batch([c.decode() for c in part], add_special_tokens=False), strict=True):
                found[c] = np.array(e.ids, dtype="<u4").tobytes()
        return found


def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker and vocabulary."""
    return hold("packing", path, lambda: ChunkEncoder(path))


class Ranks:
    """Numbers from 0 for the pieces of each length, in the order they come."""

    def __init__(self, max_len: int):
        self.seen = np.zeros(max_len + 1, dtype=np.int64)

    def add(self, lengths: np.ndarray) -> np.ndarray:
        order = np.argsort(lengths, kind="stable")
        ordered = lengths[order]
        first = np.searchsorted(ordered, ordered, side="left")
        ranks = np.empty(len(lengths), dtype=np.int64)
        ranks[order] = np.arange(len(lengths)) - first + self.seen[ordered]
        self.seen += np.bincount(lengths, minlength=len(self.seen))
        return ranks


def token_pieces(docs: DataFrame, tokenizer_path: str, max_len: int = 4096, end_id: int = 1) -> DataFrame:
    """Cut every document into pieces of at most ``max_len`` ids.

    Returns doc_id, piece, start, length and ids (unsigned 32-bit,
    little-endian).  Only the last piece of a document may be shorter.
    """
    return _ranked_pieces(docs, tokenizer_path, max_len, end_id).drop("_rank")


def _ranked_pieces(docs: DataFrame, tokenizer_path: str, max_len: int, end_id: int) -> DataFrame:
    """The pieces with ``_rank``, their number among those of their length of the same task."""
    require_columns(docs, "doc_id", "text")
    bounded_batches(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()
    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ranks = encoder(tokenizer_path), Ranks(max_len)
        for batch in batches:
            for part in slices(batch, 1, ENCODED_BYTES):
                rows, piece, start, length, ids = [], [], [], [], []
                for row, data in enumerate(enc.encode_all(list(byte_values(part.column(1))))):
                    data += end
                    n = len(data) // 4
                    for k, s in enumerate(range(0, n, max_len)):
                        rows.append(row)
                        piece.append(k)
                        start.append(s)
                        length.append(min(max_len, n - s))
                        ids.append(data[4 * s : 4 * (s + max_len)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(ranks.add(np.array(length, dtype=np.int64)))],
                    names=["doc_id", "piece", "start", "length", "ids", "_rank"],
                )

    return source.mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids binary, _rank long")


# ---------------------------------------------------------------- the plan


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 2000) -> np.ndarray:
    """min |a x - b| over x >= 0 by the active-set method."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(steps):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        passive[j] = True
        while True:
            cols = np.flatnonzero(passive)
            z = np.zeros(n)
            z[cols] = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            low = cols[z[cols] <= 1e-12]
            if not len(low):
                x = z
                break
            ratio = np.clip(x[low] / np.maximum(x[low] - z[low], 1e-300), 0.0, 1.0)
            x = np.maximum(x + float(ratio.min()) * (z - x), 0.0)
            drop = low[ratio <= ratio.min()]  # one at least, so this ends
            x[drop], passive[drop] = 0.0, False
            if not passive.any():
                break
    return x


def patterns(classes: int = LENGTH_CLASSES, parts: int = PATTERN_PARTS, spare: float = SPARE) -> np.ndarray:
    """Multisets of at most ``parts`` classes that fill ``classes`` but for ``spare``: a row each, counts by class.

    Class c holds lengths from c - 1 to c classes, so a part is expected to be half a class shorter.
    """
    found = []

    def extend(total: int, largest: int, chosen: list[int]) -> None:
        if chosen and total - len(chosen) / 2 >= classes - spare:
            found.append(list(chosen))
        if len(chosen) < parts:
            for c in range(min(largest, int(classes - total + (len(chosen) + 1) / 2)), 0, -1):
                extend(total + c, c, [*chosen, c])

    extend(0, classes, [])
    table = np.zeros((len(found), classes + 1))
    for i, p in enumerate(found):
        np.add.at(table[i], p, 1)
    return table


class PackingPlan:
    """Runs of equally long pieces and where they go, sorted by (length, rank)."""

    def __init__(self, max_len: int):
        self.max_len, self.bins, self.fitted = max_len, 0, 0
        self.gaps: list[list[tuple[int, int]]] = [[] for _ in range(max_len + 1)]
        self.open = np.zeros(max_len + 1, dtype=bool)
        self.rows: list[tuple[int, int, int, int]] = []

    def new_bins(self, count: int) -> None:
        self._put(self.max_len, self.bins, count)
        self.bins += count

    def _put(self, gap: int, first: int, count: int) -> None:
        self.gaps[gap].append((first, count))
        self.open[gap] = True

    def _take(self, gap: int, count: int) -> tuple[int, int]:
        first, have = self.gaps[gap].pop()
        if have > count:
            self.gaps[gap].append((first + count, have - count))
        elif not self.gaps[gap]:
            self.open[gap] = False
        return first, min(have, count)

    def place(self, gap: int, length: int, rank: int, count: int) -> int:
        """Put up to ``count`` pieces, one to a sequence, into sequences with that gap."""
        first, t = self._take(gap, count)
        self.rows.append((length, rank, first, self.max_len - gap))
        self._put(gap - length, first, t)
        return t

    def fill_pattern(self, runs: list[tuple[int, int]], count: int) -> None:
        """``count`` new sequences, each with a piece of every (length, first rank)."""
        offset = 0
        for length, rank in runs:
            self.rows.append((length, rank, self.bins, offset))
            offset += length
        self._put(self.max_len - offset, self.bins, count)
        self.bins += count

    def best_fit(self, length: int, rank: int, count: int) -> None:
        while count:
            fits = np.flatnonzero(self.open[length:])
            if not len(fits):
                self.new_bins(-(-count // (self.max_len // length)))
                continue
            t = self.place(length + int(fits[0]), length, rank, count)
            rank, count = rank + t, count - t

    def by_length(self) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """(length, runs of (first rank, first sequence, offset)), runs in the order of ranks."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for length, rank, first, offset in sorted((int(a), int(b), int(c), int(d)) for a, b, c, d in self.rows):
            found.setdefault(length, []).append((rank, first, offset))
        return list(found.items())


class Stock:
    """Pieces that are not placed yet, by length."""

    def __init__(self, histogram: dict[int, int], max_len: int):
        self.left = np.zeros(max_len + 1, dtype=np.int64)
        for n, c in histogram.items():
            self.left[n] = c
        self.used = np.zeros(max_len + 1, dtype=np.int64)

    def take(self, length: int, count: int) -> tuple[int, int]:
        rank = int(self.used[length])
        self.used[length] += count
        self.left[length] -= count
        return length, rank

    def lengths(self, low: int, high: int) -> np.ndarray:
        return low + np.flatnonzero(self.left[low : high + 1] > 0) if low <= high else np.zeros(0, dtype=np.int64)

    def exact_pair(self, total: int, first: tuple[int, int], second: tuple[int, int]) -> list[int]:
        """Two lengths of these ranges that add up to ``total``, those there are most of."""
        x = np.arange(max(first[0], total - second[1]), min(first[1], total - second[0]) + 1)
        if not len(x):
            return []
        pairs = np.where(2 * x == total, self.left[x] // 2, np.minimum(self.left[x], self.left[total - x]))
        best = int(np.argmax(pairs))
        return [int(x[best]), int(total - x[best])] if pairs[best] > 0 else []

    def fill(self, ranges: list[tuple[int, int]], max_len: int) -> list[int]:
        """Lengths from these ranges that together go as far as can be; none if a range has run out."""
        gap, chosen = max_len, []
        for k, (low, high) in enumerate(ranges):
            if k == len(ranges) - 2 and (pair := self.exact_pair(gap, ranges[k], ranges[k + 1])):
                chosen += pair
                break
            rest = sum(a + b for a, b in ranges[k + 1 :]) // 2
            some = self.lengths(low, high)
            under = some[some <= gap - rest]
            length = int(under[-1]) if len(under) else int(some[0]) if len(some) and k < len(ranges) - 1 else 0
            if not length or length > gap:
                for n in chosen:
                    self.left[n] += 1
                return []
            chosen.append(length)
            self.left[length] -= 1
            gap -= length
        else:
            k = len(ranges)
        for n in chosen[:k]:
            self.left[n] += 1
        return chosen


def make_plan(histogram: dict[int, int], max_len: int) -> PackingPlan:
    """Fit patterns to the histogram, round, fill them with real lengths and best-fit the rest."""
    plan, stock = PackingPlan(max_len), Stock(histogram, max_len)
    if full := int(stock.left[max_len]):
        plan.fill_pattern([stock.take(max_len, full)], full)
    classes = min(LENGTH_CLASSES, max_len)
    width = -(-max_len // classes)
    classes = -(-max_len // width)
    table = patterns(classes)
    target = np.bincount(-(-np.arange(max_len + 1) // width), weights=stock.left, minlength=classes + 1)
    # one row more holds what each pattern leaves empty against it
    empty = classes - table @ np.arange(classes + 1) + table.sum(axis=1) / 2
    wanted = np.floor(nnls(np.vstack([table.T, SPARE_COST * empty]), np.append(target, 0.0))).astype(np.int64)
    for i in np.argsort(-wanted, kind="stable"):
        ranges = [((c - 1) * width + 1, min(c * width, max_len)) for c in np.flatnonzero(table[i])[::-1].tolist() for _ in range(int(table[i, c]))]
        todo = int(wanted[i])
        while todo > 0 and (chosen := stock.fill(ranges, max_len)):
            count = max(1, min(todo, *(int(stock.left[n]) // chosen.count(n) for n in chosen)))
            plan.fill_pattern([stock.take(n, count) for n in chosen], count)
            todo -= count
    plan.fitted = plan.bins - full
    for n in range(max_len - 1, 0, -1):
        if stock.left[n]:
            plan.best_fit(n, int(stock.used[n]), int(stock.left[n]))
    return plan


# ---------------------------------------------------------------- the operator


def pack_pieces(pieces: DataFrame, max_len: int = 4096) -> DataFrame:
    """Add sequence_id and offset to a table of pieces with a ``length`` from 1 to ``max_len``.

    Other columns pass, but those named like the new ones.
    """
    require_columns(pieces, "length")
    bounded_batches(pieces.sparkSession)
    pieces = without(pieces, *PLACE, "_rank", "_marks", "_length", "_runs", "_run", "sequence_id", "offset")
    at = pieces.columns.index("length")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(max_len)
        for batch in batches:
            n = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks.add(n))], names=[*batch.schema.names, "_rank"])

    return _placed(pieces.mapInArrow(rank, f"{fields}, _rank long"), max_len)


def _placed(ranked: DataFrame, max_len: int) -> DataFrame:
    """Pieces with ``_rank`` are written once where they are; sums over earlier blocks give the rank among all of a length."""
    columns = [c for c in ranked.columns if c != "_rank"]
    table = numbered(ranked, "pieces")
    block = PLACE[0]
    counts = table.rows.groupBy(block, "length").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # max_len rows at most
    # max_len rows at most, some ten thousand runs in all: their number depends on max_len, not on the corpus
    runs = make_plan(histogram, max_len).by_length()
    # as an Arrow table: a list of rows would start a second set of Python workers on the executors
    run = pa.struct([("rank", pa.int64()), ("first", pa.int64()), ("offset", pa.int64())])
    lines = pa.array([[dict(zip(run.names, line, strict=True)) for line in lines] for _, lines in runs], pa.list_(run))
    plan = ranked.sparkSession.createDataFrame(pa.table({"_length": pa.array([n for n, _ in runs], pa.int64()), "_runs": lines}))
    before = Window.partitionBy("length").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select(block, F.col("length").cast("bigint").alias("n"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("before"))
    marks = sums.groupBy(block).agg(F.map_from_entries(F.collect_list(F.struct("n", "before"))).alias("_marks"))
    length = F.col("length").cast("bigint")
    joined = table.by_block(marks, *columns, "_rank").withColumn("_rank", F.col("_rank") + F.element_at("_marks", length)).drop("_marks")
    joined = joined.join(F.broadcast(plan), length == F.col("_length"))
    run = F.element_at(F.filter("_runs", lambda x: x["rank"] <= F.col("_rank")), -1)
    at = joined.select(*[F.col(f"`{c}`") for c in columns], "_rank", run.alias("_run"))
    return at.select(*[F.col(f"`{c}`") for c in columns], (F.col("_run.first") + F.col("_rank") - F.col("_run.rank")).alias("sequence_id"), F.col("_run.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = 4096, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """Tokenize, cut and pack: a row per piece, with its ids unless ``keep_ids`` is off."""
    pieces = _ranked_pieces(docs, tokenizer_path, max_len, end_id).withColumn("ids_crc32", F.crc32("ids"))
    return _placed(pieces if keep_ids else pieces.drop("ids"), max_len)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary), docs (doc_id, piece, offset)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"])).alias("docs")
    )
