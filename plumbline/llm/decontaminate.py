"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test items are cut into windows of ``width`` consecutive words (an item of
fewer words, but not none, is one window).  For each window length a matcher
holds a table of shifts, one byte a slot, by checksum of a block of two words: a block that ends
no pattern lets the scan jump ahead as far as any pattern of its slot allows, so most words of a
document are never looked at.  Where the shift is zero, the bucket of the block (a pattern's
suffix) and of the pattern's first two words is looked up in a sorted array, and
the text of each pattern there is compared with the document's.

Words are runs of digits, lower-cased letters a-z and non-ASCII characters.
Null texts have no words; items without words have no windows; a null item_id
counts as the empty string; rows of equal item_id make one item.  Repeated
documents are scanned one by one.  Other columns pass
unless they are named like the new ones.  With an empty
benchmark nothing is hit; an empty corpus gives an empty result.

The matchers are broadcast.  Their size is bounded: items are cut into overlapping segments
of SEGMENT_WORDS words, and segments are dealt into blocks whose tables take about
TABLE_BYTES, one pass over the documents each.  With several blocks the documents are
written once with their places, a pass writes places and hits only, and these meet the
documents where they lie.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, as_row, bounded_batches, byte_values, hold, numbered, require_columns, row_columns, scratch, written

#: Bytes that are not part of a word become spaces, A-Z become a-z.
WORD_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))
TABLE_BYTES = 96 << 20
SEGMENT_WORDS = 1 << 14
#: Bytes a window takes in the tables at most, beside its text: key, place, owner, word offset and shift slots.
WINDOW_BYTES = 8 + 4 + 4 + 4 + 16


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class WuManber:
    """Patterns of one length in words, cut from segments (item, words joined by a space)."""

    def __init__(self, length: int, segments: list[tuple[str, bytes]]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.items = sorted({item for item, _ in segments})
        number = {item: i for i, item in enumerate(self.items)}
        self.text = b" ".join(body for _, body in segments)
        # where each word begins, and one past the end; no segment is beyond 4 GB of text
        spaces = np.flatnonzero(np.frombuffer(self.text, dtype=np.uint8) == 32)
        self.words = np.concatenate([[0], spaces + 1, [len(self.text) + 1]]).astype(np.uint32)
        windows = sum(body.count(b" ") + 2 - length for _, body in segments)
        slots = 1 << max(10, (8 * windows - 1).bit_length())
        self.mask, self.shift = slots - 1, bytearray([min(self.far, 255)]) * slots
        keys, starts, owners = array("Q"), array("I"), array("I")
        at = 0
        for item, body in segments:
            words = body.split(b" ")
            sums = [zlib.crc32(b" ".join(words[i : i + self.block])) for i in range(len(words) - self.block + 1)]
            for i in range(len(words) - length + 1):
                last = i + self.far - 1
                keys.append(sums[last] << 32 | sums[i])
                starts.append(at + i)
                owners.append(number[item])
                for k in range(i, last + 1) if i == 0 else (last,):
                    slot = sums[k] & self.mask
                    if last - k < self.shift[slot]:
                        self.shift[slot] = last - k
            at += len(words)
        order = np.argsort(np.frombuffer(keys, dtype=np.uint64), kind="stable")
        self.keys = array("Q", np.frombuffer(keys, dtype=np.uint64)[order].tobytes())
        self.starts = np.frombuffer(starts, dtype=np.uint32)[order]
        self.owners = np.frombuffer(owners, dtype=np.uint32)[order]

    def size(self) -> int:
        """Bytes of the tables."""
        return len(self.text) + self.words.nbytes + len(self.shift) + 8 * len(self.keys) + self.starts.nbytes + self.owners.nbytes

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, str]]:
        """(start, item) of every occurrence of every pattern."""
        m, b, shift, mask, keys, crc = self.length, self.block, self.shift, self.mask, self.keys, zlib.crc32
        i, n = m, len(words)
        while i <= n:
            last = crc(b" ".join(words[i - b : i]))
            jump = shift[last & mask]
            if jump:
                i += jump
                continue
            start = i - m
            key = last << 32 | crc(b" ".join(words[start : start + b]))
            at = bisect_left(keys, key)
            if at < len(keys) and keys[at] == key:
                window = b" ".join(words[start:i])
                while at < len(keys) and keys[at] == key:
                    first = int(self.starts[at])
                    if self.text[self.words[first] : int(self.words[first + m]) - 1] == window:
                        yield start, self.items[self.owners[at]]
                    at += 1
            i += 1


def segments_of(item: str, text: bytes, width: int) -> Iterator[tuple[str, int, bytes, int]]:
    """(item, window length, words joined by a space, bytes in the tables) of segments that overlap by a window less a word."""
    words = words_of(text)
    m = min(width, len(words))
    if m:
        step = max(1, SEGMENT_WORDS - m + 1)
        for at in range(0, len(words) - m + 1, step):
            body = b" ".join(words[at : at + step + m - 1])
            yield item, m, body, len(body) + WINDOW_BYTES * (body.count(b" ") + 1)


def build_matchers(segments: list[tuple[str, int, bytes]]) -> list[WuManber]:
    by_length: dict[int, list[tuple[str, bytes]]] = {}
    for item, m, body in segments:
        by_length.setdefault(m, []).append((item, body))
    return [WuManber(m, some) for m, some in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Union of spans, flattened: start, end, start, end, ..."""
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


FOUND = "n_words long, hit_spans array<int>, hit_items array<string>"


def found(rows: list[tuple[int, list[int], list[str]]]) -> pa.Array:
    types = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["n_words", "hit_spans", "hit_items"])


def scanner(shared):
    """The scan of a broadcast list of matchers."""

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        hold("decontaminate")
        matchers, rows = shared.value, []
        for text in byte_values(texts):
            words, hits, names = words_of(text), [], set()
            for matcher in matchers:
                for at, item in matcher.scan(words):
                    if not hits or hits[-1] != (at, at + matcher.length):
                        hits.append((at, at + matcher.length))
                    names.add(item)
            rows.append((len(words), merged(hits), sorted(names)))
        return found(rows)

    return scan


def gathering():
    @F.arrow_udf(FOUND)
    def gathered(texts: pa.Array, spans: pa.Array, items: pa.Array) -> pa.Array:
        """What several passes found in a text (arrays of spans and of items, or null)."""
        rows = []
        for text, some, names in zip(byte_values(texts), spans.to_pylist(), items.to_pylist(), strict=True):
            hits = [pair for flat in some or () for pair in zip(flat[::2], flat[1::2], strict=True)]
            rows.append((len(words_of(text)), merged(hits), sorted({n for few in names or () for n in few})))
        return found(rows)

    return gathered


def _scanned(docs: DataFrame, benchmark: DataFrame, width: int, table_bytes: int) -> DataFrame:
    """(_row, n_words, hit_spans, hit_items)."""
    require_columns(docs, "text")
    require_columns(benchmark, "item_id", "text")
    spark = docs.sparkSession
    bounded_batches(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("decontaminate")
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), strict=True):
                for segment in segments_of(item, text, width):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(segment, (pa.string(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["item", "m", "body", "size"])

    with scratch(spark):
        return _passes(docs, benchmark, cut, table_bytes)


def _passes(docs: DataFrame, benchmark: DataFrame, cut, table_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    segments = written(items.mapInArrow(cut, "item string, m int, body binary, size long"), "segments")
    blocks = max(1, -(-(segments.agg(F.sum("size").alias("s")).first()["s"] or 0) // table_bytes))

    def matchers(k: int):
        # about table_bytes of tables, however large the benchmark or an item of it is
        rows = segments.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k).select("item", "m", "body").collect()
        return spark.sparkContext.broadcast(build_matchers(sorted((r["item"], r["m"], bytes(r["body"])) for r in rows)))

    if blocks == 1:
        return docs.select(as_row(docs)).select("_row", scanner(matchers(0))(F.col("_row")["text"].cast("binary")).alias("s")).select("_row", "s.*")
    table = numbered(docs.select(as_row(docs)))
    text = F.col("_row")["text"].cast("binary")
    parts = []
    for k in range(blocks):
        shared = matchers(k)
        parts.append(written(table.rows.select(*PLACE, scanner(shared)(text).alias("s")).where("size(s.hit_spans) > 0").select(*PLACE, "s.hit_spans", "s.hit_items"), "hits"))
        shared.destroy()
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    marks = hits.groupBy(*PLACE).agg(F.collect_list("hit_spans").alias("spans"), F.collect_list("hit_items").alias("items"))
    return table.beside(marks, "_row", how="left").select("_row", gathering()(text, "spans", "items").alias("s")).select("_row", "s.*")


def mark_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_spans (word positions, end exclusive, flattened) and hit_items.

    Input columns of these names are replaced.
    """
    new = ("n_words", "hit_spans", "hit_items")
    return _scanned(docs, benchmark, width, table_bytes).select(*row_columns(docs, *new), *new)


def hit_words():
    """Number of words inside a hit, from hit_spans."""
    i = F.sequence(F.lit(0), F.greatest(F.size("hit_spans") - 2, F.lit(0)), F.lit(2))
    total = F.aggregate(i, F.lit(0).cast("bigint"), lambda a, k: a + F.get("hit_spans", k + 1) - F.get("hit_spans", k))
    return F.when(F.size("hit_spans") > 0, total).otherwise(F.lit(0).cast("bigint"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents no test window occurs in, with their own columns."""
    return _scanned(docs, benchmark, width, TABLE_BYTES).where(F.size("hit_spans") == 0).select(*row_columns(docs))
