"""Near duplicates by their sets of word shingles: fingerprints and MinHash bands find the pairs, the sets decide.

Texts lower-cased in A-Z are cut at ASCII white space; a text's set holds every
run of SHINGLE_WORDS words (fewer words: all of them).  Texts whose sets have a
Jaccard similarity of SIMILARITY or more are linked, however they were found:

0.  SimHash fingerprints of the shingles, linked through pivot distance tables (``simhash``), find the closest texts.
1.  BANDS keys a text are made of ROWS minima each of the hashed set.  Two sets
    of similarity s share a key with a chance of 1 - (1 - s^ROWS)^BANDS: at 0.8
    five pairs in a million share none, above it fewer.
2.  Texts of equal keys are compared with the smallest row among them first, so
    a large group of near copies costs in proportion to its rows.
3.  Texts whose keys these links leave in different components are joined
    anew by prefixes of their sets.  Shingles are ordered by the number of
    those texts that hold them, rare ones first; two sets of similarity s share one of their
    first few, fewer than n - s n + 2, so this loses no pair.  A text with many words of its own has only
    those among its first and meets nobody, where all texts of a template share keys.
    A shingle further back meets only sets so small that enough can follow it: sizes are part of the keys.
    Of each key the text with the fewest rare shingles is compared first, and the pairs
    that are still apart one by one.

Sets are compared as sets of 64-bit hashes of their shingles, and only those of texts that are
candidates leave their place.

Distances of SimHash fingerprints alone do not carry this: such pairs differ by up to
a dozen of 64 bits, and keys that lose no link at that distance are too many.  So what they leave apart is the bands' to find.

Null text counts as empty; texts without words are alike.  Null doc_ids take
part; they name a component only if it has no other.  Other columns are not
read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PLACE, Numbered, as_row, bounded_batches, byte_values, hold, numbered, require_columns, row_columns, scratch, text_bytes, written
from .components import components
from .simhash import fingerprint, near_links

SHINGLE_WORDS = 5
SIMILARITY = 0.8
ROWS = 6
BANDS = 40


def shingles(text: bytes, size: int = SHINGLE_WORDS) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def similarity(a: set, b: set) -> float:
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared) if a or b else 1.0


def hashes(found: set[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(s, 42) for s in found), dtype=np.uint64, count=len(found))


class Bands:
    """Keys of a set of shingles; the same on every worker."""

    def __init__(self) -> None:
        rng = np.random.default_rng(11)
        self.masks, self.factors, self.mix = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (ROWS * BANDS, ROWS * BANDS, BANDS * (ROWS + 1)))
        self.factors |= np.uint64(1)
        self.mix = self.mix.reshape(BANDS, ROWS + 1) | np.uint64(1)

    def keys(self, found: set[bytes]) -> np.ndarray:
        own = hashes(found)
        low = np.full(ROWS * BANDS, 2**64 - 1, dtype=np.uint64)
        for at in range(0, len(own), 1024):
            np.minimum(low, ((own[at : at + 1024, None] ^ self.masks) * self.factors).min(axis=0), out=low)
        low ^= low >> np.uint64(32)
        keys = (low.reshape(BANDS, ROWS) * self.mix[:, :ROWS]).sum(axis=1, dtype=np.uint64) + self.mix[:, ROWS]
        return keys.view(np.int64)


def with_keys(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(_row, keys, fp): all columns of ``docs`` as a struct, the keys of its text and its fingerprint."""
    require_columns(docs, "text")
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("array<long>")
    def keys(texts: pa.Array) -> pa.Array:
        bands = hold("shingles", "bands", Bands)
        flat = [bands.keys(shingles(t, size)) for t in byte_values(texts)]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        hold("shingles")
        return pa.array(np.fromiter((fingerprint(t, size) for t in byte_values(texts)), dtype=np.uint64, count=len(texts)).view(np.int64))

    return docs.select(as_row(docs), keys(text_bytes()).alias("keys"), prints(text_bytes()).alias("fp"))


def hashed_sets(table: Numbered, ids: DataFrame, size: int) -> DataFrame:
    """(id, hashes), written: the sets of the rows whose number is among ``ids`` (id, distinct)."""

    @F.arrow_udf("array<long>")
    def sets(texts: pa.Array) -> pa.Array:
        hold("shingles")
        found = [np.unique(hashes(shingles(t, size))).view(np.int64) for t in byte_values(texts)]
        ends = np.cumsum([0, *(len(x) for x in found)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))

    marks = ids.select(F.shiftright("id", 33).cast("int").alias(PLACE[0]), F.col("id").alias(PLACE[1]))
    return written(table.beside(marks, "_row", how="left_semi").select(F.col(PLACE[1]).alias("id"), sets(F.col("_row")["text"].cast("binary")).alias("hashes")), "sets")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets (id, hashes) are alike."""
    left, right = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    m, n = F.size("x"), F.size("y")
    # sets of very different sizes cannot be alike; the others are counted
    near = (F.least(m, n) >= least * F.greatest(m, n) - 1e-9)
    shared = F.size(F.array_intersect("x", "y"))
    alike = F.when(m + n == 0, F.lit(True)).otherwise(near & (shared >= least * (m + n - shared)))
    return pairs.join(left, "a").join(right, "b").where(alike).select("a", "b")


def ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def hub_pairs(keyed: DataFrame) -> DataFrame:
    """(a, b): the smallest id of each key of ``keyed`` (key, id) with every other, each pair once."""
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    return keyed.join(hubs, "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def print_pairs(prints: DataFrame) -> DataFrame:
    """(a, b) of prints (id, fp), written: of equal fingerprints the smallest id with every other, of linked ones the two smallest ids."""
    firsts = written(prints.groupBy("fp").agg(F.min("id").alias("low")), "fingerprints")
    equal = prints.join(firsts, "fp").where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    low = {c: firsts.select(F.col("fp").alias(c), F.col("low").alias(f"low_{c}")) for c in "ab"}
    linked = near_links(firsts.select("fp")).join(low["a"], "a").join(low["b"], "b")
    return written(equal.unionByName(linked.select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b"))), "print-pairs")


def component_of(links: DataFrame) -> DataFrame:
    """(id, c) of the rows that ``links`` joins, written."""
    return written(components(links).select(F.col("node").alias("id"), F.col("component").alias("c")), "components")


def with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (id, ...) with ``c``; a row without links is its own."""
    return rows.join(found, "id", "left").withColumn("c", F.coalesce("c", "id"))


def still_apart(bands: DataFrame, links: DataFrame) -> DataFrame:
    """The ids of rows (key, id) whose key holds several components."""
    named = with_component(bands, component_of(links))
    split = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    return written(named.join(split, "key").select("id").distinct(), "apart")


def size_class(n: Column) -> Column:
    """Sizes within three hundredths of each other."""
    return F.floor(F.log(n.cast("double")) / math.log(1.03)).cast("int")


def prefixes(sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(key, size, id, n, place) of the first shingles of each set, rare ones first: as the smaller of two, and as the larger.

    Sets of n and m <= n that are alike share ``least / (1 + least) * (n + m)`` shingles or more.  So the smaller has one
    of them among its first m - 2 least / (1 + least) m + 1, the larger among its first n - least n + 1, and one at place p
    of the larger is of use for an m of at most (n - p + 1) (1 + least) / least - n.
    """
    rows = sets.select("id", F.size("hashes").alias("n"), F.explode("hashes").alias("key"))
    held = rows.groupBy("key").agg(F.count("*").alias("df"))
    rows = rows.join(held, "key").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("df", "key")))
    rows = written(rows.where((F.col("place") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1) & (F.col("df") > 1)).select("key", "id", "n", "place"), "prefixes")
    n, place, share = F.col("n"), F.col("place"), least / (1 + least)
    small = rows.where(place <= n - F.ceil(2 * share * n - 1e-9) + 1).withColumn("size", size_class(n))
    low, high = F.ceil(least * n - 1e-9), F.least(n, F.floor((n - place + 1) / share - n + 1e-9))
    large = rows.where(low <= high).withColumn("size", F.explode(F.sequence(size_class(low), size_class(high))))
    columns = ["key", "size", "id", "n", "place"]
    return small.select(*columns), large.select(*columns)


def first_pairs(small: DataFrame, large: DataFrame) -> DataFrame:
    """(a, b): of each key the smaller set with the fewest rare shingles, with all larger ones of other components."""
    hubs = small.groupBy("key", "size").agg(F.min(F.struct("place", "id", "c")).alias("hub"))
    met = large.join(hubs, ["key", "size"]).where((F.col("id") != F.col("hub.id")) & (F.col("c") != F.col("hub.c")))
    return met.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def rest_pairs(small: DataFrame, large: DataFrame, least: float) -> DataFrame:
    """(a, b): sets of different components whose sizes and places leave room for enough common shingles."""
    x, y = small.alias("x"), large.alias("y")
    m, n, share = F.col("x.n"), F.col("y.n"), least / (1 + least)
    order = (m < n) | ((m == n) & (F.col("x.id") < F.col("y.id")))
    room = 1 + F.least(m - F.col("x.place"), n - F.col("y.place")) >= share * (m + n) - 1e-9
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.c") != F.col("y.c")) & order & room & (m >= least * n - 1e-9)
    return x.join(y, on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def similar_links(table: Numbered, least: float = SIMILARITY, size: int = SHINGLE_WORDS, close: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that give the components of the rows of ``table`` (keys, _row), named by their numbers; pairs ``close`` (a, b) are compared first."""
    bands = table.rows.select(F.col(PLACE[1]).alias("id"), F.explode("keys").alias("key"))
    pairs = hub_pairs(bands)
    done = written(pairs if close is None else close.unionByName(pairs).distinct(), "hub-pairs")
    links = written(similar(done, hashed_sets(table, ids_of(done), size), least), "hub-links")
    sets = hashed_sets(table, still_apart(bands, links), size)
    small, large = prefixes(sets, least)
    for name in ("prefix-pairs", "prefix-rest"):
        found = component_of(links)
        left, right = with_component(small, found), with_component(large, found)
        pairs = first_pairs(left, right) if name == "prefix-pairs" else rest_pairs(left, right, least)
        new = written(pairs.join(done, ["a", "b"], "left_anti"), name)
        done = done.unionByName(new)
        links = written(links.unionByName(similar(new, sets, least)), "links")
    return links


def dedup_similar(docs: DataFrame, least: float = SIMILARITY, size: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each component, that of the smallest doc_id; all columns as they are."""
    require_columns(docs, "doc_id", "text")
    table = numbered(with_keys(docs, size))
    with scratch(docs.sparkSession):
        close = print_pairs(table.rows.select(F.col(PLACE[1]).alias("id"), "fp"))
        found = written(components(similar_links(table, least, size, close)), "components")
        ids = table.rows.select(*PLACE, F.col(PLACE[1]).alias("node"), F.col("_row")["doc_id"].alias("doc_id"))
        members = written(found.join(ids, "node"), "members")
        # of several rows with the name-giving doc_id the first stays
        stays = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("m")).select(F.col("m.node").alias("node"))
        gone = members.join(stays, "node", "left_anti").select(*PLACE)
        return table.beside(gone, "_row", how="left_anti").select(*row_columns(docs))
