"""Near-duplicate detection: SimHash fingerprints linked through pivot distance tables.

Texts lower-cased in A-Z are cut at ASCII white space; every run of three
words (fewer words: all of them) is hashed by XXH64, and a bit of the 64-bit
fingerprint is set if it is set in more than half of the hashes.  No words
give fingerprint zero.

Links (at most two differing bits) are found between distinct fingerprints:

1.  A pivot table holds the Hamming distance of each fingerprint to many
    reference fingerprints: zero, the 32 masks of two neighbouring bits, and 15
    scattered ones.
2.  Distances to zero and to a mask together tell how many bits of that mask
    are set.  Two fingerprints at most two bits apart agree in all but two of
    these 32 pivot coordinates, so of five groups of coordinates at least three
    agree: the ten choices of three groups are the keys under which
    fingerprints meet.  This loses no link.
3.  Of those that meet, pairs whose distances to any pivot differ by more
    than two are discarded (triangle inequality).
4.  Survivors are verified bit by bit.

A fingerprint has at most 2,080 others within two bits, so links stay linear in
distinct fingerprints; copies meet only as one fingerprint.

Null text counts as empty.  Null doc_ids take part; they name a component only
if it has no other.  Repeated rows are one fingerprint.  Other columns are not
read.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, as_row, bounded_batches, byte_values, hold, numbered, require_columns, row_columns, scratch, text_bytes, written
from .components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
GROUPS = 5
MASKS = [3 << (2 * i) for i in range(32)]
#: Multiples of the odd number nearest to 2^64 divided by the golden ratio.
SCATTERED = [(k * 0x9E3779B97F4A7C15) % 2**64 for k in range(1, 16)]
PIVOTS = [0, *MASKS, *SCATTERED]
CHOICES = list(combinations(range(GROUPS), GROUPS - MAX_BITS))


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: n - 1]]
    stops = ends[len(ends) - n :]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 50_000):
        hashes = np.fromiter((xxh64_intdigest(joined[s : e - 1], 42) for s, e in zip(starts[at : at + 50_000], stops[at : at + 50_000], strict=True)), dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(_row, fp): all columns of ``docs`` as a struct and the fingerprint as a signed long."""
    require_columns(docs, "text")
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        hold("simhash")
        return pa.array(np.fromiter((fingerprint(t) for t in byte_values(texts)), dtype=np.uint64, count=len(texts)).view(np.int64))

    return docs.select(as_row(docs), prints(text_bytes()).alias("fp"))


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def pivot_table(prints: DataFrame) -> DataFrame:
    """(fp, dist, groups): distances to all pivots, and the keys of the groups of pivot coordinates."""
    dist = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p)))).cast("tinyint") for p in PIVOTS])
    table = prints.withColumn("dist", dist)
    set_bits = [((F.col("dist")[0] + 2 - F.col("dist")[1 + i]) / 2).cast("bigint") for i in range(len(MASKS))]
    groups = []
    for g in range(GROUPS):
        key = F.lit(0).cast("bigint")
        for i in range(g, len(MASKS), GROUPS):
            key = key * 3 + set_bits[i]
        groups.append(key)
    return table.withColumn("groups", F.array(*groups))


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints ``fp`` at most two bits apart, each once."""
    table = pivot_table(prints)
    keys = F.array(*[F.struct(F.lit(t).cast("tinyint").alias("t"), F.xxhash64(*[F.col("groups")[g] for g in choice]).alias("key")) for t, choice in enumerate(CHOICES)])
    rows = table.select("fp", "dist", "groups", F.explode(keys).alias("k")).select("fp", "dist", "groups", "k.t", "k.key")
    a, b = rows.alias("a"), rows.alias("b")
    # the first choice of groups that agree is the one that reports the pair
    equal = sum((F.when(F.col("a.groups")[g] == F.col("b.groups")[g], 1 << g).otherwise(0) for g in range(GROUPS)), F.lit(0))
    first = [next((t for t, c in enumerate(CHOICES) if all(e >> g & 1 for g in c)), -1) for e in range(1 << GROUPS)]
    apart = F.array_max(F.zip_with("a.dist", "b.dist", lambda x, y: F.abs(x - y)))
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS
    on = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    mine = F.array(*[F.lit(t) for t in first])[equal] == F.col("a.t")
    return a.join(b, on & (apart <= MAX_BITS) & close & mine).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_components(prints: DataFrame) -> DataFrame:
    """``prints`` (a written table: doc_id, fp, ...) with component_id, the smallest doc_id reachable by links."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprints")
    found = written(components(near_links(nodes.select("fp"))), "components")
    names = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lows = names.groupBy("component").agg(F.min("low").alias("component_id"))
    named = written(names.join(lows, "component").select("fp", "component_id"), "named")
    return prints.join(named, "fp")


def dedup_near(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest doc_id; all columns as they are."""
    require_columns(docs, "doc_id", "text")
    table = numbered(with_fingerprint(docs))
    with scratch(docs.sparkSession):
        prints = written(table.rows.select(*PLACE, "fp", F.col("_row")["doc_id"].alias("doc_id")), "prints")
        grouped = written(near_components(prints).select(*PLACE, "doc_id", "component_id"), "grouped")
        # of several rows with the name-giving doc_id the first stays
        stays = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("_row_no").alias("_row_no")).select("_row_no")
        gone = grouped.select(*PLACE).join(stays, "_row_no", "left_anti")
        return table.beside(gone, "_row", how="left_anti").select(*row_columns(docs))
