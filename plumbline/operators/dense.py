"""Exact nearest neighbours by cosine distance.

Queries are dealt into blocks; a task multiplies slices of its vectors with a block in numpy and keeps the best k per
query, so a query's candidates are k rows per task and block, whatever the size of the collection, and a task holds a
block of queries, one Arrow batch and one product of ``SLICE`` vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..storage import written

#: Queries that travel with a pass over the collection.
BLOCK_QUERIES = 2048
#: Vectors of a product.
SLICE = 512
#: Of an Arrow batch of vectors.
BATCH_BYTES = 8 << 20


def matrix_of(column: pa.Array) -> np.ndarray:
    """Unit vectors of an Arrow list column of numbers without nulls, a row each; zero vectors stay zero."""
    if not len(column):
        return np.zeros((0, 0))
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


class Nearest:
    """The k nearest so far of each query: distances rise, equal ones by id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.distance = np.full((queries, k), np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, distance: np.ndarray, ids: np.ndarray, queries: np.ndarray | None = None) -> None:
        """Distances of all queries, or of those at some places, to vectors of these ids; infinite ones are left out."""
        furthest = self.distance[:, -1:] if queries is None else self.distance[queries, -1:]
        row, at = np.nonzero((distance <= furthest) & (distance < np.inf))
        if not len(row):
            return
        told, row = distance[row, at], row if queries is None else queries[row]
        touched = np.unique(row)
        q = np.concatenate([row, np.repeat(touched, self.k)])
        d = np.concatenate([told, self.distance[touched].ravel()])
        n = np.concatenate([ids[at], self.ids[touched].ravel()])
        order = np.lexsort((n, d, q))
        starts = np.searchsorted(q[order], touched)
        best = order[starts[:, None] + np.arange(self.k)]
        self.distance[touched], self.ids[touched] = d[best], n[best]

    def batch(self, queries: np.ndarray) -> pa.RecordBatch:
        """(query_id, vec_id, distance) of what was found."""
        row, at = np.nonzero(self.distance < np.inf)
        return pa.RecordBatch.from_arrays([pa.array(queries[row]), pa.array(self.ids[row, at]), pa.array(self.distance[row, at])], names=["query_id", "vec_id", "distance"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, distance) of candidates (query_id, vec_id, distance)."""
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # adding zero turns a rounded -0.0 into 0.0
    return first.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", (F.col("distance") + 0.0).alias("distance"))


def _value(within: str | None):
    return (F.lit("") if within is None else F.col(within).cast("string")).alias("value")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = DEFAULTS.dense_k, exclude_self: bool = False, digits: int = 6, within: str | None = None) -> DataFrame:
    """(query_id, rank, vec_id, distance) for queries (query_id, embedding) over vectors (vec_id, embedding).

    Distances are rounded first, then ordered, then vec_id decides.  Null embeddings are left out.  With ``within``, a column
    of both, only vectors of the query's value are compared, where they lie: vectors of a slice are multiplied with the
    queries of their value, so no value is gathered, and one that most vectors have is as many slices.  A null value has no equals.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    numbered = written(queries.where("embedding IS NOT NULL").select(F.col("query_id").cast("bigint").alias("query_id"), "embedding", _value(within)), "queries")
    blocks = max(1, -(-numbered.count() // BLOCK_QUERIES))
    source = vectors.where("embedding IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", _value(within))
    found: DataFrame | None = None
    for block in range(blocks):
        rows = numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow().combine_chunks()  # about BLOCK_QUERIES rows
        if not rows.num_rows:
            continue
        places: dict[str, list[int]] = {}
        for i, value in enumerate(rows["value"].to_pylist()):
            places.setdefault(value, []).append(i)
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), np.concatenate([matrix_of(c) for c in rows["embedding"].chunks]), {v: np.array(p) for v, p in places.items() if v is not None}))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, asked, places = shared.value
            kept = Nearest(len(ids), k)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    own, unit = batch.column(0).slice(at, SLICE).to_numpy(zero_copy_only=False), matrix_of(batch.column(1).slice(at, SLICE))
                    values = batch.column(2).slice(at, SLICE).dictionary_encode()
                    codes = values.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                    for code, value in enumerate(values.dictionary.to_pylist()):
                        queries, members = places.get(value, ()), np.flatnonzero(codes == code)
                        if len(queries):
                            distance = np.round(1.0 - asked[queries] @ unit[members].T, digits)
                            if exclude_self:
                                distance[ids[queries][:, None] == own[members][None, :]] = np.inf
                            kept.add(distance, own[members], queries)
            yield kept.batch(ids)

        part = source.mapInArrow(best, "query_id long, vec_id long, distance double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank long, vec_id long, distance double")
    return ranked(found, k)


def cache_hits(queries: DataFrame, vectors: DataFrame, distance: float = DEFAULTS.cache_distance, exclude_self: bool = True) -> DataFrame:
    """(query_id, hit, nearest_id): whether the nearest stored query is close enough, strictly."""
    top = nearest(queries, vectors, 1, exclude_self)
    return top.select("query_id", (F.col("distance") < distance).alias("hit"), F.col("vec_id").alias("nearest_id"))
