"""Nearest neighbours from stored cells of vectors, exact or of a few cells only.

Centroids are fitted on at most ``SAMPLE`` vectors, those of the smallest hashes of their ids; every vector is then put into the cell
of the nearest centroid.  A cell's vectors, by their angle to its centroid, are cut into chunks of ``CHUNK_BYTES``: rings of
one least and one largest angle.  So a cell that holds a third of all vectors is many rows, and each is read on its own.

Angles obey the triangle inequality: a vector of a ring [a, b] around a centroid at angle t from a query is at least
max(t - b, a - t) away from it.  A query first looks into the ``PROBES`` cells of the nearest centroids; the k-th
distance found there rules out all rings that begin beyond it, and the rest is read.  So the answer is that of comparing all.  With
``exact=False`` the first look is the answer.

Zero vectors have distance 1 to all and no angle: they are a cell of their own that is always looked into, and a query of zeros
looks into every ring.  Null embeddings are left out; ids are 64-bit integers and unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..storage import written
from .dense import BATCH_BYTES, Nearest, matrix_of, ranked
from .ranks import global_ranks

SAMPLE, MOST_CELLS, ROUNDS = 20_000, 1024, 8
CHUNK_BYTES = 1 << 20
PROBES = 4
#: Queries that meet a ring at a time.
TOGETHER = 256
#: Distances are rounded to six digits.
SLACK = 2e-6
ZERO = -1


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def fit_centroids(sample: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """Unit vectors by spherical k-means; a centroid that nothing is near stays where it began."""
    rng = np.random.default_rng(seed)
    centroids = sample[np.sort(rng.choice(len(sample), min(cells, len(sample)), replace=False))].copy()
    for _ in range(ROUNDS):
        nearest = np.concatenate([np.argmax(sample[i : i + 2048] @ centroids.T, axis=1) for i in range(0, len(sample), 2048)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(lengths > 1e-9, sums / np.maximum(lengths, 1e-300), centroids)
    return centroids


def _settings(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@dataclass(frozen=True)
class CellIndex:
    """rings (cell, ring, low, high, ids, data) and centroids (cell, centroid)."""

    rings: DataFrame
    centroids: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> CellIndex:
        """Of vectors (vec_id, embedding); about the root of their number of cells."""
        spark = vectors.sparkSession
        _settings(spark)
        rows = written(vectors.where("embedding IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), "vectors")
        chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()  # ``sample`` rows
        units = np.concatenate([matrix_of(c) for c in chosen["embedding"].chunks]) if chosen.num_rows else np.zeros((0, 1))
        units = units[np.linalg.norm(units, axis=1) > 0.5]
        count = cells or min(MOST_CELLS, max(1, round(rows.count() ** 0.5)))
        centroids = fit_centroids(units, count) if len(units) else np.zeros((0, units.shape[1]))
        shared = spark.sparkContext.broadcast(centroids)
        wide = max(1, units.shape[1])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    unit = matrix_of(part.column(1))
                    cell, angle = np.full(len(unit), ZERO), np.zeros(len(unit))
                    real = np.linalg.norm(unit, axis=1) > 0.5
                    if real.any():
                        cosine = unit[real] @ shared.value.T
                        cell[real] = np.argmax(cosine, axis=1)
                        angle[real] = np.arccos(np.clip(cosine.max(axis=1), -1.0, 1.0))
                    data = [row.tobytes() for row in unit]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cell, pa.int32()), pa.array(angle), pa.array(data, pa.binary())], names=["vec_id", "cell", "angle", "data"])

        placed = written(rows.mapInArrow(assign, "vec_id long, cell int, angle double, data binary"), "placed")
        size = max(1, CHUNK_BYTES // (8 * wide))
        ranks = global_ranks(placed.select("cell", "angle", "vec_id"), "cell", "angle", "vec_id")
        firsts = ranks.groupBy("cell").agg(F.min("rank").alias("_first"))  # a row a cell
        rung = ranks.join(F.broadcast(firsts), "cell").select("vec_id", F.floor((F.col("rank") - F.col("_first")) / size).cast("int").alias("ring"))
        member = F.sort_array(F.collect_list(F.struct("vec_id", "data")))
        rings = placed.join(rung, "vec_id").groupBy("cell", "ring").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), member.alias("m"))
        kept = written(rings.select("cell", "ring", "low", "high", F.col("m.vec_id").alias("ids"), F.col("m.data").alias("data")), "rings")
        table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        return cls(kept, table)

    def save(self, folder: str, mode: str = "overwrite") -> None:
        self.centroids.coalesce(1).write.mode(mode).parquet(f"{folder}/centroids")
        self.rings.repartitionByRange("cell", "ring").sortWithinPartitions("cell", "ring").write.mode(mode).parquet(f"{folder}/rings")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> CellIndex:
        return cls(spark.read.parquet(f"{folder}/rings"), spark.read.parquet(f"{folder}/centroids"))

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, number, data): unit vectors of the queries, numbered."""

        def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in matrix_of(batch.column(1))], pa.binary())], names=["query_id", "data"])

        rows = queries.where("embedding IS NOT NULL").select(F.col("query_id").cast("bigint").alias("query_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
        return written(global_ranks(rows.mapInArrow(units, "query_id long, data binary"), "query_id", name="number"), "asked")

    def _near_cells(self, asked: DataFrame, floors: DataFrame | None, probes: int) -> DataFrame:
        """(query_id, cell, angle, floor) of the cells of the nearest centroids; with ``floors`` (query_id, floor) of all cells that may hold something as near.

        The angle is null where it says nothing.
        """
        spark = asked.sparkSession
        centres = self.centroids.orderBy("cell").toArrow()  # MOST_CELLS rows
        reach = {r["cell"]: (r["low"], r["high"]) for r in self.rings.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}  # a row a cell
        cells = np.array(sorted(c for c in reach if c != ZERO), dtype=np.int32)
        held = np.array([reach[c] for c in cells.tolist()]).reshape(-1, 2)
        matrix = (np.concatenate([matrix_of(c) for c in centres["centroid"].chunks]) if centres.num_rows else np.zeros((0, 1)))[cells]
        shared, zeros, first = spark.sparkContext.broadcast((cells, matrix, held)), ZERO in reach, floors is None
        rows = asked.select("query_id", "data")
        rows = rows.withColumn("floor", F.lit(None).cast("double")) if floors is None else rows.join(floors, "query_id", "left")

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, centroids, (low, high) = shared.value[0], shared.value[1], shared.value[2].T
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    part = batch.slice(at, TOGETHER)
                    unit = np.array([np.frombuffer(x) for x in part.column(1).to_pylist()])
                    known = np.linalg.norm(unit, axis=1) > 0.5
                    floor = np.array([np.inf if f is None else f for f in part.column(2).to_pylist()])
                    angle = angles(unit, centroids) if len(own) else np.zeros((len(unit), 0))
                    if first:
                        wanted = np.zeros(angle.shape, dtype=bool)
                        np.put_along_axis(wanted, np.argsort(angle, axis=1, kind="stable")[:, :probes], True, axis=1)
                    else:
                        nearest = np.clip(np.maximum(angle - high, low - angle), 0.0, None)
                        wanted = (1.0 - np.cos(nearest) <= floor[:, None] + SLACK) | ~known[:, None]
                    row, cell = np.nonzero(wanted)
                    ids, told = part.column(0).to_numpy(), np.where(known[row], angle[row, cell], np.nan)
                    out_ids, out_cells, out_angles, out_floors = ids[row], own[cell], told, floor[row]
                    if zeros:
                        n = len(ids)
                        out_ids, out_cells = np.concatenate([out_ids, ids]), np.concatenate([out_cells, np.full(n, ZERO, dtype=np.int32)])
                        out_angles, out_floors = np.concatenate([out_angles, np.full(n, np.nan)]), np.concatenate([out_floors, floor])
                    yield pa.RecordBatch.from_arrays([pa.array(out_ids), pa.array(out_cells.astype(np.int32)), pa.array(out_angles, from_pandas=True), pa.array(out_floors)], names=["query_id", "cell", "angle", "floor"])

        return rows.mapInArrow(look, "query_id long, cell int, angle double, floor double")

    def _pairs(self, near: DataFrame) -> DataFrame:
        """(query_id, cell, ring) of the rings that may hold something as near as the floor."""
        bounds = self.rings.select("cell", "ring", "low", "high")
        nearest = F.greatest(F.lit(0.0), F.col("angle") - F.col("high"), F.col("low") - F.col("angle"))
        keep = F.col("angle").isNull() | (F.lit(1.0) - F.cos(nearest) <= F.col("floor") + SLACK)
        return near.join(bounds, "cell").where(keep).select("query_id", "cell", "ring")

    def _found(self, asked: DataFrame, pairs: DataFrame, k: int, exclude_self: bool, digits: int) -> DataFrame:
        """(query_id, vec_id, distance): the k nearest of each query in each ring it looks into."""
        together = pairs.join(asked, "query_id").groupBy("cell", "ring", F.floor(F.col("number") / TOGETHER).alias("together")).agg(F.collect_list(F.struct("query_id", F.col("data").alias("unit"))).alias("q"))
        rows = together.select("cell", "ring", F.col("q.query_id").alias("queries"), F.col("q.unit").alias("units")).join(self.rings.select("cell", "ring", "ids", "data"), ["cell", "ring"])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    queries, units, ids, data = (batch.column(c)[i].values for c in range(4))
                    unit = lambda column: np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1)
                    names, own = queries.to_numpy(), ids.to_numpy()
                    distance = np.round(1.0 - unit(units) @ unit(data).T, digits)
                    if exclude_self:
                        distance[names[:, None] == own[None, :]] = np.inf
                    kept = Nearest(len(names), k)
                    kept.add(distance, own)
                    yield kept.batch(names)

        return rows.select("queries", "units", "ids", "data").mapInArrow(best, "query_id long, vec_id long, distance double")

    def _steps(self, queries: DataFrame, k: int, exclude_self: bool, probes: int, digits: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """The queries, the pairs of the first look, what it found, and the pairs that are left to look into."""
        _settings(self.rings.sparkSession)
        asked = self._asked(queries)
        first = written(self._pairs(self._near_cells(asked, None, probes).withColumn("floor", F.lit(float("inf")))), "first-pairs")
        found = written(self._found(asked, first, k, exclude_self, digits), "first-found")
        order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        floors = found.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query_id", F.col("distance").alias("floor"))
        left = self._pairs(self._near_cells(asked, floors, probes)).join(first, ["query_id", "cell", "ring"], "left_anti")
        return asked, first, found, left

    def nearest(self, queries: DataFrame, k: int = DEFAULTS.dense_k, exclude_self: bool = False, probes: int = PROBES, exact: bool = True, digits: int = 6) -> DataFrame:
        """(query_id, rank, vec_id, distance), as ``dense.nearest`` gives it; not ``exact``: of ``probes`` cells only."""
        asked, _, found, left = self._steps(queries, k, exclude_self, probes, digits)
        if exact:
            found = found.unionByName(self._found(asked, written(left, "left-pairs"), k, exclude_self, digits))
        return ranked(found, k)

    def work(self, queries: DataFrame, k: int = DEFAULTS.dense_k, probes: int = PROBES) -> DataFrame:
        """(query_id, rings, read): how many rings there are and how many an exact search reads."""
        _, first, _, left = self._steps(queries, k, False, probes, 6)
        read = first.unionByName(left).groupBy("query_id").agg(F.count("*").alias("read"))
        return read.crossJoin(F.broadcast(self.rings.agg(F.count("*").alias("rings")))).select("query_id", "rings", "read")
