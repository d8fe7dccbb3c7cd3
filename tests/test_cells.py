"""Cells give the neighbours of a full comparison; a few probes give most of them."""

import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import cells, dense
from plumbline.plans.shared import vector_cells, vector_queries, vectors
from tests.conftest import DATA


def brute(queries, rows, k, exclude_self=False):
    unit = lambda v: v / max(np.linalg.norm(v), 1e-300)
    out = []
    for q, x in queries:
        found = sorted((round(1.0 - float(unit(np.array(x, float)) @ unit(np.array(y, float))), 6) + 0.0, v) for v, y in rows if not (exclude_self and v == q))
        out += [(q, i + 1, v, d) for i, (d, v) in enumerate(found[:k])]
    return sorted(out)


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.15 * rng.normal(size=8)).tolist()) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(300)] + [(1000, [0.0] * 8), (1001, [0.0] * 8)]
    queries = [(i, rows[i][1]) for i in (0, 5, 44, 705, 1000)] + [(5000, rng.normal(size=8).tolist())]
    return rows, queries


@pytest.mark.parametrize(("k", "exclude_self"), [(1, False), (4, True), (400, False)])
def test_equal_to_brute_force(spark, clustered, monkeypatch, k, exclude_self):
    monkeypatch.setattr(cells, "CHUNK_BYTES", 8 * 8 * 16)  # rings of 16 vectors: the repeated one fills many
    rows, queries = clustered
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").unionByName(spark.createDataFrame([(9999, None)], "vec_id long, embedding array<double>")).repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    index = cells.CellIndex.build(frame)
    expected = brute(queries, rows, k, exclude_self)
    assert rows_of(index.nearest(asked, k, exclude_self)) == expected
    assert rows_of(dense.nearest(asked, frame, k, exclude_self)) == expected
    assert max(r["n"] for r in index.rings.select(F.size("ids").alias("n")).collect()) <= 16


def test_within_a_value(spark, clustered):
    rows, queries = clustered
    label = lambda i: None if i % 50 == 49 else "hot" if i % 3 else str(i % 7)
    frame = spark.createDataFrame([(i, v, label(i)) for i, v in rows], "vec_id long, embedding array<double>, kind string")
    asked = spark.createDataFrame([(i, v, label(i)) for i, v in queries] + [(49, rows[49][1], None), (6001, rows[0][1], "other")], "query_id long, embedding array<double>, kind string")
    expected = sorted(r for q, v in queries for r in brute([(q, v)], [(i, x) for i, x in rows if label(i) == label(q)], 5, True))
    assert rows_of(dense.nearest(asked, frame, 5, True, within="kind")) == expected


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    few = cells.CellIndex.build(spark.createDataFrame([(7, [0.0, 2.0]), (8, [3.0, 0.0])], schema))
    assert rows_of(few.nearest(asked)) == [(1, 1, 8, 0.0), (1, 2, 7, 1.0)]
    assert cells.CellIndex.build(spark.createDataFrame([], schema)).nearest(asked).collect() == []
    assert few.nearest(asked.limit(0)).collect() == []


def test_rings_are_ruled_out(spark, clustered, monkeypatch):
    """Where vectors lie in groups, most rings are never read, and a few probes find the neighbours."""
    monkeypatch.setattr(cells, "CHUNK_BYTES", 8 * 8 * 16)
    rows, queries = clustered
    index = cells.CellIndex.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    asked = spark.createDataFrame([q for q in queries if q[0] not in (1000, 5000)], "query_id long, embedding array<double>")
    work = index.work(asked).agg(F.sum("read").alias("read"), F.sum("rings").alias("rings")).first()
    exact = set(rows_of(index.nearest(asked)))
    some = set(rows_of(index.nearest(asked, probes=2, exact=False)))
    print(f"rings read {work['read']} of {work['rings']}; recall of 2 probes {len(exact & some) / len(exact):.3f}")
    assert work["read"] < 0.5 * work["rings"] and len(exact & some) >= 0.9 * len(exact)


def test_recall_on_vectors_without_groups(spark):
    """The vectors of the test data lie in no groups: neighbours are 0.6 away, so nearly all rings are read, and recall takes many probes."""
    sf = f"{DATA}/sf0.1"
    index, asked = vector_cells(spark, sf), vector_queries(spark, sf)
    work = index.work(asked).agg(F.sum("read").alias("read"), F.sum("rings").alias("rings")).first()
    exact = set(rows_of(dense.nearest(asked, vectors(spark, sf))))
    some = {r[::2] for r in rows_of(index.nearest(asked, probes=30, exact=False))}
    recall = len({r[::2] for r in exact} & some) / len(exact)
    print(f"rings read {work['read']} of {work['rings']}; recall of 30 probes {recall:.3f}")
    assert set(rows_of(index.nearest(asked))) == exact and recall >= 0.9


def test_memory_of_a_task():
    """A block of queries against 10,000 vectors of 64 numbers, as a task does it: below 200 MB."""
    rng = np.random.default_rng(1)
    asked = rng.normal(size=(dense.BLOCK_QUERIES, 64))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    kept = dense.Nearest(len(asked), 4)
    for at in range(0, 10_000, dense.SLICE):
        kept.add(np.round(1.0 - asked @ rng.normal(size=(dense.SLICE, 64)).T, 6), np.arange(at, at + dense.SLICE))
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 200
