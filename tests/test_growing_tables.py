"""Indexes that grow by portions and vectors that are replaced by buckets, also after a run that was stopped."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators.lexical import LexicalIndex
from plumbline.sources import vector_store
from plumbline.sources.portions import PortionedIndex
from plumbline.sources.vector_store import VectorStore

DOCS = "doc_id long, text string"


def everything(index):
    terms = sorted(tuple(r) for r in index.terms.select("term", "df", F.round("idf", 9)).collect())
    stats = index.stats.select("n_docs", F.round("avgdl", 9)).first()
    return terms, tuple(stats), sorted(tuple(r) for r in index.postings.select("term", "doc_id", "tf").collect())


def docs_of(spark, low, high):
    return spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(i % 9)) or None) for i in range(low, high)], DOCS)


def test_portions_add_up(spark, tmp_path):
    index = PortionedIndex(spark, f"file://{tmp_path}/index")
    assert index.index().stats.first()["n_docs"] == 0
    parts = [(0, 40), (40, 41), (41, 41), (41, 90)]
    for k, (a, b) in enumerate(parts):
        assert index.add(f"v{k}", docs_of(spark, a, b), digest=f"{a}-{b}")
    whole = everything(LexicalIndex.build(docs_of(spark, 0, 90)))
    assert everything(index.index()) == whole
    # the same portion again is nothing to do
    assert not index.add("v0", docs_of(spark, 0, 40), digest="0-40")
    assert index.log().count() == 4
    # gathered into one, and changed content in place of what was there
    assert index.compact("first") and not index.compact("first")
    assert everything(index.index()) == whole and index.current().count() == 1
    assert index.add("late", docs_of(spark, 90, 95), digest="a") and index.add("late", docs_of(spark, 90, 99), digest="b")
    assert everything(index.index()) == everything(LexicalIndex.build(docs_of(spark, 0, 99)))


def test_a_portion_that_was_broken_off_is_not_read(spark, tmp_path, monkeypatch):
    from plumbline.sources import portions

    index = PortionedIndex(spark, f"file://{tmp_path}/index")
    index.add("a", docs_of(spark, 0, 20), digest="a")
    before = everything(index.index())
    monkeypatch.setattr(portions, "published", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError, match="stopped"):
        index.add("b", docs_of(spark, 20, 30), digest="b")
    assert everything(index.index()) == before
    monkeypatch.undo()
    assert index.add("b", docs_of(spark, 20, 30), digest="b")
    assert everything(index.index()) == everything(LexicalIndex.build(docs_of(spark, 0, 30)))


def test_files_are_followed(spark, tmp_path):
    index = PortionedIndex(spark, f"file://{tmp_path}/index")
    for k in range(3):
        docs_of(spark, 10 * k, 10 * k + 10).coalesce(1).write.parquet(f"file://{tmp_path}/volumes/{k}")
        index.follow(f"file://{tmp_path}/volumes", DOCS, f"file://{tmp_path}/checkpoint")
    index.follow(f"file://{tmp_path}/volumes", DOCS, f"file://{tmp_path}/checkpoint")
    assert index.log().count() == 3
    assert everything(index.index()) == everything(LexicalIndex.build(docs_of(spark, 0, 30)))


VECTORS = "doc_id long, embedding array<double>"


def vectors_of(spark, ids, factor):
    return spark.createDataFrame([(i, [float(i * factor), 1.0]) for i in ids], VECTORS)


def held(store, version=None):
    return {r["doc_id"]: r["embedding"][0] for r in store.read(version).collect()}


def test_a_stopped_upsert_goes_on(spark, tmp_path, monkeypatch):
    store = VectorStore.create(spark, f"file://{tmp_path}/store", VECTORS, buckets=8)
    assert held(store) == {}
    assert store.upsert(vectors_of(spark, range(100), 1), "first", group=3)
    before, manifest = held(store), store.manifest()
    assert before == {i: float(i) for i in range(100)}
    new, rewrite, calls = vectors_of(spark, range(90, 110), 2), VectorStore._rewrite, []

    def stopping(self, work, name, part, paths):
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return rewrite(self, work, name, part, paths)

    monkeypatch.setattr(vector_store.VectorStore, "_rewrite", stopping)
    with pytest.raises(RuntimeError, match="stopped"):
        store.upsert(new, "second", group=3)
    assert held(store) == before and store.versions() == ["00000000-first"]
    assert VectorStore.open(spark, store.folder).upsert(new, "second", group=3)
    # the group that was done was not done again
    assert calls.count(calls[0]) == 1 and calls.count(calls[1]) == 2
    assert held(store) == before | {i: 2.0 * i for i in range(90, 110)} and held(store, "00000000-first") == before
    assert not store.upsert(new, "second")
    # one key touches one bucket
    assert store.upsert(vectors_of(spark, [5], 7), "third")
    changed = [b for b, path in store.manifest().items() if "third" in path]
    assert len(changed) == 1 and len(store.manifest()) == 8 == len(manifest)
    store.vacuum()
    assert held(store)[5] == 35.0 and len(held(store)) == 110


def test_repeated_keys_nulls_and_nothing(spark, tmp_path):
    store = VectorStore.create(spark, f"file://{tmp_path}/store", VECTORS, buckets=4)
    rows = spark.createDataFrame([(1, [1.0]), (1, [3.0]), (1, [2.0]), (None, [9.0]), (2, None)], VECTORS)
    assert store.upsert(rows, "a") and store.upsert(rows.limit(0), "empty")
    assert {r["doc_id"]: r["embedding"] for r in store.read().collect()} == {1: [3.0], 2: None}
