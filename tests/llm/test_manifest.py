"""The manifest against a tree built in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import manifest
from plumbline.llm.common import table
from plumbline.llm.queries import QUERIES
from tests.conftest import DATA

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text=False):
    values = [r[c] for c in manifest.FIELDS[:-1]] + [r["text"] if text is False else text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and for each leaf the list of (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, p in enumerate(at):
            run = runs[p // 16]
            paths[k].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        at, nodes = [p // 16 for p in at], [digest("".join(r)) for r in runs]
    return nodes[0], paths


def fold(node, path):
    for left, right in path:
        node = digest(left + node + right)
    return node


def brute(rows):
    """Of every row: (doc_id, leaf, subroot, root, path)."""
    trees = {}
    for r in rows:
        trees.setdefault(r["source"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([k[2] for k, _ in sorted(trees[s], key=lambda x: x[0])]) for s in order}
    root, tops = tree([built[s][0] for s in order])
    return [(r["doc_id"], k[2], built[s][0], root, built[s][1][i] + tops[n]) for n, s in enumerate(order) for i, (k, r) in enumerate(sorted(trees[s], key=lambda x: x[0]))]


def test_registered(spark):
    rows = table(spark, f"{DATA}/sf0.001", "documents").collect()
    texts = {r["doc_id"]: r for r in rows}
    got = {r["doc_id"]: r for r in QUERIES["op11_merkle_manifest"](spark, f"{DATA}/sf0.001").collect()}
    assert len(got) == len(rows)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, own, subroot, root, path in brute(rows):
        r, text = got[i], texts[i]["text"]
        held = leaf(texts[i], text and text.translate(lower)) if zlib.crc32(str(i).encode()) % 5 == 0 else own
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) == (own, subroot, root, digest("".join(a + b for a, b in path)))
        assert r["folded_root"] == fold(held, path) and r["verified"] == (fold(held, path) == root)
    assert {r["verified"] for r in got.values()} == {True, False}


def rows_of(*sizes):
    """Sources of these sizes, the first one null, the second empty."""
    names = [None, "", "ä", "z", "a b"]
    return [(k * 10_000 + i, names[k], None if i % 3 else "en", i, "x" * (i % 7)) for k, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (2, 16, 17), (257, 1, 33), (300, 16, 15, 1, 4097)])
def test_shapes(spark, sizes):
    docs = spark.createDataFrame(rows_of(*sizes), SCHEMA)
    got = manifest.Manifest.build(docs.repartition(5)).proofs()
    found = {(r["id"], r["node"]): (r["subroot"], r["root"], [(s["left"], s["right"]) for s in r["path"]]) for r in got.collect()}
    assert found == {(i, own): (subroot, root, path) for i, own, subroot, root, path in brute(docs.collect())}
    assert not got.where(manifest.folded(F.col("node"), F.col("path")) != F.col("root")).take(1)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, "s", "en", 1, "b")] * 40 + [(1, "s", "en", 1, "a"), (None, "s", None, None, None), (None, None, None, None, ""), (None, None, None, None, "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("tree", "run", "pos", "node", "leaf", "_seq")}).repartition(7)
    got = manifest.Manifest.build(docs).proofs().collect()
    expected = sorted(((i is None, i, own, subroot, root, tuple(path)) for i, own, subroot, root, path in brute([dict(zip(SCHEMA.replace(" long", "").replace(" string", "").split(", "), r, strict=True)) for r in rows])), key=str)
    assert sorted(((r["id"] is None, r["id"], r["node"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["path"])) for r in got), key=str) == expected


def test_empty_table(spark):
    built = manifest.Manifest.build(spark.createDataFrame([], SCHEMA))
    assert built.proofs().collect() == [] and built.root().collect() == []


def test_stored_manifest_is_loaded_and_unfinished_one_is_not(spark, tmp_path):
    folder = f"file://{tmp_path}/m"
    docs = spark.createDataFrame(rows_of(40, 3), SCHEMA)
    built = manifest.Manifest.build(docs, folder)
    assert manifest.Manifest.load(spark, folder).root().collect() == built.root().collect()
    with pytest.raises(Exception, match="summary"):
        manifest.Manifest.load(spark, f"file://{tmp_path}/other")


def test_a_source_of_all_rows_is_spread(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    built = manifest.Manifest.build(docs.repartition(16))
    leaves = spark.read.parquet(f"{built.folder}/sources/level=0")
    sizes = [r["count"] for r in leaves.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 3 and max(sizes) < sum(sizes) / 2
    assert built.levels == 5 and all(0 < r["n"] <= 16 for r in leaves.select(F.size("nodes").alias("n")).distinct().collect())
