"""Merkle manifest of a table of documents, in a node store of Parquet levels.

Every row is a leaf: the digest of doc_id, source, lang, n_chars and text, each written as its length in bytes, a
colon and the value, or ``-`` where it is null.  The leaves of a source, ascending by doc_id, are a tree of up to ``FAN``
children a node; the roots of the sources, null first, then by their UTF-8 bytes, are the leaves of one more tree.

Leaves are narrow rows, sorted by (tree, doc_id, digest) into runs in the shared folder.  A leaf's place in its tree is
its number in the run and one sum a run, so a source that holds most rows is spread over as many runs as it fills.
The store has a folder a level; its rows are (tree, run, nodes), the up to 16 neighbours that become one node of the
next level, in the order of their coordinates.  A level is made by one pass over the one below and is written before the next
is begun, so a lost executor costs a re-read; no task ever holds more than a run of 16 nodes and its path.

Proofs go down the levels: each level is merged, in the order of coordinates, with the runs of the level above and
their paths, so a path is carried once for 16 children and never once a leaf.

Null doc_ids come first.  Rows of one source and doc_id follow each other by digest; equal rows are leaves of their own.
A null source is a tree of its own and is not the empty source.  Texts of any length are hashed where they lie and never
shuffled.  Columns besides the five are not read.  An empty table has levels without rows, no root and no proofs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import placed, require_columns, shared_path, tree_of, written

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree whose leaves are the roots of all sources.
TOP = ""


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """The leaf of a row; ``text`` stands in for its text."""
    values = [F.col(c) for c in FIELDS[:-1]] + [F.col("text") if text is None else text]
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _alone() -> Column:
    """Whether a row of a level is all of its tree: what it holds is the root."""
    return (F.col("run") == 0) & (F.size("nodes") == 1)


def _store(leaves: DataFrame, folder: str) -> int:
    """Write the levels of all trees of ``leaves`` (tree, pos, node, ...) below ``folder``; the number of levels."""
    spark = leaves.sparkSession
    leaves = written(leaves, "placed-leaves")
    most = leaves.agg(F.max("pos")).first()[0]
    parts, level, nodes, left = max(1, leaves.rdd.getNumPartitions()), 0, leaves, (most or 0) + 1
    while True:
        runs = nodes.withColumn("run", F.floor(F.col("pos") / FAN)).repartitionByRange(parts, "tree", "run")
        held = F.array_sort(F.collect_list(F.struct("pos", *[c for c in nodes.columns if c not in ("tree", "pos")])))
        runs.groupBy("tree", "run").agg(held.alias("nodes")).sortWithinPartitions("tree", "run").write.parquet(f"{folder}/level={level}")
        level += 1
        if left == 1:
            return level
        left, parts = -(-left // FAN), -(-parts // FAN)
        below = spark.read.parquet(f"{folder}/level={level - 1}").where(~_alone())
        nodes = below.select("tree", F.col("run").alias("pos"), F.sha2(F.array_join("nodes.node", ""), 256).alias("node"))


def _roots(spark: SparkSession, folder: str, levels: int) -> DataFrame:
    """(tree, node): the root of every tree."""
    found = None
    for level in range(levels):
        part = spark.read.parquet(f"{folder}/level={level}").where(_alone()).select("tree", F.col("nodes")[0]["node"].alias("node"))
        found = part if found is None else found.unionByName(part)
    return found


def _step(nodes: Column, pos: Column) -> Column:
    """The neighbours of a place in its run, before and after it."""
    at = F.pmod(pos, F.lit(FAN)).cast("int")
    digests = nodes["node"]
    return F.struct(F.array_join(F.slice(digests, 1, at), "").alias("left"), F.array_join(F.slice(digests, at + 2, FAN), "").alias("right"))


def _paths(spark: SparkSession, folder: str, levels: int, ends: DataFrame) -> DataFrame:
    """Rows of level 0 (tree, run, nodes) with what ``ends`` (tree, path, ...) says of their tree, and the path from their node to the end."""
    facts = [c for c in ends.columns if c not in ("tree", "path")]
    above: DataFrame | None = None
    for level in reversed(range(levels)):
        rows = spark.read.parquet(f"{folder}/level={level}")
        found = rows.where(_alone()).join(ends.hint("merge"), "tree").select("tree", "run", "nodes", *facts, "path")
        if above is not None:
            upper = above.select(F.col("tree"), F.col("run").alias("_up"), F.col("nodes").alias("_nodes"), *facts, F.col("path").alias("_path"), _alone().alias("_end"))
            below = rows.where(~_alone()).withColumn("_up", F.floor(F.col("run") / FAN)).join(upper.hint("merge"), ["tree", "_up"])
            path = F.when(F.col("_end"), F.col("_path")).otherwise(F.concat(F.array(_step(F.col("_nodes"), F.col("run"))), "_path"))
            found = found.unionByName(below.select("tree", "run", "nodes", *facts, path.alias("path")))
        above = found
    return above


def _of_leaves(rows: DataFrame, *facts: str) -> DataFrame:
    """(tree, pos, node, ..., facts, path): a row a leaf of level-0 rows with paths."""
    at = F.when(_alone(), F.col("path")).otherwise(F.concat(F.array(_step(F.col("nodes"), F.col("_leaf.pos"))), "path"))
    leaves = rows.select("*", F.explode("nodes").alias("_leaf"))
    return leaves.select("tree", "_leaf.*", *facts, at.alias("path"))


@dataclass(frozen=True)
class Manifest:
    """The stored levels of the trees of all sources, and of the tree above them."""

    spark: SparkSession
    folder: str
    levels: int
    top_levels: int

    @classmethod
    def build(cls, docs: DataFrame, folder: str | None = None, **carried: Column) -> Manifest:
        """Of ``docs``, into a new ``folder``; ``carried`` columns are kept beside the leaves."""
        require_columns(docs, *FIELDS)
        spark, folder = docs.sparkSession, (folder or shared_path(docs.sparkSession, "manifest")).rstrip("/")
        beside = [c.alias(name) for name, c in carried.items()]
        leaves = written(docs.select(tree_of(F.col("source")).alias("tree"), F.col("doc_id").alias("id"), leaf_digest().alias("node"), *beside), "leaves")
        levels = _store(placed(leaves, "id", "node").drop("size"), f"{folder}/sources")
        subroots = written(_roots(spark, f"{folder}/sources", levels).select(F.lit(TOP).alias("tree"), F.col("tree").alias("id"), "node"), "subroots")
        top_levels = _store(placed(subroots, "id").drop("size"), f"{folder}/top")
        spark.createDataFrame([(levels, top_levels)], "levels int, top_levels int").coalesce(1).write.parquet(f"{folder}/summary")
        return cls(spark, folder, levels, top_levels)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Manifest:
        """A manifest that ``build`` has ended; one that was broken off has no summary and fails."""
        said = spark.read.parquet(f"{folder.rstrip('/')}/summary").first()
        return cls(spark, folder.rstrip("/"), said["levels"], said["top_levels"])

    def root(self) -> DataFrame:
        """(root): a row, or none for an empty table."""
        return _roots(self.spark, f"{self.folder}/top", self.top_levels).select(F.col("node").alias("root"))

    def subroots(self) -> DataFrame:
        """(tree, subroot, root, path): of every source, with the path from its subroot to the root."""
        ends = self.root().select(F.lit(TOP).alias("tree"), "root", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
        leaves = _of_leaves(_paths(self.spark, f"{self.folder}/top", self.top_levels, ends), "root")
        return leaves.select(F.col("id").alias("tree"), F.col("node").alias("subroot"), "root", "path")

    def proofs(self) -> DataFrame:
        """(tree, pos, id, node, carried columns, subroot, root, path) of every leaf.

        ``path`` lists the neighbours (left, right) of the leaf and of each node above it, up to the root; a lone
        leaf is the root of its tree, and has none there.
        """
        ends = written(self.subroots(), "subroot-paths")
        return _of_leaves(_paths(self.spark, f"{self.folder}/sources", self.levels, ends), "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def path_digest(path: Column) -> Column:
    """The digest of all neighbours on a path, level by level, from left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: F.array(s["left"], s["right"]))), ""), 256)


#: DuckDB: crc32 of a column's text, with the table of single bytes beside it as ``bytes_of.t``.
SQL_CRC_TABLE = "bytes_of AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"


def sql_crc32(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _sql_leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


def _sql_levels(name: str, leaves: str) -> str:
    """Levels (lvl, tree, pos, h, n) of ``leaves`` (tree, pos, h, n), and the steps (lvl, tree, pos, step) of their nodes."""
    return f"""{name} AS (
            SELECT 0 AS lvl, tree, pos, h, n FROM {leaves}
            UNION ALL SELECT lvl + 1, tree, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM {name} WHERE n > 1 GROUP BY lvl, tree, pos // 16),
        {name}_steps AS (
            SELECT a.lvl, a.tree, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') || '|' || coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS step
            FROM {name} a JOIN {name} b ON a.lvl = b.lvl AND a.tree = b.tree AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL)"""


def oracle() -> str:
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
        WITH RECURSIVE {SQL_CRC_TABLE},
        told AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, {_sql_leaf("text")} AS h,
                 CASE WHEN {sql_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {_sql_leaf(lowered)} ELSE {_sql_leaf("text")} END AS held FROM documents, bytes_of),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM told),
        {_sql_levels("low", "leaves")},
        subs AS (SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, h, count(*) OVER () AS n, tree AS source_tree FROM low WHERE n = 1 AND pos = 0),
        {_sql_levels("high", "subs")},
        paths AS (
            SELECT x.tree, x.pos, list(s.step ORDER BY s.ord) AS steps FROM (SELECT tree, pos, n FROM leaves) x JOIN (
                SELECT lvl AS ord, tree, pos, step FROM low_steps
                UNION ALL SELECT 1000 + lvl, source_tree, b.pos, step FROM subs b JOIN high_steps h ON b.pos // (16 ** h.lvl)::BIGINT = h.pos) s
            ON x.tree = s.tree AND (s.ord >= 1000 OR x.pos // (16 ** s.ord)::BIGINT = s.pos) GROUP BY ALL)
        SELECT l.doc_id, l.h AS leaf, b.h AS subroot, r.h AS root, sha256(replace(array_to_string(coalesce(steps, []), ''), '|', '')) AS proof_sha256,
               list_reduce(list_prepend(l.held, coalesce(steps, [])), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root, folded_root = r.h AS verified
        FROM leaves l JOIN subs b ON b.source_tree = l.tree LEFT JOIN paths p ON p.tree = l.tree AND p.pos = l.pos, (SELECT h FROM high WHERE n = 1 AND pos = 0) r"""
