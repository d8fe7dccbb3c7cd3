"""Tables of the test data and the parts they play."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import BlockedIndex
from ..operators.cells import CellIndex
from ..operators.lexical import LexicalIndex
from ..storage import once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark texts as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def stored_index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """The index of the documents, written by the first query that asks for it and read from there by the others."""
    return LexicalIndex.load(spark, once(table(spark, sf_dir, "documents"), "index", lambda folder: LexicalIndex.create(documents(spark, sf_dir), folder)))


def blocked_index(spark: SparkSession, sf_dir: str) -> BlockedIndex:
    index = stored_index(spark, sf_dir)
    return BlockedIndex.load(spark, once(table(spark, sf_dir, "documents"), "blocked", lambda folder: BlockedIndex.create(index, folder)))


def lexical_top(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    return stored_index(spark, sf_dir).top(questions(spark, sf_dir), k)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def vector_cells(spark: SparkSession, sf_dir: str) -> CellIndex:
    return CellIndex.load(spark, once(table(spark, sf_dir, "embeddings"), "cells", lambda folder: CellIndex.build(vectors(spark, sf_dir)).save(folder)))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 100, held against all vectors."""
    return vectors(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


#: SQL: documents as words, terms and postings, and the BM25 hits of all benchmark texts.
TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '\s+'), lambda x: x <> '')"
BM25_SQL = f"""
    toks AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents),
    lens AS (SELECT doc_id, len(w) AS dl FROM toks),
    post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM toks) GROUP BY ALL),
    stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
    terms AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    idfs AS (SELECT term, df, ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) AS idf FROM terms, stats),
    qpos AS (SELECT item_id AS query_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT item_id, {TOKENS.format('text')} AS w FROM benchmark)),
    qt AS (SELECT query_id, term, count(*) AS qtf, min(pos) AS pos FROM qpos GROUP BY ALL),
    sc AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score, min(pos) AS first
           FROM qt JOIN idfs USING (term) JOIN post USING (term) JOIN lens USING (doc_id), stats GROUP BY ALL),
    lex AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank, doc_id, score FROM sc)"""
#: SQL: a JSON of cosine distances between the stated query vectors and all vectors.
DENSE_SQL = """
    v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    vq AS (SELECT vec_id AS query_id, e FROM v WHERE vec_id % 100 = 0),
    dist AS (SELECT query_id, vec_id, round(1e0 - list_cosine_similarity(vq.e, v.e), 6) + 0e0 AS distance FROM vq, v),
    den AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM dist)"""
