"""The index in blocks gives the rows of the index that scores every posting, and reads less."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.blocks import BlockedIndex
from plumbline.operators.lexical import LexicalIndex
from plumbline.plans.shared import blocked_index, documents, questions, stored_index
from plumbline.storage import once
from tests.conftest import DATA


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize(("k", "docs_per_block"), [(1, 1), (4, 3), (50, 8), (4, 1000)])
def test_equal_rows(spark, k, docs_per_block):
    rng = random.Random(k)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 30, 200]))) for _ in range(150)] + ["same words here"] * 9 + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    asked = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 5, 20, 60)] + ["same words", "here here same", "unknown only", "", None]
    queries = spark.createDataFrame([(i + 10, q) for i, q in enumerate(asked)], "query_id long, query string")
    index = LexicalIndex.build(docs)
    assert rows(BlockedIndex.build(index, docs_per_block).top(queries, k)) == rows(index.top(queries, k))


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert BlockedIndex.build(LexicalIndex.build(docs.limit(0))).top(queries).collect() == []
    assert BlockedIndex.build(LexicalIndex.build(docs)).top(queries.limit(0)).collect() == []


def test_less_is_read(spark):
    """Of the postings of the 200 benchmark texts on the 0.1 table, from the stored index."""
    sf = f"{DATA}/sf0.1"
    read = blocked_index(spark, sf).work(questions(spark, sf)).agg(F.sum("read_postings").alias("read"), F.sum("all_postings").alias("all")).first()
    print(f"read {read['read']} of {read['all']} postings: {read['read'] / read['all']:.3f}")
    assert read["read"] < 0.5 * read["all"]


def test_an_index_is_written_once(spark, tmp_path):
    stored_index(spark, f"{DATA}/sf0.001")
    made = []

    def make(folder):
        made.append(folder)
        spark.range(3).write.parquet(folder)

    path = f"file://{tmp_path}/t"
    spark.range(5).write.parquet(path)
    first = once(spark.read.parquet(path), "thing", make)
    assert once(spark.read.parquet(path), "thing", make) == first and len(made) == 1
    spark.range(6).write.mode("overwrite").parquet(path)
    assert once(spark.read.parquet(path), "thing", make) != first and len(made) == 2


def test_no_postings_meet_all_queries(spark):
    """All joins are on keys."""
    sf = f"{DATA}/sf0.001"
    plan = blocked_index(spark, sf).top(questions(spark, sf))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and documents(spark, sf).count() == 200


def test_words_move_once_into_their_blocks(spark, monkeypatch):
    from plumbline.operators import blocks

    plans = []
    real = blocks.written
    monkeypatch.setattr(blocks, "written", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), real(df, name))[1])
    docs = spark.createDataFrame([(i, f"a b{i} c") for i in range(20)], "doc_id long, text string")
    BlockedIndex.build(LexicalIndex.build(docs))
    above = dict(plans)["blocks"].split("Generate")[0]
    assert above.count("Exchange ") == 1 and "rangepartitioning(term" in above
