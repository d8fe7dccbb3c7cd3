"""A stored index holds one copy of what it is made of, and documents do not move to learn their block."""

import pytest

from plumbline.operators import blocks, lexical


def test_nothing_is_written_twice(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7))) for i in range(50)], "doc_id long, text string")
    for module in (blocks, lexical):
        monkeypatch.setattr(module, "written", lambda df, name: pytest.fail(f"{name} is written apart"))
    lexical.LexicalIndex.create(docs, f"file://{tmp_path}/index")
    blocks.BlockedIndex.create(lexical.LexicalIndex.load(spark, f"file://{tmp_path}/index"), f"file://{tmp_path}/blocked")
    monkeypatch.undo()
    stored = blocks.BlockedIndex.load(spark, f"file://{tmp_path}/blocked")
    asked = spark.createDataFrame([(1, "w0 w5")], "query_id long, query string")
    assert stored.top(asked).collect() == lexical.LexicalIndex.build(docs).top(asked).collect()
