"""Exact groups over several inputs, with a state of the caller's."""

import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, exact
from tests.llm.test_operators import TEXTS, brute_exact, docs_of, rows

FIRST = [*TEXTS, *[f"text {i % 7}" for i in range(40)]]
SECOND = ["text  3", "text 9", None, "One two  three", *[f"other {i}" for i in range(200)], "text 9"]
COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize("digits", [64, 2])
def test_later_input_is_held_against_earlier(spark, digits):
    folder = common.shared_path(spark, "caller")
    one = exact.exact_groups(docs_of(spark, FIRST, extra=True), digits, folder)
    assert rows(one.select(COLUMNS)) == sorted(brute_exact(FIRST), key=repr)
    two = exact.exact_groups(docs_of(spark, SECOND, ids=[1000 + i for i in range(len(SECOND))]), digits, folder)
    every = brute_exact(FIRST + SECOND)
    ids = [*range(len(FIRST)), *(1000 + i for i in range(len(SECOND)))]
    expected = [(ids[i], ids[keep], n, kept, sha) for i, keep, n, kept, sha in every][len(FIRST) :]
    assert rows(two.select(COLUMNS)) == sorted(expected, key=repr)
    # the locator leads to the row: input, block and number there
    inputs = {r["input"]: common.reopened(spark, r["path"], r["buckets"]) for r in spark.read.parquet(f"{folder}/inputs").collect()}
    [row] = two.where("doc_id = 1001").select("locator.*").collect()
    marks = spark.createDataFrame([(row["_block"], row["_row_no"])], "_block int, _row_no long")
    [found] = inputs[row["input"]].beside(marks, "_row", how="left_semi").select("_row.text").collect()
    assert found["text"] == "text 9" and row["input"] == 1


def test_no_exchange_carries_whole_texts(spark):
    """Marked rows are dropped where they lie, however many there are."""
    kept = exact.dedup_exact(docs_of(spark, ["same"] * 50 + [f"t{i}" for i in range(50)], extra=True))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and kept.count() == 51
    table = common.numbered(docs_of(spark, ["a", "b", "c"] * 400))
    for how, expected in (("left_semi", 400), ("left_anti", 800), ("inner", 400), ("left", 1200)):
        marks = table.rows.where("text = 'b'").select(*common.PLACE, *([F.lit(7).alias("x")] if how in ("inner", "left") else []))
        found = table.beside(marks, "text", how=how)
        assert found.count() == expected and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        if how in ("inner", "left"):
            assert {(r["text"], r["x"]) for r in found.collect()} == {("b", 7)} | ({("a", None), ("c", None)} if how == "left" else set())
