"""Support reads all of a text, however far down what supports a claim stands."""

import pytest
from pyspark.sql import functions as F

from plumbline.config import DEFAULTS
from plumbline.models import embedded, hashed_embedder
from plumbline.operators import chunking, verify
from plumbline.plans import registry
from tests.conftest import plain

FAR = "filler words\n" * 400 + "the accused must be told of the right to silence"


@pytest.mark.parametrize("text", ["", "x" * 349, "\u00e9\U0001f600\n" * 700, "y" * 5000])
@pytest.mark.parametrize(("width", "step", "reach"), [(450, 350, None), (450, 350, 1800), (500, 500, 500), (900, 200, None), (10, 70, 100)])
def test_windows_are_cut_as_by_slices(spark, text, width, step, reach):
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = chunking.character_windows(docs, width, step, reach).orderBy("window_no").collect()
    end = text[:reach]
    assert [(r["doc_id"], r["window_no"], r["start"], r["window"]) for r in rows] == [(1, i // step, i, end[i : i + width]) for i in range(0, len(end), step)]


def test_reviews_find_support_at_the_end_of_a_text(spark):
    claim = "accused must be told of the right to silence"
    cites = spark.createDataFrame([(1, "Far v. Down", "", claim)], "citation_id long, case_name string, reporter_cite string, holding string")
    held = spark.createDataFrame([(7, "Far v. Down", FAR)], "doc_id long, case_name string, text string")
    row = verify.score_citations(cites, held.select(F.col("case_name").alias("name")), held).first()
    assert (row["support"], row["tier"]) == (1.0, "SUPPORTED") and row["evidence"] == FAR[:200].replace("\n", " ")
    by_vectors = [
        verify.score_citations(cites, held.select(F.col("case_name").alias("name")), held.withColumn("text", F.lit(t)), support=None, embed=lambda c: embedded(c, hashed_embedder)).first()["support"] for t in (FAR, FAR[:3000])
    ]
    assert by_vectors[0] > 3 * by_vectors[1]
    assert DEFAULTS.window_reach is None and DEFAULTS.support_reach is None


def test_support_max_stub_reads_whole_hits(spark, tmp_path):
    spark.createDataFrame([(1, FAR, "en", "s"), (2, "silence", "en", "s"), (3, None, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "accused told silence")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r["item_id"], r["doc_id"]): r["support"] for r in registry.queries()["support_max_stub"](spark, str(tmp_path)).collect()}
    assert found == {(5, 1): 1.0, (5, 2): plain(round(1 / 3, 6))}
