"""Held-out toxicity on three folds, the score against the formula, and bounded samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, quality, toxicity
from tests.conftest import DATA


@pytest.mark.parametrize(("modulus", "remainder"), [(4, 2), (4, 1), (2, 0)])
def test_held_out_folds(spark, modulus, remainder):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = quality.fold(modulus, remainder)
    model = toxicity.fit(docs, labels.where(~held))
    gold = labels.where(held).select("doc_id", F.col("toxic").alias("gold"))
    got = toxicity.score_toxicity(docs.join(gold, "doc_id"), model).groupBy("gold").agg(F.avg(F.col("toxic").cast("double")).alias("share")).collect()
    share = {r["gold"]: r["share"] for r in got}
    print(modulus, remainder, share)
    assert share[1] >= 0.9 and share[0] <= 0.01


def test_scores_follow_the_formula(spark):
    model = toxicity.OrdinalModel({b"vile": 0, b"badd*": 1}, np.array([2.0, 1.5]), np.array([1.0, 3.0]))
    texts = ["Vile thing", "baddest of the baddies", None, "", "fine words here", "vile " * 500, "vile", "vile"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score_toxicity(rows, model).collect():
        words = (texts[r["doc_id"]] or "").lower().split()
        rate = lambda n, size=len(words): (100 * n / (size + 30)) ** 0.5
        s = 2.0 * rate(words.count("vile")) + 1.5 * rate(sum(len(w) > 4 and w.startswith("badd") for w in words))
        p = [1 / (1 + np.exp(t - s)) for t in (1.0, 3.0)]
        assert (r["p_toxic"], r["p_severe"], r["severity"]) == pytest.approx((*p, sum(p)))
        assert r["grade"] == sum(x >= 0.5 for x in p) and r["toxic"] == (p[0] >= 0.5)


def test_a_label_of_many_rows_does_not_grow_the_sample(spark):
    docs = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("row "), "id").alias("text")).unionByName(spark.createDataFrame([(8, "clean words"), (8, "clean words"), (9, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1, 1), (7, 1, 1), (8, 0, 0), (9, 0, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for label in ("toxic", "quality"):
        rows = common.labelled_texts(docs, labels, label, 50)
        assert {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()} == {1: 50, 0: 2}
    assert toxicity.score_toxicity(docs, toxicity.fit(docs, labels, 50)).count() == 30_003
    assert quality.score_quality(docs, quality.fit(docs, labels, 50)).count() == 30_003


def test_quality_of_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "good words of a text " * 20), (1, "good words of a text " * 20), (2, "%%% $$$ " * 40), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in (1, 2, 3)], "doc_id long, quality int")
    assert quality.score_quality(docs, quality.fit(docs, labels)).count() == 4
    assert quality.score_quality(docs.where("false"), quality.fit(docs.where("false"), labels)).count() == 0
