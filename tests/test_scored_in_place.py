"""Documents are scored where they lie, against brute force; landed files are one portion."""

import math
import random
from collections import Counter

import pytest

from plumbline.operators import lexical
from plumbline.operators.lexical import LexicalIndex, counted_words
from plumbline.sources.portions import PortionedIndex


def brute(texts, asked, k):
    held = {d: Counter((t or "").lower().split()) for d, t in texts.items()}
    length = {d: sum(c.values()) for d, c in held.items()}
    mean, df = sum(length.values()) / len(held), Counter(w for c in held.values() for w in c)
    out = []
    for q, query in asked.items():
        words = (query or "").lower().split()
        rows = []
        for d, c in held.items():
            known = [w for w in words if w in c]
            if known:
                parts = [math.log((len(held) - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * length[d] / mean)) for w in known]
                rows.append((-round(sum(parts), 6), words.index(known[0]), d))
        out += [(q, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(rows)[:k]) if s]
    return sorted(out)


@pytest.mark.parametrize(("named", "block"), [(False, 2048), (True, 2)])
def test_top_against_brute_force(spark, monkeypatch, named, block):
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", block)
    monkeypatch.setattr(lexical, "SLICE", 7)
    rng = random.Random(5)
    words = [f"W{int(rng.paretovariate(0.8))}" for _ in range(500)]
    name = (lambda i: f"d{i}") if named else (lambda i: i)
    texts = {name(i): " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 60]))) for i in range(120)} | {name(i): "same words here" for i in range(200, 209)} | {name(300): None}
    asked = dict(enumerate([" ".join(rng.choice(words) for _ in range(n)) for n in (1, 3, 20)] + ["here same same", "unknown", "", None]))
    docs = spark.createDataFrame(list(texts.items()), f"doc_id {'string' if named else 'long'}, text string").repartition(3)
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    found = LexicalIndex.build(docs).top(queries, 4).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in found) == [(*x[:3], round(x[3], 5)) for x in brute(texts, asked, 4)]
    # words are counted without a shuffle
    assert "Exchange" not in counted_words(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_files_that_landed_together_are_one_portion(spark, tmp_path):
    index = PortionedIndex(spark, f"file://{tmp_path}/index")
    spark.range(40).selectExpr("id AS doc_id", "concat('w', id % 7) AS text").repartition(4).write.parquet(f"file://{tmp_path}/volumes/0")
    for _ in range(2):
        index.follow(f"file://{tmp_path}/volumes", "doc_id long, text string", f"file://{tmp_path}/checkpoint")
    assert index.log().count() == 1 and index.index().stats.first()["n_docs"] == 40
