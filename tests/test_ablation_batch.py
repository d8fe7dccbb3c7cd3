"""The variants of an ablation are one batch: the rows of reviews apart, with fewer passes over the documents."""

from dataclasses import replace

from plumbline.config import DEFAULTS
from plumbline.engine import Engine, SharedSearch
from plumbline.operators.lexical import LexicalIndex
from plumbline.plans import loop
from plumbline.storage import shared_path

TWO = (("no_defense", False, True, True, 1), ("bare", False, False, False, 1))


def rows(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


def test_variants_together_and_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"case {i} holds that rule {i % 3} applies to matter {i}", f"Case {i}", 0, "") for i in range(12)], "doc_id long, text string, case_name string, year int, reporter_cite string")
    engine = Engine.build(docs, shared_path(spark, "engine"))
    passes = []
    real = LexicalIndex.top
    monkeypatch.setattr(LexicalIndex, "top", lambda self, queries, *more: (passes.append(queries.count()), real(self, queries, *more))[1])

    asked = spark.createDataFrame([(1, "rule 1"), (2, "rule 1"), (3, None), (2**62, "of 7")], "query_id long, query string")
    same = rows(engine.search(asked.fillna("")))
    assert rows(SharedSearch.of(engine).search(asked)) == same and passes == [4, 3]

    passes.clear()
    asked = asked.where("query_id <> 2")
    monkeypatch.setattr(loop, "ABLATIONS", TWO)
    batch = loop.ablations(asked, engine)
    together, passes_together = {n: rows(batch.where(f"variant = '{n}'").drop("variant")) for n, *_ in TWO}, sum(n > 0 for n in passes)
    passes.clear()
    for name, defense, scoring, remember, rounds in TWO:
        s = loop.Session(engine, config=replace(DEFAULTS, max_rounds=rounds), use_defense=defense, use_scoring=scoring, use_memory=remember)
        assert together[name] == rows(loop.review(asked, s))
    assert passes_together < sum(n > 0 for n in passes)
