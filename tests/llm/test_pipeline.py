"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline
from plumbline.llm import toxicity
from plumbline.llm.common import table, written
from tests.conftest import DATA
from tests.llm.test_operators import brute_exact, brute_hits, check_sequences
from tests.llm.test_shingles import brute_kept

SF = f"{DATA}/sf0.001"


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]

    def run(name, before):
        after = written(stages[name](spark, before, SF), name)
        if name != "packing":
            assert after.columns == columns
        return after

    def texts(df):
        return {r["doc_id"]: r["text"] for r in df.collect()}

    clean = run("toxicity", docs)
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    assert set(texts(clean)) == {i for i, t in texts(docs).items() if model.passes(t.encode())[0] < 0.5}
    assert {i for i, x in labels.items() if not x} <= set(texts(clean))

    before = texts(clean)
    distinct = run("exact_dedup", clean)
    ids = sorted(before)
    assert set(texts(distinct)) == {ids[i] for i, _, _, kept, _ in brute_exact([before[k] for k in ids]) if kept}

    before = texts(distinct)
    ids = sorted(before)
    apart = run("near_dedup", distinct)
    assert set(texts(apart)) == {ids[k] for k in brute_kept([before[i] for i in ids])}

    before = texts(apart)
    ids = sorted(before)
    bench = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    untested = run("decontamination", apart)
    assert set(texts(untested)) == {ids[i] for i, _, n, _ in brute_hits([before[k] for k in ids], bench) if not n}

    packed = run("packing", untested).collect()
    assert {r["doc_id"] for r in packed} == set(texts(untested))
    check_sequences(packed, 4096)
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_empty_table(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
