"""The pipeline's last stage gives the token ids, from which sequences are built."""

import zlib

from pyspark import SparkContext

import corpus_pipeline
from plumbline.llm import packing
from plumbline.llm.queries import tokenizer_path
from tests.llm.test_operators import TEXTS, docs_of


def test_last_stage_keeps_ids(spark):
    packed = dict(corpus_pipeline.STAGES)["packing"](spark, docs_of(spark, TEXTS), None)
    rows = packed.collect()
    assert rows and all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    lengths = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(packed).collect()}
    assert sum(lengths.values()) == sum(r["length"] for r in rows) and max(lengths.values()) <= 4096


def test_the_plan_starts_no_python_workers(spark, monkeypatch):
    """Rows of the plan come as an Arrow table; as a list they went through Python workers of another kind, which stayed on the executors."""
    made, own = [], SparkContext.parallelize
    monkeypatch.setattr(SparkContext, "parallelize", lambda self, *a, **k: made.append(a) or own(self, *a, **k))
    docs = spark.range(5).selectExpr("id AS doc_id", "repeat('word and another ', int(id)) AS text")
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    assert len(rows) == 5 and not made


def test_encoders_share_one_vocabulary():
    enc = packing.ChunkEncoder(tokenizer_path())
    for text in ("internationalisation", "zebra", "na\u00efvet\u00e9", "\u00e9l\u00e8ve", "stra\u00dfe"):
        assert list(memoryview(enc.encode_all([text.encode()])[0]).cast("I")) == enc.whole.encode(text, add_special_tokens=False).ids
    # a setting of the one shows in the others only where they are the same
    enc.whole.model.dropout = 0.25
    assert enc.latin.model.dropout == enc.ascii.model.dropout == 0.25
