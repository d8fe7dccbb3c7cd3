"""The registered queries without SQL, by their names and over whole tables, against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import quality, toxicity
from plumbline.llm.common import table
from plumbline.llm.queries import QUERIES, tokenizer_path
from tests.conftest import DATA
from tests.llm.test_operators import brute_components, brute_print, check_sequences, lower

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def test_op1(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = QUERIES["op1_pack"](spark, SF).collect()
    expected = []
    for i, text in docs.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        expected += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], dtype="<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    check_sequences(got, 4096)


def test_op5(spark, docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash"](spark, SF).collect()}
    prints = {i: brute_print(t) for i, t in docs.items()}
    ids = sorted(docs)
    low = brute_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert got == {i: (f"{prints[i]:016x}", low[i]) for i in ids}


def test_op8(spark, docs):
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    got = {r["doc_id"]: r for r in QUERIES["op8_toxicity"](spark, SF).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        words = [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))]
        found = Counter(f for w in words for f in toxicity.features_of(w.encode()) if f in model.index)
        s = sum(model.weights[model.index[f]] * math.sqrt(100 * n / (len(words) + 30)) for f, n in found.items())
        p = [1 / (1 + math.exp(min(max(t - s, -60), 60))) for t in model.thresholds]
        assert got[i]["severity"] == pytest.approx(sum(p), abs=1e-5) and got[i]["toxic"] == (p[0] >= 0.5)


def test_op9(spark, docs):
    import zstandard

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels").where(~quality.fold(4, 2)))
    got = {r["doc_id"]: r for r in QUERIES["op9_quality"](spark, SF).collect()}
    assert set(got) == set(docs)
    coders = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    for i, text in docs.items():
        data = text.encode()
        blocks = [data[a : a + quality.BLOCK_BYTES] for a in range(0, len(data), quality.BLOCK_BYTES)]
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in coders)
        d = (bad - good) / len(data) if data else 0.0
        score = 1 / (1 + math.exp(-min(max(model.slope * d + model.offset, -60), 60)))
        assert got[i]["held_out"] == held(i) and got[i]["score"] == pytest.approx(score, abs=1e-9) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)


def test_op10(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op10_language_model"](spark, SF).collect()}
    tokens = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", lower(t)) if w] + [None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = got[i]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(counts[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
