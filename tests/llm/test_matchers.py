"""The tables of the decontamination matcher: their size, long items and windows over the seams of segments."""

import random
import tracemalloc

from plumbline.llm import decontaminate
from tests.llm.test_operators import brute_hits, docs_of, rows


def bench_of(n_bytes, seed=3):
    rng = random.Random(seed)
    out, size = [], 0
    while size < n_bytes:
        text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(400))
        out.append((str(len(out)), text.encode()))
        size += len(text)
    return out


def test_tables_stay_within_their_bytes():
    """A benchmark of 32 MB makes blocks of at most TABLE_BYTES; the tables of 4 MB are measured."""
    items = bench_of(4 << 20)
    segments = [s for item, text in items for s in decontaminate.segments_of(item, text, 10)]
    said = sum(s[3] for s in segments)
    tracemalloc.start()
    matchers = decontaminate.build_matchers([s[:3] for s in segments])
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    size = sum(m.size() for m in matchers)
    print(said, size, held, peak)
    assert size <= said and held <= 1.1 * said + (4 << 20)
    # the peak of a full block, on the driver, in proportion
    assert peak * decontaminate.TABLE_BYTES / said < 300 << 20


def test_an_item_longer_than_a_segment(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", 50)
    rng = random.Random(9)
    words = [f"w{rng.randrange(40)}" for _ in range(2000)]
    items = [(1, " ".join(words)), (2, "short one"), (1, "another row of the same item with its own ten words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join(words[a : a + 30]) for a in range(0, 1900, 60)] + [" ".join(words[a : a + 9]) for a in range(0, 50)] + ["a short one", None, ""]
    for table_bytes in (1 << 30, 20_000):
        got = decontaminate.mark_contamination(docs_of(spark, texts), bench, table_bytes=table_bytes)
        assert rows(got.select("doc_id", "n_words", decontaminate.hit_words(), "hit_items")) == sorted(brute_hits(texts, items), key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # texts and what was found meet without a shuffle
